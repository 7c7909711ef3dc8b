"""Licence recognition by sentence rules.

A text is cut into sentences (at blank lines and after full stops and other sentence marks), each sentence is normalised
(lower case, runs of anything but letters and digits to one space) and known licence sentences are looked up in it. A
line end, semicolon or colon within a sentence may begin or end a licence sentence or lie inside it, so hard-wrapped
notices are found as well as one-line ones. Sentences that name a licence may have words before them, but for a
negation. What is found, in the order of the text, is a sequence of sentence identifiers; a licence rule is an ordered
list of identifiers and matches where they follow each other in the sequence with at most `GAP` other sentences between
two. Longer rules come first, and a sentence that a rule has used is not used again.

Licences are named by their SPDX identifiers. A sentence that names a licence ("named:X", "spdx:X") is a rule of its
own; sentences of a licence's text or notice ("mit-grant") make one only in their order. An SPDX line is read as it is
written: whole identifiers, `AND`, `OR` and `WITH` in capitals between them; an exception stays with its licence.

The title of a licence ("title:X") followed by the words that begin its text ("text-begin") makes the whole text one licence: what is named
from there to the next title, or to the first sentence after the appendix that shows how to apply it, belongs to that
text. A GNU title gives the version's `-only` identifier: a text alone grants no later version.

"All rights reserved" makes a text proprietary; of documents (`scanned`) only those in which no other licence is found.

Defined cases: a null or empty text has no sentences and no licence; repeated rows are each scanned; a text of any
length is scanned whole, in time in proportion to its length; an empty table gives an empty result; ids are passed
through; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import read, small_batches, tidy

GAP = 3
#: Characters that stand for the open words in the middle of a licence sentence, at most: names of holders.
OPEN = 600
#: SPDX identifiers by the name that notices give the licence, as a pattern over normalised text.
NAMES: list[tuple[str, str]] = [
    ("Apache-2.0", r"apache(?: software)?(?: license)?(?: version)?(?: v)? ?2(?: 0)?"),
    ("Apache-1.1", r"apache(?: software)? license(?: version)? 1 1"),
    ("MIT-0", r"mit 0|mit no attribution"),
    ("MIT", r"mit(?: x11)?|expat"),
    ("ISC", r"isc"),
    ("0BSD", r"0bsd|zero clause bsd|bsd zero clause|bsd 0 clause"),
    ("BSD-2-Clause", r"bsd 2 clause(?: simplified)?|(?:simplified |2 clause )bsd|freebsd"),
    ("BSD-3-Clause", r"bsd 3 clause(?: new| revised| new or revised)?|(?:new |modified |revised |3 clause )bsd"),
    ("BSD-4-Clause", r"bsd 4 clause|(?:original |4 clause )bsd"),
    ("BSD", r"bsd(?: style)?"),
    ("MPL-1.1", r"(?:mozilla public license|mpl)(?: version)?(?: v)? ?1 1"),
    ("MPL-2.0", r"(?:mozilla public license|mpl)(?: version)?(?: v)? ?2(?: 0)?"),
    ("EPL-1.0", r"(?:eclipse public license|epl)(?: version)?(?: v)? ?1(?: 0)?"),
    ("EPL-2.0", r"(?:eclipse public license|epl)(?: version)?(?: v)? ?2(?: 0)?"),
    ("EUPL-1.2", r"(?:european union public licen[cs]e|eupl)(?: version)?(?: v)? ?1 2"),
    ("CDDL-1.0", r"(?:common development and distribution license|cddl)(?: version)?(?: v)?(?: ?1(?: 0)?)?"),
    ("BSL-1.0", r"boost software license(?: version)?(?: 1 0)?|bsl 1 0"),
    ("Zlib", r"zlib(?: libpng)?"),
    ("Unlicense", r"unlicense"),
    ("WTFPL", r"wtfpl|do what the fuck you want to public license"),
    ("Artistic-2.0", r"artistic(?: license)?(?: version)? 2 0"),
    ("OFL-1.1", r"(?:sil )?(?:open font license|ofl)(?: version)?(?: 1 1)?"),
    ("MS-PL", r"microsoft public license|ms pl"),
    ("PSF-2.0", r"python software foundation license|psf(?: license)?(?: version)?(?: 2(?: 0)?)?"),
    ("PostgreSQL", r"postgresql"),
    ("CC0-1.0", r"cc0(?: 1 0)?(?: universal)?|creative commons zero(?: v?1 0)?(?: universal)?"),
    ("Artistic-1.0", r"artistic(?: license)?(?: version)? 1 0"),
    ("GFDL-1.1", r"(?:gnu )?(?:free documentation license|fdl|gfdl)(?: version)?(?: v)? 1 1"),
    ("GFDL-1.2", r"(?:gnu )?(?:free documentation license|fdl|gfdl)(?: version)?(?: v)? 1 2"),
    ("GFDL-1.3", r"(?:gnu )?(?:free documentation license|fdl|gfdl)(?: version)?(?: v)? 1 3"),
]
#: Titles of licence texts, as patterns over a heading, and the words that begin or end such a text.
TITLES: list[tuple[str, str]] = [
    ("GPL-1.0-only", r"gnu general public license version 1(?: february 1989)?"),
    ("GPL-2.0-only", r"gnu general public license version 2(?: june 1991)?"),
    ("GPL-3.0-only", r"gnu general public license version 3(?: 29 june 2007)?"),
    ("LGPL-2.0-only", r"gnu library general public license version 2(?: june 1991)?"),
    ("LGPL-2.1-only", r"gnu lesser general public license version 2 1(?: february 1999)?"),
    ("LGPL-3.0-only", r"gnu lesser general public license version 3(?: 29 june 2007)?"),
    ("AGPL-3.0-only", r"gnu affero general public license version 3(?: 19 november 2007)?"),
    ("GFDL-1.1", r"gnu free documentation license version 1 1(?: march 2000)?"),
    ("GFDL-1.2", r"gnu free documentation license version 1 2(?: november 2002)?"),
    ("GFDL-1.3", r"gnu free documentation license version 1 3(?: 3 november 2008)?"),
    ("Apache-2.0", r"apache license version 2 0 january 2004(?: https? www apache org licenses)?"),
    ("MPL-1.1", r"mozilla public license version 1 1"),
    ("MPL-2.0", r"mozilla public license version 2 0"),
    ("EPL-1.0", r"eclipse public license v 1 0"),
    ("EPL-2.0", r"eclipse public license v 2 0"),
    ("Artistic-1.0", r"the artistic license"),
    ("Artistic-2.0", r"(?:the )?artistic license 2 0"),
    ("CC0-1.0", r"(?:creative commons legal code )?cc0 1 0 universal"),
]
TEXT_BEGINS = (
    r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    r"terms and conditions for use reproduction and distribution",
    r"(?:1 )?definitions",
    r"the intent of this document is to state the conditions under which a package may be copied.*",
    r"creative commons corporation is not a law firm and does not provide legal services",
    r"the accompanying program is provided under the terms of this eclipse public license.*",
)
TEXT_ENDS = (
    r"but first please read.*",
    r"use the gnu (?:library|lesser) general public license instead of this license",
    r"that s all there is to it",
    r"see the license for the specific language governing permissions and limitations under the license",
)
#: The GNU licences' names and versions, and the terms and versions of Creative Commons licences.
GNU = {"GPL": r"(?:gnu )?(?:general public license|gpl)", "LGPL": r"(?:gnu )?(?:(?:lesser|library) general public license|lgpl)", "AGPL": r"(?:gnu )?(?:affero general public license|agpl)"}
GNU_VERSIONS = {"GPL": ("1", "2", "3"), "LGPL": ("2", "2 1", "3"), "AGPL": ("3",)}
CC_TERMS = {"BY": "attribution", "BY-SA": "attribution share ?alike", "BY-NC": "attribution non ?commercial", "BY-ND": "attribution no ?deriv(?:ative)?s", "BY-NC-SA": "attribution non ?commercial share ?alike", "BY-NC-ND": "attribution non ?commercial no ?deriv(?:ative)?s"}
CC_VERSIONS = ("2 0", "2 5", "3 0", "4 0")


def _named() -> list[tuple[str, str]]:
    """All licences by their names' patterns, the more special first."""
    out = []
    for family, name in GNU.items():
        for version in GNU_VERSIONS[family]:
            of = f"{family}-{version.replace(' ', '.') if ' ' in version else version + '.0'}"
            number = rf"(?:,? ?version|,? ?v)? ?{version}(?: 0)?" if " " not in version else rf"(?: version| v)? ?{version}"
            # What says "later" may come before the name or after it.
            out.append((f"{of}-or-later", rf"version {version}(?: 0)?(?: of the license)? or (?:at your option )?(?:any )?later(?: version)? of the {name}|{name}{number}(?: of the license)?(?: or (?:at your option )?(?:any )?(?:later|newer|above|greater)(?: versions?)?| plus| or later|\+)"))
            out.append((f"{of}-only", rf"version {version}(?: 0)? of the {name}|{name}{number}(?: only)?(?! (?:0|1) (?:or|only|license))"))
        out.append((family, name))
    for terms, words in CC_TERMS.items():
        for version in CC_VERSIONS:
            short = terms.lower().replace("-", " ")
            out.append((f"CC-{terms}-{version.replace(' ', '.')}", rf"(?:cc|creative commons) (?:{short}|{words})(?: licen[cs]e)?(?: version)? {version}|creative commons {words} {version}(?: international| unported| generic)?"))
    return out + NAMES


_UNDER = r"(?:licen[cs]ed|released|distributed|published|provided|offered|covered|available|shared|governed|redistributable)(?: to you)? (?:under|by)(?: either| both)?(?: of)?(?: the| an?)?(?: terms(?: and conditions)? of)?(?: either| both)?(?: of)?(?: the| an?)? "
_TAIL = r"(?: (?:general |open source |software |public |free )?licen[cs]e)?"
#: Sentences of licence texts and notices by pattern over the normalised sentence.
SENTENCES: list[tuple[str, str]] = [
    ("apache2-named", r"licen[cs]ed under the apache license version 2 0(?: the license)?"),
    ("apache2-obey", r"you may not use this file except in compliance with the license"),
    ("apache2-copy", r"you may obtain a copy of the license at(?: .*)?"),
    ("apache2-as-is", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files.*"),
    ("mit-notice", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("isc-grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-notice", r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-as-is", r"the software is provided as is and the author disclaims all warranties.*"),
    ("as-is", r"(?:the|this) software is provided as is without warranty of any kind.*"),
    ("bsd-grant", r"redistribution and use in source and binary forms with or without modification are permitted provided that.*"),
    ("bsd-source", r"(?:1 )?redistributions of source code must retain the above copyright notice.*"),
    ("bsd-binary", r"(?:2 )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("bsd-advert", r"(?:3 )?all advertising materials mentioning features or use of this software must display.*"),
    ("bsd-endorse", r"(?:[34] )?(?:neither )?the names? of .* may (?:not )?be used to endorse or promote products derived from this software.*"),
    ("bsd-as-is", r"this software is provided by .* as is and any express or implied warranties.*"),
    ("mpl2-subject", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl2-copy", r"if a copy of the mpl was not distributed with this file you can obtain one at.*"),
    ("zlib-as-is", r"this software is provided as is without any express or implied warranty"),
    ("zlib-grant", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely.*"),
    ("boost-grant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.*"),
    ("unlicense-domain", r"this is free and unencumbered software released into the public domain"),
    ("unlicense-anyone", r"anyone is free to copy modify publish use compile sell or distribute this software.*"),
    ("wtfpl-0", r"0 you just do what the fuck you want to"),
    ("epl2-made", r"this program and the accompanying materials are made available under the terms of the eclipse public license v?(?:ersion)? ?2 0.*"),
    ("gpl-modify-GPL", r"(?:this program|this file|it|\w+) is free software you can redistribute it and or modify it under the terms of the gnu general public license.*"),
    ("gpl-modify-LGPL", r"(?:this library|this program|this file|it|\w+) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license.*"),
    ("gpl-modify-AGPL", r"(?:this program|this file|it|\w+) is free software you can redistribute it and or modify it under the terms of the gnu affero general public license.*"),
    ("gpl-later-1", r"either version 1 of the license or at your option any later version"),
    ("gpl-later-2", r"either version 2 of the license or at your option any later version"),
    ("gpl-later-2.1", r"either version 2 1 of the license or at your option any later version"),
    ("gpl-later-3", r"either version 3 of the license or at your option any later version"),
    ("gpl-only-2", r"(?:as published by the free software foundation )?version 2 of the license"),
    ("gpl-only-2.1", r"(?:as published by the free software foundation )?version 2 1 of the license"),
    ("gpl-only-3", r"(?:as published by the free software foundation )?version 3 of the license"),
    ("gpl-hope", r"this (?:program|library|file|software) is distributed in the hope that it will be useful but without any warranty.*"),
    ("public-domain", r"(?:this \w+ is |released |placed |dedicated )(?:in|in to|into|to) the public domain"),
    ("reserved", r"all rights reserved"),
    ("confidential", r"(?:this (?:document|file|software) is )?(?:confidential and proprietary|proprietary and confidential)"),
    *((f"title:{name}", pattern) for name, pattern in TITLES),
    *(("text-begin", pattern) for pattern in TEXT_BEGINS),
    *(("text-end", pattern) for pattern in TEXT_ENDS),
]
#: Words that a pattern of this form may follow within its sentence.
PREFIXED = re.compile(r".*-named|named:.*|spdx:.*|reserved|confidential|public-domain|gpl-(?:modify|later|only).*|isc-notice")


def _gnu_rules() -> list[tuple[str, tuple[str, ...]]]:
    out = []
    for family, versions in GNU_VERSIONS.items():
        for version in versions:
            dotted = version.replace(" ", ".")
            of = f"{family}-{dotted if ' ' in version else version + '.0'}"
            for kind, name in (("later", "or-later"), ("only", "only")):
                out += [(f"{of}-{name}", (f"gpl-modify-{family}", f"gpl-{kind}-{dotted}", "gpl-hope")), (f"{of}-{name}", (f"gpl-modify-{family}", f"gpl-{kind}-{dotted}"))]
        out.append((family, (f"gpl-modify-{family}", "gpl-hope")))
    return out


#: Licence rules as ordered sentence identifiers. A sentence that names a licence is a rule of its own.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("Apache-2.0", ("apache2-named", "apache2-obey", "apache2-copy", "apache2-as-is")),
    ("Apache-2.0", ("apache2-named", "apache2-obey")),
    ("Apache-2.0", ("apache2-named",)),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT-0", ("mit-grant", "as-is")),
    ("ISC", ("isc-grant", "isc-notice", "isc-as-is")),
    ("0BSD", ("isc-grant", "isc-as-is")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse", "bsd-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("BSD", ("bsd-grant", "as-is")),
    ("MPL-2.0", ("mpl2-subject", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-subject",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("BSL-1.0", ("boost-grant",)),
    ("Unlicense", ("unlicense-domain", "unlicense-anyone")),
    ("WTFPL", ("wtfpl-0",)),
    ("EPL-2.0", ("epl2-made",)),
    *_gnu_rules(),
    ("public-domain", ("public-domain",)),
    ("proprietary", ("confidential",)),
    ("proprietary", ("reserved",)),
]
#: Sentences between a title and the words that begin its text, at most.
HEADING = 8
_CUT = re.compile(r"(?<=[!?])\s+|(?<=[a-z)\"]\.)\s+(?=[A-Z\"(])|(?<=[A-Z]{2}\.)\s+(?=[A-Z\"(])|(?<=[0-9]\.)\s+(?=[A-Z])|(?<=\.)[^\S\n]*\n\s*(?![a-z0-9])|\n[^\S\n]*\n\s*")
#: Breaks within a sentence, at which a licence sentence may begin or end.
_BREAK = re.compile(r"\n|(?<=[;:,.])\s+")
_START = r"(?<![0-9a-z])(?<!\bnot[ \n])(?<!\bnever[ \n])(?<!\blonger[ \n])"
_SPACES = re.compile(r"[^0-9a-z+]+|(?<=[^0-9])\+|\+(?=[0-9a-z])")
#: Every licence sentence holds one of these, in lower case.
HINTS = ("licens", "licenc", "permission", "warrant", "rights", "copyright", "redistribut", "public domain", "proprietary", "what the fuck", "free software", "as published by", "disclaim", "unencumbered", "anyone is free", "source code form", "copy of the mpl", "endorse", "advertising materials", "either version", "under the terms", "released under", "distributed under", "available under", "published under", "definitions", "legal code", "cc0", "state the conditions", "that's all there is", "please read", "law firm")
SPDX_LINE = re.compile(r"(?i:SPDX-License-Identifier)\s*:?\s*((?:[^\n]*\b(?:AND|OR|WITH)[^\S\n]*\n[\s#*/]*)*[^\n]*(?:\n[\s#*/]*(?:AND|OR|WITH)\b[^\n]*)*)")
SPDX_WORD = re.compile(r"[A-Za-z0-9.+-]+|[()]")
NAMED = _named()


def hinted(text: str) -> bool:
    low = text.lower()
    return any(hint in low for hint in HINTS)


def normalised(sentence: str) -> str:
    return _SPACES.sub(" ", sentence.lower()).strip()


def _within(name: str, pattern: str, start: str | None = None, end: str = "$") -> re.Pattern:
    """A pattern over a whole normalised sentence as one over parts of it between breaks, each of which is a line end."""
    start = start if start is not None else _START if PREFIXED.fullmatch(name) else "^"
    # Words that a pattern leaves open in its middle may go over lines; at its end they go to the line's end.
    body, rest = (pattern[:-2], ".*") if pattern.endswith(".*") else (pattern, "")
    body = body.replace(" ", "[ \n]").replace("[ \n].*[ \n]", rf"[ \n][^\0]{{1,{OPEN}}}?[ \n]")
    return re.compile(rf"(?m){start}(?:{body}{rest}){end}")


def _literal(pattern: str) -> str:
    """The plain words at the beginning of a pattern, without which it can't match."""
    plain = re.match(r"[0-9a-z ]*", pattern)[0]
    # The last letter may be optional, and a word may go on.
    return plain[:-1].rstrip() if len(plain) < len(pattern) else plain


class Scanner:
    """alone: rights that are reserved count only where no other licence is found."""

    def __init__(self, sentences=None, rules=None, gap: int = GAP, alone: bool = False):
        self.sentences = [(name, _literal(pattern), _within(name, pattern)) for name, pattern in (sentences or SENTENCES)]
        #: Names that may follow "licensed under", each alone; and in lists of them.
        self.named = [] if sentences else [(name, _within("named:", rf"(?:the )?(?:{pattern}){_TAIL}", "", "")) for name, pattern in NAMED]
        self.under = _within("named:", _UNDER, end="")
        self.spdx = re.compile(r"spdx[ \n]license[ \n]identifier")
        self.joint = re.compile(r"[ \n](?:and[ \n]or|or|and)[ \n](?:the[ \n])?(?:terms[ \n]of[ \n])?(?:the[ \n])?")
        #: SPDX identifiers in lower case to the form that is given back.
        self.spdx_ids = {}
        for name in {*(n for n, _ in NAMED), *(n for n, _ in TITLES)}:
            self.spdx_ids[name.lower()] = name
            if name.endswith(("-only", "-or-later")):
                base = name.removesuffix("-only").removesuffix("-or-later")
                self.spdx_ids[base.lower()] = f"{base}-only"
                self.spdx_ids[base.lower() + "+"] = f"{base}-or-later"
        self.rules = sorted(rules or RULES, key=lambda r: -len(r[1]))
        self.gap, self.alone = gap, alone

    def _expression(self, line: str) -> Iterator[str]:
        """The licences of an SPDX expression, each with its exception."""
        words, held = SPDX_WORD.findall(line), None
        for at, word in enumerate(words):
            if word in "()":
                continue
            before = next((w for w in reversed(words[:at]) if w not in "()"), "OR")
            if word in ("AND", "OR", "WITH"):
                continue
            if before == "WITH":
                held = f"{held} WITH {word}" if held else None
            elif before in ("AND", "OR"):
                if held:
                    yield held
                held = self.spdx_ids.get(word.lower())
            else:
                # What follows an identifier without an operator is no part of the expression.
                break
        if held:
            yield held

    def _names(self, clean: str, sentence: str) -> Iterator[tuple[int, int, int, str]]:
        """(start, rank, end, identifier) for the licences that a normalised sentence names."""
        if "spdx" in clean:
            for m, line in zip(self.spdx.finditer(clean), SPDX_LINE.finditer(sentence), strict=False):
                for i, name in enumerate(self._expression(line[1])):
                    yield m.start() + i, -2, m.start() + i, f"spdx:{name}"
        for m in self.under.finditer(clean) if "under" in clean or "by" in clean else ():
            start, at = m.start(), m.end()
            while True:
                best = max(((k.end(), -rank, name) for rank, (name, p) in enumerate(self.named) if (k := p.match(clean, at)) and not clean[k.end() : k.end() + 1].isalnum()), default=None)
                if best is None:
                    break
                yield start, -1, best[0], f"named:{best[2]}"
                if not (more := self.joint.match(clean, best[0])):
                    break
                start, at = best[0] + 1, more.end()

    def sequence(self, text: str) -> list[tuple[int, str]]:
        """(number of the sentence, identifier) for the licence sentences of a text."""
        if not hinted(" ".join(text.split())):
            return []
        out = []
        for place, sentence in enumerate(s for s in _CUT.split(text) if s and s.strip()):
            if not hinted(" ".join(sentence.split())):
                continue
            clean = "\n".join(filter(None, map(normalised, _BREAK.split(sentence))))
            flat = clean.replace("\n", " ")
            met = [(m.start(), rank, m.end(), name) for rank, (name, words, pattern) in enumerate(self.sentences) if words in flat for m in pattern.finditer(clean)]
            if self.named:
                met += self._names(clean, sentence)
            end = -1
            # Of two that begin together, the one that says more; a longer one from the same beginning may hold a name.
            for start, _, after, name in sorted(met, key=lambda x: (x[0], -x[2], x[1])):
                if start > end:
                    out.append((place, name))
                    end = after
        return out

    @staticmethod
    def _texts(found: list[tuple[int, str]]) -> Iterator[tuple[int, str, int]]:
        """(place in the sequence, licence, end) of whole licence texts."""
        titles = [at for at, (_, name) in enumerate(found) if name.startswith("title:")]
        for k, at in enumerate(titles):
            after = titles[k + 1] if k + 1 < len(titles) else len(found)
            begun = next((i for i in range(at + 1, after) if found[i][1] == "text-begin" and found[i][0] - found[at][0] <= HEADING), None)
            if begun is not None:
                last = max((i for i in range(begun, after) if found[i][1] == "text-end"), default=None)
                yield at, found[at][1].removeprefix("title:"), after if last is None else last + 1

    def scan(self, text: str) -> tuple[list[str], list[str]]:
        """(licences in the order of the text, identifiers of the sentences found)."""
        found = self.sequence(text)
        free, present, licences = [True] * len(found), {name for _, name in found}, []
        for at, licence, end in self._texts(found):
            licences.append((at, licence))
            free[at:end] = [False] * (end - at)
        for licence, rule in self.rules:
            if not present.issuperset(rule):
                continue
            # parts[k]: the latest way to the first k identifiers.
            parts: list[tuple | None] = [(), *[None] * len(rule)]
            for at, (place, name) in enumerate(found):
                if not free[at]:
                    continue
                for k in range(len(rule), 0, -1):
                    if rule[k - 1] == name and parts[k - 1] is not None and (k == 1 or place - found[parts[k - 1][-1]][0] <= self.gap + 1):
                        parts[k] = (*parts[k - 1], at)
                if parts[-1]:
                    for used in parts[-1]:
                        free[used] = False
                    licences.append((parts[-1][0], licence))
                    parts = [(), *[None] * len(rule)]
        licences += [(at, name.split(":", 1)[1]) for at, (_, name) in enumerate(found) if free[at] and name.startswith(("named:", "spdx:"))]
        others = [(at, x) for at, x in licences if found[at][1] != "reserved"]
        licences = others if self.alone and others else licences
        return [x for _, x in sorted(licences)], [name for _, name in found]


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences=None, rules=None) -> DataFrame:
    """id, licenses, sentences (arrays in the order of the text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner(sentences, rules, alone=True)
        for batch in batches:
            found = [own.scan(t.as_py() or "") for t in batch.column(1)]
            lists = [pa.array([f[k] for f in found], pa.list_(pa.string())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["id", "licenses", "sentences"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), f"id {kind}, licenses array<string>, sentences array<string>").withColumnRenamed("id", id_col)


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    found = scanned(read(spark, sf_dir))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.size("licenses").cast("long").alias("n_licenses"))
