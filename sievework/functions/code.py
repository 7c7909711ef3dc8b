"""Names in code: where one is defined, which line to open at."""

from __future__ import annotations

import re

# Words before a name that define it, and words before a name that use it; how comments start.
DEFINERS = (
    "def func fn fun function class struct enum protocol interface trait type typealias actor extension impl module namespace "
    "object record macro const let var val union mod sub @interface @implementation @protocol #define function*"
).split()
USERS = (
    "return await yield throw new else case print echo assert not and or in is do go defer try catch if while for typeof "
    "delete raise import from"
).split()
COMMENTS = ("//", "#", "/*", "*", "--", '"""', "'''", "<!--", ";")
BINDERS = {"let", "var", "const", "val"}


def _lines(text: str) -> list[str]:
    return re.split(r"\r\n|\n", text)


#: Lines that define a name, by what stands before it and after it: a word that defines; a Go method's receiver; an
#: Objective-C method's type; a type before and parameters after it, which is a declaration if the line ends with ";".
_DEFINES = re.compile(r"(?:.*\s)?(?:" + "|".join(map(re.escape, DEFINERS)) + ")")
_TYPED = re.compile(r"(?:(?!->)[^=(,.!?])*[\w*&>\]]")
_USED = re.compile(r"(?:.*\s)?(?:" + "|".join(USERS) + ")")
SHAPES = [(_DEFINES, re.compile("")), (re.compile(r"func \(.*\)"), re.compile("")), (re.compile(r"[-+] \(.*"), re.compile(r"$|[:{;]"))]


def _strength(before: str, after: str, closed: bool) -> int:
    if any(b.fullmatch(before) and a.match(after) for b, a in SHAPES):
        return 2
    typed = after[:1] == "(" and _TYPED.fullmatch(before) and not _USED.fullmatch(before) and not SHAPES[2][0].match(before)
    return (1 if closed else 2) if typed else 0


def definition(name: str, text: str, first: int = 1) -> tuple[int, int] | None:
    """(line, strength): 2 for a definition, 1 for a declaration; None where the text only uses the name."""
    whole = re.compile(rf"(?<![\w$]){re.escape(name)}(?![\w$])", re.I)
    found = [(_strength(line[: m.start()].strip(), line[m.end() :].strip(), line.rstrip().endswith(";")), -n) for n, line in enumerate(_lines(text), first) for m in whole.finditer(line)]
    best = max(found, default=(0, 0))
    return (-best[1], best[0]) if best[0] else None


def _part(word: str) -> re.Pattern:
    """The word as a word or at the start of a name's part."""
    folded = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else re.escape(c) for c in word)
    capital = (word[0].upper() + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else re.escape(c) for c in word[1:])) if word[0].isalpha() else folded
    return re.compile(rf"(?<![^\W_]){folded}|{capital}")


def first_line(words: list[str], text: str, first: int = 1) -> int | None:
    """The line to open at: one that defines something, else one of code, else any with one of the words."""
    parts = [_part(w) for w in words if len(w) >= 2]
    ranked = []
    for n, line in enumerate(_lines(text), first):
        if any(p.search(line) for p in parts):
            defines = any(w in DEFINERS and w not in BINDERS for w in line.split()[:4])
            ranked.append((0 if defines else 1 if not line.strip().startswith(COMMENTS) else 2, n))
    return min(ranked)[1] if ranked else None


def summary(text: str, limit: int = 160) -> str:
    """The line that stands for a stretch: the first that defines something, else the first of code."""
    lines = [line.strip() for line in _lines(text) if line.strip()]
    code = [line for line in lines if not line.startswith(COMMENTS)]
    best = next((line for line in lines if any(w in DEFINERS and w not in BINDERS for w in line.split()[:4])), (code or lines or [""])[0])
    return best if len(best) <= limit else best[:limit] + "…"
