"""Licence rules against brute force over sequences, and notices of many licences."""

import importlib.metadata
import itertools
import os
import textwrap
import time

import numpy as np
import pytest
from sievework.llm import licenses

BSD3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation.
{more}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED.
"""
ENDORSE = "3. Neither the name of the copyright holder nor the names of its contributors\n   may be used to endorse or promote products derived from this software.\n"
GNU = """This {thing} is free software; you can redistribute it and/or
modify it under the terms of the GNU {name} as published by
the Free Software Foundation; either version {version} of the License, or
(at your option) any later version.
"""
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE."
NOTICES = {
    BSD3.format(more=ENDORSE): ["BSD-3-Clause"],
    BSD3.format(more=""): ["BSD-2-Clause"],
    GNU.format(thing="program", name="General Public License", version=2): ["GPL-2.0-or-later"],
    GNU.format(thing="library", name="Lesser General Public License", version="2.1"): ["LGPL-2.1-or-later"],
    GNU.format(thing="program", name="Affero General Public License", version=3): ["AGPL-3.0-or-later"],
    ISC: ["ISC"],
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.": ["MPL-2.0"],
    "// SPDX-License-Identifier: MIT": ["MIT"],
    "# SPDX-License-Identifier: (MIT OR Apache-2.0)": ["MIT", "Apache-2.0"],
    "SPDX-License-Identifier: GPL-2.0+": ["GPL-2.0-or-later"],
    "SPDX-License-Identifier: LGPL-3.0-only": ["LGPL-3.0-only"],
    "Dual licensed under either of the Apache License, Version 2.0 or the MIT license at your option.": ["Apache-2.0", "MIT"],
    "Licensed under the GNU Lesser General Public License v2.1 or later.": ["LGPL-2.1-or-later"],
    "It may be distributed under the terms of the MPL 2.0.": ["MPL-2.0"],
    "Released under the 2-clause BSD license.": ["BSD-2-Clause"],
    "Text licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": ["CC-BY-SA-4.0"],
    "Photos are licensed under CC BY-NC-ND 3.0.": ["CC-BY-NC-ND-3.0"],
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled binary.": ["Unlicense"],
    "The MIT license was written long ago, and permission is a nice word.": [],
    "This work is never released under the GPL v3.": [],
    "": [],
}


@pytest.mark.parametrize("text", NOTICES)
def test_notices(text):
    assert licenses.Scanner().scan(text)[0] == NOTICES[text]


def brute(found, rules, gap):
    """All ways to a rule, tried one by one: the one that ends first, and of those the latest from its end on."""
    free, out = [True] * len(found), []
    for licence, rule in rules:
        while True:
            ways = [w for w in itertools.combinations([i for i in range(len(found)) if free[i]], len(rule)) if all(found[i][1] == r for i, r in zip(w, rule, strict=True)) and all(found[b][0] - found[a][0] <= gap + 1 for a, b in itertools.pairwise(w))]
            ways = [w for w in ways if not out or out[-1][1] != licence or w[0] > out[-1][2]]
            if not ways:
                break
            best = min(ways, key=lambda w: (w[-1], [-i for i in reversed(w)]))
            for i in best:
                free[i] = False
            out.append((best[0], licence, best[-1]))
    return [licence for _, licence, _ in sorted(out)]


def test_rules_against_brute_force(monkeypatch):
    rules = [("R3", ("a", "b", "c")), ("R2", ("b", "a")), ("R1", ("c",))]
    rng = np.random.default_rng(4)
    for _ in range(300):
        places = np.cumsum(rng.integers(0, 4, int(rng.integers(0, 9))))
        found = [(int(p), "abc"[rng.integers(0, 3)]) for p in places]
        own = licenses.Scanner(rules=rules, gap=2)
        monkeypatch.setattr(own, "sequence", lambda text, found=found: found)
        assert own.scan("")[0] == brute(found, rules, 2), found


def test_a_long_text_takes_time_in_proportion():
    own, sentence, took = licenses.Scanner(), "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files. ", []
    for n in (2000, 8000):
        began = time.process_time()
        assert own.scan(sentence * n)[0] == []
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.2


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n"))


@pytest.mark.parametrize("text", NOTICES)
def test_notices_at_every_width(text):
    own = licenses.Scanner()
    wrong = {width: got for width in range(30, 101) if (got := own.scan(wrapped(text, width))[0]) != NOTICES[text]}
    assert not wrong


@pytest.mark.parametrize(
    ("line", "right"),
    [
        ("GPL-2.0-or-later", ["GPL-2.0-or-later"]),
        ("AGPL-3.0-or-later */", ["AGPL-3.0-or-later"]),
        ("LGPL-2.1+", ["LGPL-2.1-or-later"]),
        ("GPL-2.0", ["GPL-2.0-only"]),
        ("gpl-3.0-OR-later", ["GPL-3.0-or-later"]),
        ("GPL-2.0-or-later WITH Classpath-exception-2.0", ["GPL-2.0-or-later WITH Classpath-exception-2.0"]),
        ("(GPL-2.0-only OR MIT) AND Apache-2.0 -->", ["GPL-2.0-only", "MIT", "Apache-2.0"]),
        ("MIT OR\n# LicenseRef-Own AND ISC", ["MIT", "ISC"]),
        ("LicenseRef-Own WITH Something", []),
        ("MIT and more words", ["MIT"]),
    ],
)
def test_spdx_expressions(line, right):
    assert licenses.Scanner().scan(f"# SPDX-License-Identifier: {line}\nint x;")[0] == right


TEXTS = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0-only", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2": "LGPL-2.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


@pytest.mark.parametrize("name", TEXTS)
def test_whole_licence_texts(name):
    path = f"/usr/share/common-licenses/{name}"
    if not os.path.exists(path):
        pytest.skip("no such file here")
    with open(path, encoding="utf-8", errors="replace") as f:
        text = f.read()
    own = licenses.Scanner(alone=True)
    assert own.scan(text)[0] == [TEXTS[name]]
    # A notice before the text, and another text behind it, stay licences of their own.
    assert own.scan("Released under the MIT license.\n\n" + text + "\n\n" + BSD3.format(more=ENDORSE))[0] in (["MIT", TEXTS[name], "BSD-3-Clause"], ["MIT", TEXTS[name]])


PACKAGES = {"attrs": "MIT", "certifi": "MPL-2.0", "idna": "BSD-3-Clause", "protobuf": "BSD-3-Clause", "psutil": "BSD-3-Clause", "pygments": "BSD-2-Clause", "pytest": "MIT", "pyyaml": "MIT", "requests": "Apache-2.0", "sortedcontainers": "Apache-2.0", "tiktoken": "MIT", "urllib3": "MIT", "xxhash": "BSD-2-Clause", "zstandard": "BSD-3-Clause"}


@pytest.mark.parametrize("name", PACKAGES)
def test_licence_files_of_installed_packages(name):
    try:
        files = [f for f in importlib.metadata.files(name) or [] if f.name.upper().startswith(("LICENSE", "COPYING"))]
    except importlib.metadata.PackageNotFoundError:
        files = []
    if not files:
        pytest.skip("not installed here")
    assert licenses.Scanner(alone=True).scan(files[0].read_text(encoding="utf-8"))[0] == [PACKAGES[name]]


def test_reserved_rights_alone_are_proprietary():
    own = licenses.Scanner(alone=True)
    assert own.scan("Copyright 2020 Someone. All rights reserved.")[0] == ["proprietary"]
    assert own.scan("Copyright 2020 Someone. All rights reserved.\n\n" + BSD3.format(more=""))[0] == ["BSD-2-Clause"]


def test_recognition_of_sentences_against_brute_force():
    """Each sentence's pattern, tried at every run of words of a text that is cut by full stops alone."""
    import re

    rng, own = np.random.default_rng(9), licenses.Scanner()
    fixed = [(name, pattern) for name, pattern in licenses.SENTENCES if re.fullmatch(r"[0-9a-z ]+", pattern) and not name.startswith(("title", "text-", "spdx"))]
    words = "the software may be used by anyone at will".split()
    for _ in range(200):
        picked = [fixed[k] for k in rng.integers(0, len(fixed), int(rng.integers(0, 4)))]
        lines = [pattern for _, pattern in picked] + [" ".join(rng.choice(words, 6)) for _ in range(2)]
        order = rng.permutation(len(lines))
        text = ". ".join(lines[k].capitalize() for k in order) + "."
        sentences = [" ".join(re.findall("[0-9a-z+]+", part.lower())) for part in text.split(". ")]
        right = [name for part in sentences for name, pattern in fixed if re.fullmatch(pattern, part)]
        assert [name for name in own.scan(text)[1] if name in dict(fixed)] == right, text
