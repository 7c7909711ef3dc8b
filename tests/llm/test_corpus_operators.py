"""The corpus operators against brute force, and on rows with nulls, empty and very long texts, ties and repeats."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sievework.llm import bpe, chat, exact_dedup, jaccard_join, language_id, licenses, maxent, mixing, quality, textkernel, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, size long, part string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EN = "the quick brown fox jumps over a lazy dog while seven bright rivers run down to the sea and nobody minds at all today".split()
DE = "der schnelle braune fuchs springt über den faulen hund und sieben helle flüsse fließen zum meer hinab heute früh".split()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(words, seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(words[i] for i in rng.integers(0, len(words), n))


TEXTS = [
    None, "", " \n\t ", "one", "one two", "one two three", "One  two three", prose(EN, 1, 300), prose(EN, 1, 300), prose(EN, 1, 300).replace(" ", "  "),
    prose(EN, 1, 299) + " x", prose(EN, 2, 80), prose(DE, 3, 120), prose(DE, 4, 90), "a b c " * 50, "line one\nline one\n\nline two\n", "###%% $$ <tag> | & *",
    prose(EN, 5, 30_000), "x" * 50_000, "na\x0bïve\x0ccafé\r\n\x1cend", prose(DE, 6, 200) + "!!", prose(EN, 7, 60).upper(), "<|endoftext|> mid<|startoftext|>dle", "1234567890", "é",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 7 == 3 else "de" if t and "fuchs" in t else "en", None if i % 5 == 4 else f"s{i % 3}", 0, "clash", 9, "p") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_kernel():
    for piece in textkernel.pieces(pa.array(TEXTS, pa.string())):
        starts, ends, owner = piece.words()
        got = [[] for _ in range(piece.n)]
        for a, b, t in zip(starts, ends, owner, strict=True):
            got[t].append(piece.string(a, b))
        assert got == [WORD.findall(t or "") for t in TEXTS[piece.first : piece.first + piece.n]]


def test_exact_dedup(docs, empty):
    plain = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in enumerate(TEXTS)}
    groups = collections.defaultdict(list)
    for i, p in plain.items():
        groups[p].append(i)
    got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup.exact_dedup(docs).collect()}
    for p, own in groups.items():
        keep = min(own, key=lambda i: (-len(TEXTS[i] or ""), i))
        for i in own:
            assert got[i] == (keep, len(own), i == keep, hashlib.sha256(p.encode()).hexdigest())
    assert exact_dedup.keep_documents(docs).count() == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.keep_documents(empty).count() == 0


def test_exact_dedup_ties_and_nulls(spark):
    rows = [(None, "a b"), (5, "a b"), (5, "a b"), (-3, "ab "), (2, "a b"), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, exact_dedup.exact_dedup(d).collect()), key=str)
    # "a b" and "ab " have as many code points: the smallest id stays.
    assert [(r[1], r[2]) for r in got].count((-3, 5)) == 5 and (None, None, 1, True, hashlib.sha256(b"").hexdigest()) in got
    assert exact_dedup.keep_documents(d).count() == 2


def test_exact_dedup_keeps_each_text_of_null_and_repeated_ids(spark):
    rows = [(None, "a"), (None, "b"), (None, "b"), (3, "y"), (5, "y"), (5, "x"), (5, "z"), (7, "y"), (8, "q q"), (8, "qq"), (9, None), (9, "w")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(tuple, exact_dedup.keep_documents(d).collect()), key=str)
    assert kept == sorted([(None, "a"), (None, "b"), (3, "y"), (5, "x"), (5, "z"), (8, "q q"), (9, None), (9, "w")], key=str)


def shingles(text, window):
    words = WORD.findall(lower(text))
    return {tuple(words[i : i + window]) for i in range(len(words) - window + 1)} if len(words) >= window else {tuple(words)} if words else set()


def near_brute(texts, window, up):
    sets = {i: shingles(t, window) for i, t in texts.items()}
    root, links = {i: i for i in sets}, collections.Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= up * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i), links[i]) for i in sets}


@pytest.mark.parametrize(("window", "up"), [(3, 90), (5, 80)])
def test_jaccard_join(docs, empty, window, up):
    got = {r["doc_id"]: tuple(r)[1:] for r in jaccard_join.jaccard_classes(docs, window=window, up=up).collect()}
    assert got == near_brute(dict(enumerate(TEXTS)), window, up)
    assert jaccard_join.jaccard_classes(empty).count() == 0


def test_jaccard_join_of_a_large_group(spark, monkeypatch):
    """A group of near copies larger than a block, so that chunks and bands meet."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 8)
    base = [f"w{i}" for i in range(120)]
    rng = np.random.default_rng(5)
    texts = {}
    for i in range(90):
        words = base[: 120 - int(rng.integers(0, 12))]
        for at in rng.integers(0, len(words), int(rng.integers(0, 4))):
            words = [*words[:at], f"new{i}_{at}", *words[at + 1 :]]
        texts[i] = " ".join(words)
    got = {r["doc_id"]: tuple(r)[1:] for r in jaccard_join.jaccard_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == near_brute(texts, 3, 90)


def test_jaccard_join_of_a_large_group_at_a_lower_threshold(spark):
    base = [f"w{i}" for i in range(300)]
    # Sizes 192 and 235: only pairs across them tie the two halves together, at a Jaccard of 0.809.
    texts = {i: " ".join([*base[: 195 if i % 2 else 238], f"own{i}"]) for i in range(jaccard_join.CHUNK + 12)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in jaccard_join.jaccard_classes(d, window=5, up=80).collect()}
    assert got == near_brute(texts, 5, 80)
    assert jaccard_join.keep_documents(d, window=5, up=80).count() == 1


def test_bpe(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: (np.frombuffer(bytes(r["ids"]), "<u4").tolist(), r["decoded"]) for r in bpe.encode_decode(docs).collect()}
    for i, t in enumerate(TEXTS):
        ids = own.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (ids, own.decode(ids, skip_special_tokens=False))
    encoded = bpe.encode_decode(docs)
    assert bpe.decode(encoded.drop("decoded")).join(encoded.select("doc_id", F.col("decoded").alias("d")), "doc_id").where("decoded <> d").count() == 0
    assert bpe.encode_decode(empty).count() == 0


def test_bpe_on_odd_letters():
    import public_tokenizers
    from tokenizers import Tokenizer

    own, mine = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), bpe.Tokenizer(bpe.default_spec())
    rng = np.random.default_rng(1)
    pool = [chr(c) for lo, hi in ((9, 14), (32, 127), (0xA0, 0x250), (0x300, 0x330), (0x391, 0x3C9), (0x621, 0x64A), (0x905, 0x939), (0x2000, 0x2010), (0x3041, 0x3096), (0xAC00, 0xAC20), (0x1F600, 0x1F610)) for c in range(lo, hi)]
    texts = ["".join(pool[i] for i in rng.integers(0, len(pool), int(rng.integers(1, 30)))) for _ in range(2000)] + ["aaaaaaa", "ΣΑΣ", "İ don't I'LL"]
    for text, (ids, decoded), right in zip(texts, mine.encode_decode(texts), own.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == right.ids, text
        assert decoded == own.decode(right.ids, skip_special_tokens=False)


def base_brute(text):
    words, lines = WORD.findall(text or ""), [line for line in (text or "").split("\n") if WORD.search(line)]
    seen = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, empty):
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for i, t in enumerate(TEXTS):
        base = base_brute(t)
        assert tuple(got[i][c] for c in quality.COUNTS) == base
        assert got[i]["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])
    kept = {r["doc_id"] for r in quality.keep_documents(docs).collect()}
    assert kept == {i for i in got if got[i]["kept"]}
    assert quality.judge(empty).count() == 0 and quality.keep_documents(empty).count() == 0


def test_quality_bands_find_junk(spark):
    clean = [(i, prose(EN, i, 80), "en") for i in range(60)]
    junk = [(100 + i, "%%% ".join(prose(EN, i, 80).split()) + "$$$", "en") for i in range(4)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")).collect() if not r["base_failed"]}
    assert all(k == (i < 100) for i, k in got.items()) and sum(i >= 100 for i in got) == 4


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(2)
    codes = np.unique(rng.integers(0, 1 << 21, 3000))
    model = quality.KneserNey(codes, rng.integers(1, 9, len(codes)).astype(float))
    for context in (int(codes[0]) >> 7, int(codes[77]) >> 7, 5):
        assert np.sum(10 ** model.log10(np.arange(128) + (context << 7)).astype(float)) == pytest.approx(1, abs=1e-4)


def test_mixing(docs, empty):
    got = {r["id"]: r for r in mixing.decisions(docs).collect()}
    assert {i: r["size"] for i, r in got.items()} == {i: len(WORD.findall(t or "")) for i, t in enumerate(TEXTS)}
    by = collections.defaultdict(list)
    for r in got.values():
        by[r["source"]].append(r)
    assert sum(own[0]["target"] for own in by.values()) == pytest.approx(sum(r["size"] for r in got.values()))
    for own in by.values():
        assert own[0]["target"] <= 3 * own[0]["source_size"] + 1e-6
        taken = sum(r["size"] * r["copies"] for r in own)
        assert abs(taken - own[0]["target"]) <= max(r["size"] for r in own)
    assert mixing.training_order(docs).count() == sum(r["copies"] for r in got.values())
    assert mixing.decisions(empty).count() == 0 and mixing.training_order(empty).count() == 0


def test_mixing_positions_invert_the_demand(spark):
    for tilt in (-0.5, 0.0, 0.5):
        for x in (0.0, 0.1, 0.5, 0.99):
            t = spark.range(1).select(mixing.position(F.lit(x * 40.0), F.lit(40.0), F.lit(tilt))).first()[0]
            assert t + tilt * (t - t * t) == pytest.approx(x, abs=1e-9)


def test_language_id(docs, empty, spark):
    rows = [(i, prose(EN, i, 30), "en") for i in range(60)] + [(100 + i, prose(DE, i, 30), "de") for i in range(60)] + [(300, None, "en"), (301, "x", None)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    test = [(1, prose(EN, 999, 20)), (2, prose(DE, 999, 20)), (3, None), (4, "12 34"), (5, ""), (6, prose(DE, 5, 40_000))]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(spark.createDataFrame(test, "doc_id long, text string"), model).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["en", "de", "und", "und", "und", "de"]
    assert all(0 <= s <= 1 for _, s in got.values()) and got[3][1] == 0
    nothing = language_id.train(empty)
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


@pytest.mark.parametrize("head", [1_000_000, 20])
def test_maxent(docs, empty, monkeypatch, head):
    monkeypatch.setattr(maxent, "HEAD", head)
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in enumerate(TEXTS)}
    train = {i for i in tokens if zlib.crc32(str(i).encode()) % 10}
    count = collections.Counter(w for i in train for w in tokens[i])
    n, v = sum(count.values()), len(count)
    model, table = maxent.train(docs.where(maxent.fold(F.col("doc_id"), 10) != 0))
    for r in maxent.score(docs, model, table).collect():
        own = tokens[r["doc_id"]]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(count[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    nothing, none = maxent.train(empty)
    assert maxent.score(docs, nothing, none).count() == len(TEXTS) and maxent.score(empty, model, table).count() == 0


def test_licenses(docs, empty):
    own = licenses.Scanner()
    assert own.scan("Intro.\nLicensed under the Apache License, Version 2.0.") == (["Apache-2.0"], ["named:Apache-2.0"])
    assert own.scan("This work is licensed under the GNU General Public License, version 3.\nAll rights reserved.")[0] == ["GPL-3.0-only", "proprietary"]
    long = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the X).\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nThe software is provided \"as is\", without warranty of any kind, express or implied."
    assert own.scan(long)[0] == ["MIT"]
    assert own.scan("\n".join(reversed(long.split("\n"))))[0] == []
    assert licenses.scanned(docs).where(F.size("licenses") > 0).count() == 0 and licenses.scanned(empty).count() == 0


MIT = """MIT License

Copyright (c) 2020 IBM. All rights reserved.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.
"""
APACHE = """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS,
// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the notice is kept.
The software is provided "as is", without warranty
of any kind.
"""


def test_licenses_in_wrapped_headers():
    own = licenses.Scanner()
    found = {"apache": APACHE, "gpl": GPL, "bsd": BSD, "mit": MIT}
    assert {k: own.scan(t)[0] for k, t in found.items()} == {"apache": ["Apache-2.0"], "gpl": ["GPL-3.0-or-later"], "bsd": ["BSD"], "mit": ["proprietary", "MIT"]}
    assert own.scan(APACHE)[1] == ["apache2-named", "apache2-obey", "apache2-copy", "apache2-as-is"]
    assert own.scan(MIT.replace("\n", "\r\n"))[0] == ["proprietary", "MIT"]
    assert own.scan("This project is released under the MIT License.")[0] == ["MIT"]
    assert own.scan("This project is licensed\nunder the BSD 3-Clause\nLicense.")[0] == ["BSD-3-Clause"]
    assert own.scan("Copyright 2020 IBM. All rights reserved.")[0] == ["proprietary"]
    assert own.scan("It is not released under the MIT License.")[0] == []
    assert own.scan("Released under the MIT License\nAll rights reserved\nno more")[0] == ["MIT", "proprietary"]


def test_chat(spark):
    turn = lambda c, t, text, role="user": (c, t, role, text)
    rows = [
        turn(1, 0, "hi"), turn(2, 0, "hi"), turn(2, 1, "hello", "assistant"), turn(3, 0, "hi"), turn(3, 1, "hello", "assistant"), turn(3, 2, "bye"),
        turn(4, 0, "hi"), turn(4, 1, "other"), turn(5, 0, "hi"), turn(5, 1, "other"), turn(6, None, None, None), turn(None, 0, "alone"), turn(3, 2, "bye"),
    ]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["rendered"]) for r in chat.formatted(d).collect()}
    assert set(got) == {3, 4, 6, None}
    assert got[3] == (3, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n")
    assert got[6] == (1, "<|im_start|>\n<|im_end|>\n")
    assert chat.formatted(d.limit(0)).count() == 0


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(240):
        words = prose(EN, i, 40).split()
        bad = i % 4 == 0
        if bad:
            words.insert(int(rng.integers(0, 40)), ["blockhead", "nitwit", "dimwit"][i % 3])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    test = [(1, prose(EN, 900, 30)), (2, prose(EN, 901, 15) + " nitwit " + prose(EN, 902, 15)), (3, "you d.i.m.w.i.t today"), (4, "b l o c k h e a d"), (5, None), (6, "")]
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(spark.createDataFrame(test, "doc_id long, text string"), model).collect()}
    assert [got[i] >= toxicity.THRESHOLD for i in range(1, 7)] == [False, True, True, True, False, False]
    assert all(0 <= s <= 1 for s in got.values())
    nothing = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.scored(docs, nothing).count() == len(TEXTS) and toxicity.scored(empty, model).count() == 0


def test_pipeline(spark, docs):
    import corpus_pipeline

    kept = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "")
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    judged = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    best = {}
    for i in judged:
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", TEXTS[i]), []).append(i)
    exact = {min(own, key=lambda i: (-len(TEXTS[i]), i)) for own in best.values()}
    near = near_brute({i: TEXTS[i] for i in exact}, 5, 80)
    assert {r["doc_id"] for r in kept.collect()} <= {i for i in exact if near[i][1] == i}
    assert corpus_pipeline.STAGES[-1][1](spark, kept, "").count() == kept.count()
