"""Crash-safe changes, moves, fingerprints, versions, folder choices, result texts, code search."""

import os

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from sievework.engine import Engine
from sievework.functions import results
from sievework.functions.embedding import HashEmbedder
from sievework.operators import folders, lookup, media, search, upkeep
from sievework.operators.keyword_index import KeywordIndex, build
from sievework.operators.store import KEPT, Index


def test_a_crash_between_tables_and_pointer_leaves_the_state_before(spark, tmp_path, monkeypatch):
    index = Index(spark, str(tmp_path))
    index.set_meta(a="1")

    def crash(*_):
        raise RuntimeError("crash")

    monkeypatch.setattr(index, "_point", crash)
    with pytest.raises(RuntimeError):
        index.set_meta(a="2")
    again = Index(spark, str(tmp_path))
    assert again.table("meta").first()["value"] == "1"
    again.set_meta(a="3")
    assert again.table("meta").first()["value"] == "3" and again.size() > 0
    for k in range(6):
        again.set_meta(a=str(k))
    assert len(os.listdir(tmp_path / "pointers")) == KEPT and len(os.listdir(tmp_path / "meta")) <= KEPT
    for pointer in os.listdir(tmp_path / "pointers"):
        os.rename(tmp_path / "pointers" / pointer, tmp_path / f"lost-{pointer}")
    with pytest.raises(ValueError, match="no pointer"):
        Index(spark, str(tmp_path))


def test_a_second_writer_is_refused(spark, tmp_path):
    index = Index(spark, str(tmp_path))
    with pytest.raises(ValueError, match="another writer"):
        index._point(index.versions(), index._pointers()[-1])


def test_a_moved_file_keeps_its_vectors(spark, tmp_path):
    root, store = tmp_path / "docs", tmp_path / "index"
    root.mkdir()
    (root / "river.txt").write_text("The river runs past the old stone mill every single day.")
    (root / "page.html").write_text("<html><head><title>x</title></head><body><p>A lantern &amp; a window stand here</p><script>no()</script></body></html>")
    calls = []

    class Counting(HashEmbedder):
        def embed(self, texts):
            calls.extend(texts)
            return super().embed(texts)

    engine = Engine(spark, str(store), Counting)
    engine.index(str(root))
    before = engine.index_tables.table("segments").where("vec is not null").orderBy("id").collect()
    assert len(before) == 2 and engine.search("lantern window").first()["path"].endswith("page.html")
    assert engine.search("script title").where(F.col("coverage") > 0).count() == 0
    os.rename(root / "river.txt", root / "stream.txt")
    assert {r["change"]: r["n"] for r in engine.index(str(root)).collect()} == {"moved": 1, "unchanged": 1}
    assert engine.index_tables.table("segments").where("vec is not null").orderBy("id").collect() == before
    assert engine.search("river mill").first()["path"].endswith("stream.txt")

    class Other(Counting):
        def __init__(self):
            super().__init__(32)

    other = Engine(spark, str(store), Other)
    assert other.search("river mill").first()["z"] is None and "built with" in other.warning
    other.index(str(root))
    assert len(other.index_tables.table("segments").where("vec is not null").first()["vec"]) == 32


def test_fingerprints():
    assert upkeep.adopt(None, "a") is False and upkeep.adopt("a", "a") is False
    with pytest.raises(upkeep.FingerprintError):
        upkeep.adopt("a", "b")
    emptied = []
    assert upkeep.adopt("a", "b", lambda: emptied.append(1)) and emptied == [1]
    assert upkeep.fingerprint("m") == "m | photo140 shot280 page280 frame70/3.0s audio30.0/25.0s"
    asked = []
    vectors = upkeep.QueryVectors(lambda t, c: asked.append((t, c)) or [1.0])
    assert [vectors.of("x"), vectors.of("x"), vectors.of("x", True)] == [[1.0]] * 3 and asked == [("x", False), ("x", True)]


FILES = "id long, path string, kind string, size long, mtime double, state string, detail string, info map<string,string>"
SEGMENTS = "id long, file long, kind string, modality string, loc double, excerpt string, vec array<float>"


def test_migrations(spark):
    files = spark.createDataFrame([
        (1, "/a.pdf", "pdf", 1, 1.0, "partial", None, {"pages": "90"}), (2, "/b.txt", "doc", 1, 1.0, "done", None, {"chunks": "40", "chars": "80000"}), (3, "/c.txt", "doc", 1, 1.0, "done", None, {"chunks": "3"}), (4, "/d.pdf", "pdf", 1, 1.0, "done", None, {}),
    ], FILES)
    bad = "".join(chr(0x9BF) + chr(0x995) for _ in range(12))
    segments = spark.createDataFrame([(10, 1, "page", "text", 1.0, None, [1.0]), (11, 3, "ocr", "text", None, None, [1.0]), (12, 3, "chunk", "text", 1.0, None, [1.0]), (13, 4, "page", "text", 1.0, None, [1.0]), (14, 4, "name", "none", None, None, None)], SEGMENTS)
    fts = spark.createDataFrame([(10, 1, "", "words to read here", None), (11, 3, "", "ocr", None), (12, 3, "", "12 34 56 78", None), (13, 4, "", bad, None), (14, 4, "d.pdf", "", None)], "rowid long, file long, name string, body string, original string")
    meta = spark.createDataFrame([("vector_source", "x llama.cpp-b11461-metal y")], "key string, value string")
    t, version = upkeep.migrated({"files": files, "segments": segments, "fts": fts, "meta": meta}, 1)
    assert version == 5
    got = {r["id"]: r for r in t["files"].collect()}
    assert (got[1]["info"]["read_to"], got[1]["info"]["read_end"]) == ("30", "90")
    assert (got[2]["state"], got[2]["info"]["read_to"], got[2]["info"]["read_end"]) == ("partial", "40", "50")
    assert got[3]["state"] == "done" and got[4]["state"] == "pending"
    assert {r["id"]: r["vec"] is not None for r in t["segments"].collect()} == {10: True, 11: False, 12: False, 14: False}
    assert t["meta"].first()["value"] == "x llama.cpp-vectors1 y" and t["fts"].count() == 4
    with pytest.raises(ValueError, match="version 9"):
        upkeep.migrated({}, 9)


def test_read_again_happens_once(spark):
    files = spark.createDataFrame([(1, "/a", "pdf", 1, 1.0, "done", None, {}), (2, "/b", "image", 1, 1.0, "skipped", "too small", {}), (3, "/c", "image", 1, 1.0, "done", None, {})], FILES)
    segments = spark.createDataFrame([(9, 1, "page_image", "image", 2.0, None, None)], SEGMENTS)
    none = spark.createDataFrame([], "key string, value string")
    found, flags = upkeep.read_again(files, segments, none, True, True)
    assert {r["path"] for r in found.collect()} == {"/a", "/b"} and flags == ["scans_ocr", "pictures_drawn"]
    found, flags = upkeep.read_again(files, segments, spark.createDataFrame([(f, "1") for f in flags], "key string, value string"), True, True)
    assert found.count() == 0 and flags == []


def test_folder_choices():
    s = folders.Selection(("/a",), ("/a/b",), ("/k",))
    assert [s.searched(p) for p in ("/a", "/a/x", "/a/b", "/a/b/c", "/ab", "/k/z", "/a/.git/x", "/a/node_modules/x")] == [True, True, False, False, False, True, False, False]
    inner = folders.Selection(("/a", "/a/b/c"), ("/a/b",))
    assert inner.searched("/a/b/c/d") and inner.folders() == ["/a", "/a/b/c"] and inner.searched_as("/a/b/c/d") == "/a/b/c"
    assert folders.Selection(("/a", "/a/x")).folders() == ["/a"] and folders.Selection(("/a",), ("/z/q", "/a/b")).effective_skips() == ["/a/b"]
    assert [s.mark(f) for f in ("/a", "/a/b", "/", "/q")] == ["mixed", "off", "mixed", "off"]
    assert s.with_folder("/a", True).mark("/a") == "on" and s.with_folder("/a", False).searched("/a/x") is False
    assert s.with_subfolder("/a/b", True).searched("/a/b/c") and s.with_subfolder("/a/c", False).skipped == ("/a/b", "/a/c")


def test_folder_gates(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    tag = bytearray(b"Signature: 8a477f597d28d172789f06886806bc55 more")
    assert one(folders.is_cache_tag(F.lit("CACHEDIR.TAG"), F.lit(tag))) is True and one(folders.is_cache_tag(F.lit("CACHEDIR.TAG"), F.lit(bytearray(b"Signature: no")))) is False
    assert [one(folders.folder_skip_reason(F.lit(p), F.lit("/h"), ["/x"])) for p in ("/a/node_modules", "/a/b.noindex", "/h/Library", "/x/y", "/a")] == ["developer folder", ".noindex folder", "~/Library", "excluded folder", None]
    assert [one(folders.code_folder_skip_reason(F.lit(p), F.lit(g))) for p, g in (("/a/vendor", False), ("/a/sub", True), ("/a/src", False))] == ["vendored or built code", "submodule or worktree", None]
    assert [one(folders.file_gate(F.lit(p), F.lit(r), F.lit(c), F.lit(k))) for p, r, c, k in (("/A.photoslibrary", True, False, True), ("/A.app", True, False, True), ("/l", False, False, False), ("/c", True, True, False), ("/f", True, False, False))] == ["Photos library", "app or bundle", "link or special file", "in the cloud, not downloaded", None]
    assert [one(folders.is_text(F.lit(bytearray(b)))) for b in (b"plain", b"a\0b", b"\x10\x01")] == [True, False, True]
    assert [one(folders.change_may_matter(F.lit(p), F.lit(d))) for p, d in (("/a/b.txt", False), ("/a/X.app/c.txt", False), ("/a/b.zip", False), ("/a/b", True))] == [True, False, False, True]


def test_result_texts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(results.byte_size(F.lit(n).cast("long"))) for n in (999, 62_400, 2_140_000, 23_000_000)] == ["999 bytes", "62 KB", "2.1 MB", "23 MB"]
    assert [one(results.duration(F.lit(s))) for s in (40.0, 600.0, 9000.0)] == ["40 s", "10 min", "2.5 h"]
    info = F.create_map(*map(F.lit, ("pages", "463", "read_to", "120", "width", "1440", "height", "900")))
    assert one(results.details(F.lit("pdf"), F.lit("Oct 7, 2026"), F.lit(23_000_000).cast("long"), info)) == "PDF · Oct 7, 2026 · 1440 × 900 · 463 pages, 120 read so far · 23 MB"
    assert one(results.folder_text(F.lit("/home/me/a/b.txt"), F.lit("/home/me"))) == "~/a" and one(results.folder_words(F.lit("/home/me/a b/c/d.txt"), F.lit("/home/me"))) == "a b c"
    assert one(results.found_words(F.lit("x «one» y «two» «one»"))) == ["one", "two"]
    assert one(results.highlighted(F.lit("<b> River & rivers"), ["river"])) == "&lt;b&gt; <mark>River</mark> &amp; <mark>river</mark>s"
    assert one(results.place(F.lit("video"), F.lit("audio"), F.lit(25.0), F.lit(None).cast("double"))) == "♪ 0:25"
    assert one(results.location(F.lit("lines"), F.lit(12.0), F.lit(40.0), F.lit(15.0))) == "lines 12–40, opens at 15"


def test_pictures(spark):
    rgb = np.zeros((16, 16, 3), np.uint8)
    rgb[:8] = 255
    d = spark.createDataFrame([(bytearray(rgb.tobytes()), 16, 16), (None, 1, 1)], "p binary, w int, h int")
    assert [r[0] for r in d.select(media.average_hash("p", "w", "h")).collect()] == [(1 << 32) - 1, None]
    assert spark.range(1).select(media.target_size(F.lit(720), F.lit(960), F.lit(140)).alias("t")).select("t.*").first() == (480, 624)
    assert spark.range(1).select(media.scaled_cost(F.lit(10.0), F.lit(4.0), F.lit(8.0))).first()[0] == pytest.approx(1.4)


def test_code_search(spark, tmp_path):
    rows = [(1, 1, "a.py", "x = read_all(1)\n"), (2, 1, "a.py", "\ndef read_all(path):\n    return 1\n"), (3, 2, "b.c", "int read_all(char *p);\n"), (4, 3, "c.py", "all the things to read\n")]
    fts = spark.createDataFrame(rows, "rowid long, file long, name string, body string")
    build(fts, str(tmp_path))
    index = KeywordIndex(spark, str(tmp_path))
    stretches = fts.select("file", F.col("rowid").alias("id"), (F.col("rowid") * 10.0).alias("loc"), F.col("body").alias("text"))
    words = ["read", "all"]
    found = search.search(None, None, index, "read_all", phrase=words, widen=False)
    hits = search.pointed(found).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "file")))
    got = {r["file"]: (r["points_at"], r["focus"]) for r in lookup.code_places(hits, stretches, index, "read_all()", words).collect()}
    assert got == {1: (2, 21), 2: (3, 30)}
    plain = search.pointed(search.search(None, None, index, "things read", widen=False)).withColumn("place", F.lit(1))
    assert {r["file"]: r["focus"] for r in lookup.code_places(plain, stretches, index, "things read", None).collect()}[3] == 40


def test_many_queries_in_one_plan_are_each_query_alone(spark, tmp_path):
    rng = np.random.default_rng(2)
    words = "river stone lamp table window garden cloud seven invoice grokipedia k7q2lm photo".split()
    rows = [(i, i // 2, f"f{i}", " ".join(words[k] for k in rng.integers(0, len(words), 6))) for i in range(60)]
    build(spark.createDataFrame(rows, "rowid long, file long, name string, body string"), str(tmp_path))
    index = KeywordIndex(spark, str(tmp_path))
    vec = lambda: [float(x) for x in rng.normal(size=8)]
    segments = spark.createDataFrame([(i, i // 2, ["image", "doc"][i // 2 % 2], ["text", "image", "audio"][i % 3], i % 9 != 0, vec()) for i in range(60)], "id long, file long, kind string, modality string, sets_scale boolean, vec array<float>")
    vectors = {"river stone": vec(), "photo of a lamp": vec(), "k7q2lm": vec(), "grok window": None, "the": vec()}
    got = {}
    for r in search.search_many(segments, vectors, index, 7).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["file"], pytest.approx(r["score"], abs=1e-6)))
    for query, vector in vectors.items():
        q = spark.createDataFrame([(vector,)], "q array<float>") if vector else None
        hits = search.search(segments, q, index, query, limit=7).orderBy(F.desc("score"), "file").collect()
        assert sorted(got.get(query, []), key=lambda x: x[0]) == [(k, r["file"], r["score"]) for k, r in enumerate(hits, 1)], query


def test_choices_as_tables_equal_the_short_list(spark):
    """Random choices and paths: `standing`, `marks` and `effective` against Selection, and Selection against the definition."""
    import itertools
    import random

    rng, names = random.Random(3), ["a", "b", ".git", "node_modules", "c.noindex"]
    tree = ["/", *("/" + "/".join(p) for n in (1, 2, 3) for p in itertools.product(names, repeat=n))]
    inside = lambda path, folder: path != folder and path.startswith(folder.rstrip("/") + "/")

    def reached(path, top):
        rest = path[len(top.rstrip("/")) + 1 :].split("/")
        return path == top or (inside(path, top) and not any(x.startswith(".") or x.endswith(".noindex") or x == "node_modules" for x in rest))

    for _ in range(6):
        picked = [tuple(rng.sample(tree, rng.randint(0, 4))) for _ in range(3)]
        s = folders.Selection(*picked)
        by = lambda path, top, s=s: reached(path, top) and not any(inside(k, top) and (path == k or inside(path, k)) for k in s.skipped)
        tops = [*s.kept, *s.chosen]
        right = {p: [t for t in tops if by(p, t)] for p in tree}
        assert all(s.searched(p) == bool(right[p]) and s.searched_as(p) == max(right[p], key=len, default=None) for p in tree)
        assert s.folders() == [f for f in dict.fromkeys(tops) if not any(o != f and inside(f, o) and by(f, o) for o in tops)]
        assert s.effective_skips() == [k for k in s.skipped if any(inside(k, f) for f in s.folders())]
        choices = s.table(spark)
        paths = spark.createDataFrame([(p,) for p in tree], "path string")
        rows = {r["path"]: (r["searched"], r["searched_as"]) for r in folders.standing(paths, choices).collect()}
        assert rows == {p: (s.searched(p), s.searched_as(p)) for p in tree}
        marked = {r["folder"]: r["mark"] for r in folders.marks(paths.withColumnRenamed("path", "folder"), choices).collect()}
        assert marked == {p: s.mark(p) for p in tree}
        kept = {(r["folder"], r["choice"]) for r in folders.effective(choices).collect()}
        assert {f for f, c in kept if c != "skipped"} == set(s.folders()) and {f for f, c in kept if c == "skipped"} == set(s.effective_skips())


def test_standing_of_odd_paths(spark):
    choices = spark.createDataFrame([("/a", "chosen"), ("/a", "chosen"), (None, "chosen"), ("/b", None), ("/a/s", "skipped")], folders.CHOICES)
    rows = spark.createDataFrame([("/a/x", 1), (None, 2), ("", 3), ("/ab", 4), ("/a/s/t", 5), ("/a", 6)], "path string, folder int")
    found = folders.standing(rows, choices)
    assert found.columns == ["path", "folder", "searched", "searched_as"]
    assert {r["folder"]: (r["searched"], r["searched_as"]) for r in found.collect()} == {1: (True, "/a"), 2: (False, None), 3: (False, None), 4: (False, None), 5: (False, None), 6: (True, "/a")}
    many = spark.range(5000).select(F.concat(F.lit("/r/"), F.col("id").cast("string")).alias("folder"), F.lit("chosen").alias("choice"))
    plan = folders.standing(rows, many)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000 and folders.standing(rows, many).where("searched").count() == 0
