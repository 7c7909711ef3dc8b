"""Snippets, code lookup, embedding, and an index from a folder to ranked hits."""

import os
import shutil
import tempfile

from pyspark.sql import functions as F

from sievework.engine import Engine
from sievework.functions import code, embedding, passages


def test_spans_and_snippets():
    text = "Das Café liegt am Fluss, und das CAFE ist schön."
    assert [text[a:b] for a, b in passages.spans("cafe", text)] == ["Café", "CAFE"]
    assert passages.spans("fl", text) == []
    assert passages.snippet(text, ["fluss"], 6) == "…liegt am «Fluss», und das CAFE ist…"
    assert passages.snippet(text, ["nothing"]) is None
    assert passages.landmark(2, ["Tanaka paid", "Tanaka and Yoshida paid"], ["tanaka", "yoshida"]) == "Yoshida"
    assert passages.landmark(1, ["a"], ["a"]) is None


def test_page_problem(spark):
    bad = "".join(chr(0x9BF) + chr(0x995) for _ in range(12))
    good = "".join(chr(0x995) + chr(0x9BF) for _ in range(12))
    lost = "ا?ر ا.ب"
    got = [r[0] for r in spark.createDataFrame([(bad,), (good,), (lost,), ("plain",)], "t string").select(passages.page_problem(F.col("t"))).collect()]
    assert got == ["glyphOrder", None, "lostLetters", None]


def test_definitions():
    assert code.definition("retry", "x = retry()\ndef retry(n):\n    return retry(n)") == (2, 2)
    assert code.definition("gguf_open", "int gguf_open(const char * name);\nstatic int gguf_open(const char * name) {") == (2, 2)
    assert code.definition("gguf_open", "int gguf_open(const char * name);") == (1, 1)
    assert code.definition("run", "await run(x)\nreturn run(y)\nfoo.run(z)") is None
    assert code.definition("Serve", "func (s *Server) Serve(l int) error {", 7) == (7, 2)
    assert code.first_line(["retry"], "# retry here\nlog(retryWithBackoff)\ndef retry_with_backoff():", 10) == 12
    assert code.first_line(["retry"], "# retry here\nlog(retryWithBackoff)") == 2
    assert code.first_line(["try"], "retry") is None
    assert code.summary("# note\n\nx = 1\nclass A:\n    pass") == "class A:"


def test_embedding_isolates_errors(spark):
    class Picky(embedding.HashEmbedder):
        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("bad text")
            return super().embed(texts)

    rows = spark.createDataFrame([(1, "fine"), (2, "bad"), (3, None)], "id long, text string").coalesce(1)
    got = {r["id"]: (r["vec"] is not None, r["error"]) for r in embedding.embedded(rows, "text", Picky).collect()}
    assert got == {1: (True, None), 2: (False, "bad text"), 3: (True, None)}


def test_index_and_search(spark):
    root, store = tempfile.mkdtemp(), tempfile.mkdtemp()
    for name, text in {"river.txt": "The river runs past the old stone mill every day.", "lamp.md": "A lamp stands on the table beside the window.", "notes.txt": "Invoice k7q2lm was paid in March by the tenant."}.items():
        with open(f"{root}/{name}", "w") as f:
            f.write(text)
    engine = Engine(spark, store)
    assert {r["change"]: r["n"] for r in engine.index(root).collect()} == {"added": 3}
    assert {(r["kind"], r["state"]): r["n"] for r in engine.status().collect()} == {("doc", "done"): 3}
    assert os.path.basename(engine.search("stone mill river").first()["path"]) == "river.txt"
    assert [os.path.basename(r["path"]) for r in engine.search("k7q2lm").collect()] == ["notes.txt"]
    os.remove(f"{root}/lamp.md")
    assert {r["change"]: r["n"] for r in engine.index(root).collect()} == {"unchanged": 2, "removed": 1}
    assert engine.index_tables.table("fts").select("file").distinct().count() == 2
    expected = spark.createDataFrame([("stone mill", "t", f"{root}/river.txt", None, None)], "query string, tag string, path string, first int, last int")
    assert {r["tag"]: r["r1"] for r in engine.evaluate(expected).collect()} == {"t": 1.0, "ALL": 1.0}
    shutil.rmtree(root)
