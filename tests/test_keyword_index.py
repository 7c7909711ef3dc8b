"""Tokens, BM25, phrases and prefixes against SQLite's own full-text index."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F
from sievework.functions.tokens import Tokens, folded, stem
from sievework.operators.keyword_index import KeywordIndex, build

TOKENIZE = "porter unicode61 remove_diacritics 2 categories 'L* N* Co M*'"
WORDS = """caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed
failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization
predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical
hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism
activate angulariti homologous effective bowdlerize probate rate cease controll roll yes yacht syzygy flying dying geology apology running runner easily""".split()


def sqlite_tokens(words):
    c = sqlite3.connect(":memory:")
    c.execute(f'CREATE VIRTUAL TABLE t USING fts5(a, tokenize="{TOKENIZE}")')
    c.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    c.executemany("INSERT INTO t(rowid, a) VALUES (?, ?)", list(enumerate(words, 1)))
    out = {}
    for term, doc in c.execute("SELECT term, doc FROM v ORDER BY doc, offset"):
        out.setdefault(doc - 1, []).append(term)
    return [out.get(i, []) for i in range(len(words))]


def test_tokens_like_sqlite():
    rng = random.Random(5)
    endings = "s es ed ing er ation ational ly ness ful ies eed y al ic ize ator iveness e ll ment ion ous able".split()
    made = ["".join(rng.choice("bcdfglmnprstvwxyaeiou") for _ in range(rng.randint(1, 7))) + "".join(rng.sample(endings, rng.randint(0, 2))) for _ in range(4000)]
    words = [*WORDS, *made, "Café", "naïvely", "ÜBER", "Straße", "éEs", "Ελλάδα", "Привет", "কাজ", "كتاب", "a1b2", "foo_bar", "x-ray", "don't", "s" * 70, "", "12", "ab"]
    tokens = Tokens()
    for word, right in zip(words, sqlite_tokens(words), strict=True):
        assert tokens.of(word) == right, word


def test_stems():
    assert [stem(w) for w in ("running", "cats", "hopping", "relational", "be")] == ["run", "cat", "hop", "relat", "be"]
    assert folded("CAFÉ") == "cafe"


ROWS = [
    (1, 1, "river notes", "The rivers are running to the sea"), (2, 1, None, "river runs"), (3, 2, "Cafés", None), (4, 2, None, None), (5, 3, "sea", "seas and naïve rivers"),
    (6, 3, "", "Grok4 and Grokipedia"), (7, 4, "cat", "a cat in a category"), (8, 5, "x", "quantize_row_q8_0 is called; row quantize"), (9, 6, "y", "running running running"), (10, 7, "z", "the sea the river"),
]


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("keywords"))
    build(spark.createDataFrame(ROWS, "rowid long, file long, name string, body string").repartition(3), folder)
    c = sqlite3.connect(":memory:")
    c.execute(f'CREATE VIRTUAL TABLE fts USING fts5(name, body, tokenize="{TOKENIZE}")')
    c.executemany("INSERT INTO fts(rowid, name, body) VALUES (?, ?, ?)", [(r[0], r[2] or "", r[3] or "") for r in ROWS])
    return KeywordIndex(spark, folder), c


@pytest.mark.parametrize("terms", [["river"], ["rivers", "running"], ["cafe"], ["sea", "naive", "river"], ["zzz", "cat"]])
def test_bm25_like_sqlite(both, terms):
    index, c = both
    found = {r["rowid"]: r["bm25"] for r in index.bm25(index.matched(terms)).collect()}
    right = dict(c.execute("SELECT rowid, bm25(fts, 3.0, 1.0) FROM fts WHERE fts MATCH ?", (" OR ".join(f'"{t}"' for t in terms),)).fetchall())
    assert found == {k: pytest.approx(v, rel=1e-6) for k, v in right.items()}


def test_prefixes_and_phrases_like_sqlite(both):
    index, c = both
    assert index.prefixes(["grok", "cat", "gr"]) == [True, False, False] and index.prefixes(["cat"], typing=True) == [True]
    rows = lambda q: {r[0] for r in c.execute("SELECT rowid FROM fts WHERE fts MATCH ?", (q,))}
    assert {r["rowid"] for r in index.matched(["grok"], [True]).collect()} == rows('"grok" *') == {6}
    for words in (["quantize", "row", "q8", "0"], ["row", "quantize"], ["running", "running"], ["the", "sea"], ["sea", "the"]):
        assert {r["rowid"] for r in index.phrase(words).collect()} == rows('body : "' + " ".join(words) + '"'), words


def test_null_names_and_bodies_are_found(both):
    index, _ = both
    assert {r["rowid"] for r in index.matched(["river"]).where(F.col("bodies") > 0).collect()} == {1, 2, 5, 10}
    assert index.statistics.first()["rows"] == len(ROWS)


def test_a_search_reads_its_tokens_only(both):
    index, _ = both
    plan = index.matched(["river"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "token" in plan[plan.index("PushedFilters") :]
