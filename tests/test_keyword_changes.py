"""The keyword index after changes against one built anew; the best rows against the full ranking."""

import os
import random

import pytest
from pyspark.sql import functions as F
from sievework.operators import keyword_index as K
from sievework.operators.keyword_index import KeywordIndex, build
from sievework.plans import delta

SCHEMA = "rowid long, file long, name string, body string"


def prose(rng, n=None):
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(0, 60) if n is None else n)]
    return " ".join(words) + rng.choice(["", " Running rivers", " naïve Café"])


def ranking(index, terms, prefixes=None):
    return [(r["rowid"], pytest.approx(r["bm25"], rel=1e-9)) for r in index.bm25(index.matched(terms, prefixes), terms, prefixes).orderBy("bm25", "rowid").collect()]


def test_changes_equal_a_full_build_and_write_what_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "BUCKET", 8)
    rng = random.Random(8)
    texts = {i: (i // 2, rng.choice(["name river", None, "w1"]), prose(rng)) for i in range(400)}
    texts[7] = (3, None, None)
    frame = lambda some: spark.createDataFrame([(i, *texts[i]) for i in some], SCHEMA).repartition(3)
    ids = lambda some: spark.createDataFrame([(i,) for i in some], "rowid long")
    index = KeywordIndex(spark, str(tmp_path / "changed"))
    index.update(frame(texts))
    sizes = lambda: sum(p["bytes"] for t in index.store.versions()["tables"].values() for p in (*t["parts"], *t["gone"]))
    monkeypatch.setattr(delta, "FIRST", 4000)
    whole = sizes()
    for step in range(3):
        going, again, coming = rng.sample(sorted(texts), 12), rng.sample(sorted(texts), 14), range(1000 + 20 * step, 1010 + 20 * step)
        for i in going:
            texts.pop(i)
        again = [i for i in again if i in texts]
        texts |= {i: (i // 2, "again", prose(rng)) for i in (*again, *coming)}
        index.update(frame([*again, *coming]), ids([*going, *again]))
        if step == 0:
            assert sizes() - whole < whole / 3
        build(frame(texts), str(tmp_path / f"new{step}"))
        new = KeywordIndex(spark, str(tmp_path / f"new{step}"))
        assert index.figures == pytest.approx(new.figures)
        table = lambda x: {tuple(r) for r in x.words.collect()}
        assert table(index) == table(new)
        posted = lambda x: {(r["token"], r["rowid"], r["names"], r["bodies"], r["length"], tuple(r["places"])) for r in x.postings.collect()}
        assert posted(index) == posted(new)
        for terms in (["w1", "river"], ["w2", "w3", "cafe"], ["again", "zzz"]):
            assert ranking(index, terms) == ranking(new, terms)
        assert ranking(index, ["w1", "riv"], [False, True]) == ranking(new, ["w1", "riv"], [False, True])
        assert {tuple(r) for r in index.phrase(["running", "rivers"]).collect()} == {tuple(r) for r in new.phrase(["running", "rivers"]).collect()}
    assert len(index.store.versions()["tables"]["blocks"]["parts"]) <= delta.FANOUT


def test_merged_parts_keep_bounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "BUCKET", 4)
    rng, index = random.Random(2), KeywordIndex(spark, str(tmp_path))
    for step in range(5):
        index.update(spark.createDataFrame([(100 * step + i, i, "n", prose(rng)) for i in range(30)], SCHEMA), spark.createDataFrame([(100 * (step - 1) + 3,)], "rowid long"))
    assert len(index.store.versions()["tables"]["blocks"]["parts"]) < 5
    x = index.blocks.select("token", "bucket", "n", "uses", "strongest", "shortest", F.explode("postings").alias("p")).groupBy("token", "bucket").agg(*[F.first(c).alias(c) for c in ("n", "uses", "strongest", "shortest")], F.count("p").alias("m"), F.sum(F.col("p.names") + F.col("p.bodies")).alias("u"), F.max(3 * F.col("p.names") + F.col("p.bodies")).alias("s"), F.min("p.length").alias("l"))
    assert x.where("n <> m or uses <> u or strongest <> s or shortest <> l or n > 4").count() == 0 and x.count() > 100


@pytest.mark.parametrize("terms", [["w1", "rare"], ["w1"], ["w1", "w2", "w3", "river"], ["w1", "w1"], ["zzz"], ["rare", "zzz"]])
def test_the_best_rows_equal_the_full_ranking(spark, posted, terms):
    full = ranking(posted, terms)
    for k in (1, 20, 100):
        got = [(r["rowid"], r["bm25"]) for r in posted.top(terms, k, small=0).collect()]
        assert got == full[:k], k


@pytest.fixture(scope="module")
def posted(spark, tmp_path_factory):
    rng = random.Random(6)
    rows = [(i, i // 3, rng.choice(["a", "river"]), prose(rng, rng.choice([1, 5, 40, 200])) + (" rare" if i % 333 == 5 else "")) for i in range(3000)]
    folder = str(tmp_path_factory.mktemp("posted"))
    build(spark.createDataFrame(rows, SCHEMA).repartition(2), folder)
    index = KeywordIndex(spark, folder)
    gone = [r[0] for r in rows[::17]]
    index.update(removed=spark.createDataFrame([(g,) for g in gone], "rowid long"))
    return index


def test_fewer_rows_are_read_for_the_best(posted, monkeypatch):
    """Of a frequent and a rare term only buckets that can hold one of the best are read."""
    read = []
    matched = KeywordIndex._matched

    def counted(self, blocks, *more):
        read.append(blocks)
        return matched(self, blocks, *more)

    monkeypatch.setattr(KeywordIndex, "_matched", counted)
    assert posted.top(["w1", "rare"], 20, small=0).count() == 20
    postings = lambda b: b.where("token in ('w1', 'rare')").agg(F.sum("n")).first()[0] or 0
    assert sum(map(postings, read)) < 0.8 * postings(posted.blocks)


def test_frequencies_read_no_posting(posted):
    plan = posted._table("words").where(F.col("token").isin(["w1"]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(token), EqualTo(token,w1)]" in plan.replace("In(token, [w1])", "EqualTo(token,w1)") and "postings" not in plan
    assert posted.known(["w1", "zzz"]) == [True, False] and posted.begun("riv").first()["token"] == "river"
    assert os.path.isdir(posted.store.folder)


def shuffled(spark):
    """Bytes that the session's stages have shuffled and spilled."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() + stages.apply(i).memoryBytesSpilled() for i in range(stages.size()))


def test_a_build_shuffles_the_vocabulary_only(spark, tmp_path):
    rng = random.Random(3)
    texts = spark.createDataFrame([(i, i, "n", " ".join(f"w{rng.randint(0, 300)}" for _ in range(400))) for i in range(800)], SCHEMA).repartition(4).localCheckpoint()
    assert texts.count() == 800
    before = shuffled(spark)
    build(texts, str(tmp_path))
    written = sum(p["bytes"] for p in KeywordIndex(spark, str(tmp_path)).store.versions()["tables"]["blocks"]["parts"])
    assert written > 500_000 and shuffled(spark) - before < written / 4
    assert not [f for f in os.listdir(tmp_path) if f.startswith("aside-")]
    index = KeywordIndex(spark, str(tmp_path))
    assert index.words.agg(F.sum("uses")).first()[0] == 800 * 401 == index.figures[0] * index.figures[1]


def test_removed_rows_are_hashed_not_sorted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "SENT", 3)
    rng, index, plans = random.Random(4), KeywordIndex(spark, str(tmp_path)), []
    index.update(spark.createDataFrame([(i, i, "n", prose(rng)) for i in range(60)], SCHEMA))
    monkeypatch.setattr(delta.Change, "delete", lambda self, name, keys: plans.append(keys._jdf.queryExecution().executedPlan().toString()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for n in (2, 20):
            index.remove(index.store.begin(), spark.createDataFrame([(i,) for i in range(n)], "rowid long"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in "".join(plans)
    assert "BroadcastHashJoin" in plans[0] and "ShuffledHashJoin" in plans[-1]
