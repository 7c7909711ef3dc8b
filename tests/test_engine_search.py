"""What a search says of its hits: excerpts, typing, folders and types; the best window of a snippet by brute force."""

import random

from sievework.engine import Engine
from sievework.functions import passages
from sievework.operators import folders


def test_search_with_excerpts_folders_and_typing(spark, tmp_path):
    root, store = tmp_path / "docs", tmp_path / "index"
    for name, text in {"a/river.txt": "First words stand here. " * 20 + "The river runs past the old stone mill every single day.", "b/mill.md": "A stone mill stands in the green garden beside the river.", "b/lamp.txt": "A lamp stands on the table beside the window."}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    engine = Engine(spark, str(store))
    engine.index(str(root))
    assert engine.crawled["files"] == 3 and engine.crawled["bytes"] > 500
    rows = engine.search("river stone mill", excerpts=True).collect()
    assert {r["path"].rpartition("/")[2] for r in rows} >= {"river.txt", "mill.md"}
    assert all("«" in r["excerpt"] for r in rows if r["coverage"])
    assert any("«river» runs past the old «stone» «mill»" in r["excerpt"] for r in rows)
    names = lambda hits: {r["path"].rpartition("/")[2] for r in hits.where("coverage > 0").collect()}
    assert names(engine.search("stone mil", typing=True)) == {"river.txt", "mill.md"}
    choices = spark.createDataFrame([(str(root / "b"), "chosen")], folders.CHOICES)
    assert names(engine.search("stone mill", choices=choices)) == {"mill.md"}
    assert names(engine.search("stone mill", types=["md"])) == {"river.txt"}


def test_best_window_by_brute_force():
    rng = random.Random(6)
    for _ in range(400):
        places = sorted((rng.randint(0, 60), rng.randint(0, 3)) for _ in range(rng.randint(1, 25)))
        width = rng.randint(1, 15)
        held = lambda at: [t for p, t in places if at <= p < at + width]  # noqa: B023, E731
        right = max(sorted({p for p, _ in places}), key=lambda at: (len(set(held(at))), -at))
        assert passages._best_window(places, width) == right


def test_snippets_hold_most_terms():
    text = "alpha stands here " + "and so on " * 20 + "then beta and alpha meet gamma near the end of it all"
    assert passages.snippet(text, ["alpha", "beta", "gamma"]) == "…and so on then «beta» and «alpha» meet «gamma» near the end of…"
    assert passages.snippet("x alpha", ["alpha"]) == "x «alpha»"
