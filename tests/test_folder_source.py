"""The folder source: what a crawl lists, what a stream gives, also after a restart."""

import json
import os

import pytest
from pyspark.sql import Observation
from sievework.sources import files, folder_source


def tree(root):
    made = {"a.txt": "one", "docs/b.md": "two", "docs/deep/c.txt": "three", "node_modules/x/d.txt": "no", ".git/e.txt": "no", "Photos.photoslibrary/f.jpg": "no", "out/g.txt": "no", "cache/h.txt": "no", "sub/i.txt": "four", "é ü/j[1].txt": "five", "y.noindex/k.txt": "no"}
    for name, text in made.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (root / "cache" / "CACHEDIR.TAG").write_text("Signature: 8a477f597d28d172789f06886806bc55\n# x")
    os.symlink(root / "a.txt", root / "link.txt")
    (root / "empty").mkdir()


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_a_crawl_gives_every_file_once(spark, tmp_path, parts):
    tree(tmp_path)
    folder_source.register(spark)
    rows = spark.read.format("folder").option("parts", parts).option("excluded", json.dumps([str(tmp_path / "out")])).load(str(tmp_path)).collect()
    short = lambda r: os.path.relpath(r["path"], tmp_path)
    assert sorted(short(r) for r in rows if not r["folder"] and not r["reason"]) == ["a.txt", "docs/b.md", "docs/deep/c.txt", "sub/i.txt", "é ü/j[1].txt"]
    assert {short(r): r["reason"] for r in rows if r["reason"]} == {"node_modules": "developer folder", ".git": "hidden folder", "Photos.photoslibrary": "Photos library", "out": "excluded folder", "cache": "cache folder", "y.noindex": ".noindex folder", "link.txt": "link or special file"}
    assert {short(r): r["entries"] for r in rows if r["folder"] and not r["reason"]}["empty"] == 0 and len({r["path"] for r in rows}) == len(rows)
    file = next(r for r in rows if short(r) == "a.txt")
    assert (file["size"], file["inode"], file["device"]) == (3, os.stat(file["path"]).st_ino, os.stat(file["path"]).st_dev)


def test_what_is_not_entered_is_not_listed(tmp_path, monkeypatch):
    tree(tmp_path)
    seen, scandir = [], os.scandir
    monkeypatch.setattr(folder_source.os, "scandir", lambda path: seen.append(os.path.relpath(path, tmp_path)) or scandir(path))
    reader = folder_source.FolderReader({"path": str(tmp_path), "excluded": json.dumps([str(tmp_path / "out")])})
    assert [r for p in reader.partitions() for r in reader.read(p)]
    assert sorted(seen) == [".", "cache", "docs", "docs/deep", "empty", "sub", "é ü"]
    gone = folder_source.FolderReader({"path": str(tmp_path / "none")})
    assert [r[3] for p in gone.partitions() for r in gone.read(p)] == ["not listed: No such file or directory"]


def test_crawl_classifies_and_counts(spark, tmp_path):
    tree(tmp_path)
    seen = Observation("c")
    found = files.crawl(spark, str(tmp_path), progress=seen)
    assert {os.path.basename(r["path"]): (r["action"], r["kind"]) for r in found.collect()}["b.md"] == ("index", "doc")
    assert seen.get["files"] == found.count() == 7 and seen.get["bytes"] > 15


def test_a_stream_goes_on_from_its_offset(spark, tmp_path):
    root, state, checkpoint, got = tmp_path / "r", tmp_path / "s", tmp_path / "c", []
    root.mkdir()
    (root / "a.txt").write_text("one")
    (root / "b.txt").write_text("two")
    folder_source.register(spark)

    def run():
        got.clear()
        stream = spark.readStream.format("folder").option("state", str(state)).load(str(root))
        query = stream.writeStream.foreachBatch(lambda batch, _: got.extend(batch.orderBy("path").collect())).option("checkpointLocation", str(checkpoint)).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return [(os.path.basename(r["path"]), r["change"]) for r in got]

    assert run() == [("a.txt", "added"), ("b.txt", "added")]
    assert run() == []
    (root / "a.txt").write_text("longer")
    os.remove(root / "b.txt")
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.txt").write_text("no")
    (root / "c.txt").write_text("new")
    assert run() == [("a.txt", "changed"), ("b.txt", "removed"), ("c.txt", "added")]


def test_batches_can_be_read_again(tmp_path):
    (tmp_path / "r").mkdir()
    options = {"path": str(tmp_path / "r"), "state": str(tmp_path / "s")}
    stream = folder_source.FolderStream(options)
    offset = stream.initialOffset()
    assert stream.read(offset)[1] == offset
    for k in range(folder_source.SNAPSHOTS + 3):
        (tmp_path / "r" / f"{k}.txt").write_text("x")
        rows, new = stream.read(offset)
        rows = list(rows)
        # A lost batch is the same after a restart, whatever has changed since.
        (tmp_path / "r" / f"{k}.txt").write_text("xy")
        assert list(folder_source.FolderStream(options).readBetweenOffsets(offset, new)) == rows and len(rows) in (1, 2)
        stream.commit(new)
        offset = new
    assert len(os.listdir(tmp_path / "s")) <= folder_source.SNAPSHOTS + 1
    with pytest.raises(ValueError, match="state"):
        folder_source.FolderStream({"path": "/x"})


