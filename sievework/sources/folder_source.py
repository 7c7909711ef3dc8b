"""A folder as a Spark data source: `spark.read.format("folder")` crawls it, `spark.readStream` gives its changes.

A crawl never lists a folder that it doesn't enter: hidden and developer folders, caches, bundles, what was excluded.
The driver lists folders from the top until there are enough of them to share out; tasks walk what lies below. Folders
are rows too, with the number of their entries, or with the reason why they weren't entered.

A stream's offset is the number of a snapshot (path, size, time, inode of every file), which is written to the folder
`state` before the offset is given out. A batch is the difference of two snapshots, so a query that starts again reads
the same batch again, and goes on from its last offset with what has changed meanwhile; the first batch is the whole
folder. Without `state` a stream is refused. A stream lists on the driver, since what it watches is one tree.

The folder must be one that the executors see too. Entries that vanish during a walk are left out; links are rows with a
reason and are not followed; a name that isn't valid Unicode is left out and counted with its folder's entries.
"""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from sievework.operators import folders, rules

ROWS = "path string, folder boolean, entries int, reason string, size long, mtime double, inode long, device long"
CHANGES = "path string, change string, size long, mtime double, snapshot long"
#: Parts that a crawl is shared out to, unless the option `parts` says otherwise; snapshots that a stream keeps.
PARTS, SNAPSHOTS = 64, 8


@dataclass(frozen=True)
class Limits:
    """What a walk doesn't enter."""

    excluded: tuple[str, ...] = ()
    home: str = ""
    code: bool = False

    @classmethod
    def of(cls, options: dict[str, str]) -> Limits:
        return cls(tuple(json.loads(options.get("excluded", "[]"))), options.get("home", ""), options.get("code", "false").lower() == "true")

    def reason(self, path: str) -> str | None:
        """Why a folder below the root isn't entered, by its name and what was excluded."""
        name = os.path.basename(path)
        kind = name.rpartition(".")[2].lower() if "." in name[1:] else ""
        told = [
            (kind in folders.LIBRARIES, "Photos library"),
            (kind in folders.BUNDLES, "app or bundle"),
            (name.startswith("."), "hidden folder"),
            (name in rules.SKIPPED_FOLDERS, "developer folder"),
            (name.endswith(".noindex"), ".noindex folder"),
            (bool(self.home) and path == f"{self.home.rstrip('/')}/Library", "~/Library"),
            (path in self.excluded, "excluded folder"),
            (self.code and name in rules.CODE_SKIPPED_FOLDERS, "vendored or built code"),
        ]
        return next((why for test, why in told if test), None)

    def held_back(self, path: str, names: set[str], root: bool) -> str | None:
        """Why a folder's entries are left alone although it was listed: marks that lie in it."""
        if "CACHEDIR.TAG" in names:
            try:
                with open(os.path.join(path, "CACHEDIR.TAG"), "rb") as f:
                    if f.read(len(folders.CACHE_TAG)) == folders.CACHE_TAG.encode():
                        return "cache folder"
            except OSError:
                pass
        if self.code and not root and ".git" in names and os.path.isfile(os.path.join(path, ".git")):
            return "submodule or worktree"
        return None


def listed(path: str, limits: Limits, root: bool = False) -> tuple[list[tuple], list[str]]:
    """The rows of a folder and its files, and the folders in it that are to be entered."""
    try:
        with os.scandir(path) as found:
            entries = sorted(found, key=lambda e: e.name)
    except OSError as e:
        return [(path, True, None, f"not listed: {e.strerror}", None, None, None, None)], []
    if reason := limits.held_back(path, {e.name for e in entries}, root):
        return [(path, True, None, reason, None, None, None, None)], []
    rows, below = [(path, True, len(entries), None, None, None, None, None)], []
    for e in entries:
        try:
            e.name.encode()
            if e.is_dir(follow_symlinks=False):
                reason = limits.reason(e.path)
                if reason:
                    rows.append((e.path, True, None, reason, None, None, None, None))
                else:
                    below.append(e.path)
                continue
            s = e.stat(follow_symlinks=False)
        except (OSError, UnicodeEncodeError):
            continue
        reason = None if stat.S_ISREG(s.st_mode) else "link or special file"
        inode = s.st_ino - (1 << 64) if s.st_ino >> 63 else s.st_ino
        rows.append((e.path, False, None, reason, s.st_size, s.st_mtime, inode, s.st_dev))
    return rows, below


def walked(path: str, limits: Limits) -> Iterator[tuple]:
    left = [path]
    while left:
        rows, below = listed(left.pop(), limits)
        yield from rows
        left += reversed(below)


@dataclass
class Part(InputPartition):
    """Rows that the driver has found, and folders to walk."""

    rows: list[tuple]
    tops: list[str]

    def __init__(self, rows: list[tuple], tops: list[str]):
        super().__init__(0)
        self.rows, self.tops = rows, tops


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.limits, self.parts = options["path"].rstrip("/") or "/", Limits.of(options), int(options.get("parts", PARTS))

    def partitions(self) -> list[Part]:
        rows, tops = listed(self.root, self.limits, root=True)
        # Level by level, until there are folders for every part, or none with folders in it.
        while tops and len(tops) < self.parts:
            found = [listed(t, self.limits) for t in tops]
            rows += [r for own, _ in found for r in own]
            tops = [b for _, below in found for b in below]
        share = [tops[k :: self.parts] for k in range(self.parts)]
        return [Part(rows, []), *(Part([], some) for some in share if some)]

    def read(self, partition: Part) -> Iterator[tuple]:
        yield from partition.rows
        for top in partition.tops:
            yield from walked(top, self.limits)


class FolderStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        if "state" not in options:
            raise ValueError("the option `state` must name a folder for snapshots")
        self.root, self.limits, self.state = options["path"].rstrip("/") or "/", Limits.of(options), options["state"]
        os.makedirs(self.state, exist_ok=True)

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def _file(self, number: int) -> str:
        return os.path.join(self.state, f"{number:012d}.json")

    def _snapshot(self, number: int) -> dict[str, list]:
        if not number:
            return {}
        with open(self._file(number), encoding="utf-8") as f:
            return json.load(f)

    def _now(self) -> dict[str, list]:
        found, left = {}, [self.root]
        while left:
            path = left.pop()
            rows, below = listed(path, self.limits, root=path == self.root)
            found |= {r[0]: [r[4], r[5], r[6]] for r in rows if not r[1] and r[3] is None}
            left += below
        return found

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        before, now = self._snapshot(start["snapshot"]), self._now()
        if before == now:
            return iter(()), start
        number = start["snapshot"] + 1
        with open(self._file(number) + ".aside", "w", encoding="utf-8") as f:
            json.dump(now, f)
        os.replace(self._file(number) + ".aside", self._file(number))
        # The iterator is copied, which a generator can't be.
        return iter(list(self._between(before, now, number))), {"snapshot": number}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._between(self._snapshot(start["snapshot"]), self._snapshot(end["snapshot"]), end["snapshot"])

    @staticmethod
    def _between(before: dict, now: dict, number: int) -> Iterator[tuple]:
        for path in sorted(before.keys() | now.keys()):
            old, new = before.get(path), now.get(path)
            if old != new:
                change = "removed" if new is None else "added" if old is None else "changed"
                yield (path, change, *(new or old)[:2], number)

    def commit(self, end: dict) -> None:
        """Forgets the snapshots that no batch can ask for any more."""
        for name in os.listdir(self.state):
            if name.endswith(".json") and int(name.removesuffix(".json")) < end["snapshot"] - SNAPSHOTS:
                os.remove(os.path.join(self.state, name))


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        # A stream names its state, a crawl doesn't.
        return CHANGES if "state" in self.options else ROWS

    def reader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))

    def simpleStreamReader(self, schema) -> FolderStream:
        return FolderStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderSource)
