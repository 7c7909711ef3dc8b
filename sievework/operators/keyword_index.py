"""The stored keyword index: postings in blocks by token, a vocabulary with frequencies, changed by what changes.

Three tables of a `DeltaStore`:

- blocks: the postings (rowid, file, names, bodies, length, places) that a token has in one bucket of rows, with the
  greatest weighted use and the least row length among them, from which follows the greatest score that they can have;
- rows: each row's file, length, and tokens with their uses, so that a row can be taken out without its text;
- words: each token's rows and uses; changes add differences, also negative ones.

Buckets hold rows of like length, so that a bucket's bound is close. Tasks cut texts into tokens batch by batch, each
distinct word once, and give whole blocks in runs that are sorted by token and row length. Blocks and rows are written
as they are cut, in one job: of a build only the vocabulary is shuffled. A change writes blocks, rows and words of its
own rows, and the keys of what goes; parts are merged level by level, which sorts them as a whole. The number of rows and
their whole length are figures of the store, kept by differences.

A search filters blocks by its tokens, which reaches the Parquet scan and its small pages; document frequencies come from
the words alone, and no search reads a text. For the best rows (`top`), blocks' bounds are added up by bucket: buckets are read from the
highest sum downwards until no other can hold a row of the best.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.text import INFLECTING
from sievework.functions.tokens import TOKEN, Tokens
from sievework.plans.delta import Change, DeltaStore

from .postings import K1, LEAST_IDF, NAME_WEIGHT, B

POSTING = "struct<rowid:long,file:long,names:int,bodies:int,length:int,places:array<int>>"
SCHEMAS = {
    "blocks": f"token string, bucket long, n int, uses long, strongest double, shortest int, postings array<{POSTING}>",
    "rows": "rowid long, file long, length int, tokens array<struct<token:string,uses:int>>",
    "words": "token string, docs long, uses long",
}
KEYS = {"blocks": "rowid", "rows": "rowid"}
#: Rows of a bucket; characters that a task cuts at once; bits of a bucket's number for its part and task.
BUCKET, CHARS, PART_BITS, TASK_BITS = 64, 4 << 20, 44, 24
#: Postings of a search that are read without looking at bounds; share of the postings read first otherwise.
SMALL, SHARE = 1_000_000, 16
#: Frequencies that an index remembers; rows that go and are broadcast at most.
SEEN, SENT = 10_000, 250_000
_CUT = "kind string, token string, bucket long, n int, uses long, strongest double, shortest int, postings array<" + POSTING + ">, rowid long, file long, length int, tokens array<struct<token:string,uses:int>>"


def _offsets(starts: np.ndarray, total: int) -> pa.Array:
    return pa.array(np.append(starts, total).astype(np.int32))


def _cut(table: pa.Table, tokens: Tokens, first_bucket: int, size: int = BUCKET) -> tuple[pa.RecordBatch, pa.RecordBatch, int]:
    """Blocks and rows of some texts (rowid, file, name, body), and the number of their buckets."""
    rows, words, counts = table.num_rows, [], np.zeros((2, table.num_rows), np.int64)
    for field in (0, 1):
        for i, text in enumerate(table.column(2 + field).to_pylist()):
            found = TOKEN.findall(text) if text else []
            counts[field, i] = len(found)
            words += found
    # Each distinct word is folded and stemmed once.
    coded = pa.array(words, pa.string()).dictionary_encode()
    known = [tokens.one(w) for w in coded.dictionary.to_pylist()]
    names = sorted(set(known))
    number = {t: i for i, t in enumerate(names)}
    code = np.array([number[t] for t in known], np.int64)[coded.indices.to_numpy()] if words else np.zeros(0, np.int64)
    row, field = np.concatenate([np.repeat(np.arange(rows), c) for c in counts]), np.repeat(np.arange(2), counts.sum(1))
    if names and names[0] == "":
        code, row, field = (x[code > 0] for x in (code, row, field))
    length = np.bincount(row, minlength=rows)
    starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(row + rows * field, minlength=2 * rows))])
    place = np.arange(len(code)) - starts[row + rows * field]
    # Rows by length; a bucket is a run of them.
    ranked = np.lexsort((np.arange(rows), length))
    rank = np.empty(rows, np.int64)
    rank[ranked] = np.arange(rows)
    order = np.lexsort((place, field, rank[row], code))
    code, at, field, place = code[order], rank[row[order]], field[order], place[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (at[1:] != at[:-1])
    begin = np.flatnonzero(new)
    in_body = np.add.reduceat(field, begin) if len(begin) else begin
    used = np.diff(np.append(begin, len(code)))
    token, at = code[begin], at[begin]
    own = table.take(pa.array(ranked))
    lengths = length[ranked]
    body_places = np.concatenate([np.zeros(1, np.int64), np.cumsum(in_body)])[:-1] if len(begin) else begin
    places = pa.ListArray.from_arrays(_offsets(body_places, int(in_body.sum()) if len(begin) else 0), pa.array(place[field == 1].astype(np.int32)))
    take = pa.array(at)
    postings = pa.StructArray.from_arrays(
        [own.column(0).combine_chunks().take(take), own.column(1).combine_chunks().take(take), pa.array((used - in_body).astype(np.int32)), pa.array(in_body.astype(np.int32)), pa.array(lengths[at].astype(np.int32)), places],
        ["rowid", "file", "names", "bodies", "length", "places"],
    )
    bucket = at // size
    block = np.ones(len(token), bool)
    block[1:] = (token[1:] != token[:-1]) | (bucket[1:] != bucket[:-1])
    heads = np.flatnonzero(block)
    reduced = lambda f, x: f.reduceat(x, heads) if len(heads) else x
    strength = NAME_WEIGHT * (used - in_body) + in_body
    vocabulary = pa.array(names, pa.string())
    n, none = len(heads), lambda kind, k: pa.nulls(k, kind)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.struct([("token", pa.string()), ("uses", pa.int32())])))
    blocks = [vocabulary.take(pa.array(token[heads])), pa.array(first_bucket + bucket[heads]), pa.array(np.diff(np.append(heads, len(token))).astype(np.int32)), pa.array(reduced(np.add, used).astype(np.int64)), pa.array(reduced(np.maximum, strength).astype(np.float64)), pa.array(reduced(np.minimum, lengths[at]).astype(np.int32)), pa.ListArray.from_arrays(_offsets(heads, len(token)), postings)]
    by_row = np.argsort(at, kind="stable")
    per_row = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(at, minlength=rows))])
    forward = pa.ListArray.from_arrays(pa.array(per_row.astype(np.int32)), pa.StructArray.from_arrays([vocabulary.take(pa.array(token[by_row])), pa.array(used[by_row].astype(np.int32))], ["token", "uses"]))
    rest = [own.column(0).combine_chunks(), own.column(1).combine_chunks(), pa.array(lengths.astype(np.int32)), forward]
    heading = ["kind", "token", "bucket", "n", "uses", "strongest", "shortest", "postings", "rowid", "file", "length", "tokens"]
    whole = lambda kind, arrays: pa.RecordBatch.from_arrays([pa.array([kind] * len(arrays[0]), pa.string()), *arrays], heading)
    return whole("blocks", [*blocks, *(none(k, n) for k in kinds)]), whole("rows", [*(none(b.type, rows) for b in blocks), *rest]), -(-rows // size)


def tokenized(rows: DataFrame, number: int) -> DataFrame:
    """Blocks and rows, by `kind`, of rows (rowid, file, name, body); null texts are empty. A bucket's number holds that of
    the part, of the task, and a count."""

    bucket_rows, most = BUCKET, CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held, size = Tokens(), [], 0
        bucket = (number << PART_BITS) + (TaskContext.get().partitionId() << TASK_BITS)
        for batch in batches:
            for low in range(0, batch.num_rows, bucket_rows):
                held.append(batch.slice(low, bucket_rows))
                size += held[-1].nbytes
                if size >= most:
                    blocks, own, used = _cut(pa.Table.from_batches(held), tokens, bucket, bucket_rows)
                    yield from (blocks, own)
                    bucket, held, size = bucket + used, [], 0
        if held:
            blocks, own, _ = _cut(pa.Table.from_batches(held), tokens, bucket, bucket_rows)
            yield from (blocks, own)

    rows = rows.select(F.col("rowid").cast("long"), F.col("file").cast("long"), "name", "body")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    # A table in fewer pieces than there are cores is dealt out first.
    return (rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows).mapInArrow(run, _CUT)


def score(strength: Column, length: Column, idf: Column, mean: float) -> Column:
    """A token's part of a row's BM25, as a positive number. It grows with the uses and falls with the length."""
    return idf * strength * (K1 + 1) / (strength + K1 * (1 - B + B * length / mean))


def idf(df: Column, rows: int) -> Column:
    return F.greatest(F.log((F.lit(float(rows)) - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))


class KeywordIndex:
    """The index in a folder of its own, or in the tables `names` of another store."""

    def __init__(self, spark: SparkSession, folder: str | None = None, store: DeltaStore | None = None, names: dict[str, str] | None = None, state: dict | None = None):
        self.spark, self.names = spark, names or {n: n for n in SCHEMAS}
        self.store = store or DeltaStore(spark, folder, SCHEMAS, KEYS)
        self.state = state or self.store.versions()
        self._tokens, self._seen = Tokens(), {}

    # --- changing ---------------------------------------------------------------------------------------------------

    def _table(self, name: str) -> DataFrame:
        return self.store.table(self.names[name], self.state)

    def remove(self, change: Change, rowids: DataFrame) -> None:
        """Takes out rows (rowid)."""
        rows = change.table(self.names["rows"])
        ids = rowids.select(F.col("rowid").alias("gone_rowid")).distinct()
        # Hashed, not sorted: only the few columns of `ids` are held, and the rows with their tokens stream by.
        ids = F.broadcast(ids) if ids.count() <= SENT else ids.hint("shuffle_hash")
        going = rows.join(ids, rows["rowid"].eqNullSafe(F.col("gone_rowid")), "left_semi")
        count, length = going.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        if count:
            words = going.select(F.explode("tokens").alias("t")).groupBy("t.token").agg((-F.count(F.lit(1))).alias("docs"), (-F.sum("t.uses")).alias("uses"))
            change.append(self.names["words"], words)
            change.delete(self.names["rows"], going.select("rowid"))
            change.delete(self.names["blocks"], going.select("rowid"))
            change.add(keyword_rows=-count, keyword_length=-int(length))

    def add(self, change: Change, rows: DataFrame) -> None:
        """Adds rows (rowid, file, name, body). Texts are cut into tokens once and written once; counting reads what was
        written."""
        blocks, own = change.append_apart({n: self.names[n] for n in ("blocks", "rows")}, tokenized(rows, change.number), "kind")
        change.append(self.names["words"], sorted_words(blocks.groupBy("token").agg(F.sum("n").alias("docs"), F.sum("uses").alias("uses"))))
        count, length = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        change.add(keyword_rows=count, keyword_length=int(length))

    def update(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """A change of its own: rows that go (rowid), then rows (rowid, file, name, body) that come."""
        change = self.store.begin()
        if removed is not None:
            self.remove(change, removed)
        if added is not None:
            self.add(change, added)
        change.commit()
        self.compact()

    def compact(self) -> None:
        """Merges parts where a level is full."""
        ways = {"blocks": lambda rows: sorted_blocks(reblocked(self.live(rows.withColumn("x", F.explode("postings"))))), "rows": None, "words": lambda rows: sorted_words(rows.groupBy("token").agg(F.sum("docs").alias("docs"), F.sum("uses").alias("uses")).where("docs <> 0 or uses <> 0"))}
        for name, merge in ways.items():
            self.state = self.store.versions()
            while self.store.compact(self.names[name], merge):
                self.state = self.store.versions()
        self.state, self._seen = self.store.versions(), {}

    # --- reading ----------------------------------------------------------------------------------------------------

    @property
    def blocks(self) -> DataFrame:
        return self.store.raw(self.names["blocks"], self.state)

    def live(self, spread: DataFrame) -> DataFrame:
        """Of blocks' postings `x` those whose rows count."""
        gone = self.store.gone(self.names["blocks"], self.state)
        if gone is None:
            return spread
        gone = gone.withColumnRenamed("rowid", "gone_rowid")
        return spread.join(gone, spread["x.rowid"].eqNullSafe(gone["gone_rowid"]) & (spread["part_number"] < gone["until"]), "left_anti")

    def _spread(self, blocks: DataFrame) -> DataFrame:
        return self.live(blocks.select("token", "bucket", "part_number", F.explode("postings").alias("x"))).select("token", "bucket", "x.*")

    @property
    def postings(self) -> DataFrame:
        """token, rowid, file, names, bodies, length, places."""
        return self._spread(self.blocks).drop("bucket")

    @property
    def words(self) -> DataFrame:
        """token, docs, uses: the vocabulary."""
        return self._table("words").groupBy("token").agg(F.sum("docs").alias("docs"), F.sum("uses").alias("uses")).where("docs > 0")

    @property
    def figures(self) -> tuple[int, float]:
        """The number of rows and their mean length."""
        known = self.store.figures(self.state)
        rows = int(known.get("keyword_rows", 0))
        return rows, known.get("keyword_length", 0) / rows if rows else 0.0

    @property
    def statistics(self) -> DataFrame:
        return self.spark.createDataFrame([self.figures], "rows long, mean double")

    def tokens(self, terms: list[str]) -> list[str]:
        """Each term's token; one that is cut in several is a phrase, of which the first counts."""
        return [(self._tokens.of(t) or [""])[0] for t in terms]

    def frequencies(self, tokens: list[str]) -> dict[str, int]:
        """The rows that hold each token, from the words; a token that no row holds isn't there."""
        asked = sorted({t for t in tokens if t and t not in self._seen})
        if asked:
            rows = self._table("words").where(F.col("token").isin(asked)).groupBy("token").agg(F.sum("docs").alias("docs")).collect()
            if len(self._seen) > SEEN:
                self._seen.clear()
            self._seen |= dict.fromkeys(asked, 0) | {r["token"]: r["docs"] for r in rows}
        return {t: n for t in tokens if t and (n := self._seen[t]) > 0}

    def _wanted(self, tokens: list[str], prefixes: list[bool]) -> Column:
        exact = sorted({t for t, p in zip(tokens, prefixes, strict=True) if t and not p})
        wanted = F.col("token").isin(exact) if exact else F.lit(False)
        for token in sorted({t for t, p in zip(tokens, prefixes, strict=True) if t and p}):
            wanted = wanted | F.col("token").startswith(token)
        return wanted

    @staticmethod
    def _terms(tokens: list[str], prefixes: list[bool]) -> Column:
        """The numbers of the terms that a token stands for."""
        numbers = [F.when(F.col("token").startswith(t) if p else F.col("token") == t, F.lit(i)) for i, (t, p) in enumerate(zip(tokens, prefixes, strict=True)) if t]
        return F.array_compact(F.array(*numbers)) if numbers else F.array().cast("array<int>")

    def _matched(self, blocks: DataFrame, tokens: list[str], prefixes: list[bool], files: DataFrame | None = None) -> DataFrame:
        rows = self._spread(blocks.where(self._wanted(tokens, prefixes))).withColumn("term", F.explode(self._terms(tokens, prefixes)))
        if files is not None:
            rows = rows.join(files.select("file"), "file", "left_semi")
        rows = rows.select("term", "rowid", "file", "names", "bodies", "length")
        # Without prefixes a row has one posting for a term.
        return rows.groupBy("term", "rowid", "file").agg(F.sum("names").alias("names"), F.sum("bodies").alias("bodies"), F.first("length").alias("length")) if any(prefixes) else rows

    def matched(self, terms: list[str], prefixes: list[bool] | None = None, files: DataFrame | None = None) -> DataFrame:
        """term (its number), rowid, file, names, bodies, length of the postings of some terms."""
        return self._matched(self.blocks, self.tokens(terms), prefixes or [False] * len(terms), files)

    def _dfs(self, found: DataFrame, terms: list[str], prefixes: list[bool]) -> list[int]:
        """The rows of each term: from the words, and for prefixes from the matched rows."""
        tokens = self.tokens(terms)
        whole = self.frequencies([t for t, p in zip(tokens, prefixes, strict=True) if not p])
        begun = [i for i, p in enumerate(prefixes) if p]
        counted = {r["term"]: r["n"] for r in found.where(F.col("term").isin(begun)).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()} if begun else {}
        return [counted.get(i, 0) if p else whole.get(t, 0) for i, (t, p) in enumerate(zip(tokens, prefixes, strict=True))]

    def _idfs(self, dfs: list[int]) -> Column:
        """A term's weight, as an expression over `term`."""
        weights = F.array(*[idf(F.lit(float(n)), self.figures[0]) for n in dfs])
        return F.element_at(weights, F.col("term") + 1)

    def _scored(self, found: DataFrame, dfs: list[int]) -> DataFrame:
        part = score(NAME_WEIGHT * F.col("names") + F.col("bodies"), F.col("length"), self._idfs(dfs), self.figures[1])
        return found.groupBy("rowid", "file").agg((-F.sum(part)).alias("bm25"))

    def bm25(self, found: DataFrame, terms: list[str] | None = None, prefixes: list[bool] | None = None) -> DataFrame:
        """rowid, file, bm25 (smaller is better) of `matched` rows. With the terms, their frequencies come from the words;
        without, from what was found."""
        if terms is not None:
            return self._scored(found, self._dfs(found, terms, prefixes or [False] * len(terms)))
        df = found.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
        rows, mean = self.figures
        part = score(NAME_WEIGHT * F.col("names") + F.col("bodies"), F.col("length"), idf(F.col("df"), rows), mean)
        return found.join(df, "term").groupBy("rowid", "file").agg((-F.sum(part)).alias("bm25"))

    def top(self, terms: list[str], k: int, prefixes: list[bool] | None = None, small: int = SMALL) -> DataFrame:
        """rowid, file, bm25 of the best k rows: the first of the full ranking, by (bm25, rowid).

        With more postings than `small`, the buckets' bounds are added up from the blocks' heads, which leaves postings
        unread. Buckets with the highest sums are scored first; the k-th score among them is one that the answer's last
        row has at least, so that buckets whose sum is below it hold no row of the answer. Blocks of a token lie by row
        length, and the longest length that is still wanted reaches the scan as a filter."""
        prefixes = prefixes or [False] * len(terms)
        tokens = self.tokens(terms)
        counts = self.frequencies(tokens)
        if any(prefixes) or sum(counts.values()) <= small:
            found = self._matched(self.blocks, tokens, prefixes)
            return self._scored(found, self._dfs(found, terms, prefixes)).orderBy("bm25", "rowid").limit(k)
        dfs = [counts.get(t, 0) for t in tokens]
        blocks = self.blocks.where(self._wanted(tokens, prefixes))
        heads = blocks.select("token", "bucket", "strongest", "shortest")
        bound = score(F.col("strongest"), F.col("shortest"), self._idfs(dfs), self.figures[1])
        # A little more than the sum, against rounding.
        bounds = heads.withColumn("term", F.explode(self._terms(tokens, prefixes))).groupBy("bucket").agg((F.sum(bound) * (1 + 1e-9)).alias("bound"))
        cut = bounds.select(F.percentile_approx("bound", 1 - 1 / SHARE, 10_000)).first()[0]

        def best(of: Column) -> DataFrame:
            some = bounds.where(of).select("bucket")
            longest = heads.join(some, "bucket", "left_semi").groupBy("token").agg(F.max("shortest").alias("most")).collect()
            near = F.lit(False)
            for r in longest:
                near = near | ((F.col("token") == r["token"]) & (F.col("shortest") <= r["most"]))
            found = self._matched(blocks.where(near).join(some, "bucket", "left_semi"), tokens, prefixes)
            return self._scored(found, dfs).orderBy("bm25", "rowid").limit(k)

        first = best(F.col("bound") >= cut).collect()
        least = -first[-1]["bm25"] if len(first) == k else 0.0
        rest = best((F.col("bound") < cut) & (F.col("bound") >= least))
        return self.spark.createDataFrame(first, "rowid long, file long, bm25 double").unionByName(rest).orderBy("bm25", "rowid").limit(k)

    def coverage(self, found: DataFrame, files: DataFrame, terms: int) -> DataFrame:
        held = found.join(F.broadcast(files.select("file")), "file", "left_semi")
        return held.groupBy("file").agg((F.countDistinct("term") / F.lit(float(terms))).alias("coverage"))

    def known(self, terms: list[str]) -> list[bool]:
        """Which terms stand in the index, from the words."""
        tokens = self.tokens(terms)
        there = self.frequencies(tokens)
        return [t in there for t in tokens]

    def prefixes(self, terms: list[str], typing: bool = False, widen: bool = True) -> list[bool]:
        """Terms searched as prefixes: the last one while typing, those of inflecting scripts, and those of three letters
        or more that stand nowhere."""
        known = self.known(terms) if widen and terms else [True] * len(terms)
        return [bool(re.search(INFLECTING, t)) or (typing and i == len(terms) - 1) or (len(t) >= 3 and not k) for i, (t, k) in enumerate(zip(terms, known, strict=True))]

    def begun(self, prefix: str) -> DataFrame:
        """token, docs, uses of the words that begin with a prefix, most frequent first; no posting is read."""
        return self.words.where(F.col("token").startswith(prefix)).orderBy(F.desc("docs"), "token")

    def phrase(self, words: list[str], files: DataFrame | None = None) -> DataFrame:
        """rowid, file of rows whose body has the words side by side."""
        tokens = [t for w in words for t in self._tokens.of(w)]
        if not tokens:
            return self.postings.where("false").select("rowid", "file")
        rows = self._spread(self.blocks.where(F.col("token").isin(sorted(set(tokens))))).where(F.size("places") > 0)
        if files is not None:
            rows = rows.join(files.select("file"), "file", "left_semi")
        less = lambda k: lambda place: place - k
        begins = [F.when(F.col("token") == t, F.transform("places", less(k))) for k, t in enumerate(tokens)]
        # A beginning counts once for each of the phrase's places that fits it.
        spread = rows.select("rowid", "file", F.explode(F.flatten(F.array_compact(F.array(*begins)))).alias("at"))
        whole = spread.groupBy("rowid", "file", "at").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(tokens))
        return whole.select("rowid", "file").distinct()


def sorted_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.repartitionByRange("token", "shortest", "bucket").sortWithinPartitions("token", "shortest", "bucket")


def sorted_words(words: DataFrame) -> DataFrame:
    return words.repartitionByRange("token").sortWithinPartitions("token")


def reblocked(spread: DataFrame) -> DataFrame:
    """Postings `x` (token, bucket, x) as blocks again: a bucket's postings of a token, `BUCKET` at most."""
    x = F.sort_array(F.collect_list("x"))
    return spread.groupBy("token", "bucket").agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        F.sum(F.col("x.names") + F.col("x.bodies")).cast("long").alias("uses"),
        F.max(NAME_WEIGHT * F.col("x.names") + F.col("x.bodies")).cast("double").alias("strongest"),
        F.min("x.length").alias("shortest"),
        x.alias("postings"),
    )


def build(rows: DataFrame, folder: str) -> None:
    """A new index of rows (rowid, file, name, body) in a folder."""
    KeywordIndex(rows.sparkSession, folder).update(rows)
