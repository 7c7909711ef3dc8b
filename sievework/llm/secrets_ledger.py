"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every historical version of every path is named by the SHA-256 of its text. A ledger in a folder keeps, for each blob,
the rules (name and version) that it was scanned with, and what they found. A scan

1. digests all versions, in one pass that keeps narrow rows;
2. compares the distinct digests with the ledger: what remains are pairs of a blob and a rule's version that the ledger
   has not seen. An unchanged file, a copy or a reverted version costs nothing; a new version of a rule is run over all
   blobs, and only that rule;
3. reads the texts of these blobs, once each (copies are combined in map tasks before they meet, by whole content), runs
   their missing rules, and commits findings and pairs as one batch of the ledger;
4. joins the findings back to every path and version.

A rule is a regular expression with the least length of its match or of one of its groups. Spark has no function that
gives the places of matches, so they come from what stands between them: a text split by the pattern gives the gaps,
the matches give the rest, and running sums over a blob's matches give start and end in code points.

A batch of the ledger counts once its marker is written, after its two tables; what a lost scan leaves is not read. Two
scans at once may both scan a blob; readers count its findings once.

Defined cases: a null text counts as empty; null paths and versions are values; rows that repeat a path and version are
each reported; an empty table gives an empty result; a text without findings has zeros and empty spans; other columns
are not read; very long texts are one row each, as they come.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import read, shared_dir


@dataclass(frozen=True)
class Rule:
    """`least` is the fewest characters of the match's group number `group` (0: of the match). A text without any of
    the literals `needs` can't match. `version` is raised when the pattern changes."""

    name: str
    pattern: str
    least: int = 1
    group: int = 0
    needs: tuple[str, ...] = ()
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


def either_case(letters: str) -> str:
    """A pattern of letters in either case, ASCII only."""
    return "".join(f"[{c.upper()}{c}]" if "a" <= c <= "z" else c for c in letters)


#: The contract's kinds, in its order. Runs of hex are whole runs, so a least length in the pattern changes no match.
BASE = (
    Rule("assign", rf"""({'|'.join(map(either_case, ('password', 'passwd', 'secret', 'token', 'api_?key')))})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", "AKIA[A-Z0-9]+", 20, 0, ("AKIA",)),
    Rule("hex", "[0-9a-f]{24,}", 24),
)
#: Published shapes of credentials.
SHAPES = (
    Rule("temporary", "ASIA[A-Z0-9]{16}", 20, 0, ("ASIA",)),
    Rule("github", "gh[oprsu]_[A-Za-z0-9]{36,}", 40, 0, ("gho_", "ghp_", "ghr_", "ghs_", "ghu_")),
    Rule("slack", "xox[abeprs]-[A-Za-z0-9-]{10,}", 15, 0, ("xox",)),
    Rule("google", "AIza[A-Za-z0-9_-]{35}", 39, 0, ("AIza",)),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,}", 24, 0, ("k_live_",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 20, 0, (".eyJ",)),
    Rule("private", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 27, 0, ("PRIVATE KEY-----",)),
    Rule("login", r"[a-z]{2,10}://[A-Za-z0-9._~-]+:[^\x20\x09-\x0D/@:]{3,}@[A-Za-z0-9.-]+", 10, 0, ("://",)),
)
RULES = BASE + SHAPES


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _matches(text: Column, rule: Rule) -> Column:
    """Array of (rule, gap, size, long_enough): each match, the code points between it and the one before, its own."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.pattern, -1)
    zipped = F.transform(F.arrays_zip(found.alias("m"), checked.alias("c"), F.slice(gaps, 1, F.size(found)).alias("g")), lambda x: F.struct(F.lit(rule.key).alias("rule"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"), (F.length(x["c"]) >= rule.least).alias("enough")))
    return zipped


def findings(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """digest, rule, start, end of every match. blobs: digest, text (not null), todo (keys of the rules to run)."""
    each = []
    for rule in rules:
        could = F.array_contains("todo", rule.key)
        if rule.needs:
            could &= F.exists(F.array(*[F.contains(F.col("text"), F.lit(x)) for x in rule.needs]), lambda x: x)
        each.append(F.when(could & F.col("text").rlike(rule.pattern), _matches(F.col("text"), rule)))
    some = blobs.select("digest", F.explode(F.array_compact(F.array(*each))).alias("of")).select("digest", F.posexplode("of").alias("place", "x"))
    so_far = Window.partitionBy("digest", "x.rule").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = some.select("digest", "x.rule", "x.enough", "x.size", F.sum(F.col("x.gap") + F.col("x.size")).over(so_far).alias("end"))
    return ends.where("enough").select("digest", "rule", (F.col("end") - F.col("size")).alias("start"), "end")


class Ledger:
    """The ledger in `root`, a folder that driver and executors share."""

    PAIRS, FOUND = "digest binary, rules array<string>", "digest binary, rule string, start long, end long"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """The names of the committed batches."""
        fs, folder = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(n for n in names if n.startswith("batch-") and fs.exists(self._path(n, "COMMITTED")))

    def _table(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/{b}/{name}" for b in self.batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        """digest, rules: the pairs seen so far."""
        return self._table("scanned", self.PAIRS)

    def found(self) -> DataFrame:
        """digest, rule, start, end, each once."""
        return self._table("found", self.FOUND).distinct()

    def _commit(self, batch: str) -> None:
        self._fs().create(self._path(batch, "COMMITTED"), True).close()

    def scan(self, versions: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> int:
        """Scans what is new in `versions`; returns the number of blobs read."""
        keys, text = [r.key for r in rules], F.coalesce(F.col(text_col), F.lit(""))
        digests = versions.select(_digest(text).alias("digest")).distinct()
        batch, first = f"batch-{uuid.uuid4().hex}", not self.batches()
        every = F.array(*map(F.lit, keys))
        if first:
            pairs = digests.select("digest", every.alias("rules"))
        else:
            seen = self.scanned().groupBy("digest").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
            missing = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
            pairs = digests.join(seen, "digest", "left").select("digest", missing.alias("rules")).where(F.size("rules") > 0)
        pairs.write.parquet(f"{self.root}/{batch}/scanned")
        todo = self.spark.read.schema(self.PAIRS).parquet(f"{self.root}/{batch}/scanned")
        count = todo.count()
        if not count:
            self._fs().delete(self._path(batch), True)
            return 0
        texts = versions.select(_digest(text).alias("digest"), text.alias("text"))
        # Copies are combined in map tasks, then by whole content; a first scan has nothing to leave out.
        if first:
            blobs = texts.groupBy("digest", "text").agg(every.alias("todo"))
        else:
            blobs = texts.join(todo.select("digest"), "digest", "left_semi").groupBy("digest", "text").count().drop("count").join(todo.withColumnRenamed("rules", "todo"), "digest")
        findings(blobs, rules).write.parquet(f"{self.root}/{batch}/found")
        self._commit(batch)
        return count

    def report(self, versions: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """The versions' other columns, rule, start, end: a row for each finding of the rules' versions at each place."""
        wanted = F.broadcast(self.spark.createDataFrame([(r.key,) for r in rules], "rule string"))
        found = self.found().join(wanted, "rule")
        named = versions.withColumn("digest", _digest(F.coalesce(F.col(text_col), F.lit("")))).drop(text_col)
        return named.join(found, "digest").drop("digest")


def digested(ledger: Ledger, versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Of each version: the number of each base kind, the digest of their spans, and all spans."""
    kinds = {r.key: (i, r.name, r in base) for i, r in enumerate(rules)}
    table = F.create_map(*[F.lit(x) for k, (i, _, _) in kinds.items() for x in (k, i)])
    names = F.array(*[F.lit(r.name) for r in rules])
    known = ledger.found().where(F.col("rule").isin(list(kinds))).select("digest", F.struct("start", table[F.col("rule")].alias("kind"), "end").alias("s"))
    spans = known.groupBy("digest").agg(F.sort_array(F.collect_list("s")).alias("s"))
    shown = lambda these: F.array_join(F.transform(these, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    own = lambda test: F.filter("s", lambda x: test(x["kind"]))
    counts = [F.size(own(lambda k, i=i: k == i)).cast("long").alias(f"n_{r.name}") for i, r in enumerate(rules) if r in base]
    told = spans.select("digest", *counts, F.sha2(shown(own(lambda k: k < len(base))), 256).alias("base_sha256"), shown(F.col("s")).alias("spans"))
    ids = versions.select(F.col(id_col), _digest(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"))
    none = {f"n_{r.name}": F.lit(0).cast("long") for r in base} | {"base_sha256": F.sha2(F.lit(""), 256), "spans": F.lit("")}
    return ids.join(told, "digest", "left").select(id_col, *[F.coalesce(c, v).alias(c) for c, v in none.items()])


def op12_secret_ledger(spark, sf_dir: str) -> DataFrame:
    """Every document is a version of a path of its own; the ledger is a new one."""
    ledger = Ledger(spark, f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}")
    docs = read(spark, sf_dir)
    ledger.scan(docs.select("text"))
    return digested(ledger, docs)


def _sql() -> str:
    literal = lambda x: "'" + x.replace("'", "''") + "'"
    each = "\n  UNION ALL\n".join(
        f"  SELECT doc_id, {i} AS kind, {literal(r.name)} AS name, {r.least} AS least, regexp_extract_all(text, {literal(r.pattern)}) AS m,"
        f" regexp_extract_all(text, {literal(r.pattern)}, {r.group}) AS c, regexp_split_to_array(text, {literal(r.pattern)}) AS g FROM d"
        for i, r in enumerate(RULES)
    )
    counts = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{r.name}" for i, r in enumerate(BASE))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), r AS (
{each}
), u AS (
  SELECT doc_id, kind, name, least, unnest(m) AS m, unnest(c) AS c, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS place FROM r WHERE len(m) > 0
), s AS (
  SELECT doc_id, kind, name, CAST(sum(length(g) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY place) AS BIGINT) AS stop, length(m) AS size, length(c) >= least AS enough FROM u
), f AS (
  SELECT doc_id, kind, stop - size AS start, name || ':' || CAST(stop - size AS VARCHAR) || ':' || CAST(stop AS VARCHAR) AS shown FROM s WHERE enough
), t AS (
  SELECT doc_id, {counts}, sha256(coalesce(string_agg(shown, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)}), '')) AS base_sha256, string_agg(shown, ',' ORDER BY start, kind) AS spans
  FROM f GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.name}, 0) AS n_{r.name}" for r in BASE)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""


SQL = _sql()
