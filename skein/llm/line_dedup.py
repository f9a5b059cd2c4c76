"""Line deduplication with levelled sorted runs of line hashes.

Lines that many documents share go everywhere but in the largest document that holds them. The state is a set of runs:
tables of (128-bit key hash, holder, n, m), dealt into buckets by hash and sorted by hash in each, in levels. Documents
come in batches of descending doc_id. The keys of a batch are merge-anti-joined with all runs: keys that no run has are
new, and their largest document in the batch is their holder for good, as all later batches have smaller ids; for known
keys only the numbers of documents (n) and lines (m) are added. The batch then becomes a run of level 0, and whenever a
level has FAN runs they are compacted into one run of the next level. When all batches are in, keys with enough
documents decide which lines go. Joins and compactions read runs as they lie: no run is shuffled or sorted again. The
folder's list of runs lets a later call open them and add further batches.

Runs and joins of lines carry hashes alone. Texts are read once to hash their lines, and once more, with one shuffle by
row, to leave lines out.

Defined cases: null and empty text is one empty line; short keys are never counted; documents are counted by distinct
doc_id (null is one id, smaller than any other); a line repeated in its own holder stays each time; rows that repeat a
doc_id are the same document, and all keep what it holds; the longest texts are split whole; an empty table gives no
rows; extra columns, whatever their names, are kept inside `doc` by dedup().
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import files
from skein.llm.common import BLANKS, join_unique, lower_az, only, packed, shared_dir, stored, table

#: Code points of a key at least, documents that hold it at least.
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Batches of documents (an equal share of ids each), runs of a level before they are compacted.
BATCHES, FAN = 4, 2
RUN = "h1 long, h2 long, holder long, n long, m long"
KEY = ["h1", "h2"]
#: Lets the planner use the order inside buckets of one file.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, pos, h1, h2) of each line whose key is long enough; row tells rows with the same doc_id apart."""
    rows = only(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    rows = rows.withColumn("key", F.btrim("line", F.lit(BLANKS))).where(F.length("key") >= LEAST_CHARS).withColumn("key", lower_az(F.col("key")))
    return rows.select("doc_id", "row", "pos", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"))


class Runs:
    """Levelled sorted runs in a shared folder; with the same folder, those of an earlier call."""

    def __init__(self, spark: SparkSession, folder: str, fan: int = FAN):
        self.spark, self.folder, self.fan = spark, folder.rstrip("/"), fan
        known = files.get(f"{self.folder}/runs.json")
        state = json.loads(known) if known else {"buckets": int(spark.conf.get("spark.sql.shuffle.partitions")), "made": 0, "levels": []}
        self.buckets, self.made = state["buckets"], state["made"]
        self.levels: list[list[str]] = state["levels"]

    def _name(self, run: str) -> str:
        return "skein_run_" + hashlib.md5(f"{self.folder}/{run}".encode()).hexdigest()[:20]

    def _open(self, run: str) -> DataFrame:
        name = self._name(run)
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({RUN}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{run}'")
        return self.spark.table(name)

    @contextmanager
    def ordered(self) -> Iterator[None]:
        before = self.spark.conf.get(ORDERED, None)
        self.spark.conf.set(ORDERED, "true")
        try:
            yield
        finally:
            self.spark.conf.set(ORDERED, before) if before is not None else self.spark.conf.unset(ORDERED)

    def _write(self, run: DataFrame, level: int) -> str:
        """A new run. Its rows come from an aggregation by hash into as many parts as there are buckets: one file each."""
        self.made += 1
        name = f"level{level}-{self.made}"
        with self.ordered():
            writer = run.select(*[c.split()[0] for c in RUN.split(", ")]).write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
            writer.option("path", f"{self.folder}/{name}").saveAsTable(self._name(name))
        return name

    def _list(self) -> None:
        files.put(f"{self.folder}/runs.json", json.dumps({"buckets": self.buckets, "made": self.made, "levels": self.levels}).encode())

    def all(self) -> list[DataFrame]:
        return [self._open(run) for level in self.levels for run in level]

    def marked(self, keys: DataFrame) -> DataFrame:
        """keys with `fresh`: whether no run has the key, by one merge join with each run."""
        runs = [run.select(*KEY, F.lit(True).alias(f"in{k}")).hint("merge") for k, run in enumerate(self.all())]
        met = reduce(lambda left, run: left.join(run, KEY, "left"), runs, keys)
        known = [F.col(f"in{k}") for k in range(len(runs))]
        return met.withColumn("fresh", F.coalesce(*known, F.lit(False)) == F.lit(False)).drop(*[f"in{k}" for k in range(len(runs))])

    def add(self, keys: DataFrame) -> None:
        """Adds a batch's (h1, h2, holder, n, m), each key once; afterwards full levels are compacted."""
        new = self._write(self.marked(keys).withColumn("holder", F.when(F.col("fresh"), F.col("holder"))), 0)
        self.levels = [[*(self.levels[0] if self.levels else []), new], *self.levels[1:]]
        level = 0
        while len(self.levels[level]) >= self.fan:
            merged = self._write(self.merged(self.levels[level]), level + 1)
            above = self.levels[level + 1] if level + 1 < len(self.levels) else []
            self.levels[level : level + 2] = [[], [*above, merged]]
            level += 1
        self._list()

    def merged(self, runs: list[str] | None = None) -> DataFrame:
        """One row for each key of the runs (of all, if none are named): outer merge joins, of two runs without a shuffle."""

        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            met = a.hint("merge").join(b.select(*KEY, *[F.col(c).alias(f"{c}2") for c in ("holder", "n", "m")]).hint("merge"), KEY, "full")
            n, m = (F.coalesce(c, F.lit(0)) + F.coalesce(f"{c}2", F.lit(0)) for c in ("n", "m"))
            return met.select(*KEY, F.greatest("holder", "holder2").alias("holder"), n.alias("n"), m.alias("m"))

        return reduce(both, self.all() if runs is None else [self._open(run) for run in runs])

    def close(self) -> None:
        """Forgets the session's names of the runs; their files stay."""
        for run in range(1, self.made + 1):
            for level in range(len(self.levels)):
                self.spark.sql(f"DROP TABLE IF EXISTS {self._name(f'level{level}-{run}')}")


def batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """Descending ids that cut docs into batches of about equal size."""
    shares = [k / batches for k in range(1, batches)]
    cuts = only(docs, "doc_id").agg(F.percentile_approx("doc_id", shares, 1000)).first()[0] if shares else None
    return sorted(set(cuts or []), reverse=True)  # null over no rows


def batch_keys(lines: DataFrame) -> DataFrame:
    """(h1, h2, holder, n, m) of the lines: largest document, documents and lines of each key."""
    of_doc = lines.groupBy(*KEY, "doc_id").agg(F.count("*").alias("m"))
    return of_doc.groupBy(*KEY).agg(F.max("doc_id").alias("holder"), F.count("*").alias("n"), F.sum("m").alias("m"))


def dropped_positions(docs: DataFrame, batches: int = BATCHES, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, row, drop): the positions of the lines that go, of each row that loses any."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    bounds = batch_bounds(docs, batches)
    batch = reduce(lambda rest, k: F.when(F.col("doc_id") >= bounds[k], k).otherwise(rest), reversed(range(len(bounds))), F.lit(len(bounds)))
    path = f"{folder}/lines"
    made = keyed_lines(docs).withColumn("batch", batch)
    made.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(made.schema).parquet(path)
    runs = Runs(spark, f"{folder}/runs")
    for k in range(len(bounds) + 1):
        runs.add(batch_keys(lines.where(F.col("batch") == k)))
    # Written first, so that the keys are a table of their own: a line that is in a third of all documents is split.
    with runs.ordered():
        shared = stored(runs.merged().where(F.col("n") >= least_docs).select(*KEY, "holder", "m"), f"{folder}/shared")
    runs.close()
    gone = join_unique(lines, shared, KEY, "m").where(~F.col("doc_id").eqNullSafe(F.col("holder")))
    return stored(gone.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("drop")), f"{folder}/drops")


def dedup(docs: DataFrame, batches: int = BATCHES, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc, kept, n_lines, n_dropped): each row of docs as a struct, its text without the dropped lines, and how many."""
    drops = dropped_positions(docs, batches, least_docs).withColumnRenamed("doc_id", "dropped_doc").withColumnRenamed("row", "dropped_row")
    rows = packed(docs, F.xxhash64("text").alias("row"))
    met = rows.join(drops, F.col("doc.doc_id").eqNullSafe(F.col("dropped_doc")) & (F.col("row") == F.col("dropped_row")), "left")
    lines = split_lines(F.col("doc.text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))  # by hash: linear in the lines
    kept = F.when(F.col("drop").isNull(), F.coalesce(F.col("doc.text"), F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    return met.select("doc", kept.alias("kept"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return out.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), k AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), s AS (
  SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.holder AS gone FROM k LEFT JOIN s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
