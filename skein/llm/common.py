"""What the operators share: tables, the shared folder, and Arrow text columns."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that count as white space in the word and line rules: space, tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: Lowers A-Z alone and leaves every other byte.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that all executors share, below spark.checkpoint.dir.

    Where that is unset, a local session (tests) gets a temporary one; on a cluster that is an error, as executors would
    each write to a disk of their own. Results are read lazily from the folder, so its owner removes it, not the query.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/skein-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts the lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of fixed width that may be broadcast (a few dozen bytes each: some MB), and keys that count as hot at most.
BROADCAST_ROWS, HOT_KEYS = 200_000, 2_000


def few(df: DataFrame) -> DataFrame:
    """df, a written table of numbers, to be broadcast if it is counted to be small; to be shuffled otherwise."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def join_unique(rows: DataFrame, unique: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """rows joined with unique, a written table that has each key once; its `weight` says how many rows have the key.

    A key with more than 1/HOT_KEYS of all weight is hot. Fewer than HOT_KEYS keys can be, so those are broadcast,
    whatever the size of the input, and their rows stay where they are; the rest is shuffled, and no key of it is large.
    """
    total = unique.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * F.lit(HOT_KEYS).cast("decimal(20,0)") > F.lit(total).cast("decimal(20,0)")
    hot, cold = unique.where(is_hot), unique.where(~is_hot)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.hint("merge"), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """docs as one struct column `doc`, so that no column of docs can clash with one of ours; more columns may be added."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("doc"), *more)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def lower_az(col):
    """A-Z lowered, all else untouched."""
    return F.translate(col, UPPER, LOWER)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column as strings; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batch in pieces, so that few texts are Python objects at once."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, whatever else the input has."""
    return df.select(*[F.col(quoted(n)) for n in names])
