"""Token counts by separator scan over flat, unindexed token files.

A file is just token ids (little-endian unsigned 16-bit, or 32-bit for a larger vocabulary), each document closed by the
end-of-document id. Files are cut into blocks of equal bytes that tasks scan on their own: a vectorised comparison finds
the separators, which give the lengths of the documents that lie within the block, a head (ids up to the first
separator) and a tail. A prefix scan over the blocks of a file numbers the documents, and heads and tails that belong
to the same document are added up. A document may span any number of blocks.

Defined cases: an empty document counts 0 tokens; ids after the last separator are a document without an end, reported
with ended = false; null text is empty; repeated rows are documents of their own; a null doc_id is counted like any
other; a document may be longer than a block; an empty table or file gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import files
from skein.llm.bpe import chunks, default_path, encoder
from skein.llm.common import only, shared_dir, stored, table

#: Bytes of a block; a multiple of both widths.
BLOCK_BYTES = 4 << 20
SEPARATOR = "<|endoftext|>"


def write(docs: DataFrame, folder: str, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Writes flat token files; (files: path, bytes, width), and for the caller's own use (path, k, doc_id): who is where.

    The separator's string inside a text is ordinary text here, so only ends of documents have its id.
    """
    path = path or default_path()
    files.make_folder(f"{folder}/files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        width = 2 if len(own.vocabulary.tokens) <= 1 << 16 else 4
        end = np.array([own.vocabulary.special[SEPARATOR]], f"<u{width}").tobytes()
        for ids, texts in chunks(batches, 16_000_000):
            parts = []
            for k in range(0, len(texts), 500):
                for made in own.encode(texts[k : k + 500], special=False):
                    parts += [made.astype(f"<u{width}").tobytes(), end]
            name = files.write(f"{folder}/files", parts)
            n = len(ids)
            yield pa.RecordBatch.from_pydict({"path": [name] * n, "bytes": [sum(map(len, parts))] * n, "width": [width] * n, "k": pa.array(np.arange(n)), "doc_id": pa.array(ids, pa.int64())})

    made = stored(only(docs, "doc_id", "text").mapInArrow(run, "path string, bytes long, width long, k long, doc_id long"), f"{folder}/manifest")
    return made.where("k = 0").select("path", "bytes", "width"), made.select("path", "k", "doc_id")


def scan(token_files: DataFrame, separator: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, k, n_tokens, ended) of every document, from (path, bytes, width) of flat token files."""
    blocks = token_files.select("path", "bytes", "width", F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("bytes") - 1), F.lit(block_bytes).cast("long"))).alias("block", "at"))
    spread = blocks.repartition(F.col("path"), F.col("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = files.read(row["path"], row["at"], min(block_bytes, row["bytes"] - row["at"]))
                ends = np.flatnonzero(np.frombuffer(data, f"<u{row['width']}") == separator)
                count = len(data) // row["width"]
                inner = np.diff(ends) - 1
                yield pa.RecordBatch.from_pydict(
                    {
                        "path": [row["path"]],
                        "block": pa.array([row["block"]], pa.int32()),
                        "n_ends": pa.array([len(ends)], pa.int64()),
                        "head": pa.array([int(ends[0]) if len(ends) else count], pa.int64()),
                        "tail": pa.array([count - 1 - int(ends[-1]) if len(ends) else 0], pa.int64()),
                        "inner": pa.array([inner], pa.list_(pa.int64())),
                    }
                )

    found = spread.select("path", "block", "at", "bytes", "width").mapInArrow(run, "path string, block int, n_ends long, head long, tail long, inner array<long>")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    numbered = found.withColumn("k", F.coalesce(F.sum("n_ends").over(before), F.lit(0).cast("long")))
    whole = numbered.select("path", (F.col("k") + 1).alias("k0"), F.posexplode("inner").alias("i", "n_tokens")).select("path", (F.col("k0") + F.col("i")).alias("k"), "n_tokens", F.lit(True).alias("ended"))
    pieces = numbered.select("path", "k", F.col("head").alias("n"), (F.col("n_ends") > 0).alias("ended")).unionByName(
        numbered.where("n_ends > 0").select("path", (F.col("k") + F.col("n_ends")).alias("k"), F.col("tail").alias("n"), F.lit(False).alias("ended"))
    )
    cut = pieces.groupBy("path", "k").agg(F.sum("n").alias("n_tokens"), F.bool_or("ended").alias("ended")).where("ended or n_tokens > 0")
    return whole.unionByName(cut.select("path", "k", "n_tokens", "ended"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes documents as flat token files, scans the files, and returns (doc_id, n_tokens) of every document."""
    token_files, who = write(table(spark, sf_dir, "documents"), shared_dir(spark))
    counts = scan(token_files, encoder(default_path()).vocabulary.special[SEPARATOR])
    # Both sides have a row a document, so neither is broadcast, however small its files are.
    return counts.hint("merge").join(who.hint("merge"), ["path", "k"]).select("doc_id", "n_tokens")
