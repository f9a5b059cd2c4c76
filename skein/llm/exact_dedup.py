"""Exact duplicates: grouped by a 128-bit content hash, with the bytes compared inside each group.

Texts are equal when they are identical after deleting white space. Three steps:

1. Each row becomes numbers: its 128-bit hash, a rank that orders rows within a group, and the digest to be reported. One
   aggregation by hash gives each group's size and best rank; no text is shuffled.
2. Groups of two or more rows compare their bytes: their texts, and hardly any other, are grouped by the hash and the
   normalised text itself, and copies collapse on the map side before anything is sent. Which rows may be in such a group
   is asked of a bit table of FILTER_BITS bits (16 MB, whatever the input); a bit that is set by chance costs a
   comparison and changes nothing. A hash with two texts is a collision.
3. Rows meet their group by hash; rows of collided hashes, of which there are hardly ever any, meet it by their text.

Defined cases: null text counts as empty and equals other empty or blank texts; ties go to the smallest doc_id; repeated
rows are members of their own, and all rows with the winning length and id count as kept; a null doc_id loses against
any other; the longest texts are hashed and compared whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import BLANKS, join_unique, only, shared_dir, stored, table

#: Most code points first, then the smallest id, then none, as one number: the aggregation stays in its hash map, which
#: holds numbers only. 2^65 a code point, less the id counted from 2^63 below zero (2^64 for null).
RANK = "cast(size as decimal(10,0)) * 36893488147419103232BD - coalesce(cast(doc_id as decimal(20,0)) + 9223372036854775808BD, 18446744073709551616BD)"
#: The id in a rank.
KEEP = "cast(nullif(pmod(-best, 36893488147419103232BD), 18446744073709551616BD) - 9223372036854775808BD as bigint)"
#: Bits of the table that says which hashes occur twice; a power of two.
FILTER_BITS = 1 << 27
HASH = ["h1", "h2"]
OUT = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def normalised(text: Column) -> Column:
    """The text without white space; byte searches, as most texts hold only one or two of the characters."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def content_hash(norm: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), norm), F.xxhash64(F.lit(2), norm)


def _ranked(docs: DataFrame, hashes: Callable[[Column], tuple[Column, Column]]) -> DataFrame:
    rows = only(docs, "doc_id", "text").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("size"), normalised(F.col("text")).alias("norm"))
    h1, h2 = hashes(F.col("norm"))
    return rows.select("doc_id", F.expr(RANK).alias("rank"), h1.alias("h1"), h2.alias("h2"), "norm")


def _sized(rows: DataFrame, keys: list[str]) -> DataFrame:
    size = rows.groupBy(*keys).agg(F.count("*").alias("group_size"), F.max("rank").alias("best"))
    return size.select(*keys, "group_size", "best", F.expr(KEEP).alias("keep_id"))


def collided(texts: DataFrame, several: DataFrame) -> DataFrame:
    """(h1, h2) of several's hashes that stand for more than one of the texts (h1, h2, norm)."""
    place = F.col("h1").bitwiseAND(F.lit(FILTER_BITS - 1))
    at = several.select((place + 1).alias("at"))
    bits = at.groupBy(F.expr("bitmap_bucket_number(at)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits"))
    asked = texts.withColumn("at", place + 1).withColumn("bucket", F.expr("bitmap_bucket_number(at)")).withColumn("bit", F.expr("bitmap_bit_position(at)"))
    is_set = F.expr("shiftright(cast(conv(hex(substr(bits, cast(bit div 8 + 1 as int), 1)), 16, 10) as int), cast(bit % 8 as int)) & 1 = 1")
    maybe = asked.join(F.broadcast(bits), "bucket").where(is_set)  # FILTER_BITS bits at most
    distinct = maybe.groupBy(*HASH, "norm").agg(F.count("*").alias("rows"))
    return distinct.groupBy(*HASH).agg(F.count("*").alias("texts")).where("texts > 1").select(*HASH)


def groups(docs: DataFrame, hashes: Callable[[Column], tuple[Column, Column]] = content_hash) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row."""
    folder = shared_dir(docs.sparkSession)
    ranked = _ranked(docs, hashes)
    rows = stored(ranked.withColumn("text_sha256", F.sha2("norm", 256)).drop("norm"), f"{folder}/rows")
    size = stored(_sized(rows, HASH), f"{folder}/groups")
    apart = stored(collided(ranked.select(*HASH, "norm"), size.where("group_size > 1")), f"{folder}/collided")
    kept = (F.col("rank") == F.col("best")).alias("kept")
    if apart.isEmpty():
        return join_unique(rows, size, HASH, "group_size").select(*OUT[:3], kept, OUT[4])
    alike = join_unique(rows.join(apart.hint("merge"), HASH, "left_anti"), size, HASH, "group_size")
    unlike = ranked.join(apart.hint("merge"), HASH)
    by_text = stored(_sized(unlike, [*HASH, "norm"]), f"{folder}/texts")
    met = unlike.join(by_text.hint("merge"), [*HASH, "norm"]).withColumn("text_sha256", F.sha2("norm", 256))
    return alike.select(*OUT[:3], kept, OUT[4]).unionByName(met.select(*OUT[:3], kept, OUT[4]))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM n
WINDOW w AS (PARTITION BY norm ORDER BY size DESC, doc_id ASC)
"""
