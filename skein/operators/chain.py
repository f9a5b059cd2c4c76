"""Chains: the visible messages of each chat in order, and what is to be read of them next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions.settings import Settings


def build_chain(messages: DataFrame) -> DataFrame:
    """(chat_id, idx, pos, sig, is_user, name, text) from (chat_id, idx, role, name, text): hidden and blank ones go."""
    shown = messages.where("role <> 'system'").withColumn("text", X.collapse("text")).where("text <> ''")
    is_user = F.col("role") == "user"
    name = F.when(F.coalesce("name", F.lit("")) != "", F.col("name")).otherwise(F.when(is_user, "User").otherwise("Narrator"))
    pos = F.row_number().over(Window.partitionBy("chat_id").orderBy("idx")) - 1
    return shown.select("chat_id", "idx", pos.alias("pos"), X.signature(is_user, F.col("text")).alias("sig"), is_user.alias("is_user"), name.alias("name"), "text")


def positions(chain: DataFrame) -> DataFrame:
    """(chat_id, sig, pos): a signature's first place."""
    return chain.groupBy("chat_id", "sig").agg(F.min("pos").alias("pos"))


def settled(chain: DataFrame, lag: int) -> DataFrame:
    """Without the newest `lag` messages."""
    newest = F.max("pos").over(Window.partitionBy("chat_id"))
    return chain.withColumn("_newest", newest).where(F.col("pos") < F.col("_newest") + 1 - lag).drop("_newest")


def unscanned(rows: DataFrame, scanned: DataFrame) -> DataFrame:
    """Rows whose signature has not been read yet; scanned is (chat_id, sig)."""
    return rows.join(scanned.select("chat_id", "sig").distinct(), ["chat_id", "sig"], "left_anti").select(rows.columns)


def due(rows: DataFrame, at_least: int, forced: bool = False) -> DataFrame:
    """(chat_id, n) of the chats that have enough to read."""
    return rows.groupBy("chat_id").agg(F.count("*").alias("n")).where(F.col("n") >= (1 if forced else at_least))


def batches(rows: DataFrame, size: int) -> DataFrame:
    """rows with batch: so many at a time, in order."""
    rank = F.row_number().over(Window.partitionBy("chat_id").orderBy("pos")) - 1
    return rows.withColumn("batch", F.floor(rank / size).cast("long"))


def limited(batched: DataFrame, calls: int) -> DataFrame:
    """The first batches of each chat, so many at most (Q10)."""
    return batched.where(F.col("batch") < calls)


def with_context(chain: DataFrame, batched: DataFrame, context: int) -> DataFrame:
    """Batches with the messages just before their first one, numbered from 1 (B9, B10): adds batch, is_context and n."""
    first = batched.groupBy("chat_id", "batch").agg(F.min("pos").alias("first"))
    before = first.select("chat_id", "batch", F.explode(F.sequence(F.col("first") - context, F.col("first") - 1)).alias("pos")).where("pos >= 0") if context else None
    rows = batched.withColumn("is_context", F.lit(False))
    if before is not None:
        rows = rows.unionByName(chain.join(before, ["chat_id", "pos"]).select(*chain.columns, "batch", F.lit(True).alias("is_context")))
    number = F.row_number().over(Window.partitionBy("chat_id", "batch").orderBy(F.col("is_context").desc(), "pos"))
    return rows.withColumn("n", number)


def windows(messages: DataFrame, scanned: DataFrame, settings: Settings, forced: bool = False, calls: int | None = None) -> DataFrame:
    """All that the extractor is to read next, batch by batch, in so many calls a chat at most."""
    chain = build_chain(messages)
    todo = unscanned(settled(chain, 0 if forced else settings.settle_lag), scanned)
    ready = todo.join(due(todo, settings.extract_every, forced).select("chat_id"), "chat_id", "left_semi").select(todo.columns)
    batched = batches(ready, settings.window_max)
    return with_context(chain, batched if calls is None else limited(batched, calls), settings.context_msgs)


def alive(observations: DataFrame, where: DataFrame) -> DataFrame:
    """(chat_id, obs_id, at, positions): observations with any source in the chain, and where."""
    each = observations.select("chat_id", "obs_id", F.explode(F.array_distinct("sigs")).alias("sig"))
    return each.join(where, ["chat_id", "sig"]).groupBy("chat_id", "obs_id").agg(F.min("pos").alias("at"), F.sort_array(F.collect_set("pos")).alias("positions"))


def all_alive(items: DataFrame, keys: list[str], where: DataFrame) -> DataFrame:
    """The items (with sigs) all of whose sources are in the chain; none without a source."""
    each = items.select("chat_id", *keys, F.explode("sigs").alias("sig")).join(where.withColumn("_there", F.lit(True)), ["chat_id", "sig"], "left")
    kept = each.groupBy("chat_id", *keys).agg(F.bool_and(F.col("_there").isNotNull()).alias("_all")).where("_all").drop("_all")
    return items.join(kept, ["chat_id", *keys], "left_semi")


def episodes(positions_: Column, gap: int) -> Column:
    """How many runs sorted positions form, where a run ends before a gap of more than `gap` (F2)."""
    return F.size(F.filter(positions_, lambda x, i: (i == 0) | (x - F.get(positions_, i - 1) > gap)))
