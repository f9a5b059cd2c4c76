"""Dashboard queries (P)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.settings import Settings
from skein.operators import chain as C
from skein.operators.derive import View

STATE_ORDER = ["promoted", "candidate", "excluded", "rejected"]
UNDOABLE = ["create", "update", "remove", "disable"]
HISTORY = 150


def state_rank(state: Column) -> Column:
    place = F.array_position(F.array(*map(F.lit, STATE_ORDER)), state)
    return F.when(place > 0, place - 1).otherwise(len(STATE_ORDER)).cast("int")


def entities(view: View) -> DataFrame:
    """Entities with their active facts and their place in their chat: promoted and important ones first."""
    said = view.facts.where("state = 'active'").groupBy("chat_id", "entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda f: f["text"]).alias("facts"))
    place = F.row_number().over(Window.partitionBy("chat_id").orderBy(state_rank(F.col("state")), F.col("imp_max").desc(), "entity_id"))
    return view.entities.join(said, ["chat_id", "entity_id"], "left").withColumn("place", place)


def history(log: DataFrame, most: int = HISTORY) -> DataFrame:
    """Each chat's newest changes, and whether they can be undone."""
    rank = F.row_number().over(Window.partitionBy("chat_id").orderBy(F.col("seq").desc()))
    return log.withColumn("rank", rank).where(F.col("rank") <= most).withColumn("undoable", F.col("kind").isin(UNDOABLE))


def estimate(rows: DataFrame, settings: Settings) -> DataFrame:
    """What reading the rest would take: messages, characters, tokens, calls."""
    total = rows.groupBy("chat_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return total.select("chat_id", "n", "chars", F.ceil(F.col("chars") / 4).alias("tokens"), F.ceil(F.col("n") / settings.window_max).alias("calls"))


def meta(observations: DataFrame, where: DataFrame, scanned: DataFrame) -> DataFrame:
    """Live and all observations, and messages read, of each chat."""
    live = C.alive(observations, where).groupBy("chat_id").agg(F.count("*").alias("live"))
    every = observations.groupBy("chat_id").agg(F.count("*").alias("observations"))
    read = scanned.distinct().groupBy("chat_id").agg(F.count("*").alias("scanned"))
    return every.join(live, "chat_id", "left").join(read, "chat_id", "full").fillna(0)
