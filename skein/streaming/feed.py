"""Change feeds as Structured Streaming (Q): micro-batches of message changes drive the engine.

A feed row is (chat_id, idx, role, name, text, op, at): put sets a message, delete removes it. Each micro-batch is merged
into the stored messages of the chats it touches, and only then the engine reads what is due in those chats and syncs
them; other chats are neither read nor written. Micro-batches follow each other (Q3), and what could not be parsed stays
unread for the next one (Q9). The trigger's interval is the debounce (Q2). The messages are a table of the store, so a
restart from the checkpoint goes on where the last commit left off; a micro-batch that is given twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.engine import Engine
from skein.functions import text as X
from skein.sources.store import Scope

FEED = "chat_id string, idx int, role string, name string, text string, op string, at long"


def change_feed(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The feed as a stream of Parquet files (Q1, A15); so many files at once (Q10)."""
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def newest(changes: DataFrame) -> DataFrame:
    """The last change of each place."""
    last = F.row_number().over(Window.partitionBy("chat_id", "idx").orderBy(F.col("at").desc(), F.col("op").desc()))
    return changes.withColumn("_last", last).where("_last = 1").drop("_last")


def merged(messages: DataFrame, changes: DataFrame) -> DataFrame:
    """messages after the changes: the last change of a place decides."""
    made = newest(changes)
    kept = messages.join(made.select("chat_id", "idx"), ["chat_id", "idx"], "left_anti")
    return kept.select(*messages.columns).unionByName(made.where("op <> 'delete'").select(*messages.columns))


def bursts(changes: DataFrame, quiet_ms: int) -> DataFrame:
    """(chat_id, started, ended, changes): runs of changes of a chat with pauses of at most quiet_ms; one sync is due after each (Q2)."""
    before = F.lag("at").over(Window.partitionBy("chat_id").orderBy("at"))
    starts = F.when(F.col("_before").isNull() | (F.col("at") - F.col("_before") > quiet_ms), 1).otherwise(0)
    number = F.sum("_new").over(Window.partitionBy("chat_id").orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    rows = changes.select("chat_id", "at").withColumn("_before", before).withColumn("_new", starts).withColumn("_burst", number)
    return rows.groupBy("chat_id", "_burst").agg(F.min("at").alias("started"), F.max("at").alias("ended"), F.count("*").alias("changes")).drop("_burst")


def take(engine: Engine, changes: DataFrame) -> Scope:
    """One micro-batch: the messages of the chats it touches after the changes; those chats."""
    changes = engine.cut(changes)
    scope = engine.store.scope(changes)
    engine.store.replace("messages", merged(engine.read("messages", scope), changes), scope)
    return scope


def follow(engine: Engine, feed: DataFrame, checkpoint: str, every: str | None = "4 seconds", calls: int | None = None, on_batch: Callable[[int], None] | None = None) -> StreamingQuery:
    """Runs the engine on a feed; every=None processes what is there and stops; calls bounds the batches of a chat each time."""

    def apply(changes: DataFrame, number: int) -> None:
        if not changes.isEmpty():
            scope = take(engine, changes)
            if engine.extractor is not None:
                engine.scan(chats=scope, calls=calls)
            engine.sync(scope)
        if on_batch is not None:
            on_batch(number)

    writer = feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def seen_once(feed: DataFrame) -> DataFrame:
    """Each message signature of a chat once, over the whole stream (Q7)."""
    return feed.withColumn("sig", X.signature(F.col("role") == "user", F.col("text"))).dropDuplicates(["chat_id", "sig"])
