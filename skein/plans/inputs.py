"""The driver tables as the library's inputs."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.engine import Engine
from skein.functions.settings import Settings
from skein.operators import chain as C
from skein.operators import derive as D
from skein.sources.store import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages: a conversation is a chat, system rows are hidden."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("chat_id"), F.col("turn").alias("idx"), "role", F.lit(None).cast("string").alias("name"), "text")


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.build_chain(messages(spark, sf_dir))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as observations of entities: user = chat, event_type = entity, place = order by time."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("chat_id"), F.col("event_type").alias("entity_id"), F.col("event_id").alias("obs_id"), "value", place.alias("pos"),
        F.least(F.lit(10.0), F.col("value") / 20).alias("importance"), F.least(F.lit(1.0), F.col("value") / 60).alias("confidence"),
    )


_FOLDERS: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """A folder of the session for tables that queries write."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = shared_path(spark)
    return _FOLDERS[app]


def cut(df: DataFrame) -> DataFrame:
    """df written and read back."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Ledger:
    """events as a ledger: user = chat, event = message and observation, event_type = entity. Messages of value below 1 are gone."""

    messages: DataFrame
    observations: DataFrame
    state: DataFrame
    statics: DataFrame


TYPE_OF = {"view": "character", "click": "item", "error": "event", "purchase": "quest", "signup": "other"}


def ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    o = observed(spark, sf_dir).withColumn("text", F.concat(F.lit("event "), "obs_id"))
    messages = o.where("value >= 1").select("chat_id", F.col("pos").alias("idx"), F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("name"), "text")
    sigs = F.array(F.md5(F.concat(F.lit("a|"), "text")))
    kind = F.element_at(F.create_map(*[F.lit(x) for p in TYPE_OF.items() for x in p]), F.col("entity_id"))
    fact = F.struct(
        F.concat(F.lit("w"), F.md5("entity_id"), F.lit(" seen")).alias("text"), F.when(F.col("value") < 50, "rumor").otherwise("confirmed").alias("status"), F.lit("").alias("slot"), F.lit(False).alias("changed"),
        F.lit("").alias("evidence"), F.lit("story").alias("by"), sigs.alias("sigs"), F.lit(None).cast("string").alias("rel_kind"), F.lit(None).cast("string").alias("other"),
    )
    observations = o.select(
        "chat_id", "obs_id", "entity_id", F.col("entity_id").alias("name"), kind.alias("type"), F.array(F.upper("entity_id")).alias("aliases"), F.array(F.concat(F.lit("user "), "chat_id"), F.lit("the")).alias("keys"), sigs.alias("sigs"),
        "importance", "confidence", F.lit("").alias("reason"), F.when(F.col("entity_id") == "purchase", "static:lore:1").alias("static_id"), F.lit("exact").alias("how"), F.array(fact).cast(D.FACTS).alias("facts"), F.lit(None).cast(D.UPDATES).alias("updates"),
    )
    chats, user = o.select("chat_id").distinct(), F.col("chat_id").cast("long")
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    rule = lambda when, entity, status, lock, into: chats.where(when).select("chat_id", F.lit(entity).alias("entity_id"), F.lit(status).cast("string").alias("status"), F.lit(lock).alias("lock"), F.lit(False).alias("protected"), F.lit(False).alias("keep"), F.lit(into).cast("string").alias("merge_into"), *none("name", "type", "lock_reason"))
    state = rule(user % 7 == 0, "click", "promote", True, None).unionByName(rule(user % 5 == 0, "error", "reject", False, None)).unionByName(rule(user % 11 == 0, "view", None, False, "click"))
    statics = chats.select("chat_id", F.lit("static:lore:1").alias("static_id"), F.lit("Old lore").alias("name"), F.array(F.lit("old key")).alias("keys"), F.lit("quest").alias("type"), F.concat(F.lit("w"), F.md5(F.lit("purchase")), F.lit(" seen before")).alias("content"))
    return Ledger(messages, observations, state, statics)


SETTINGS = Settings(enabled=True)
_VIEWS: dict[tuple[str, str], D.View] = {}
_ENGINES: dict[tuple[str, str], Engine] = {}


def derived(spark: SparkSession, sf_dir: str) -> D.View:
    """The whole projection of the ledger."""
    x = ledger(spark, sf_dir)
    return D.derive(spark, x.observations, C.build_chain(x.messages), SETTINGS, x.state, None, x.statics, cut)


def view(spark: SparkSession, sf_dir: str) -> D.View:
    """derived(), made once a session for the queries that look at parts of it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _VIEWS:
        _VIEWS[key] = derived(spark, sf_dir)
    return _VIEWS[key]


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine over the ledger, synced once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ENGINES:
        own, x = Engine(spark, f"{folder(spark)}/{uuid.uuid4().hex}", SETTINGS, buckets=2), ledger(spark, sf_dir)
        with own.store.change():
            for name, df in (("messages", x.messages), ("observations", x.observations), ("entity_state", x.state), ("statics", x.statics)):
                own.store.write(name, df)
        own.sync()
        _ENGINES[key] = own
    return _ENGINES[key]
