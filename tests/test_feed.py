"""The feed: a stopped and restarted engine, retraction and return, the fold without a stop in between."""

from pyspark.sql import functions as F

from skein.engine import Engine
from skein.functions.settings import Settings
from skein.operators import derive as D
from skein.streaming import feed as S


def test_restart_keeps_what_was_there(spark, tmp_path):
    ddl = S.FEED
    put = lambda chat, idx, text, at, op="put": (chat, idx, "assistant", None, text, op, at)
    base = f"file://{tmp_path}"
    spark.createDataFrame([put("a", 0, "one", 1), put("a", 1, "two", 2), put("b", 0, "other", 3)], ddl).coalesce(1).write.parquet(f"{base}/in")
    first = Engine(spark, f"{base}/store", Settings(enabled=True), buckets=2)
    facts = [("told", "confirmed", "", False, "", "story", None, None)]
    observation = spark.createDataFrame([("a", 1, "e", "two"), ("b", 1, "e", "other")], "chat_id string, obs_id long, entity_id string, text string")
    sig = F.array(F.md5(F.concat(F.lit("a|"), "text")))
    fact = F.array(F.struct(*[F.lit(v).cast(t).alias(n) for (n, t), v in zip((("text", "string"), ("status", "string"), ("slot", "string"), ("changed", "boolean"), ("evidence", "string"), ("by", "string")), facts[0])], sig.alias("sigs"), F.lit(None).cast("string").alias("rel_kind"), F.lit(None).cast("string").alias("other")))
    rows = observation.select("chat_id", "obs_id", "entity_id", F.lit("Eel").alias("name"), F.lit("creature").alias("type"), F.array().cast("array<string>").alias("aliases"), F.array(F.lit("eel")).alias("keys"), sig.alias("sigs"), F.lit(9.0).alias("importance"), F.lit(0.9).alias("confidence"), F.lit("").alias("reason"), F.lit("new").alias("how"), fact.cast(D.FACTS).alias("facts"))
    first.store.write("observations", rows)
    S.follow(first, S.change_feed(spark, f"{base}/in", 1), f"{base}/checkpoint", None).awaitTermination()
    assert {r["chat_id"] for r in first.store.read("book").collect()} == {"a", "b"}
    # Another engine goes on: chat a loses the message that bears its card; chat b is not touched.
    number = first.store.folders["messages"]
    spark.createDataFrame([put("a", 1, "two", 9, "delete")], ddl).coalesce(1).write.mode("append").parquet(f"{base}/in")
    second = Engine(spark, f"{base}/store", Settings(enabled=True), buckets=2)
    S.follow(second, S.change_feed(spark, f"{base}/in", 1), f"{base}/checkpoint", None).awaitTermination()
    assert {r["chat_id"] for r in second.store.read("book").collect()} == {"b"} and second.messages.count() == 2
    touched = [b for b, p in second.store.folders["messages"].items() if number.get(b) != p]
    assert len(touched) == 1
    # It returns: so does the card.
    scope = S.take(second, spark.createDataFrame([put("a", 1, "two", 20)], ddl))
    second.sync(scope)
    assert {r["chat_id"] for r in second.store.read("book").collect()} == {"a", "b"}
