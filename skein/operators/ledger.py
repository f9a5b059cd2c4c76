"""What is added to a ledger and taken from it, as tables in and tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import chain as C
from skein.operators import derive as D
from skein.operators.validate import Validated

AT = ["chat_id", "batch_id"]
RUN_ROWS = 60
#: The place of a batch's status updates, after all its entities.
LAST = 2_147_483_647


def told(checked: Validated) -> DataFrame:
    """(chat_id, batch_id, ent, facts): each entity's facts and then its relations, written as `other: text` (H3)."""
    at = [*AT, "ent"]
    plain = F.struct("text", "status", "slot", "changed", "evidence", "by", "sigs", F.lit(None).cast("string").alias("rel_kind"), F.lit(None).cast("string").alias("other"))
    related = F.struct(F.concat("other", F.lit(": "), "text").alias("text"), "status", "slot", "changed", "evidence", "by", "sigs", "rel_kind", "other")
    rows = checked.facts.select(*at, F.struct(F.lit(0).alias("k"), "ord", plain.alias("f")).alias("o")).unionByName(checked.relations.select(*at, F.struct(F.lit(1).alias("k"), "ord", related.alias("f")).alias("o")))
    before = lambda a, b: F.when((a["k"] < b["k"]) | ((a["k"] == b["k"]) & (a["ord"] < b["ord"])), -1).otherwise(1)
    return rows.groupBy(*at).agg(F.transform(F.array_sort(F.collect_list("o"), before), lambda o: o["f"]).cast(D.FACTS).alias("facts"))


def update_observations(updates: DataFrame) -> DataFrame:
    """The status updates of a batch as one observation, with the sources of all of them."""
    rows = updates.groupBy(*AT).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "ref", "to", "evidence", "sigs"))), lambda u: F.struct(u["ref"].alias("ref"), u["to"].alias("to"), u["evidence"].alias("evidence"), u["sigs"].alias("sigs"))).alias("updates"))
    fixed = [F.lit(LAST).alias("ent"), *[F.lit("_updates").alias(c) for c in ("entity_id", "name")], F.lit("other").alias("type")]
    sources = F.array_distinct(F.flatten(F.transform("updates", lambda u: u["sigs"]))).alias("sigs")
    return rows.select(*AT, *fixed, sources, F.lit(0.0).alias("importance"), F.lit(1.0).alias("confidence"), F.lit("fact status updates").alias("reason"), F.lit("update").alias("how"), "updates")


def appended(old: DataFrame, new: DataFrame) -> DataFrame:
    """old observations and new ones (chat_id, batch_id, ent, ...), numbered on from their chat's last (H1)."""
    last = old.groupBy("chat_id").agg(F.max("obs_id").alias("_last"))
    number = F.row_number().over(Window.partitionBy("chat_id").orderBy("batch_id", "ent"))
    rows = new.join(last, "chat_id", "left").withColumn("obs_id", F.coalesce("_last", F.lit(0).cast("long")) + number)
    return old.unionByName(rows.select(*[c for c in old.columns if c in rows.columns]), allowMissingColumns=True)


def marked(scanned: DataFrame, window: DataFrame, good: DataFrame) -> DataFrame:
    """scanned with the messages of the good batches, context left out, even if nothing came of them (H2)."""
    new = window.where("not is_context").join(good.select(*AT).distinct(), AT, "left_semi").select("chat_id", "sig")
    return scanned.select("chat_id", "sig").unionByName(new).distinct()


def run_rows(read: DataFrame, window: DataFrame, entities: DataFrame, dropped: DataFrame) -> DataFrame:
    """(chat_id, batch_id, ok, n, added, dropped, error) of each batch that was asked (E15); read: (chat_id, batch_id, ok)."""
    n = window.where("not is_context").groupBy(*AT).agg(F.count("*").cast("int").alias("n"))
    added, lost = (df.groupBy(*AT).agg(F.count("*").cast("int").alias(c)) for df, c in ((entities, "added"), (dropped, "dropped")))
    rows = read.select(*AT, "ok").join(n, AT, "left").join(added, AT, "left").join(lost, AT, "left")
    return rows.withColumn("error", F.when(~F.col("ok"), "no usable JSON")).fillna(0, ["n", "added", "dropped"])


def newest_runs(old: DataFrame, new: DataFrame, most: int = RUN_ROWS) -> DataFrame:
    """The newest runs of each chat, new ones numbered on from the last."""
    last = old.groupBy("chat_id").agg(F.max("seq").alias("_last"))
    seq = F.coalesce("_last", F.lit(-1).cast("long")) + F.row_number().over(Window.partitionBy("chat_id").orderBy("batch_id"))
    rows = old.unionByName(new.join(last, "chat_id", "left").withColumn("seq", seq).select(*old.columns))
    rank = F.row_number().over(Window.partitionBy("chat_id").orderBy(F.col("seq").desc()))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def prune_dormant(observations: DataFrame, where: DataFrame, keep_newest: int = 4000) -> DataFrame:
    """All live observations and the newest dormant ones, so many together."""
    live = C.alive(observations, where).select("chat_id", "obs_id").withColumn("_live", F.lit(True))
    marks = observations.join(live, ["chat_id", "obs_id"], "left").withColumn("_live", F.coalesce("_live", F.lit(False)))
    lives = F.sum(F.col("_live").cast("int")).over(Window.partitionBy("chat_id"))
    rank = F.row_number().over(Window.partitionBy("chat_id", "_live").orderBy(F.col("obs_id").desc()))
    out = marks.withColumn("_n", lives).withColumn("_rank", rank).where(F.col("_live") | (F.col("_rank") <= F.greatest(F.lit(0), F.lit(keep_newest) - F.col("_n"))))
    return out.select(*observations.columns)


def forgotten(rows: DataFrame, chats: DataFrame) -> DataFrame:
    """rows without those of the chats that are to be read anew."""
    return rows.join(chats.select("chat_id").distinct(), "chat_id", "left_anti").select(*rows.columns)


def branched(rows: DataFrame, branches: DataFrame) -> DataFrame:
    """rows with those of each branch's origin under its own id as well; branches: (chat_id, new_id)."""
    copies = rows.join(branches.select("chat_id", "new_id").distinct(), "chat_id").withColumn("chat_id", F.col("new_id"))
    return rows.unionByName(copies.select(*rows.columns))


def ledgers(owners: DataFrame, chats: DataFrame) -> DataFrame:
    """(chat_id, origin, how) for chats (chat_id, origin): `kept` if it has a ledger, `branch` if its origin has one, else `new` (A2)."""
    own, of_origin = (owners.select(F.col("chat_id").alias(c), F.lit(True).alias(f)).distinct() for c, f in (("chat_id", "_own"), ("origin", "_parent")))
    met = chats.join(own, "chat_id", "left").join(of_origin, "origin", "left")
    return met.select("chat_id", "origin", F.when(F.col("_own").isNotNull(), "kept").when(F.col("_parent").isNotNull(), "branch").otherwise("new").alias("how"))
