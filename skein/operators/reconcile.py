"""Reconciling the view with the target book: plan, apply, review, undo (M).

Everything is keyed by (chat_id, entity_id); an operation table is the only thing that changes a book, a book is only
ever replaced by a new table, and only the four managed columns of managed entries change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions.settings import Settings
from skein.operators.render import entry_template, render

BOOK = "chat_id string, uid int, comment string, content string, key array<string>, disable boolean, extra map<string,string>"
WRITTEN = "chat_id string, entity_id string, uid int, content_hash string, keys_hash string"
SNAP = "struct<content:string,key:array<string>,comment:string,disable:boolean>"
OPS = f"chat_id string, type string, entity_id string, uid int, name string, why string, before {SNAP}, after {SNAP}"
LOG = f"chat_id string, seq long, kind string, entity_id string, uid int, name string, why string, before {SNAP}, after {SNAP}"
KEY = ["chat_id", "entity_id"]
LOG_ROWS = 300


@dataclass
class Plan:
    ops: DataFrame
    held: DataFrame


@dataclass
class Applied:
    book: DataFrame
    written: DataFrame
    state: DataFrame
    log: DataFrame


def managed(book: DataFrame) -> DataFrame:
    """The managed entry of each entity: of several, the one with the largest uid."""
    own = book.withColumn("entity_id", X.managed_id("comment")).where("entity_id is not null")
    last = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("uid").desc()))
    snap = F.struct("content", "key", "comment", F.coalesce("disable", F.lit(False)).alias("disable"))
    return own.withColumn("_last", last).where("_last = 1").select(*KEY, "uid", snap.alias("before"))


def _edited() -> Column:
    """Whether the entry differs from what was last written; false if nothing is known to be written."""
    content, keys = F.md5(F.coalesce("before.content", F.lit(""))), F.md5(F.array_join(F.coalesce("before.key", F.array().cast("array<string>")), "|"))
    return F.coalesce((content != F.col("w_content")) | (keys != F.col("w_keys")), F.lit(False))


def matched(entities: DataFrame, facts: DataFrame, book: DataFrame, written: DataFrame, state: DataFrame, settings: Settings) -> DataFrame:
    """Every card that should be there and every managed entry that is, side by side (D13), with whether the entry was edited."""
    cards = render(entities.where("state = 'promoted'").drop("lock", "protected", "keep"), facts, settings)
    cards = cards.select(*KEY, F.col("name").alias("card_name"), F.col("reason").alias("card_reason"), F.struct("content", F.col("card_keys").alias("key"), "comment", F.lit(False).alias("disable")).alias("card"))
    known = written.select(*KEY, F.col("content_hash").alias("w_content"), F.col("keys_hash").alias("w_keys"))
    flags = state.select(*KEY, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("lock", "protected", "keep")])
    why = entities.select(*KEY, F.col("reason").alias("reason"))
    both = cards.join(managed(book), KEY, "full").join(known, KEY, "left").join(flags, KEY, "left").join(why, KEY, "left")
    both = both.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("lock", "protected", "keep")}).withColumn("edited", _edited())
    return both.withColumn("wanted", F.col("card").isNotNull()).withColumn("there", F.col("before").isNotNull())


def plan(entities: DataFrame, facts: DataFrame, book: DataFrame, written: DataFrame, state: DataFrame, settings: Settings) -> Plan:
    """The operations that bring the book up to the view, and what is held back (M1-M6)."""
    both = matched(entities, facts, book, written, state, settings)
    card, before = F.col("card"), F.col("before")
    usable, guarded = F.size("card.key") > 0, F.col("lock") | (F.col("edited") & F.lit(settings.on_manual_edit != "overwrite"))
    differs = (~before["content"].eqNullSafe(card["content"])) | (F.array_join(F.coalesce(before["key"], F.array().cast("array<string>")), "|") != F.array_join(card["key"], "|")) | before["disable"] | ~before["comment"].eqNullSafe(card["comment"])
    wanted, there = F.col("wanted"), F.col("there")
    kept = F.col("lock") | F.col("protected") | F.col("edited")
    kind = (
        F.when(wanted & ~usable, None)
        .when(wanted & ~there, "create")
        .when(wanted & guarded, F.when(F.col("edited") & ~F.col("lock"), "lock"))
        .when(wanted, F.when(differs, "update"))
        .when(F.col("keep"), None)
        .when(kept, F.when(~before["disable"], "disable"))
        .otherwise("remove")
    )
    gone = F.when(F.col("reason").isNull(), "its source messages are no longer in the active chat").otherwise(F.concat(F.lit("no longer meets promotion rules ("), "reason", F.lit(")")))
    told = F.when(F.col("type") == "create", F.col("card_reason")).when(F.col("type") == "update", "facts changed").when(F.col("type") == "lock", "manual edit detected")
    told = told.when(F.col("type") == "disable", F.concat(gone, F.lit("; kept because it is locked/edited"))).otherwise(gone)
    off = F.struct(before["content"].alias("content"), before["key"].alias("key"), before["comment"].alias("comment"), F.lit(True).alias("disable"))
    after = F.when(F.col("type").isin("create", "update"), card).when(F.col("type") == "disable", off)
    ops = both.withColumn("type", kind).where("type is not null")
    ops = ops.select("chat_id", "type", "entity_id", "uid", F.coalesce("card_name", "before.comment").alias("name"), told.alias("why"), before.alias("before"), after.alias("after"))
    held = both.where(wanted & (~usable | (there & guarded)))
    held = held.select(*KEY, F.col("card_name").alias("name"), F.when(~usable, "no usable keys").when(F.col("lock"), "locked by user").otherwise("edited manually").alias("why"))
    return Plan(ops, held)


def keyed(ops: DataFrame) -> DataFrame:
    """Operations with op_key, which identifies a proposal."""
    return ops.withColumn("op_key", X.op_key("type", "entity_id", F.col("after.content"), F.col("after.key")))


def review(ops: DataFrame, rejected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what may be applied at once, what waits for approval), without rejected proposals."""
    fresh = keyed(ops).join(rejected.select("chat_id", "op_key").distinct(), ["chat_id", "op_key"], "left_anti")
    return fresh.where("type in ('lock', 'disable')"), fresh.where("type not in ('lock', 'disable')")


def approved(ops: DataFrame, picks: DataFrame) -> DataFrame:
    """The planned operations whose proposal was approved."""
    return keyed(ops).join(picks.select("chat_id", "op_key").distinct(), ["chat_id", "op_key"], "left_semi").drop("op_key")


def next_uids(rows: DataFrame, book: DataFrame, order: str = "entity_id") -> DataFrame:
    """rows with new uids, counted on from the largest of their chat's book."""
    top = book.groupBy("chat_id").agg(F.max("uid").alias("_top"))
    rank = F.row_number().over(Window.partitionBy("chat_id").orderBy(order))
    return rows.join(top, "chat_id", "left").withColumn("uid", (F.coalesce("_top", F.lit(-1)) + rank).cast("int")).drop("_top")


def trimmed(log: DataFrame, most: int = LOG_ROWS) -> DataFrame:
    """The newest rows of each chat's log."""
    rank = F.row_number().over(Window.partitionBy("chat_id").orderBy(F.col("seq").desc()))
    return log.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def logged(log: DataFrame, rows: DataFrame) -> DataFrame:
    """log with the rows added behind its last one, capped."""
    last = log.groupBy("chat_id").agg(F.max("seq").alias("_last"))
    seq = F.coalesce("_last", F.lit(-1).cast("long")) + F.row_number().over(Window.partitionBy("chat_id").orderBy("entity_id", "kind"))
    added = rows.join(last, "chat_id", "left").withColumn("seq", seq).select("chat_id", "seq", "kind", "entity_id", "uid", "name", "why", "before", "after")
    return trimmed(log.unionByName(added))


def noted(log: DataFrame, chats: DataFrame, kind: str, why: Column) -> DataFrame:
    """log with one row for each chat that says what was done to it as a whole."""
    none = {"entity_id": "string", "uid": "int", "name": "string"}
    rows = chats.select("chat_id", F.lit(kind).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()], why.alias("why"), *[F.lit(None).cast(SNAP).alias(c) for c in ("before", "after")])
    return logged(log, rows)


def _put(state: DataFrame, rows: DataFrame, *changed: str) -> DataFrame:
    """state with the given columns of rows written over it, entity by entity."""
    new = rows.select(*KEY, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in changed])
    out = state.join(new, KEY, "full")
    hit = F.coalesce("_hit", F.lit(False))
    return out.select(*[F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in state.columns])


def apply_ops(ops: DataFrame, book: DataFrame, written: DataFrame, state: DataFrame, log: DataFrame, settings: Settings) -> Applied:
    """The book, what is written, the flags and the log after the operations (M7)."""
    extra = F.create_map(*[F.lit(x) for pair in entry_template(settings).items() for x in pair])
    made = next_uids(ops.where("type = 'create'"), book)
    ops = made.unionByName(ops.where("type <> 'create'"))
    change = ops.where("type in ('update', 'remove', 'disable')").select("chat_id", "uid", F.col("type").alias("_type"), F.col("after").alias("_after"))
    new = F.col("_type") == "update"
    kept = book.join(change, ["chat_id", "uid"], "left").where("_type is null or _type <> 'remove'")
    kept = kept.select(
        "chat_id", "uid", *[F.when(new, F.col(f"_after.{c}")).otherwise(F.col(c)).alias(c) for c in ("comment", "content", "key")],
        F.when(new, False).when(F.col("_type") == "disable", True).otherwise(F.col("disable")).alias("disable"), "extra",
    )
    created = made.select("chat_id", "uid", "after.comment", "after.content", "after.key", F.lit(False).alias("disable"), extra.alias("extra"))
    wrote = ops.where("type in ('create', 'update')").select(*KEY, "uid", F.md5("after.content").alias("content_hash"), F.md5(F.array_join("after.key", "|")).alias("keys_hash"))
    forgotten = ops.where("type in ('create', 'update', 'remove')").select(*KEY)
    locks = ops.where("type = 'lock'").withColumn("lock", F.lit(True)).withColumn("lock_reason", F.lit("manual edit detected"))
    return Applied(
        kept.unionByName(created),
        written.join(forgotten, KEY, "left_anti").unionByName(wrote),
        _put(state, locks, "lock", "lock_reason"),
        logged(log, ops.withColumnRenamed("type", "kind")),
    )


def rollback(log_row: DataFrame, book: DataFrame, written: DataFrame, state: DataFrame, log: DataFrame, settings: Settings) -> Applied:
    """Undoes one logged change for each chat in log_row; the entity is then kept from automation (M8)."""
    extra = F.create_map(*[F.lit(x) for pair in entry_template(settings).items() for x in pair])
    rows = log_row.select("chat_id", "kind", "entity_id", "uid", "name", "before")
    there = rows.join(book.select("chat_id", "uid"), ["chat_id", "uid"], "left_semi")
    undo = there.where("kind = 'create' or (kind in ('update', 'disable') and before is not null)").select("chat_id", "uid", "entity_id", "name", "kind", "before")
    lost = next_uids(rows.where("kind = 'remove' and before is not null").drop("uid"), book).select("chat_id", "uid", "entity_id", "name", "kind", "before")
    done = undo.unionByName(lost)
    own = undo.select("chat_id", "uid", F.col("kind").alias("_kind"), F.col("before").alias("_before"))
    back = F.col("_kind").isNotNull()
    kept = book.join(own, ["chat_id", "uid"], "left").where("_kind is null or _kind <> 'create'")
    kept = kept.select("chat_id", "uid", *[F.when(back, F.col(f"_before.{c}")).otherwise(F.col(c)).alias(c) for c in ("comment", "content", "key", "disable")], "extra")
    restored = lost.select("chat_id", "uid", "before.comment", "before.content", "before.key", F.lit(False).alias("disable"), extra.alias("extra"))
    wrote = done.where("kind <> 'create'").select(*KEY, "uid", F.md5("before.content").alias("content_hash"), F.md5(F.array_join("before.key", "|")).alias("keys_hash"))
    flags = done.where("kind <> 'create'").withColumn("lock", F.lit(True)).withColumn("keep", F.lit(True)).withColumn("lock_reason", F.lit("rolled back"))
    flagged = _put(_put(state, done.where("kind = 'create'").withColumn("status", F.lit("reject")), "status"), flags, "lock", "keep", "lock_reason")
    none = F.lit(None).cast(SNAP)
    entry = done.select("chat_id", F.lit("rollback").alias("kind"), "entity_id", F.lit(None).cast("int").alias("uid"), "name", F.concat(F.lit('undid "'), "kind", F.lit('"')).alias("why"), none.alias("before"), none.alias("after"))
    return Applied(kept.unionByName(restored), written.join(done, KEY, "left_anti").unionByName(wrote), flagged, logged(log, entry))


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)
