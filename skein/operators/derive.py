"""The view: entities with their votes, rollups, facts, and promotion state (E, K8-K10)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions.settings import Settings
from skein.operators import chain as C
from skein.operators import fold as K

FACTS = "array<struct<text:string,status:string,slot:string,changed:boolean,evidence:string,by:string,sigs:array<string>,rel_kind:string,other:string>>"
UPDATES = "array<struct<ref:string,to:string,evidence:string,sigs:array<string>>>"
OBSERVATIONS = (
    "chat_id string, obs_id long, entity_id string, name string, type string, aliases array<string>, keys array<string>, sigs array<string>, "
    f"importance double, confidence double, reason string, static_id string, how string, facts {FACTS}, updates {UPDATES}"
)
ENTITY_STATE = "chat_id string, entity_id string, status string, lock boolean, protected boolean, keep boolean, merge_into string, name string, type string, lock_reason string"
DECISIONS = "chat_id string, pair_key string, decision string"
STATICS = "chat_id string, static_id string, name string, keys array<string>, type string, content string"
HOPS = 8


@dataclass
class View:
    entities: DataFrame
    facts: DataFrame
    conflicts: DataFrame


def merge_redirect(state: DataFrame) -> DataFrame:
    """(chat_id, entity_id, target): where merged entities lead, over at most HOPS steps."""
    step = state.where("merge_into is not null and merge_into <> ''").select("chat_id", "entity_id", F.col("merge_into").alias("target"))
    follow = step.select("chat_id", F.col("entity_id").alias("target"), F.col("target").alias("next"))
    out = step
    for _ in range(HOPS - 1):
        out = out.join(follow, ["chat_id", "target"], "left").select("chat_id", "entity_id", F.coalesce("next", "target").alias("target"))
    return out


def top(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """keys and the most frequent value; of equals the one seen first."""
    seen = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_n").desc(), "_first"))
    return seen.withColumn("_rank", rank).where("_rank = 1").select(*keys, value)


def first_distinct(rows: DataFrame, keys: list[str], value: str, order: list[str], most: int | None = None) -> DataFrame:
    """keys and `values`: the distinct values in order of first appearance, so many at most."""
    seen = rows.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_first"))
    if most is not None:
        seen = seen.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_first"))).where(F.col("_rank") <= most)
    return seen.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_first", value))), lambda s: s[value]).alias("values"))


def episode_counts(places: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """keys, appear, span and episodes from distinct (keys, pos): gaps and islands."""
    before = F.lag("pos").over(Window.partitionBy(*keys).orderBy("pos"))
    starts = F.when(F.col("_before").isNull() | (F.col("pos") - F.col("_before") > gap), 1).otherwise(0)
    return (
        places.withColumn("_before", before)
        .groupBy(*keys)
        .agg(F.count("*").cast("int").alias("appear"), (F.max("pos") - F.min("pos")).alias("span"), F.sum(starts).cast("int").alias("episodes"))
    )


def rule_of(settings: Settings, kind: Column, member: str) -> Column:
    """A member of a type's rule, of the rule for other types if it has none."""
    known = F.create_map(*[F.lit(x) for name, r in settings.type_rules.items() for x in (name, getattr(r, member))])
    return F.coalesce(F.try_element_at(known, kind), F.lit(getattr(settings.rule("other"), member)))


def rollup(seen: DataFrame, keys: list[str], at: str = "at") -> DataFrame:
    """Live observations of each entity: how many, from where to where, importance and confidence."""
    return seen.groupBy(*keys).agg(
        F.count("*").alias("live_obs"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.max("importance").alias("imp_max"),
        F.avg("importance").alias("imp_avg"), F.max("confidence").alias("conf_max"), F.avg("confidence").alias("conf_avg"),
    )


def redirected(rows: DataFrame, state: DataFrame) -> DataFrame:
    """rows with the entities that merged ones lead to."""
    return rows.join(merge_redirect(state), ["chat_id", "entity_id"], "left").withColumn("entity_id", F.coalesce("target", "entity_id")).drop("target")


def fact_rows(seen: DataFrame, where: DataFrame) -> DataFrame:
    """The live facts of live observations, one a row with its id and chain position."""
    at = ["chat_id", "entity_id", "obs_id", "at"]
    facts = seen.select(*at, F.posexplode("facts").alias("ord", "f")).select(*at, "ord", "f.*").where("size(sigs) > 0")
    return C.all_alive(facts, ["obs_id", "ord"], where).withColumn("fact_id", X.fact_id("entity_id", "text"))


def update_rows(live: DataFrame, where: DataFrame) -> DataFrame:
    """The live status updates of live observations."""
    updates = live.where("how = 'update'").select("chat_id", "obs_id", "at", F.posexplode("updates").alias("ord", "u"))
    updates = updates.select("chat_id", "obs_id", "at", "ord", "u.ref", "u.to", "u.sigs").where("size(sigs) > 0")
    return C.all_alive(updates, ["obs_id", "ord"], where).drop("sigs")


def user_state(state: DataFrame) -> DataFrame:
    """What users set for an entity, under names of its own."""
    return state.select("chat_id", "entity_id", F.col("status").alias("user_status"), F.col("name").alias("user_name"), F.col("type").alias("user_type"), "lock", "protected", "keep")


def with_static(entities: DataFrame, statics: DataFrame) -> DataFrame:
    """entities with the name, keys and words of the static entry they refer to."""
    static = statics.select("chat_id", "static_id", F.col("name").alias("static_name"), F.col("keys").alias("static_keys"), X.content_tokens("content").alias("static_words"))
    return entities.join(static, ["chat_id", "static_id"], "left")


def marked_static(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """facts, with those that the static entry of their entity says already in state `in-static` (K8)."""
    words = X.content_tokens("text")
    covered = (F.col("state") == "active") & (F.size("static_words") > 0) & (F.size(words) >= 2) & (X.containment(words, F.col("static_words")) >= 0.85)
    met = facts.join(entities.select("chat_id", "entity_id", "static_words"), ["chat_id", "entity_id"], "left")
    return met.withColumn("state", F.when(F.coalesce(covered, F.lit(False)), "in-static").otherwise(F.col("state"))).drop("static_words")


def renderable(facts: DataFrame) -> DataFrame:
    """The facts that are shown: active ones, open conflicts, and disputed ones."""
    return facts.where("state in ('active', 'conflict') or disputed")


def with_content(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """entities with has_content: whether any fact is active."""
    key = ["chat_id", "entity_id"]
    content = facts.groupBy(*key).agg(F.bool_or(F.col("state") == "active").alias("has_content"))
    return entities.join(content, key, "left").withColumn("has_content", F.coalesce("has_content", F.lit(False)))


def classify(settings: Settings) -> tuple[Column, Column]:
    """(state, reason) from the columns of a rolled-up entity: the first rule that fires (K9)."""
    on, times, least = (rule_of(settings, F.col("type"), member) for member in ("on", "min_appearances", "min_importance"))
    floor = F.greatest(F.lit(float(settings.min_importance)), least.cast("double"))
    instant = F.col("imp_max") >= settings.instant_importance
    recurring = (F.col("episodes") >= times) | (F.col("appear") >= settings.long_episode_msgs)
    number = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    bar = number(F.lit(float(settings.instant_importance)))
    rows = [
        (F.col("user_status") == "reject", "rejected", F.lit("rejected by user")),
        (F.col("static_id").isNotNull() & F.lit(settings.static_match == "ignore"), "rejected", F.lit("exists in static lore (ignored by setting)")),
        ((F.col("user_status") == "promote") & F.col("has_content"), "promoted", F.lit("promoted by user")),
        (F.col("user_status") == "promote", "candidate", F.lit("promoted by user but no facts yet")),
        (~on, "excluded", F.concat(F.lit('type "'), F.col("type"), F.lit('" is excluded'))),
        (F.col("conf_max") < settings.min_confidence, "candidate", F.concat(F.lit("confidence "), F.format_string("%.2f", F.col("conf_max")), F.lit(" < "), F.lit(f"{settings.min_confidence:g}"))),
        ((F.col("imp_max") < floor) & ~instant, "candidate", F.concat(F.lit("importance "), F.format_string("%.1f", F.col("imp_max")), F.lit(" < "), number(floor))),
        (~instant & ~recurring, "candidate", F.concat(F.lit("seen in "), F.col("episodes"), F.lit(" scene(s); needs "), times, F.lit(" or importance ≥ "), bar)),
        (~F.col("has_content") & F.col("static_id").isNotNull(), "candidate", F.lit("nothing new beyond static lore")),
        (~F.col("has_content"), "candidate", F.lit("no established facts yet")),
        (instant, "promoted", F.concat(F.lit("importance "), F.format_string("%.1f", F.col("imp_max")), F.lit(" ≥ "), bar)),
    ]
    last = F.concat(F.col("episodes"), F.lit(" scenes, importance "), F.format_string("%.1f", F.col("imp_max")))
    state, reason = F.lit("promoted"), last
    for condition, name, why in reversed(rows):
        fires = F.coalesce(condition, F.lit(False))
        state, reason = F.when(fires, name).otherwise(state), F.when(fires, why).otherwise(reason)
    return state, reason


def derive(spark: SparkSession, observations: DataFrame, messages_chain: DataFrame, settings: Settings, state: DataFrame | None = None, decisions: DataFrame | None = None, statics: DataFrame | None = None, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> View:
    """The whole projection for all chats at once (K10). cut may write a table and read it back, to keep plans short."""
    empty = lambda df, ddl: df if df is not None else spark.createDataFrame([], ddl)
    state, decisions, statics = empty(state, ENTITY_STATE), empty(decisions, DECISIONS), empty(statics, STATICS)
    key = ["chat_id", "entity_id"]
    where = C.positions(messages_chain)
    live = observations.join(C.alive(observations, where), ["chat_id", "obs_id"])
    moved = cut(redirected(live, state))
    seen = moved.where("how <> 'update'").withColumn("type", F.coalesce(F.when(F.col("type") != "", F.col("type")), F.lit("other")))
    facts = cut(fact_rows(seen, where))
    folded = cut(K.fold_facts(K.fold_input(facts, update_rows(moved, where), decisions), settings))

    order = ["at", "obs_id"]
    names = top(seen, key, "name", order)
    types = top(seen.where("type <> 'other'"), key, "type", order)
    referenced = seen.where("static_id is not null").groupBy(*key).agg(F.min(F.struct(*order, "static_id"))["static_id"].alias("static_id"))
    places = seen.select(*key, F.explode("positions").alias("pos")).distinct()
    e = rollup(seen, key).join(names, key).join(types, key, "left").join(referenced, key, "left").join(episode_counts(places, key, settings.episode_gap), key).join(user_state(state), key, "left")
    e = e.withColumn("name", F.coalesce("user_name", "name")).withColumn("type", F.coalesce("user_type", "type", F.lit("other"))).drop("user_name", "user_type")

    e = cut(e)
    called = seen.select(*key, F.lit(0).alias("_src"), *order, F.lit(0).alias("_i"), F.col("name").alias("alias")).unionByName(
        seen.select(*key, F.lit(1).alias("_src"), *order, F.posexplode("aliases").alias("_i", "alias"))
    )
    other = called.join(e.select(*key, F.col("name").alias("_name")), key).where(X.norm("alias") != X.norm("_name"))
    aliases = first_distinct(other, key, "alias", ["_src", *order, "_i"], 10).withColumnRenamed("values", "aliases")
    keyed = first_distinct(seen.select(*key, *order, F.posexplode("keys").alias("_i", "key")), key, "key", [*order, "_i"]).withColumnRenamed("values", "keys")
    none = F.array().cast("array<string>")
    e = with_static(e.join(aliases, key, "left").join(keyed, key, "left"), statics)
    e = e.withColumn("aliases", F.coalesce("aliases", none)).withColumn("keys", F.array_distinct(F.concat(F.coalesce("static_keys", none), F.coalesce("keys", none))))
    made = marked_static(folded.where("kind = 'fact'").drop("kind", "key", "old_id", "new_id", "old_text", "new_text"), e)
    e = with_content(e, made).drop("static_keys", "static_words")
    how, why = classify(settings)
    e = e.withColumn("state", how).withColumn("reason", why)
    e, made = cut(e), cut(made)
    conflicts = folded.where("kind = 'conflict'").select(*key, "key", "slot", "old_id", "new_id", "old_text", "new_text").join(e.select(*key, F.col("name").alias("entity_name")), key, "left")
    return View(e, made, conflicts)
