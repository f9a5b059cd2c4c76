"""Untrusted extraction JSON to typed rows and an audit (C17, D1, G, I).

All set-based: entities, facts, relations and updates are exploded with their place, the first rule that fails gives the
reason, and rejects go to the audit (or are silent where the rules say so).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import lexicon as L
from skein.functions import text as X
from skein.functions.settings import Settings

MOST_ENTITIES, MOST_FACTS, MOST_RELATIONS, MOST_UPDATES, MOST_ALIASES, MOST_KEYS = 40, 14, 8, 30, 8, 10
AT = ["chat_id", "batch_id"]
WHY = L.DROP_REASONS


class Validated:
    """What validate() made of answers. Each part is worked out when it is first asked for, and kept."""

    def __init__(self, parsed: Callable[[], DataFrame], parts: dict[str, Callable[[], tuple[DataFrame, DataFrame]]]):
        self._parsed, self._parts = lru_cache(parsed), {name: lru_cache(part) for name, part in parts.items()}

    @property
    def unusable(self) -> DataFrame:
        """The part of the audit on answers that are not of the shape at all."""
        return self._parsed().where("not usable").select(*AT, F.lit("response").alias("what"), F.lit(WHY["no_shape"]).alias("why"))

    entities = property(lambda self: self._parts["entities"]()[0])
    facts = property(lambda self: self._parts["facts"]()[0])
    relations = property(lambda self: self._parts["relations"]()[0])
    updates = property(lambda self: self._parts["updates"]()[0])

    @property
    def dropped(self) -> DataFrame:
        """The audit of all parts."""
        out = self.unusable
        for part in self._parts.values():
            out = out.unionByName(part()[1])
        return out


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _truthy(v: Column, path: str) -> Column:
    """Whether a member counts as true in JSON's own language: not absent, null, false, zero or empty text."""
    kind = F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))
    number = F.coalesce(_get(v, path, "double"), F.lit(0.0))
    return F.when(kind == "VOID", False).when(kind == "BOOLEAN", F.coalesce(_get(v, path, "boolean"), F.lit(False))).when(kind == "STRING", F.coalesce(_get(v, path), F.lit("")) != "").when(kind.rlike("^(OBJECT|ARRAY)"), True).otherwise(number != 0)


def _list(v: Column, path: str, most: int | None = None) -> Column:
    """An array member as variants, the first ones; empty where it is no array."""
    items = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    return items if most is None else F.slice(items, 1, most)


def _objects(rows: DataFrame, path: str, most: int, name: str) -> DataFrame:
    """One row for each object in the list; other items are skipped without a word."""
    out = rows.select("*", F.posexplode(_list(F.col("v"), path, most)).alias(name, "_item"))
    return out.where(F.schema_of_variant("_item").startswith("OBJECT")).drop("v").withColumnRenamed("_item", "v")


def _cited(rows: DataFrame, path: str, window: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with the window rows that a list of numbers names: sigs, texts and whether all are the player's."""
    numbers = F.transform(_list(F.col("v"), path), lambda x: F.try_variant_get(x, "$", "double").try_cast("int"))
    each = rows.select(*AT, *keys, F.posexplode(F.array_distinct(numbers)).alias("_i", "n"))
    met = each.join(window.select(*AT, "n", "sig", "text", "is_user"), [*AT, "n"]).groupBy(*AT, *keys).agg(F.array_sort(F.collect_list(F.struct("_i", "sig", "text", "is_user"))).alias(name))
    return rows.join(met, [*AT, *keys], "left")


def _why(rules: list[tuple[Column, str]]) -> Column:
    """The first failing rule's reason, '' for a silent one, null if none fails."""
    out = F.lit(None).cast("string")
    for condition, reason in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), reason).otherwise(out)
    return out


def _sources(cited: str) -> list[Column]:
    c = F.col(cited)
    return [
        F.array_distinct(F.transform(c, lambda m: m["sig"])).alias("sigs"),
        F.when(F.forall(c, lambda m: m["is_user"]), "player").otherwise("story").alias("by"),
    ]


def _texts(cited: str) -> Column:
    return F.array_join(F.transform(F.col(cited), lambda m: m["text"]), " ")


def validate(extractions: DataFrame, window: DataFrame, settings: Settings, known_facts: DataFrame | None = None, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> Validated:
    """extractions: (chat_id, batch_id, raw); window: (chat_id, batch_id, n, sig, is_user, text, ...)."""
    names = settings.protagonist

    @lru_cache
    def parsed() -> DataFrame:
        rows = cut(extractions.select(*AT, X.tolerant_json("raw").alias("v")))
        return rows.withColumn("usable", _get(F.col("v"), "$.entities", "array<variant>").isNotNull())

    @lru_cache
    def checked() -> DataFrame:
        e = _objects(parsed().where("usable").drop("usable"), "$.entities", MOST_ENTITIES, "ent")
        action = _get(F.col("v"), "$.action")
        e = e.withColumn("name", X.sanitize(_get(F.col("v"), "$.name"), 60)).withColumn("action", F.when(action.isin(L.ACTIONS), action).otherwise("mention"))
        kind = _get(F.col("v"), "$.type")
        e = e.withColumn("type", F.when(kind.isin(L.TYPES), kind).otherwise("other"))
        e = _cited(e, "$.messages", window, ["ent"], "cited")
        excluded = F.col("type").isin(list(settings.excluded_types)) if settings.excluded_types else F.lit(False)
        e = e.withColumn("_why", _why([
            (F.col("name") == "", WHY["no_name"]), (F.col("action") == "ignore", ""), (X.is_protagonist("name", names), WHY["protagonist"]),
            (excluded, "type excluded"), (F.col("cited").isNull(), WHY["no_source"]),
        ]))
        e = e.withColumn("_why", F.when(F.col("_why") == "type excluded", F.concat(F.lit("type "), "type", F.lit(" excluded"))).otherwise(F.col("_why")))
        return cut(e)

    @lru_cache
    def owners() -> DataFrame:
        e = checked().where("_why is null")
        return e.select(*AT, "ent", F.col("name").alias("owner"), F.col("cited").alias("inherited"), "v")

    def entities_() -> tuple[DataFrame, DataFrame]:
        e = checked()
        audit = e.where("_why <> ''").select(*AT, F.when(F.col("name") == "", "entity").otherwise(F.col("name")).alias("what"), F.col("_why").alias("why"))
        e = e.where("_why is null").drop("_why")
        strings = lambda path: F.transform(_list(F.col("v"), path), lambda x: F.try_variant_get(x, "$", "string"))
        alias = F.filter(F.transform(strings("$.aliases"), lambda a: X.sanitize(a, 60)), lambda a: (a != "") & (X.norm(a) != X.norm("name")) & ~X.is_protagonist(a, names))
        key = F.filter(F.transform(strings("$.keys"), lambda k: X.sanitize_key(k)), lambda k: k.isNotNull())
        entities = e.select(
            *AT, "ent", "name", X.sanitize(_get(F.col("v"), "$.matches_id"), 80).alias("matches_id"), "type", "action",
            F.slice(F.array_distinct(alias), 1, MOST_ALIASES).alias("aliases"), F.slice(F.array_distinct(key), 1, MOST_KEYS).alias("keys"),
            X.clamp(_get(F.col("v"), "$.importance"), 0, 10).alias("importance"), X.clamp(_get(F.col("v"), "$.confidence"), 0, 1).alias("confidence"),
            X.sanitize(_get(F.col("v"), "$.reason"), 140).alias("reason"), _sources("cited")[0],
        )
        return entities, audit

    def facts_() -> tuple[DataFrame, DataFrame]:
        f = _cited(_objects(owners(), "$.facts", MOST_FACTS, "ord"), "$.messages", window, ["ent", "ord"], "own").withColumn("cited", F.coalesce("own", "inherited"))
        status, slot = _get(F.col("v"), "$.status"), F.replace(X.norm(_get(F.col("v"), "$.slot")), F.lit(" "), F.lit("_"))
        f = f.withColumn("text", X.sanitize(_get(F.col("v"), "$.text"), 180)).withColumn("holds", X.evidence_holds(_get(F.col("v"), "$.evidence"), _texts("cited")))
        f = f.withColumn("status", F.when(status.isin(L.STATUSES), status).otherwise("unresolved"))
        strict = settings.evidence_strictness == "strict"
        f = f.withColumn("_why", _why([
            (F.length("text") < 3, ""), (X.violates_agency("text", names), WHY["agency"]),
            (~F.col("holds") & F.lit(strict), WHY["no_quote"]),
        ]))
        f = cut(f)
        audit = f.where("_why <> ''").select(*AT, F.col("text").alias("what"), F.col("_why").alias("why"))
        softened = F.when(~F.col("holds") & (F.col("status") == "confirmed"), "unresolved").otherwise(F.col("status"))
        facts = f.where("_why is null").select(
            *AT, "ent", "ord", "text", X.guard_status("text", softened).alias("status"), F.when(slot.isin(L.SLOTS), slot).otherwise("").alias("slot"),
            _truthy(F.col("v"), "$.changes_previous").alias("changed"), X.sanitize(_get(F.col("v"), "$.evidence"), 140).alias("evidence"), *_sources("cited"),
        )
        return facts, audit

    def relations_() -> tuple[DataFrame, DataFrame]:
        r = _cited(_objects(owners(), "$.relationships", MOST_RELATIONS, "ord"), "$.messages", window, ["ent", "ord"], "own").withColumn("cited", F.coalesce("own", "inherited"))
        rel = _get(F.col("v"), "$.kind")
        r = r.withColumn("other", X.sanitize(_get(F.col("v"), "$.other"), 60)).withColumn("rel_kind", F.when(rel.isin(L.RELATIONS), rel).otherwise("other"))
        given = _get(F.col("v"), "$.text")
        r = r.withColumn("text", X.sanitize(F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(F.replace("rel_kind", F.lit("_"), F.lit(" "))), 100))
        romantic = F.col("rel_kind").isin(L.ROMANTIC)
        r = r.withColumn("_why", _why([
            ((F.col("other") == "") | (X.norm("other") == X.norm("owner")), ""), (X.violates_agency(F.concat_ws(" ", "other", "text"), names) & ~romantic, WHY["bond_agency"]),
            (romantic & ~_truthy(F.col("v"), "$.explicit"), WHY["not_explicit"]),
            (~X.evidence_holds(_get(F.col("v"), "$.evidence"), _texts("cited")), WHY["bond_no_quote"]),
        ]))
        pair = F.concat("owner", F.lit("↔"), "other", F.when(F.col("_why").startswith("romantic"), F.concat(F.lit(":"), "rel_kind")).otherwise(""))
        r = cut(r)
        audit = r.where("_why <> ''").select(*AT, pair.alias("what"), F.col("_why").alias("why"))
        relations = r.where("_why is null").select(
            *AT, "ent", "ord", "text", F.lit("confirmed").alias("status"), F.concat(F.lit("rel:"), X.norm("other")).alias("slot"),
            _truthy(F.col("v"), "$.changes_previous").alias("changed"), X.sanitize(_get(F.col("v"), "$.evidence"), 140).alias("evidence"), *_sources("cited"), "rel_kind", "other",
        )
        return relations, audit

    def updates_() -> tuple[DataFrame, DataFrame]:
        u = _cited(_objects(parsed().where("usable").drop("usable"), "$.fact_updates", MOST_UPDATES, "ord"), "$.messages", window, ["ord"], "cited")
        u = u.withColumn("ref", X.sanitize(_get(F.col("v"), "$.fact_id"), 24)).withColumn("to", _get(F.col("v"), "$.new_status"))
        if known_facts is None:
            u = u.withColumn("_known", F.lit(True))
        else:
            u = u.join(known_facts.select("chat_id", F.col("fact_id").alias("ref")).distinct().withColumn("_known", F.lit(True)), ["chat_id", "ref"], "left")
        u = u.withColumn("_why", _why([
            ((F.col("ref") == "") | F.col("_known").isNull(), WHY["unknown_fact"]), (~F.coalesce(F.col("to").isin(L.UPDATE_STATES), F.lit(False)) | F.col("cited").isNull(), ""),
            (~X.evidence_holds(_get(F.col("v"), "$.evidence"), _texts("cited")), WHY["update_no_quote"]),
        ]))
        u = cut(u)
        audit = u.where("_why <> ''").select(*AT, F.concat(F.lit("update "), "ref").alias("what"), F.col("_why").alias("why"))
        updates = u.where("_why is null").select(*AT, "ord", "ref", "to", X.sanitize(_get(F.col("v"), "$.evidence"), 140).alias("evidence"), _sources("cited")[0])
        return updates, audit

    return Validated(parsed, {"entities": entities_, "facts": facts_, "relations": relations_, "updates": updates_})
