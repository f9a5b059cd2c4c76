"""Votes, rollups, the fold, classification, caps and reports (E, F, G, K, P) over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import lexicon as L
from skein.functions import text as X
from skein.functions.settings import Settings
from skein.operators import chain as C
from skein.operators import derive as D
from skein.operators import fold as K
from skein.operators import reconcile as M
from skein.operators import render as R
from skein.operators import report as P
from skein.plans import inputs as I
from skein.plans import sql as Q
from skein.plans.registry import add
from skein.plans.text_queries import PAIRS, pairs

KEY, GAP = ["chat_id", "entity_id"], 6
TYPE_OF = {"view": "character", "click": "item", "error": "event", "purchase": "quest", "signup": "other"}
SETTINGS = Settings()


def _events(f):
    return lambda spark, sf_dir: f(I.observed(spark, sf_dir))


def _with(*ctes: str, then: str) -> str:
    return "WITH " + ",".join([Q.OBSERVED, *ctes]) + "\n" + then


def _type(entity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in TYPE_OF.items() for x in p]), entity)


TYPE_SQL = "CASE entity_id " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPE_OF.items()) + " END"

add("e1_count_by", _events(lambda o: o.groupBy(*KEY).agg(F.count("*").alias("n"))), _with(then="SELECT chat_id, entity_id, count(*) AS n FROM obs GROUP BY ALL"))
TOP = "votes AS (SELECT chat_id, entity_id, count(*) AS n, min(pos) AS first FROM obs {where} GROUP BY ALL), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY n DESC, first) AS r FROM votes) WHERE r = 1)"
add("e2_top_key", _events(lambda o: D.top(o, ["chat_id"], "entity_id", ["pos"])), _with(TOP.format(where=""), then="SELECT chat_id, entity_id FROM top"))
add("e4_name_vote", _events(lambda o: D.top(o, ["chat_id"], "entity_id", ["pos"]).join(o.groupBy("chat_id").agg(F.max("value").alias("m")), "chat_id").select("chat_id", F.coalesce(F.when(F.col("m") > 250, "Named"), "entity_id").alias("name"))),
    _with(TOP.format(where=""), then="SELECT chat_id, CASE WHEN (SELECT max(value) FROM obs o WHERE o.chat_id = top.chat_id) > 250 THEN 'Named' ELSE entity_id END AS name FROM top"))
add("e5_type_vote", _events(lambda o: D.top(o.where("entity_id <> 'view'"), ["chat_id"], "entity_id", ["pos"])), _with(TOP.format(where="WHERE entity_id <> 'view'"), then="SELECT chat_id, entity_id FROM top"))
ROLL = "roll AS (SELECT chat_id, entity_id, count(*) AS live_obs, min(pos) AS first_at, max(pos) AS last_at, max(importance) AS imp_max, avg(importance) AS imp_avg, max(confidence) AS conf_max, avg(confidence) AS conf_avg FROM obs GROUP BY ALL)"
EPISODES = f"""epi AS (SELECT chat_id, entity_id, count(*) AS appear, max(pos) - min(pos) AS span, sum(CASE WHEN before IS NULL OR pos - before > {GAP} THEN 1 ELSE 0 END) AS episodes
  FROM (SELECT *, lag(pos) OVER (PARTITION BY chat_id, entity_id ORDER BY pos) AS before FROM obs) GROUP BY ALL)"""


def rolled(o: DataFrame) -> DataFrame:
    return D.rollup(o, KEY, "pos")


add("e6_alias_set", _events(lambda o: D.first_distinct(o, ["chat_id"], "entity_id", ["pos"], 3).select("chat_id", F.array_join("values", ",").alias("aliases"))),
    _with(TOP.format(where=""), then="SELECT chat_id, string_agg(entity_id, ',' ORDER BY first) AS aliases FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY first) AS k FROM votes) WHERE k <= 3 GROUP BY chat_id"))
add("e7_key_set", _events(lambda o: D.first_distinct(o, ["chat_id"], "entity_id", ["pos"]).select("chat_id", F.array_join(F.array_distinct(F.concat(F.array(F.lit("static"), F.lit("view")), "values")), ",").alias("keys"))),
    _with(TOP.format(where="WHERE entity_id <> 'view'"), then="SELECT o.chat_id, 'static,view' || coalesce(',' || v.keys, '') AS keys FROM (SELECT DISTINCT chat_id FROM obs) o LEFT JOIN (SELECT chat_id, string_agg(entity_id, ',' ORDER BY first) AS keys FROM votes GROUP BY chat_id) v USING (chat_id)"))
add("e8_distinct_positions", _events(lambda o: D.episode_counts(o.select(*KEY, "pos"), KEY, GAP).select(*KEY, "appear", "span")), _with(EPISODES, then="SELECT chat_id, entity_id, appear, span FROM epi"))
add("f2_episodes", _events(lambda o: D.episode_counts(o.select(*KEY, "pos"), KEY, GAP).select(*KEY, "episodes")), _with(EPISODES, then="SELECT chat_id, entity_id, episodes::INT AS episodes FROM epi"))
add("q11_session_gap", _events(lambda o: o.groupBy(*KEY).agg(C.episodes(F.sort_array(F.collect_set("pos")), 2).alias("sessions"))), _with(EPISODES.replace(f"> {GAP}", "> 2"), then="SELECT chat_id, entity_id, episodes::INT AS sessions FROM epi"))
add("e10_next_uid", _events(lambda o: M.next_uids(o.select("chat_id", "obs_id"), o.where("value > 100").select("chat_id", F.col("pos").alias("uid")), "obs_id")),
    _with(then="SELECT o.chat_id, obs_id, coalesce(t.m, -1) + row_number() OVER (PARTITION BY o.chat_id ORDER BY obs_id) AS uid FROM obs o LEFT JOIN (SELECT chat_id, max(pos) AS m FROM obs WHERE value > 100 GROUP BY chat_id) t USING (chat_id)"))


add("g5_cap_lengths", lambda spark, sf_dir: I.table(spark, sf_dir, "documents").select("doc_id", X.sanitize("text", 60).alias("name"), X.sanitize("text", 180).alias("fact"), X.sanitize("text", 140).alias("quote"), X.sanitize("text", 100).alias("relation")),
    f"SELECT doc_id, {Q.sanitize('text', 60)} AS name, {Q.sanitize('text', 180)} AS fact, {Q.sanitize('text', 140)} AS quote, {Q.sanitize('text', 100)} AS relation FROM documents")
LOGGED = "SELECT chat_id, seq FROM (SELECT chat_id, pos AS seq, row_number() OVER (PARTITION BY chat_id ORDER BY pos DESC) AS r FROM obs) WHERE r <= "
add("g8_cap_log", _events(lambda o: M.trimmed(o.select("chat_id", F.col("pos").alias("seq")), 30)), _with(then=LOGGED + "30"))
HISTORY = "SELECT chat_id, seq, rank, kind IN ('create', 'update', 'remove', 'disable') AS undoable FROM (SELECT chat_id, pos AS seq, CASE entity_id WHEN 'click' THEN 'create' WHEN 'view' THEN 'rollback' ELSE 'user' END AS kind, row_number() OVER (PARTITION BY chat_id ORDER BY pos DESC) AS rank FROM obs) WHERE rank <= 50"
add("g11_top_history", _events(lambda o: P.history(o.select("chat_id", F.col("pos").alias("seq"), F.when(F.col("entity_id") == "click", "create").when(F.col("entity_id") == "view", "rollback").otherwise("user").alias("kind")), 50).select("chat_id", "seq", "rank", "undoable")), _with(then=HISTORY))
add("f5_slot_rank_order", lambda spark, sf_dir: I.table(spark, sf_dir, "part").select("p_partkey", R.slot_rank(F.element_at(F.array(*map(F.lit, [*L.SLOTS, "none"])), F.pmod("p_size", F.lit(14)).cast("int") + 1), F.when(F.col("p_retailprice") > 1500, "ally")).alias("rank")),
    f"SELECT p_partkey, CASE WHEN p_retailprice > 1500 THEN 100 WHEN s = 'none' THEN 50 ELSE list_position([{Q.quote(L.SLOT_ORDER)}], s) - 1 END AS rank FROM (SELECT *, [{Q.quote([*L.SLOTS, 'none'])}][p_size % 14 + 1] AS s FROM part)")


# ---- the fold. A fact is one word for each kind of event, so that only equal facts are near-duplicates.
def facts(o: DataFrame, status: Column, slot: str) -> DataFrame:
    word = F.concat(F.lit("w"), F.md5("entity_id"))
    return o.select(
        "chat_id", F.lit("who").alias("entity_id"), F.lit("fact").alias("kind"), F.col("pos").alias("at"), "obs_id", F.lit(0).alias("ord"), X.fact_id(F.lit("who"), word).alias("fact_id"), word.alias("text"),
        status.alias("status"), F.lit(slot).alias("slot"), F.lit("").alias("val"), F.lit("story").alias("by"), F.lit("").alias("evidence"), F.lit(None).cast("string").alias("rel_kind"),
        F.lit(None).cast("string").alias("other"), F.lit(False).alias("changed"), F.array(F.col("obs_id").cast("string")).alias("sigs"), F.lit("active").alias("state"), F.lit(False).alias("disputed"),
        F.lit(None).cast("string").alias("sup_by"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("string").alias("to"),
    )


def _folded(status: str, slot: str, settings: Settings, columns: list[str]):
    """Facts after the fold; status and columns are SQL expressions."""
    return _events(lambda o: K.fold_facts(facts(o, F.expr(status), slot), settings).where("kind = 'fact'").selectExpr("chat_id", *columns))


WORDS = "w AS (SELECT chat_id, 'w' || md5(entity_id) AS text, CASE WHEN value < 50 THEN 'rumor' ELSE 'confirmed' END AS status, obs_id, pos FROM obs)"
SEEN = "seen AS (SELECT chat_id, text, count(*) AS n, min(pos) AS first FROM w GROUP BY ALL)"
add("k2_fact_dedupe", _folded("'rumor'", "", SETTINGS, ["text", "cast(size(sigs) as bigint) as n", "at"]), _with(WORDS, SEEN, then='SELECT chat_id, text, n, first AS "at" FROM seen'))
add("k5_slot_conflict", _folded("'confirmed'", "location", Settings(conflict_policy="latest"), ["text", "state"]), _with(WORDS, SEEN, then="SELECT chat_id, text, CASE WHEN first = max(first) OVER (PARTITION BY chat_id) THEN 'active' ELSE 'superseded' END AS state FROM seen"))
add("f6_conflict_prev", _folded("'confirmed'", "location", Settings(conflict_policy="latest"), ["text", "sup_by"]), _with(WORDS, SEEN, then="SELECT chat_id, text, 'F' || left(md5('who|' || lead(text) OVER (PARTITION BY chat_id ORDER BY first)), 12) AS sup_by FROM seen"))
add("k3_fact_settle", _folded("if(value < 50, 'rumor', 'confirmed')", "", SETTINGS, ["text", "status", "state"]),
    _with(WORDS, then="SELECT chat_id, text, status, CASE WHEN status = 'rumor' AND EXISTS (SELECT 1 FROM w c WHERE c.chat_id = r.chat_id AND c.text = r.text AND c.status = 'confirmed' AND c.pos > r.first) THEN CASE WHEN (SELECT min(c.pos) FROM w c WHERE c.chat_id = r.chat_id AND c.text = r.text AND c.status = 'confirmed') > r.first THEN 'superseded' ELSE 'active' END ELSE 'active' END AS state FROM (SELECT chat_id, text, status, min(pos) AS first FROM w GROUP BY ALL) r"))
def _longer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A location that grows by a word with each message: one refined fact a chat (K4)."""
    o = I.observed(spark, sf_dir)
    f = facts(o, F.lit("confirmed"), "location").withColumn("text", F.concat(F.lit("harbour"), F.when(F.col("at") > 0, " district").otherwise("")))
    return K.fold_facts(f, SETTINGS).where("kind = 'fact'").select("chat_id", "text", F.size("sigs").cast("long").alias("n"))


add("k4_slot_refine", _longer, _with(then="SELECT chat_id, CASE WHEN count(*) > 1 THEN 'harbour district' ELSE 'harbour' END AS text, count(*) AS n FROM obs GROUP BY chat_id"))


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rumors of every kind of event, then an update after all of them: errors were false, signups true."""
    o = I.observed(spark, sf_dir)
    f = facts(o, F.lit("rumor"), "")
    said = o.where("entity_id in ('error', 'signup')").select("chat_id", F.concat(F.lit("w"), F.md5("entity_id")).alias("w"), F.when(F.col("entity_id") == "error", "false").otherwise("confirmed").alias("to")).distinct()
    updates = said.select("chat_id", X.fact_id(F.lit("who"), F.col("w")).alias("ref"), "to", F.lit(1_000_000_000).alias("at"), F.lit(0).cast("long").alias("obs_id"), F.lit(0).alias("ord"))
    rows = f.drop("ref", "to").unionByName(K.route_updates(f, updates).withColumn("kind", F.lit("update")), allowMissingColumns=True)
    return K.fold_facts(rows, SETTINGS).where("kind = 'fact'").select("chat_id", "text", "status", "state")


TOLD = "SELECT chat_id, text, CASE WHEN text = 'w' || md5('signup') THEN 'confirmed' ELSE 'rumor' END AS status, CASE WHEN text = 'w' || md5('error') THEN 'false' ELSE 'active' END AS state FROM seen"
add("k6_fact_update", _told, _with(WORDS, SEEN, then=TOLD))


def _routed(o: DataFrame) -> DataFrame:
    """An update from every error, by the id of the fact about it; some ids are nobody's."""
    ref = F.when(F.col("pos") % 4 == 0, "F0").otherwise(X.fact_id(F.lit("who"), F.concat(F.lit("w"), F.md5("entity_id"))))
    updates = o.where("entity_id = 'error'").select("chat_id", ref.alias("ref"), F.lit("false").alias("to"), F.col("pos").alias("at"), "obs_id", F.lit(0).alias("ord"))
    return K.route_updates(facts(o, F.lit("rumor"), ""), updates).select("chat_id", "entity_id", "obs_id", "to")


add("d8_update_join", _events(_routed), _with(then="""SELECT chat_id, 'who' AS entity_id, obs_id, 'false' AS "to" FROM obs WHERE entity_id = 'error' AND pos % 4 <> 0"""))


def _k8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).select("conv_id", "turn", F.col("conv_id").cast("string").alias("chat_id"), F.col("turn").cast("string").alias("entity_id"), F.col("a").alias("text"), F.lit("active").alias("state"), F.col("b").alias("content"))
    statics = rows.select("chat_id", F.col("entity_id").alias("static_id"), F.lit("").alias("name"), F.array().cast("array<string>").alias("keys"), "content")
    entities = D.with_static(rows.select(*KEY, F.col("entity_id").alias("static_id")), statics)
    return D.marked_static(rows.drop("content"), entities).select("conv_id", "turn", (F.col("state") == "in-static").alias("in_static"))


add("k8_static_delta", _k8, f"WITH p AS ({PAIRS}), t AS (SELECT *, {Q.content('a')} AS ta, {Q.content('b')} AS tb FROM p) SELECT conv_id, turn, len(ta) >= 2 AND len(tb) > 0 AND ({Q.containment('ta', 'tb')}) >= 0.85 AS in_static FROM t")


# ---- classification. Users who spent over 300 promote, those who never passed 5 reject; content is a purchase-free entity of three events.
def classified(o: DataFrame) -> DataFrame:
    e = rolled(o).join(D.episode_counts(o.select(*KEY, "pos"), KEY, GAP), KEY).withColumn("type", _type(F.col("entity_id")))
    e = e.withColumn("user_status", F.when(F.col("imp_max") >= 9.5, "promote").when(F.col("imp_avg") < 1.2, "reject")).withColumn("has_content", F.col("live_obs") >= 3)
    e = e.withColumn("static_id", F.when(F.col("entity_id") == "purchase", "static:1"))
    state, reason = D.classify(SETTINGS)
    return e.withColumn("state", state).withColumn("reason", reason)


RULES = "rules(type, is_on, times, least) AS (VALUES " + ", ".join(f"('{t}', {r.on}, {r.min_appearances}, {float(r.min_importance)})" for t, r in SETTINGS.type_rules.items()) + ")"
CLASSIFIED = f"""ents AS (
  SELECT *, {TYPE_SQL} AS type, CASE WHEN imp_max >= 9.5 THEN 'promote' WHEN imp_avg < 1.2 THEN 'reject' END AS user_status, live_obs >= 3 AS has_content,
         entity_id = 'purchase' AS static FROM roll JOIN epi USING (chat_id, entity_id)
), classified AS (
  SELECT ents.*, CASE WHEN user_status = 'reject' THEN 'rejected' WHEN user_status = 'promote' AND has_content THEN 'promoted' WHEN user_status = 'promote' THEN 'candidate'
    WHEN NOT is_on THEN 'excluded' WHEN conf_max < 0.6 THEN 'candidate' WHEN imp_max < greatest(3, least) AND imp_max < 8 THEN 'candidate'
    WHEN imp_max < 8 AND episodes < times AND appear < 10 THEN 'candidate' WHEN NOT has_content THEN 'candidate' ELSE 'promoted' END AS state,
  CASE WHEN user_status = 'reject' THEN 'rejected by user' WHEN user_status = 'promote' AND has_content THEN 'promoted by user' WHEN user_status = 'promote' THEN 'promoted by user but no facts yet'
    WHEN NOT is_on THEN 'type "' || type || '" is excluded' WHEN conf_max < 0.6 THEN 'confidence ' || printf('%.2f', conf_max) || ' < 0.6'
    WHEN imp_max < greatest(3, least) AND imp_max < 8 THEN 'importance ' || printf('%.1f', imp_max) || ' < ' || greatest(3, least)::INT
    WHEN imp_max < 8 AND episodes < times AND appear < 10 THEN 'seen in ' || episodes::INT || ' scene(s); needs ' || times || ' or importance ≥ 8'
    WHEN NOT has_content AND static THEN 'nothing new beyond static lore' WHEN NOT has_content THEN 'no established facts yet'
    WHEN imp_max >= 8 THEN 'importance ' || printf('%.1f', imp_max) || ' ≥ 8' ELSE episodes::INT || ' scenes, importance ' || printf('%.1f', imp_max) END AS reason
  FROM ents JOIN rules USING (type)
)"""
add("k9_classify", _events(lambda o: classified(o).select(*KEY, "type", "state", F.regexp_replace("reason", "[0-9]+[.][0-9]+", "#").alias("reason"), "episodes", "appear")),
    _with(ROLL, EPISODES, RULES, CLASSIFIED, then="SELECT chat_id, entity_id, type, state, regexp_replace(reason, '[0-9]+[.][0-9]+', '#', 'g') AS reason, episodes::INT AS episodes, appear::INT AS appear FROM classified"))
