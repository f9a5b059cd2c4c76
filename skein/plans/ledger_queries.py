"""The ledger over events: its view and what is derived, planned, reported and kept of it (A, B, D, E, F, G, H, K, M, N, P, R)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.engine import TABLES
from skein.functions import text as X
from skein.functions.settings import Settings
from skein.operators import chain as C
from skein.operators import derive as D
from skein.operators import extract as E
from skein.operators import fold as K
from skein.operators import ledger as G
from skein.operators import reconcile as M
from skein.operators import render as R
from skein.operators import report as P
from skein.plans import inputs as I
from skein.plans import sql as Q
from skein.plans.registry import add
from skein.sources.store import migrated, upserted

KEY = ["chat_id", "entity_id"]


def _view(*ctes: str, then: str) -> str:
    return "WITH " + ",\n".join([Q.ledger(), *ctes]) + "\n" + then


def _obs(*ctes: str, then: str) -> str:
    return "WITH " + ",\n".join([Q.OBSERVED, *ctes]) + "\n" + then


def _events(f):
    return lambda s, d: f(I.observed(s, d))


def masked(reason: str = "reason"):
    return F.regexp_replace(reason, "[0-9]+[.][0-9]+ (?=<|≥)|[0-9]+[.][0-9]+$", "# ").alias("reason")


# ---- the view
def _derived(s: SparkSession, d: str) -> DataFrame:
    """The whole projection: every entity with its votes, rollup, state and reason, and how many facts it has in which state."""
    v = I.derived(s, d)
    facts = v.facts.groupBy(*KEY).agg(F.count("*").alias("facts"), F.count_if(F.col("state") == "active").alias("active"), F.count_if(F.col("state") == "in-static").alias("in_static"), F.sum(F.size("sigs")).alias("sources"))
    reason = F.trim(F.regexp_replace("reason", "[0-9]+[.][0-9]+", "#")).alias("reason")
    return v.entities.join(facts, KEY).select(*KEY, "name", "type", "state", reason, "live_obs", "first_at", "last_at", "appear", "episodes", "has_content", "facts", "active", "in_static", "sources")


add("k10_derive", _derived, _view(then="""
SELECT chat_id, entity_id, name, type, state, replace(reason, '0.6', '#') AS reason, live_obs, first_at::INT AS first_at, last_at::INT AS last_at, appear::INT AS appear, episodes::INT AS episodes, has_content, f.facts, f.active, f.in_static, f.sources
FROM view JOIN (SELECT chat_id, entity_id, count(*) AS facts, count(*) FILTER (WHERE state = 'active') AS active, count(*) FILTER (WHERE state = 'in-static') AS in_static, sum(n)::BIGINT AS sources FROM facts GROUP BY ALL) f USING (chat_id, entity_id)"""))
add("b14_renderable_filter", lambda s, d: D.renderable(I.view(s, d).facts).select(*KEY, "text", "status", "state"), _view(then="SELECT chat_id, entity_id, text, status, state FROM facts WHERE state = 'active'"))
add("d7_static_info", lambda s, d: I.view(s, d).entities.where("static_id is not null").select(*KEY, "static_name", F.array_join("keys", "|").alias("keys")), _view(then="SELECT chat_id, entity_id, 'Old lore' AS static_name, 'old key|user ' || chat_id || '|the' AS keys FROM view WHERE static"))
add("d10_user_state", lambda s, d: I.view(s, d).entities.select(*KEY, "user_status", F.coalesce("lock", F.lit(False)).alias("lock")), _view(then="SELECT chat_id, entity_id, user_status, coalesce(user_status = 'promote', false) AS lock FROM view"))
add("r8_merge_into", lambda s, d: D.redirected((x := I.ledger(s, d)).observations, x.state).groupBy(*KEY).agg(F.count("*").alias("n")),
    _obs(then="SELECT chat_id, CASE WHEN entity_id = 'view' AND chat_id::BIGINT % 11 = 0 THEN 'click' ELSE entity_id END AS entity_id, count(*) AS n FROM obs GROUP BY ALL"))
add("p1_report_entities", lambda s, d: P.entities(I.view(s, d)).select(*KEY, "place", "state", "type", F.coalesce(F.array_join("facts", "; "), F.lit("")).alias("facts")), _view(then="""
SELECT chat_id, entity_id, row_number() OVER (PARTITION BY chat_id ORDER BY list_position(['promoted', 'candidate', 'excluded', 'rejected'], state), imp_max DESC, entity_id) AS place, state, type,
  coalesce((SELECT string_agg(text, '; ' ORDER BY "at", status DESC) FROM facts f WHERE f.chat_id = v.chat_id AND f.entity_id = v.entity_id AND f.state = 'active'), '') AS facts FROM view v"""))
add("g10_top_entities", lambda s, d: P.entities(I.view(s, d)).where("place <= 2").select(*KEY, "place"), _view(then="""
SELECT * FROM (SELECT chat_id, entity_id, row_number() OVER (PARTITION BY chat_id ORDER BY list_position(['promoted', 'candidate', 'excluded', 'rejected'], state), imp_max DESC, entity_id) AS place FROM view) WHERE place <= 2"""))


def _told(s: SparkSession, d: str) -> DataFrame:
    x = I.ledger(s, d)
    where = C.positions(C.build_chain(x.messages))
    seen = x.observations.join(C.alive(x.observations, where), ["chat_id", "obs_id"])
    return D.fact_rows(seen, where).select(*KEY, "obs_id", "at", "ord", "fact_id", "text", "status")


add("k1_fact_init", _told, _view(then="""SELECT chat_id, name AS entity_id, obs_id, "at"::INT AS "at", 0 AS ord, 'F' || left(md5(name || '|w' || md5(name) || ' seen'), 12) AS fact_id, 'w' || md5(name) || ' seen' AS text, CASE WHEN value < 50 THEN 'rumor' ELSE 'confirmed' END AS status FROM live"""))
add("e3_entity_rollup", _events(lambda o: D.rollup(o, KEY, "pos").select(*KEY, "live_obs", "first_at", "last_at", *[F.round(c, 9).alias(c) for c in ("imp_max", "imp_avg", "conf_max", "conf_avg")])),
    _obs(then="SELECT chat_id, entity_id, count(*) AS live_obs, min(pos) AS first_at, max(pos) AS last_at, round(max(importance), 9) AS imp_max, round(avg(importance), 9) AS imp_avg, round(max(confidence), 9) AS conf_max, round(avg(confidence), 9) AS conf_avg FROM obs GROUP BY ALL"))
add("d12_type_rule_lookup", _events(lambda o: o.select("obs_id", F.concat("entity_id", F.lit("")).alias("t")).withColumn("t", F.when(F.col("t") == "view", "character").when(F.col("t") == "click", "mystery").when(F.col("t") == "error", "no such type").otherwise("other")).select("obs_id", *[D.rule_of(Settings(), F.col("t"), m).alias(m) for m in ("on", "min_appearances", "min_importance")])),
    _obs(then="""SELECT obs_id, entity_id IN ('view', 'click') AS "on", CASE entity_id WHEN 'view' THEN 2 WHEN 'click' THEN 1 ELSE 3 END AS min_appearances, CASE entity_id WHEN 'view' THEN 3 WHEN 'click' THEN 6 ELSE 5 END AS min_importance FROM obs"""))


# ---- facts in order
def _rows(o: DataFrame, status: str = "confirmed", slot: str = "") -> DataFrame:
    """Each event as a fact of one word about `who`."""
    word = F.concat(F.lit("w"), F.md5("entity_id"))
    return o.select(
        "chat_id", F.lit("who").alias("entity_id"), F.col("pos").alias("at"), "obs_id", F.lit(0).alias("ord"), X.fact_id(F.lit("who"), word).alias("fact_id"), word.alias("text"), F.lit(status).alias("status"), F.lit(slot).alias("slot"),
        F.lit("story").alias("by"), F.lit("").alias("evidence"), F.lit(None).cast("string").alias("rel_kind"), F.lit(None).cast("string").alias("other"), F.lit(False).alias("changed"), F.array(F.col("obs_id").cast("string")).alias("sigs"),
    )


NO_UPDATES = "chat_id string, ref string, to string, at int, obs_id long, ord int"


def _decisions(o: DataFrame) -> DataFrame:
    """The newer of error and signup holds in chats of one kind, the older in those of another; the rest is undecided."""
    ids = [F.concat(F.lit("F"), F.substring(F.md5(F.concat(F.lit("who|w"), F.md5(F.lit(t)))), 1, 12)) for t in ("error", "signup")]
    keys = F.array(*[F.md5(F.concat(a, F.lit("|"), b)) for a, b in (ids, ids[::-1])])
    kind = F.col("chat_id").cast("long") % 3
    return o.select("chat_id").distinct().where(kind < 2).select("chat_id", F.explode(keys).alias("pair_key"), F.when(kind == 0, "new").otherwise("old").alias("decision"))


def _decided(o: DataFrame) -> DataFrame:
    facts = _rows(o.where("entity_id in ('error', 'signup')"), slot="location")
    return K.fold_facts(K.fold_input(facts, o.sparkSession.createDataFrame([], NO_UPDATES), _decisions(o)), Settings(conflict_policy="ask"))


TWO = """two AS (SELECT chat_id, entity_id, 'w' || md5(entity_id) AS text, row_number() OVER (PARTITION BY chat_id ORDER BY min(pos)) AS k, count(*) OVER (PARTITION BY chat_id) AS n, chat_id::BIGINT % 3 AS kind
  FROM obs WHERE entity_id IN ('error', 'signup') GROUP BY chat_id, entity_id)"""
add("d11_decision_lookup", _events(lambda o: _decided(o).where("kind = 'fact'").select("chat_id", "text", "state")), _obs(TWO, then="SELECT chat_id, text, CASE WHEN k = 1 THEN CASE WHEN n = 2 AND kind = 0 THEN 'superseded' ELSE 'active' END ELSE CASE kind WHEN 0 THEN 'active' WHEN 1 THEN 'rejected' ELSE 'conflict' END END AS state FROM two"))
add("r5_conflict_actions", _events(lambda o: _decided(o).where("kind = 'conflict'").select("chat_id", "old_text", "new_text")), _obs(TWO, then="SELECT a.chat_id, a.text AS old_text, b.text AS new_text FROM two a JOIN two b ON a.chat_id = b.chat_id AND a.k = 1 AND b.k = 2 WHERE a.kind = 2"))
add("e9_provenance_union", _events(lambda o: K.fold_facts(K.fold_input(_rows(o, "rumor"), o.sparkSession.createDataFrame([], NO_UPDATES), _decisions(o)), Settings()).select("chat_id", "text", F.array_join("sigs", ",").alias("sigs"))),
    _obs(then="SELECT chat_id, 'w' || md5(entity_id) AS text, string_agg(obs_id::VARCHAR, ',' ORDER BY pos) AS sigs FROM obs GROUP BY chat_id, entity_id"))


def _fold_checks(o: DataFrame) -> DataFrame:
    """Facts in one slot that must be both kept, then settled: every event type is a value, rumors below 50."""
    rows = _rows(o, slot="location").join(o.select("obs_id", "value"), "obs_id").withColumn("status", F.when(F.col("value") < 50, "rumor").otherwise("confirmed")).drop("value")
    folded = K.fold_facts(K.fold_input(rows, o.sparkSession.createDataFrame([], NO_UPDATES), _decisions(o).limit(0)), Settings(conflict_policy="both"))
    return folded.where("kind = 'fact'").select("chat_id", "text", "status", "state", "disputed", F.size("sigs").alias("n"))


# A confirmed fact is disputed if there is a second value: the first one by the second, every later one by the first.
FOLDED = """said AS (SELECT chat_id, 'w' || md5(entity_id) AS text, CASE WHEN value < 50 THEN 'rumor' ELSE 'confirmed' END AS status, min(pos) AS first, count(*) AS n FROM obs GROUP BY ALL),
folded AS (SELECT s.chat_id, s.text, s.status, CASE WHEN s.status = 'rumor' AND c.first > s.first THEN 'superseded' ELSE 'active' END AS state,
  s.status = 'confirmed' AND (SELECT count(*) FROM said o WHERE o.chat_id = s.chat_id AND o.status = 'confirmed') > 1 AS disputed, s.n::INT AS n
  FROM said s LEFT JOIN said c ON c.chat_id = s.chat_id AND c.text = s.text AND c.status = 'confirmed' AND s.status = 'rumor')"""
add("k7_fold_driver", _events(_fold_checks), _obs(FOLDED, then="SELECT * FROM folded"))
add("f3_fact_fold", _events(lambda o: _fold_checks(o).groupBy("chat_id", "state", "disputed").agg(F.count("*").alias("facts"), F.sum("n").alias("sources"))), _obs(FOLDED, then="SELECT chat_id, state, disputed, count(*) AS facts, sum(n)::BIGINT AS sources FROM folded GROUP BY ALL"))


def _last(o: DataFrame) -> DataFrame:
    facts = _rows(o).withColumn("state", F.lit("active")).withColumn("ord", F.col("at"))
    return E.last_facts(facts).select("chat_id", "said")


add("f4_last_k_facts", _events(_last), _obs(then="""SELECT chat_id, string_agg('[F' || left(md5('who|w' || md5(entity_id)), 12) || '|confirmed] w' || md5(entity_id), ' ; ' ORDER BY pos) AS said
FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY pos DESC) AS r FROM obs) WHERE r <= 8 GROUP BY chat_id"""))


# ---- cards
def _grouped(o: DataFrame) -> DataFrame:
    facts = o.select(*KEY, F.col("pos").alias("ord"), F.lit("active").alias("state"), F.when(F.col("value") < 50, "rumor").otherwise("confirmed").alias("status"), F.concat(F.lit("no "), "obs_id", F.lit(" ;")).alias("text"))
    return R.status_groups(facts)


add("e12_status_group_concat", _events(_grouped), _obs(then="SELECT chat_id, entity_id, CASE WHEN value < 50 THEN 'rumor' ELSE 'confirmed' END AS status, string_agg('no ' || obs_id, '; ' ORDER BY pos) AS said FROM obs GROUP BY ALL"))


def _long_cards(o: DataFrame) -> DataFrame:
    """Cards of all events of a kind, of at most 120 characters: cut at a word, and without an uncertain part that does not fit."""
    e = o.groupBy(*KEY).agg(F.lit("item").alias("type"), F.first("entity_id").alias("name"))
    facts = o.select(*KEY, F.col("pos").alias("at"), F.col("pos").alias("ord"), F.lit("active").alias("state"), F.when(F.col("value") < 50, "rumor").otherwise("confirmed").alias("status"), F.concat(F.lit("bears no "), "obs_id").alias("text"), F.lit("").alias("slot"), F.lit(None).cast("string").alias("rel_kind"), F.lit(False).alias("disputed"))
    return R.content(e, facts, Settings(max_chars=120)).select(*KEY, "content")


add("g6_cap_card", _events(_long_cards), _obs("""told AS (SELECT chat_id, entity_id, entity_id || ' (item)' || coalesce(': ' || string_agg('bears no ' || obs_id, '. ' ORDER BY pos) FILTER (WHERE value >= 50), '') || '.' AS a,
  'Rumors (unverified): ' || string_agg('bears no ' || obs_id, '; ' ORDER BY pos) FILTER (WHERE value < 50) || '.' AS b FROM obs GROUP BY chat_id, entity_id),
short AS (SELECT *, CASE WHEN length(a) > 120 THEN regexp_replace(left(a, 120), '\\s+\\S*$', '') || '…' ELSE a END AS s FROM told)""",
    then="SELECT chat_id, entity_id, CASE WHEN b IS NOT NULL AND length(s) + 1 + length(b) <= 120 THEN s || chr(10) || b ELSE s END AS content FROM short"))


# ---- the ledger as tables
def _append(o: DataFrame) -> DataFrame:
    old = o.where("pos < 5").select("chat_id", (F.col("pos") * 10).cast("long").alias("obs_id"), "entity_id")
    new = o.where("pos >= 5").select("chat_id", F.col("pos").cast("long").alias("batch_id"), F.lit(0).alias("ent"), "entity_id")
    return G.appended(old, new)


add("h1_obs_append", _events(_append), _obs(then="SELECT chat_id, (CASE WHEN pos < 5 THEN pos * 10 ELSE 40 + pos - 4 END)::BIGINT AS obs_id, entity_id FROM obs"))


def _updates(o: DataFrame) -> DataFrame:
    rows = o.select("chat_id", F.floor(F.col("pos") / 5).cast("long").alias("batch_id"), (F.col("pos") % 5).alias("ord"), F.lit("F1").alias("ref"), F.lit("done").alias("to"), F.lit("").alias("evidence"), F.array(F.col("entity_id"), F.col("obs_id").cast("string")).alias("sigs"))
    return G.update_observations(rows).select("chat_id", "batch_id", "how", F.size("updates").alias("n"), F.array_join("sigs", ",").alias("sigs"))


add("e11_update_sig_union", _events(_updates), _obs("""each AS (SELECT chat_id, pos // 5 AS batch_id, entity_id AS sig, pos * 2 AS k FROM obs UNION ALL SELECT chat_id, pos // 5, obs_id::VARCHAR, pos * 2 + 1 FROM obs),
firsts AS (SELECT chat_id, batch_id, sig, min(k) AS k FROM each GROUP BY ALL)""",
    then="SELECT chat_id, batch_id, 'update' AS how, (SELECT count(*) FROM obs o WHERE o.chat_id = f.chat_id AND o.pos // 5 = f.batch_id)::INT AS n, string_agg(sig, ',' ORDER BY k) AS sigs FROM firsts f GROUP BY chat_id, batch_id"))


def _runs(o: DataFrame) -> DataFrame:
    old = o.select("chat_id", F.col("pos").cast("long").alias("seq"), F.lit(True).alias("ok"), F.lit(1).alias("n"), F.lit(0).alias("added"), F.lit(0).alias("dropped"), F.lit(None).cast("string").alias("error"))
    new = o.where("pos < 2").select("chat_id", F.col("pos").cast("long").alias("batch_id"), F.lit(False).alias("ok"), F.lit(7).alias("n"), F.lit(0).alias("added"), F.lit(0).alias("dropped"), F.lit("no usable JSON").alias("error"))
    return G.newest_runs(old, new).select("chat_id", "seq", "ok", "n")


add("g9_cap_runs", _events(_runs), _obs("""runs AS (SELECT chat_id, pos AS seq, true AS ok, 1 AS n FROM obs UNION ALL SELECT chat_id, (SELECT max(pos) FROM obs m WHERE m.chat_id = obs.chat_id) + 1 + pos, false, 7 FROM obs WHERE pos < 2)""",
    then="SELECT chat_id, seq, ok, n FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY seq DESC) AS r FROM runs) WHERE r <= 60"))


def _ledgers(s: SparkSession, d: str) -> DataFrame:
    """Chats with even ids have ledgers; each asks with its own id, and a copy of each with another."""
    chats = I.ledger(s, d).observations.select("chat_id").distinct()
    asked = chats.select("chat_id", F.lit(None).cast("string").alias("origin")).unionByName(chats.select(F.concat("chat_id", F.lit("-b")).alias("chat_id"), F.col("chat_id").alias("origin")))
    return G.ledgers(chats.where("cast(chat_id as bigint) % 2 = 0"), asked)


add("a2_ledger_get", _ledgers, _obs("chats AS (SELECT DISTINCT chat_id FROM obs)", then="SELECT chat_id, NULL::VARCHAR AS origin, CASE WHEN chat_id::BIGINT % 2 = 0 THEN 'kept' ELSE 'new' END AS how FROM chats UNION ALL SELECT chat_id || '-b', chat_id, CASE WHEN chat_id::BIGINT % 2 = 0 THEN 'branch' ELSE 'new' END FROM chats"))
add("n3_branch_reown", lambda s, d: G.branched((o := I.ledger(s, d).observations.select("chat_id", "obs_id", "entity_id")), o.select("chat_id", F.concat("chat_id", F.lit("-b")).alias("new_id"))), _obs(then="SELECT chat_id, obs_id, entity_id FROM obs UNION ALL SELECT chat_id || '-b', obs_id, entity_id FROM obs"))
add("n2_rescan", lambda s, d: G.forgotten((o := I.ledger(s, d).observations.select("chat_id", "obs_id")), I.ledger(s, d).state.where("lock").select("chat_id")), _obs(then="SELECT chat_id, obs_id FROM obs WHERE chat_id::BIGINT % 7 <> 0"))
add("a3_ledger_new", lambda s, d: s.createDataFrame([(n, len((f := s.createDataFrame([], ddl)).columns), f.count()) for n, ddl in TABLES.items()], "name string, members int, row_count long"), """
SELECT * FROM (VALUES ('messages', 5, 0::BIGINT), ('observations', 15, 0), ('scanned', 2, 0), ('entity_state', 10, 0), ('decisions', 3, 0), ('written', 5, 0), ('rejected', 2, 0), ('pending', 9, 0), ('change_log', 9, 0), ('runs', 7, 0), ('book', 7, 0), ('books', 3, 0), ('static_books', 2, 0), ('statics', 6, 0)) t(name, members, row_count)""")
add("a4_ledger_migrate", lambda s, d: migrated(I.observed(s, d).select("obs_id", "chat_id", F.col("pos").alias("older_member"), F.col("importance").cast("float").alias("importance")), "chat_id string, obs_id long, importance double, how string").select("chat_id", "obs_id", F.round("importance", 3).alias("importance"), "how"),
    _obs(then="SELECT chat_id, obs_id, round(importance::FLOAT::DOUBLE, 3) AS importance, NULL::VARCHAR AS how FROM obs"))


def _state(s: SparkSession, d: str) -> DataFrame:
    """What users do over what they did before: click is rejected in even chats, and error locked everywhere."""
    x = I.ledger(s, d)
    rows = I.observed(s, d).select("chat_id").distinct()
    done = rows.where("cast(chat_id as bigint) % 2 = 0").select("chat_id", F.lit("click").alias("entity_id"), F.lit("reject").alias("status"), F.lit(True).alias("lock"))
    done = done.unionByName(rows.select("chat_id", F.lit("error").alias("entity_id"), F.lit(None).cast("string").alias("status"), F.lit(True).alias("lock")))
    return upserted(x.state, KEY, done).select(*KEY, "status", "lock", "merge_into")


add("r3_entity_actions", _state, _obs("""chats AS (SELECT DISTINCT chat_id, chat_id::BIGINT AS u FROM obs),
old AS (SELECT chat_id, 'click' AS entity_id, 'promote' AS status, true AS lock, NULL::VARCHAR AS merge_into FROM chats WHERE u % 7 = 0 UNION ALL SELECT chat_id, 'view', NULL, false, 'click' FROM chats WHERE u % 11 = 0)""",
    then="SELECT * FROM old WHERE NOT (entity_id = 'click' AND chat_id::BIGINT % 2 = 0) UNION ALL SELECT chat_id, 'click', 'reject', true, NULL FROM chats WHERE u % 2 = 0 UNION ALL SELECT chat_id, 'error', NULL, true, NULL FROM chats"))


# ---- the engine, end to end: derive, plan, apply, commit
def _synced(s: SparkSession, d: str) -> DataFrame:
    return I.engine(s, d).store.read("book").select("chat_id", "comment", "content", "disable")


BOOKED = "SELECT chat_id, 'DL:' || entity_id || ' | ' || name || ' [' || type || ']' AS comment, content, false AS disable FROM cards"
add("m10_sync", _synced, _view(then=BOOKED))
add("a5_ledger_persist", lambda s, d: (e := I.engine(s, d)).store.read("observations").select("chat_id", "obs_id", "entity_id", F.size("facts").alias("facts")), _obs(then="SELECT chat_id, obs_id, entity_id, 1 AS facts FROM obs"))
add("n4_log_change", lambda s, d: I.engine(s, d).store.read("change_log").select("chat_id", "seq", "kind", "entity_id"), _view(then="SELECT chat_id, row_number() OVER (PARTITION BY chat_id ORDER BY entity_id) - 1 AS seq, 'create' AS kind, entity_id FROM cards"))
add("r2_cmd_dashboard", lambda s, d: I.engine(s, d).report()["meta"].select("chat_id", "observations", "live", "scanned"), _obs(then="SELECT chat_id, count(*) AS observations, count(*) FILTER (WHERE value >= 1) AS live, 0::BIGINT AS scanned FROM obs GROUP BY chat_id"))


def _exported(s: SparkSession, d: str):
    from skein.engine import Engine

    path = f"{I.folder(s)}/export-{id(object())}"
    I.engine(s, d).export_json(path)
    other = Engine(s, f"{path}-store", I.SETTINGS, buckets=1)
    other.import_json(path)
    return path, other


add("a12_export_json", lambda s, d: s.read.schema(D.OBSERVATIONS).json(f"{_exported(s, d)[0]}/observations").select("chat_id", "obs_id", "entity_id", F.round("importance", 6).alias("importance"), F.col("facts")[0]["text"].alias("fact")), _obs(then="SELECT chat_id, obs_id, entity_id, round(importance, 6) AS importance, 'w' || md5(entity_id) || ' seen' AS fact FROM obs"))
add("a13_import_json", lambda s, d: (e := _exported(s, d)[1]).store.read("observations").groupBy("chat_id").agg(F.count("*").alias("observations")).join(e.store.read("change_log").groupBy("chat_id").agg(F.count("*").alias("logged")), "chat_id", "left").withColumn("books", F.lit(e.store.read("book").count())),
    _view(then="SELECT o.chat_id, o.n AS observations, c.n AS logged, 0::BIGINT AS books FROM (SELECT chat_id, count(*) AS n FROM obs GROUP BY ALL) o LEFT JOIN (SELECT chat_id, count(*) AS n FROM cards GROUP BY ALL) c USING (chat_id)"))


def _kept_up(s: SparkSession, d: str) -> DataFrame:
    """Maintenance: all messages below 2 are gone as well, what is dormant is forgotten, odd chats are to be read anew."""
    own = _exported(s, d)[1]
    own.messages = I.ledger(s, d).messages.join(I.observed(s, d).where("value >= 2").select("chat_id", F.col("pos").alias("idx")), ["chat_id", "idx"], "left_semi")
    own.prune(0)
    own.rescan(own.store.read("observations").where("cast(chat_id as bigint) % 2 = 1").select("chat_id"))
    return own.store.read("observations").select("chat_id", "obs_id")


add("r6_maintenance", _kept_up, _obs(then="SELECT chat_id, obs_id FROM obs WHERE value >= 2 AND chat_id::BIGINT % 2 = 0"))


def _reviewed(s: SparkSession, d: str) -> DataFrame:
    """Plans over the view in review mode, against the book as it is but for the cards of click, which others have deleted."""
    e = I.engine(s, d)
    book = e.store.read("book").where("comment not like 'DL:click %'")
    v = I.view(s, d)
    return I.cut(M.plan(v.entities, v.facts, book, e.store.read("written"), e.store.read("entity_state"), I.SETTINGS).ops)


NONE_REJECTED = "chat_id string, op_key string"
add("q8_retraction", lambda s, d: C.alive((x := I.ledger(s, d)).observations, C.positions(C.build_chain(x.messages.where("idx % 3 <> 0")))).select("chat_id", "obs_id"), _obs(then="SELECT chat_id, obs_id FROM obs WHERE value >= 1 AND pos % 3 <> 0"))
add("m9_approve", lambda s, d: M.approved(_reviewed(s, d), M.keyed(_reviewed(s, d)).select("chat_id", "op_key")).select("chat_id", "entity_id", "type"), _view(then="SELECT chat_id, entity_id, 'create' AS type FROM cards WHERE entity_id = 'click'"))
