"""Validation, cards, reconciliation, prompts, tables and settings (A, I, L, M, N, O, P, Q, R)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import lexicon as L
from skein.functions import text as X
from skein.functions.settings import Settings, merge_settings
from skein.operators import chain as C
from skein.operators import extract as E
from skein.operators import reconcile as M
from skein.operators import render as R
from skein.operators import report as P
from skein.operators import validate as V
from skein.plans import inputs as I
from skein.plans import sql as Q
from skein.plans.entity_queries import CLASSIFIED, EPISODES, KEY, ROLL, RULES, classified
from skein.plans.registry import add

S = Settings()


# ---- validation: every message is a window of its own, with an answer that quotes it
def answers(spark: SparkSession, sf_dir: str, **settings) -> V.Validated:
    c = I.chain(spark, sf_dir).withColumn("batch_id", F.col("pos").cast("long")).withColumn("n", F.lit(1))
    one = F.array(F.lit(1))
    fact = F.struct("text", F.lit("confirmed").alias("status"), F.lit("Location").alias("slot"), F.col("text").alias("evidence"), one.alias("messages"))
    false = F.struct(F.concat(F.lit("never said "), F.col("sig")).alias("text"), F.lit("rumor").alias("status"), F.lit("").alias("slot"), F.col("sig").alias("evidence"), one.alias("messages"))
    mind = F.struct(F.lit("Dragon loves tea").alias("text"), F.lit("confirmed").alias("status"), F.lit("").alias("slot"), F.col("text").alias("evidence"), one.alias("messages"))
    bond = F.struct(F.lit("Someone").alias("other"), F.when(F.col("is_user"), "partner").otherwise("ally").alias("kind"), F.lit("walks along").alias("text"), F.lit(False).alias("explicit"), F.col("text").alias("evidence"), one.alias("messages"))
    entity = F.struct(
        F.when(F.col("pos") == 0, "Dragon").otherwise(F.concat(F.lit("Npc "), F.col("chat_id"))).alias("name"), F.when(F.col("is_user"), "wizard").otherwise("location").alias("type"),
        F.when(F.col("pos") == 3, "ignore").otherwise("create").alias("action"), F.lit(12).alias("importance"), F.lit("0.5").alias("confidence"), F.when(F.col("pos") == 4, F.array(F.lit(9))).otherwise(one).alias("messages"),
        F.array(fact, false, mind).alias("facts"), F.array(bond).alias("relationships"),
    )
    change = F.struct(F.when(F.col("pos") == 1, "").otherwise("F1").alias("fact_id"), F.when(F.col("is_user"), "done").otherwise("gone").alias("new_status"), F.col("text").alias("evidence"), one.alias("messages"))
    raw = c.select("chat_id", "batch_id", F.when(F.col("pos") == 5, "no answer").otherwise(F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(entity).alias("entities"), F.array(change).alias("fact_updates"))), F.lit("\n```"))).alias("raw"))
    return V.validate(raw, c, Settings(**settings), cut=I.cut)


KEPT = f"""kept AS (SELECT *, {Q.norm('text')} AS ev, {Q.sanitize('text', 180)} AS fact FROM chain WHERE pos NOT IN (0, 3, 4, 5)),
told AS (SELECT * FROM kept WHERE length(ev) >= 6 AND length(fact) >= 3 AND NOT ({Q.has_words('fact', X.protagonist_words(('Dragon',)))} AND {Q.has_words('fact', L.MENTAL)}))"""


def _with(*ctes: str, then: str) -> str:
    return "WITH " + ",".join([Q.CHAIN, *ctes]) + "\n" + then


add("i2_validate_entity", lambda s, d: answers(s, d).entities.select("chat_id", "batch_id", "name", "type", "importance", "confidence"),
    _with(then="SELECT chat_id, pos AS batch_id, 'Npc ' || chat_id AS name, CASE WHEN is_user THEN 'other' ELSE 'location' END AS type, 10.0 AS importance, 0.5 AS confidence FROM chain WHERE pos NOT IN (0, 3, 4, 5)"))
add("i3_validate_fact", lambda s, d: answers(s, d).facts.select("chat_id", "batch_id", "text", "status", "slot", "by"),
    _with(KEPT, then=f"SELECT chat_id, pos AS batch_id, fact AS text, {Q.guard('fact', chr(39) + 'confirmed' + chr(39))} AS status, 'location' AS slot, CASE WHEN is_user THEN 'player' ELSE 'story' END AS by FROM told"))
add("i4_validate_relation", lambda s, d: answers(s, d).relations.select("chat_id", "batch_id", "rel_kind", "slot"), _with(KEPT, then="SELECT chat_id, pos AS batch_id, 'ally' AS rel_kind, 'rel:someone' AS slot FROM kept WHERE NOT is_user AND length(ev) >= 6"))
add("i5_validate_update", lambda s, d: answers(s, d).updates.select("chat_id", "batch_id", "ref", "to"), _with(then=f"""SELECT chat_id, pos AS batch_id, 'F1' AS ref, 'done' AS "to" FROM chain WHERE pos NOT IN (1, 5) AND is_user AND length({Q.norm('text')}) >= 6"""))
add("i6_dropped_audit", lambda s, d: answers(s, d).dropped.groupBy("why").agg(F.count("*").alias("n")), _with(KEPT, f"""why AS (
  SELECT 'protagonist is never given a card' AS why, count(*) AS n FROM chain WHERE pos = 0 UNION ALL SELECT 'no cited messages (no provenance)', count(*) FROM chain WHERE pos = 4
  UNION ALL SELECT 'not an object with an entities array', count(*) FROM chain WHERE pos = 5 UNION ALL SELECT 'unknown fact id', count(*) FROM chain WHERE pos = 1
  UNION ALL SELECT 'romantic relationship not explicitly established', count(*) FROM kept WHERE is_user UNION ALL SELECT 'relationship evidence not found', count(*) FROM kept WHERE NOT is_user AND length(ev) < 6
  UNION ALL SELECT 'asserts protagonist thoughts/feelings/choices', count(*) + count(*) FILTER (WHERE length(fact) >= 3 AND mind) FROM (SELECT *, {Q.has_words('fact', X.protagonist_words(('Dragon',)))} AND {Q.has_words('fact', L.MENTAL)} AS mind FROM kept)
  UNION ALL SELECT 'evidence quote not found in cited messages', count(*) + count(*) FILTER (WHERE length(fact) >= 3 AND NOT mind AND length(ev) < 6) FROM (SELECT *, {Q.has_words('fact', X.protagonist_words(('Dragon',)))} AND {Q.has_words('fact', L.MENTAL)} AS mind FROM kept)
  UNION ALL SELECT 'evidence not found', count(*) FROM chain WHERE pos NOT IN (1, 5) AND is_user AND length({Q.norm('text')}) < 6)""", then="SELECT why, sum(n)::BIGINT AS n FROM why GROUP BY why HAVING sum(n) > 0"))


def _told(s: SparkSession, d: str) -> DataFrame:
    """What an entity's observation holds: facts, then relations rewritten."""
    from skein.operators import ledger as G

    return G.told(answers(s, d)).select("chat_id", "batch_id", F.array_join("facts.text", " // ").alias("facts"), F.array_join(F.col("facts.rel_kind"), "/").alias("kinds"))


add("h3_facts_plus_rels", _told, _with(KEPT, then="""SELECT k.chat_id, k.pos AS batch_id, concat_ws(' // ', t.fact, CASE WHEN NOT k.is_user AND length(k.ev) >= 6 THEN 'Someone: walks along' END) AS facts, CASE WHEN NOT k.is_user AND length(k.ev) >= 6 THEN 'ally' ELSE '' END AS kinds
FROM kept k LEFT JOIN told t ON k.chat_id = t.chat_id AND k.pos = t.pos WHERE t.fact IS NOT NULL OR (NOT k.is_user AND length(k.ev) >= 6)"""))
add("i1_validate_shape", lambda s, d: answers(s, d).unusable.select("chat_id", "batch_id"), _with(then="SELECT chat_id, pos AS batch_id FROM chain WHERE pos = 5"))
add("q9_retry", lambda s, d: I.chain(s, d).select("chat_id", F.col("pos").cast("long").alias("batch_id"), "sig").join(answers(s, d).unusable.select("chat_id", "batch_id"), ["chat_id", "batch_id"], "left_anti").select("chat_id", "sig").distinct(),
    _with(then="SELECT DISTINCT chat_id, sig FROM chain WHERE pos <> 5"))


# ---- cards and books over events: a user is a chat, a kind of event an entity with one fact
def entities(o: DataFrame) -> DataFrame:
    e = classified(o).withColumn("name", F.col("entity_id")).withColumn("aliases", F.array(F.upper("entity_id"))).withColumn("keys", F.array(F.concat(F.lit("user "), F.col("chat_id")), F.lit("the")))
    return e.select(*KEY, "name", "type", "aliases", "keys", "state", "reason", "live_obs", *[F.lit(False).alias(c) for c in ("lock", "protected", "keep")])


def facts(e: DataFrame) -> DataFrame:
    fact = lambda k, text, status, when: F.when(when, F.struct(F.lit(k).alias("ord"), text.alias("text"), F.lit(status).alias("status")))
    both = F.array_compact(F.array(fact(0, F.concat(F.lit("seen "), "live_obs", F.lit(" times.")), "confirmed", F.lit(True)), fact(1, F.lit("may return;"), "rumor", F.col("entity_id") == "click")))
    rows = e.select(*KEY, F.explode(both).alias("f")).select(*KEY, "f.*")
    return rows.select("*", F.lit("active").alias("state"), F.lit("").alias("slot"), F.lit(None).cast("string").alias("rel_kind"), F.lit(0).alias("at"), F.lit(False).alias("disputed"))


def cards(s: SparkSession, d: str) -> DataFrame:
    e = entities(I.observed(s, d))
    return R.render(e, facts(e), S)


CARDS = """cards AS (SELECT chat_id, entity_id, entity_id || ' (' || type || '): seen ' || live_obs || ' times.' || CASE WHEN entity_id = 'click' THEN chr(10) || 'Rumors (unverified): may return.' ELSE '' END AS content,
  entity_id || '|user ' || chat_id AS card_keys, 'DL:' || entity_id || ' | ' || entity_id || ' [' || type || ']' AS comment, state, reason FROM classified)"""


def _book(*ctes: str, then: str) -> str:
    return "WITH " + ",".join([Q.OBSERVED, ROLL, EPISODES, RULES, CLASSIFIED, CARDS, *ctes]) + "\n" + then


add("l1_render_keys", lambda s, d: cards(s, d).select(*KEY, F.array_join("card_keys", "|").alias("card_keys")), _book(then="SELECT chat_id, entity_id, card_keys FROM cards"))
add("l2_render_content", lambda s, d: cards(s, d).select(*KEY, "content"), _book(then="SELECT chat_id, entity_id, content FROM cards"))
add("l3_render", lambda s, d: cards(s, d).select(*KEY, "comment", "content_hash", "keys_hash"), _book(then="SELECT chat_id, entity_id, comment, md5(content) AS content_hash, md5(card_keys) AS keys_hash FROM cards"))
add("l4_entry_template", lambda s, d: s.createDataFrame(list(R.entry_template(Settings(order=7, depth=2)).items()), "field string, value string"), """
SELECT unnest(['constant', 'vectorized', 'ignoreBudget', 'excludeRecursion', 'preventRecursion', 'matchPersonaDescription', 'matchCharacterDescription', 'matchCharacterPersonality', 'matchCharacterDepthPrompt', 'matchScenario', 'matchCreatorNotes', 'groupOverride']) AS field, 'false' AS value
UNION ALL SELECT unnest(['selective', 'addMemo', 'useProbability']), 'true' UNION ALL SELECT unnest(['scanDepth', 'caseSensitive', 'matchWholeWords', 'useGroupScoring', 'sticky', 'cooldown', 'delay']), 'null'
UNION ALL SELECT unnest(['keysecondary', 'triggers']), '[]' UNION ALL SELECT unnest(['outletName', 'group', 'automationId']), '""' UNION ALL SELECT unnest(['selectiveLogic', 'position', 'delayUntilRecursion', 'role']), '0'
UNION ALL SELECT unnest(['probability', 'groupWeight']), '100' UNION ALL VALUES ('order', '7'), ('depth', '2'), ('characterFilter', '{"isExclude":false,"names":[],"tags":[]}')""")


def reconciled(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """click has its card, view another text, error was edited by hand, signup is there though excluded, gone is not in the view."""
    e = I.cut(entities(I.observed(s, d)))
    own = I.cut(R.render(e, facts(e), S).where("entity_id <> 'purchase'"))
    content = F.when(F.col("entity_id") == "view", "old").otherwise(F.col("content"))
    book = own.select("chat_id", F.array_position(F.array(*map(F.lit, ["click", "view", "error", "signup"])), F.col("entity_id")).cast("int").alias("uid"), "comment", content.alias("content"), F.col("card_keys").alias("key"), F.lit(False).alias("disable"), F.create_map().cast("map<string,string>").alias("extra"))
    gone = e.select("chat_id").distinct().select("chat_id", F.lit(9).alias("uid"), F.lit("DL:gone | gone [item]").alias("comment"), F.lit("x").alias("content"), F.array(F.lit("gone")).alias("key"), F.lit(False).alias("disable"), F.create_map().cast("map<string,string>").alias("extra"))
    other = gone.withColumn("uid", F.lit(20)).withColumn("comment", F.lit("my own note"))
    written = own.where("entity_id in ('click', 'error')").select(*KEY, F.lit(0).alias("uid"), F.when(F.col("entity_id") == "error", "other").otherwise(F.md5("content")).alias("content_hash"), F.md5(F.array_join("card_keys", "|")).alias("keys_hash"))
    state = e.where("entity_id = 'signup' and length(chat_id) = 1").select(*KEY, F.lit(None).cast("string").alias("status"), F.lit(False).alias("lock"), F.lit(True).alias("protected"), F.lit(False).alias("keep"), *[F.lit(None).cast("string").alias(c) for c in ("merge_into", "name", "type", "lock_reason")])
    whole = I.cut(book.unionByName(gone).unionByName(other))
    return e, whole, I.cut(written), I.cut(state)


def planned(s: SparkSession, d: str) -> tuple[M.Plan, DataFrame, DataFrame, DataFrame]:
    e, book, written, state = reconciled(s, d)
    plan = M.plan(e, facts(e), book, written, state, S)
    return M.Plan(I.cut(plan.ops), plan.held), book, written, state


def side_by_side(s: SparkSession, d: str) -> DataFrame:
    e, book, written, state = reconciled(s, d)
    return M.matched(e, facts(e), book, written, state, S)


OPS = """ops AS (SELECT chat_id, entity_id, CASE
    WHEN state = 'promoted' THEN CASE entity_id WHEN 'purchase' THEN 'create' WHEN 'view' THEN 'update' WHEN 'error' THEN 'lock' WHEN 'signup' THEN NULL END
    WHEN entity_id = 'purchase' THEN NULL WHEN entity_id = 'error' OR (entity_id = 'signup' AND length(chat_id) = 1) THEN 'disable' ELSE 'remove' END AS type FROM cards
  UNION ALL SELECT DISTINCT chat_id, 'gone', 'remove' FROM cards)"""
for _key, _type in (("m1_plan_create", "create"), ("m2_plan_update", "update"), ("m4_plan_lock", "lock"), ("m5_plan_remove", "remove"), ("m6_plan_disable", "disable")):
    add(_key, lambda s, d, t=_type: planned(s, d)[0].ops.where(F.col("type") == t).select("chat_id", "entity_id", "type"), _book(OPS, then=f"SELECT chat_id, entity_id, type FROM ops WHERE type = '{_type}'"))
add("m3_plan_hold", lambda s, d: planned(s, d)[0].held.select("chat_id", "entity_id", "why"), _book(then="SELECT chat_id, entity_id, 'edited manually' AS why FROM cards WHERE state = 'promoted' AND entity_id = 'error'"))
QUEUED = "SELECT chat_id, entity_id, type FROM ops WHERE type IN ('create', 'update', 'remove')"
add("p2_report_pending", lambda s, d: M.review(planned(s, d)[0].ops, s.createDataFrame([], "chat_id string, op_key string"))[1].select("chat_id", "entity_id", "type"), _book(OPS, then=QUEUED))


def _approved(s: SparkSession, d: str, kind: str = "update") -> DataFrame:
    """Proposals of one kind are approved, with keys that are planned no more; what else is planned waits."""
    ops = planned(s, d)[0].ops
    picks = M.keyed(ops).where(F.col("type") == kind).select("chat_id", "op_key")
    return M.approved(ops, picks.unionByName(picks.withColumn("op_key", F.lit("gone")))).select("chat_id", "entity_id", "type")


def _rejecting(s: SparkSession, d: str) -> DataFrame:
    """What waits for approval once removals are rejected."""
    ops = planned(s, d)[0].ops
    return M.review(ops, M.keyed(ops).where("type = 'remove'").select("chat_id", "op_key"))[1].select("chat_id", "entity_id", "type")


def _queues(s: SparkSession, d: str) -> DataFrame:
    now, later = M.review(planned(s, d)[0].ops, s.createDataFrame([], "chat_id string, op_key string"))
    return now.select("chat_id", "entity_id", F.lit("now").alias("queue")).unionByName(later.select("chat_id", "entity_id", F.lit("later").alias("queue")))


add("r4_proposal_actions", _approved, _book(OPS, then="SELECT chat_id, entity_id, type FROM ops WHERE type = 'update'"))
add("d17_approve_semi", lambda s, d: _approved(s, d, "remove"), _book(OPS, then="SELECT chat_id, entity_id, type FROM ops WHERE type = 'remove'"))
add("d16_rejected_anti", _rejecting, _book(OPS, then="SELECT chat_id, entity_id, type FROM ops WHERE type IN ('create', 'update')"))
add("h7_safe_split", _queues, _book(OPS, then="SELECT chat_id, entity_id, CASE WHEN type IN ('lock', 'disable') THEN 'now' ELSE 'later' END AS queue FROM ops WHERE type IS NOT NULL"))
add("d13_managed_outer", lambda s, d: side_by_side(s, d).select("chat_id", "entity_id", "wanted", "there"), _book(then="""
SELECT chat_id, entity_id, state = 'promoted' AS wanted, entity_id <> 'purchase' AS there FROM cards WHERE state = 'promoted' OR entity_id <> 'purchase' UNION ALL SELECT DISTINCT chat_id, 'gone', false, true FROM cards"""))
add("d14_edited_detect", lambda s, d: side_by_side(s, d).where("there").select("chat_id", "entity_id", "edited"), _book(then="SELECT chat_id, entity_id, entity_id = 'error' AS edited FROM cards WHERE entity_id <> 'purchase' UNION ALL SELECT DISTINCT chat_id, 'gone', false FROM cards"))


def applied(s: SparkSession, d: str) -> M.Applied:
    plan, book, written, state = planned(s, d)
    return M.apply_ops(plan.ops, book, written, state, s.createDataFrame([], M.LOG), S)


AFTER = """SELECT c.chat_id, c.comment, c.content, coalesce(o.type = 'disable', false) AS disable FROM cards c LEFT JOIN ops o USING (chat_id, entity_id)
WHERE coalesce(o.type, '') <> 'remove' AND (c.entity_id <> 'purchase' OR o.type = 'create') UNION ALL SELECT DISTINCT chat_id, 'my own note', 'x', false FROM cards"""
add("m7_apply_ops", lambda s, d: applied(s, d).book.select("chat_id", "comment", "content", "disable"), _book(OPS, then=AFTER))
def _rolled_back(s: SparkSession, d: str) -> DataFrame:
    """Every removal of a view's card undone: the cards are there again."""
    done = applied(s, d)
    whole = I.cut(done.log)
    log = whole.where("kind = 'remove' and entity_id = 'view'")
    return M.rollback(log, I.cut(done.book), I.cut(done.written), I.cut(done.state), whole, S).book.where("comment like 'DL:view %'").select("chat_id", "content")


add("m8_rollback", _rolled_back, _book(OPS, then="SELECT chat_id, CASE WHEN o.type = 'remove' THEN 'old' ELSE c.content END AS content FROM cards c JOIN ops o USING (chat_id, entity_id) WHERE entity_id = 'view'"))


# ---- prompts
def windows(s: SparkSession, d: str) -> DataFrame:
    c = I.chain(s, d)
    return C.with_context(c, C.batches(c, 3), 1).withColumnRenamed("batch", "batch_id")


def _prompts(s: SparkSession, d: str) -> DataFrame:
    rows = windows(s, d)
    return E.user_prompts(rows, rows.select("chat_id", "batch_id").distinct().withColumn("known", F.lit("(none)")), "0" * 12, S)


add("o4_user_prompt", _prompts, _with(then=f"""
, b AS (SELECT *, pos // 3 AS batch FROM chain), s AS (SELECT chat_id, batch, pos, is_user, name, text, false AS ctx FROM b UNION ALL SELECT b.chat_id, b.batch, c.pos, c.is_user, c.name, c.text, true FROM b JOIN chain c ON c.chat_id = b.chat_id AND c.pos = b.pos - 1 WHERE b.pos % 3 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY chat_id, batch ORDER BY pos) AS n FROM s)
SELECT chat_id, batch AS batch_id, '(none)' || chr(10) || chr(10) || '<story_000000000000>' || chr(10) || string_agg('#' || n || CASE WHEN ctx THEN ' (seen before) ' ELSE ' (NEW) ' END || CASE WHEN is_user THEN 'player ' ELSE 'story ' END || name || ':' || chr(10) || left(text, 5000), chr(10) || chr(10) ORDER BY n)
  || chr(10) || '</story_000000000000>' || chr(10) || chr(10) || 'Answer with the JSON object.' AS prompt FROM n GROUP BY ALL""".replace("\n, b AS", ", b AS", 1)).replace(")\n, b AS", "), b AS"))  # fmt: skip
def _instructed(s: SparkSession, d: str) -> DataFrame:
    """Which words of the vocabularies, names and marks stand in the instructions."""
    text = E.system_prompt(Settings(protagonist=("Dragon", "Wyrm"), extra_rules="Keep it short."), "0" * 12)
    asked = [*L.TYPES, *L.STATUSES, *L.SLOTS, *L.RELATIONS, "Dragon / Wyrm", "<story_000000000000>", "</story_000000000000>", "Keep it short.", "no such word"]
    return s.createDataFrame([(w, w in text) for w in dict.fromkeys(asked)], "word string, there boolean")


add("o2_system_prompt", _instructed, f"SELECT DISTINCT unnest([{Q.quote([*L.TYPES, *L.STATUSES, *L.SLOTS, *L.RELATIONS])}, 'Dragon / Wyrm', '<story_000000000000>', '</story_000000000000>', 'Keep it short.']) AS word, true AS there UNION ALL SELECT 'no such word', false")


def _shape(s: SparkSession, d: str) -> DataFrame:
    """Every member of the answer's schema by its path, with its type, and whether it must be there."""

    def walk(node: dict, path: str):
        for name, own in node.get("properties", {}).items():
            yield f"{path}{name}", own["type"], name in node["required"]
            yield from walk(own.get("items", {}), f"{path}{name}[].")

    return s.createDataFrame(list(walk(E.json_schema(), "")), "member string, type string, required boolean")


add("o1_json_schema", _shape, """
WITH e AS (SELECT unnest(['name', 'matches_id', 'type', 'action', 'aliases', 'keys', 'importance', 'confidence', 'reason', 'messages', 'facts', 'relationships']) AS m, unnest(['string', 'string', 'string', 'string', 'array', 'array', 'number', 'number', 'string', 'array', 'array', 'array']) AS t),
f AS (SELECT unnest(['text', 'status', 'slot', 'changes_previous', 'evidence', 'messages']) AS m, unnest(['string', 'string', 'string', 'boolean', 'string', 'array']) AS t),
r AS (SELECT unnest(['other', 'kind', 'text', 'explicit', 'changes_previous', 'evidence', 'messages']) AS m, unnest(['string', 'string', 'string', 'boolean', 'boolean', 'string', 'array']) AS t),
u AS (SELECT unnest(['fact_id', 'new_status', 'evidence', 'messages']) AS m, unnest(['string', 'string', 'string', 'array']) AS t)
SELECT 'entities' AS member, 'array' AS type, true AS required UNION ALL SELECT 'fact_updates', 'array', false
UNION ALL SELECT 'entities[].' || m, t, m IN ('name', 'type', 'action', 'importance', 'confidence', 'messages') FROM e UNION ALL SELECT 'entities[].facts[].' || m, t, m IN ('text', 'status', 'evidence', 'messages') FROM f
UNION ALL SELECT 'entities[].relationships[].' || m, t, m IN ('other', 'kind', 'evidence', 'messages') FROM r UNION ALL SELECT 'fact_updates[].' || m, t, true FROM u""")


# ---- settings, batches, conflicts
add("a14_settings_merge", lambda s, d: s.createDataFrame([(k, r.on, r.min_appearances, float(r.min_importance)) for k, r in merge_settings({"type_rules": {"other": {"on": True}, "ship": {"min_importance": 7}}}).type_rules.items()], "type string, is_on boolean, times int, least double"),
    "SELECT type, CASE WHEN type = 'other' THEN true ELSE is_on END AS is_on, times, least FROM (WITH " + RULES + " SELECT type, is_on, times, least::DOUBLE AS least FROM rules) UNION ALL SELECT 'ship', true, 2, 7.0")
add("q5_count_tumbling", lambda s, d: C.batches(I.chain(s, d), 3).groupBy("chat_id", "batch").agg(F.count("*").alias("n")), _with(then="SELECT chat_id, pos // 3 AS batch, count(*) AS n FROM chain GROUP BY ALL"))


def _conflicts(s: SparkSession, d: str) -> DataFrame:
    """Conflicts of each user's kinds of events over one slot, if asked (K5 with policy ask)."""
    from skein.operators import fold as K
    from skein.plans.entity_queries import facts as fold_facts_of

    folded = K.fold_facts(fold_facts_of(I.observed(s, d), F.lit("confirmed"), "location"), Settings(conflict_policy="ask"))
    return folded.where("kind = 'conflict'").select("chat_id", "old_text", "new_text")


CONFLICTS = "SELECT chat_id, first_value(text) OVER w AS old_text, text AS new_text FROM seen WINDOW w AS (PARTITION BY chat_id ORDER BY first) QUALIFY row_number() OVER w > 1"
add("p3_report_conflicts", _conflicts, "WITH " + Q.OBSERVED + ", w AS (SELECT chat_id, 'w' || md5(entity_id) AS text, pos FROM obs), seen AS (SELECT chat_id, text, min(pos) AS first FROM w GROUP BY ALL)\n" + CONFLICTS)
add("p4_report_history", lambda s, d: P.history(I.engine(s, d).store.read("change_log"), 3).select("chat_id", "seq", "rank", "entity_id", "undoable"), "WITH " + Q.ledger() + """
SELECT * FROM (SELECT chat_id, row_number() OVER (PARTITION BY chat_id ORDER BY entity_id) - 1 AS seq, row_number() OVER (PARTITION BY chat_id ORDER BY entity_id DESC) AS rank, entity_id, true AS undoable FROM cards) WHERE rank <= 3""")
