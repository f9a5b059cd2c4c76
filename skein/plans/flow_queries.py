"""Feeds, books, settings and the extractor over conversations (A, G, H, J, Q, R)."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.engine import COMMANDS, Engine
from skein.functions import lexicon as L
from skein.functions.settings import Settings, merge_settings, members
from skein.operators import chain as C
from skein.operators import extract as E
from skein.operators import ledger as G
from skein.operators import validate as V
from skein.plans import inputs as I
from skein.plans import sql as Q
from skein.plans.registry import add
from skein.sources import books as B
from skein.streaming import feed as S

AT = ["chat_id", "batch_id"]
EXTRACTED: dict[tuple[str, str], Engine] = {}


def _with(*ctes: str, then: str) -> str:
    return "WITH " + ",\n".join([Q.CHAIN, *ctes]) + "\n" + then


# ---- feeds
def changes(s: SparkSession, d: str) -> DataFrame:
    """conversations as a feed: every message is put; then the second is put again in another wording, and the third deleted."""
    m = I.table(s, d, "conversations").select(F.col("conv_id").cast("string").alias("chat_id"), F.col("turn").cast("int").alias("idx"), "role", F.lit(None).cast("string").alias("name"), "text")
    put = m.select("*", F.lit("put").alias("op"), F.col("idx").cast("long").alias("at"))
    again = m.where("idx = 1").select("chat_id", "idx", "role", "name", F.concat(F.lit("again "), F.coalesce("text", F.lit(""))).alias("text"), F.lit("put").alias("op"), F.lit(100).cast("long").alias("at"))
    gone = m.where("idx = 2").select("chat_id", "idx", "role", "name", "text", F.lit("delete").alias("op"), F.lit(200).cast("long").alias("at"))
    return put.unionByName(again).unionByName(gone)


def _streamed(s: SparkSession, d: str) -> tuple[Engine, list[int]]:
    """The feed in three files, a file a micro-batch, and the engine stopped and started again after the first one."""
    path, seen = f"{I.folder(s)}/feed-{uuid.uuid4().hex}", []
    parts = F.when(F.col("op") == "delete", 2).when(F.col("at") >= 100, 1).otherwise(0)
    rows = changes(s, d).withColumn("part", parts)
    for k in range(3):
        if k == 1:
            S.follow(Engine(s, f"{path}/store", Settings(enabled=False), buckets=2), S.change_feed(s, f"{path}/in", 1), f"{path}/checkpoint", None, on_batch=seen.append).awaitTermination()
        rows.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{path}/in")
    own = Engine(s, f"{path}/store", Settings(enabled=False), buckets=2)
    S.follow(own, S.change_feed(s, f"{path}/in", 1), f"{path}/checkpoint", None, on_batch=seen.append).awaitTermination()
    return own, seen


#: Of a time without a zone, whatever the session's is.
MILLIS = "(unix_date(cast(ts as date)) * 86400L + hour(ts) * 3600 + minute(ts) * 60) * 1000 + floor(extract(second from ts) * 1000)"
FED = "fed AS (SELECT conv_id::VARCHAR AS chat_id, turn::INT AS idx, role, CASE WHEN turn = 1 THEN 'again ' || coalesce(text, '') ELSE text END AS text FROM conversations WHERE turn <> 2)"
add("q1_change_feed", lambda s, d: _streamed(s, d)[0].messages.select("chat_id", "idx", "role", "text"), f"WITH {FED} SELECT * FROM fed")
add("a15_event_source", lambda s, d: S.merged(I.messages(s, d).limit(0).withColumn("idx", F.col("idx").cast("int")), changes(s, d)).groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")), f"WITH {FED} SELECT role, count(*) AS n, sum(length(text))::BIGINT AS chars FROM fed GROUP BY role")
add("q3_serial_queue", lambda s, d: s.createDataFrame(list(enumerate(_streamed(s, d)[1])), "k int, batch int"), "SELECT * FROM (VALUES (0, 0), (1, 1), (2, 2)) t(k, batch)")
add("q2_debounce", lambda s, d: S.bursts(I.table(s, d, "events").select(F.col("user_id").cast("string").alias("chat_id"), F.expr(MILLIS).cast("long").alias("at")), 3_600_000), """
WITH t AS (SELECT user_id::VARCHAR AS chat_id, epoch_us(ts) // 1000 AS ms FROM events), e AS (SELECT *, lag(ms) OVER (PARTITION BY chat_id ORDER BY ms) AS before FROM t),
b AS (SELECT *, sum(CASE WHEN before IS NULL OR ms - before > 3600000 THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id ORDER BY ms RANGE UNBOUNDED PRECEDING) AS k FROM e)
SELECT chat_id, min(ms) AS started, max(ms) AS ended, count(*) AS changes FROM b GROUP BY chat_id, k""")


def _seen_once(s: SparkSession, d: str) -> DataFrame:
    """The feed as a stream in two files, every message in both; what comes out of the deduplication."""
    path = f"{I.folder(s)}/seen-{uuid.uuid4().hex}"
    for _ in range(2):
        changes(s, d).where("at < 100").coalesce(1).write.mode("append").parquet(f"{path}/in")
    S.seen_once(S.change_feed(s, f"{path}/in", 1)).writeStream.format("parquet").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return s.read.parquet(f"{path}/out").select("chat_id", "sig")


add("q7_seen_state", _seen_once, f"SELECT DISTINCT conv_id::VARCHAR AS chat_id, md5((CASE WHEN role = 'user' THEN 'u|' ELSE 'a|' END) || {Q.collapse('text')}) AS sig FROM conversations")
add("q10_gate_cancel", lambda s, d: C.windows(I.messages(s, d), I.chain(s, d).limit(0).select("chat_id", "sig"), Settings(window_max=2, context_msgs=0, extract_every=1, settle_lag=0), calls=2).select("chat_id", "batch", "pos"), _with(then="SELECT chat_id, pos // 2 AS batch, pos FROM chain WHERE pos < 4"))


# ---- the extractor, end to end: windows, prompts, calls, validation, resolution, appending, marking
def teller(system: str, prompt: str, schema: str | None) -> str:
    """An extractor that quotes the first new message, and answers in prose when it is asked with a schema."""
    if schema:
        return "I would rather not."
    n, text = re.search(r"#(\d+) \(NEW\) [^\n]*:\n(.*)", prompt).groups()
    fact = {"text": "appears in the tale", "status": "confirmed", "slot": "", "evidence": text[:80], "messages": [int(n)]}
    return json.dumps({"entities": [{"name": "Zorbal", "type": "creature", "action": "create", "importance": 9, "confidence": 0.9, "messages": [int(n)], "facts": [fact]}]})


def extracted(s: SparkSession, d: str) -> Engine:
    key = (s.sparkContext.applicationId, d)
    if key not in EXTRACTED:
        own = Engine(s, f"{I.folder(s)}/{uuid.uuid4().hex}", Settings(enabled=True), teller, buckets=2)
        own.messages = I.messages(s, d)
        own.scan(force=True)
        EXTRACTED[key] = own
    return EXTRACTED[key]


QUOTED = f"quoted AS (SELECT *, length({Q.norm('left(text, 80)')}) >= 6 AS holds FROM chain WHERE pos = 0)"
add("r1_cmd_scan", lambda s, d: extracted(s, d).store.read("runs").select("chat_id", "ok", "n", "added", "dropped"), _with(QUOTED, then="SELECT c.chat_id, true AS ok, count(*)::INT AS n, 1 AS added, max(CASE WHEN q.holds THEN 0 ELSE 1 END) AS dropped FROM chain c JOIN quoted q USING (chat_id) GROUP BY c.chat_id"))
add("j5_ingest", lambda s, d: extracted(s, d).store.read("observations").select("chat_id", "obs_id", "entity_id", "type", "how", F.array_join("sigs", ",").alias("sigs"), F.coalesce(F.array_join("facts.text", ","), F.lit("")).alias("facts")),
    _with(QUOTED, then="SELECT chat_id, 1::BIGINT AS obs_id, 'zorbal' AS entity_id, 'creature' AS type, 'new' AS how, sig AS sigs, CASE WHEN holds THEN 'appears in the tale' ELSE '' END AS facts FROM quoted"))
add("a11_extract_source", lambda s, d: E.call(_asked(s, d), teller).select("chat_id", "batch_id", F.get_json_object("raw", "$.entities[0].facts[0].evidence").alias("evidence")), _with(then="SELECT chat_id, pos // 3 AS batch_id, left(text, 80) AS evidence FROM chain WHERE pos % 3 = 0"))
add("a16_profile_list", lambda s, d: s.createDataFrame([(p,) for p in Engine(s, f"{I.folder(s)}/{uuid.uuid4().hex}", extractors={"second": teller, "first": teller}).profiles()], "profile string"), "SELECT * FROM (VALUES ('first'), ('second')) t(profile)")


def _asked(s: SparkSession, d: str) -> DataFrame:
    c = I.chain(s, d)
    rows = C.with_context(c, C.batches(c, 3), 1).withColumnRenamed("batch", "batch_id")
    return E.user_prompts(rows, rows.select(*AT).distinct().withColumn("known", F.lit("none")), "0" * 12, Settings()).withColumn("system", F.lit("s"))


def _marked(s: SparkSession, d: str) -> DataFrame:
    """Windows of three with context; batches that are no multiple of two could be parsed."""
    c = I.chain(s, d)
    window = C.with_context(c, C.batches(c, 3), 2).withColumnRenamed("batch", "batch_id")
    return G.marked(c.where("pos = 3").select("chat_id", "sig"), window, window.where("batch_id % 2 = 0"))


add("h2_scanned_add", _marked, _with(then="SELECT DISTINCT chat_id, sig FROM chain WHERE pos = 3 OR (pos // 3) % 2 = 0"))


def _run_stats(s: SparkSession, d: str) -> DataFrame:
    c = I.chain(s, d)
    window = C.with_context(c, C.batches(c, 3), 2).withColumnRenamed("batch", "batch_id")
    new = window.where("not is_context")
    return G.run_rows(window.select(*AT).distinct().withColumn("ok", F.col("batch_id") % 2 == 0), window, new.where("is_user"), new.where("pos = 0")).select(*AT, "ok", "n", "added", "dropped", "error")


add("e15_run_stats", _run_stats, _with(then="SELECT chat_id, pos // 3 AS batch_id, (pos // 3) % 2 = 0 AS ok, count(*)::INT AS n, (count(*) FILTER (WHERE is_user))::INT AS added, (count(*) FILTER (WHERE pos = 0))::INT AS dropped, CASE WHEN (pos // 3) % 2 <> 0 THEN 'no usable JSON' END AS error FROM chain GROUP BY chat_id, pos // 3"))


# ---- caps and citations, through the validator: an answer to the first message of each chat
def _answer(s: SparkSession, d: str, entities, updates=None, settings: Settings = Settings(), twice: bool = False) -> V.Validated:
    c = I.chain(s, d).where("pos = 0").withColumn("batch_id", F.lit(0).cast("long"))
    window = c.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))) if twice else c.withColumn("n", F.lit(1))
    raw = c.select(*AT, F.to_json(F.struct(entities.alias("entities"), *([updates.alias("fact_updates")] if updates is not None else []))).alias("raw"))
    return V.validate(raw, window, settings, c.select("chat_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("F"), i))).alias("fact_id")), I.cut)


def _many(n: int, what) -> F.Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), what)


ONE = F.array


def _entity(**more) -> F.Column:
    base = {"name": F.lit("Zorbal"), "type": F.lit("creature"), "action": F.lit("create"), "importance": F.lit(5), "confidence": F.lit(0.9), "messages": F.array(F.lit(1))}
    return F.struct(*[v.alias(k) for k, v in (base | more).items()])


HOLDS = f"first AS (SELECT *, length({Q.norm('text')}) >= 6 AS holds FROM chain WHERE pos = 0)"
add("g1_cap_entities", lambda s, d: _answer(s, d, _many(45, lambda i: _entity(name=F.concat(F.lit("Zorbal no "), i)))).entities.groupBy("chat_id").agg(F.count("*").alias("n"), F.max("ent").alias("last")), _with(then="SELECT chat_id, 40::BIGINT AS n, 39 AS last FROM chain WHERE pos = 0"))


def _facts(s: SparkSession, d: str) -> DataFrame:
    fact = lambda i: F.struct(F.concat(F.lit("holds item "), i).alias("text"), F.lit("confirmed").alias("status"), F.lit("").alias("slot"), F.col("text").alias("evidence"))
    bond = lambda i: F.struct(F.concat(F.lit("Other "), i).alias("other"), F.lit("ally").alias("kind"), F.col("text").alias("evidence"))
    got = _answer(s, d, F.array(_entity(facts=_many(17, fact), relationships=_many(11, bond))))
    return got.facts.select("chat_id", F.lit("fact").alias("what"), "text").unionByName(got.relations.select("chat_id", F.lit("relation").alias("what"), F.concat("other", F.lit(" is "), "text").alias("text")))


add("g2_cap_facts", _facts, _with(HOLDS, then="SELECT chat_id, 'fact' AS what, 'holds item ' || i AS text FROM first, range(1, 15) t(i) WHERE holds UNION ALL SELECT chat_id, 'relation', 'Other ' || i || ' is ally' FROM first, range(1, 9) t(i) WHERE holds"))
add("g3_cap_updates", lambda s, d: _answer(s, d, F.array(_entity()), _many(36, lambda i: F.struct(F.concat(F.lit("F"), i).alias("fact_id"), F.lit("done").alias("new_status"), F.col("text").alias("evidence"), F.array(F.lit(1)).alias("messages")))).updates.select("chat_id", "ord", "ref"),
    _with(HOLDS, then="SELECT chat_id, (i - 1)::INT AS ord, 'F' || i AS ref FROM first, range(1, 31) t(i) WHERE holds"))
add("g4_cap_aliases", lambda s, d: _answer(s, d, F.array(_entity(aliases=_many(12, lambda i: F.concat(F.lit("Alias "), i)), keys=_many(15, lambda i: F.concat(F.lit("key "), i))))).entities.select("chat_id", F.array_join("aliases", ",").alias("aliases"), F.array_join("keys", ",").alias("keys")),
    _with(then="SELECT chat_id, (SELECT string_agg('Alias ' || i, ',' ORDER BY i) FROM range(1, 9) t(i)) AS aliases, (SELECT string_agg('key ' || i, ',' ORDER BY i) FROM range(1, 11) t(i)) AS keys FROM chain WHERE pos = 0"))


def _cited(s: SparkSession, d: str) -> DataFrame:
    """Every batch of three cites its second message, one that is not there, the second again, and the first as 1.7."""
    c = I.chain(s, d)
    window = C.with_context(c, C.batches(c, 3), 0).withColumnRenamed("batch", "batch_id")
    raw = window.select(*AT).distinct().withColumn("raw", F.lit('{"entities": [{"name": "Zorbal", "type": "creature", "action": "create", "messages": [2, 99, "2", 1.7, "x", null]}]}'))
    return V.validate(raw, window, Settings(), cut=I.cut).entities.select(*AT, F.array_join("sigs", ",").alias("sigs"))


add("d1_cite_join", _cited, _with("n AS (SELECT chat_id, pos // 3 AS batch_id, sig, pos % 3 + 1 AS n FROM chain)", then="SELECT a.chat_id, a.batch_id, CASE WHEN b.sig IS NULL OR b.sig = a.sig THEN a.sig ELSE b.sig || ',' || a.sig END AS sigs FROM n a LEFT JOIN n b ON a.chat_id = b.chat_id AND a.batch_id = b.batch_id AND b.n = 2 WHERE a.n = 1"))
add("h6_dedupe_sigs", lambda s, d: _answer(s, d, F.array(_entity(messages=F.array(F.lit(1), F.lit(2), F.lit(1)))), twice=True).entities.select("chat_id", F.size("sigs").alias("n"), F.array_join("sigs", ",").alias("sigs")), _with(then="SELECT chat_id, 1 AS n, sig AS sigs FROM chain WHERE pos = 0"))


def _known_only(s: SparkSession, d: str) -> DataFrame:
    """Updates of two known facts and of one that nobody knows: kept ones, and what the audit says."""
    update = lambda ref: F.struct(F.lit(ref).alias("fact_id"), F.lit("done").alias("new_status"), F.col("text").alias("evidence"), F.array(F.lit(1)).alias("messages"))
    got = _answer(s, d, F.array(_entity()), F.array(update("F7"), update("F999"), update("F8")))
    return got.updates.select("chat_id", F.col("ref").alias("what")).unionByName(got.dropped.where(F.col("why") == L.DROP_REASONS["unknown_fact"]).select("chat_id", "what"))


add("d18_known_fact_semi", _known_only, _with(HOLDS, then="SELECT chat_id, unnest(['F7', 'F8']) AS what FROM first WHERE holds UNION ALL SELECT chat_id, 'update F999' FROM first"))


# ---- books: suppliers have books, parts are entries
def _books(s: SparkSession, d: str) -> DataFrame:
    return I.table(s, d, "supplier").select(F.col("s_nationkey").cast("string").alias("chat_id"), F.when(F.col("s_suppkey") % 10 == 0, F.concat(F.lit("Skein_"), "s_suppkey")).otherwise(F.col("s_name")).alias("book"))


def _entries(s: SparkSession, d: str) -> DataFrame:
    book = F.concat(F.lit("Supplier#"), F.lpad((F.col("p_partkey") % 100).cast("string"), 9, "0"))
    return I.table(s, d, "part").select(book.alias("book"), F.col("p_partkey").cast("int").alias("uid"), F.when(F.col("p_size") > 10, F.col("p_name")).otherwise("").alias("comment"), F.when(F.col("p_size") % 7 > 0, F.col("p_type")).alias("content"),
        F.when(F.col("p_size") > 5, F.array(F.lit(""), F.col("p_brand"))).otherwise(F.array().cast("array<string>")).alias("key"), (F.col("p_size") % 5 == 0).alias("disable"))


OWN_BOOK = "Supplier#000000003"
NAMED = "b AS (SELECT s_nationkey::VARCHAR AS chat_id, CASE WHEN s_suppkey % 10 = 0 THEN 'Skein_' || s_suppkey ELSE s_name END AS book FROM supplier)"


def _names(s: SparkSession, d: str) -> DataFrame:
    own = _books(s, d).select("chat_id").distinct().withColumn("book", F.lit(OWN_BOOK))
    return B.static_names(_books(s, d), own, Settings(static_books=("House rules", "Skein_x")))


add("h4_static_name_set", _names, f"WITH {NAMED} SELECT DISTINCT chat_id, book FROM (SELECT * FROM b UNION ALL SELECT chat_id, 'House rules' FROM b) WHERE book NOT LIKE 'Skein%' AND book <> '{OWN_BOOK}'")
STATIC = f"""WITH {NAMED}, e AS (SELECT 'Supplier#' || lpad((p_partkey % 100)::VARCHAR, 9, '0') AS book, * FROM part WHERE p_size % 5 <> 0 AND p_size % 7 > 0 AND p_size > 5)
SELECT DISTINCT chat_id, 'static:' || book || ':' || p_partkey AS static_id, CASE WHEN p_size > 10 THEN p_name ELSE p_brand END AS name, p_brand AS keys, p_type AS content FROM e JOIN b USING (book) WHERE book NOT LIKE 'Skein%'"""
add("a8_static_scan", lambda s, d: B.static_entries(_entries(s, d), _books(s, d), Settings()).select("chat_id", "static_id", "name", F.array_join("keys", "|").alias("keys"), "content"), STATIC)


def _cached(s: SparkSession, d: str) -> DataFrame:
    """Entries asked for four times on a clock; read anew after a minute."""
    reads, now = [], [0.0]
    cache = B.StaticCache(lambda: reads.append(now[0]) or _entries(s, d), lambda: now[0])
    for now[0] in (0.0, 59.0, 61.0, 100.0):
        held = cache.get()
    return held.where("disable").agg(F.count("*").alias("disabled")).withColumn("read_at", F.lit(",".join(f"{x:g}" for x in reads)))


add("a9_static_cache", _cached, "SELECT count(*) AS disabled, '0,61' AS read_at FROM part WHERE p_size % 5 = 0")
add("a7_book_name", lambda s, d: I.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("chat_id"), F.concat("c_name", F.lit(" & Söhne")).alias("label")).select("chat_id", B.book_name("chat_id", Settings()).alias("book")),
    "SELECT c_custkey::VARCHAR AS chat_id, 'Skein_' || left(regexp_replace(c_name || ' & Söhne', '[^A-Za-z0-9_-]', '_', 'g'), 40) || '_' || left(md5(c_custkey::VARCHAR), 5) AS book FROM customer")


def _ensured(s: SparkSession, d: str) -> DataFrame:
    c = I.table(s, d, "customer")
    chats = c.select(F.col("c_custkey").cast("string").alias("chat_id"), F.col("c_name").alias("label"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Skein_"), "c_custkey")).alias("book"), F.when(F.col("c_custkey") % 3 == 0, "Hand made").alias("bound"))
    return B.ensure_books(chats, c.where("c_custkey % 4 = 0").select(F.concat(F.lit("Skein_"), "c_custkey").alias("book")), Settings())


add("a6_book_ensure", _ensured, """WITH c AS (SELECT c_custkey::VARCHAR AS chat_id, c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'Skein_' || c_custkey ELSE 'Skein_' || regexp_replace(c_name, '[^A-Za-z0-9_-]', '_', 'g') || '_' || left(md5(c_custkey::VARCHAR), 5) END AS book FROM customer)
SELECT chat_id, book, k % 4 <> 0 AS created, CASE WHEN k % 3 = 0 THEN 'Hand made' ELSE book END AS bound, k % 3 = 0 AS warn FROM c""")


def _sunk(s: SparkSession, d: str) -> DataFrame:
    """Books that may be written: one is no target of its own, one is static, one has another prefix."""
    c = I.table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("chat_id"))
    own = c.select("chat_id", F.when(F.col("k") % 5 == 0, F.concat(F.lit("Mine_"), "k")).otherwise(F.concat(F.lit("Skein_"), "k")).alias("book"), "k")
    own = own.withColumn("target", F.when(F.col("k") % 7 == 0, "Skein_other").otherwise(F.col("book")))
    return B.writable(own.drop("k"), own.where("k % 11 = 0").select("chat_id", "book"), Settings())


add("a10_book_sink", _sunk, "SELECT c_custkey::VARCHAR AS chat_id, CASE WHEN c_custkey % 5 = 0 THEN 'Mine_' ELSE 'Skein_' END || c_custkey AS book, c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND NOT (c_custkey % 11 = 0) AS ok FROM customer")


# ---- settings and commands
add("r7_settings_ui", lambda s, d: s.createDataFrame([(n, k) for n, k, _ in members(merge_settings({"depth": 9}))], "member string, kind string"), """
SELECT * FROM (VALUES ('enabled', 'bool'), ('extract_every', 'int'), ('settle_lag', 'int'), ('window_max', 'int'), ('context_msgs', 'int'), ('max_chars_per_msg', 'int'), ('min_confidence', 'float'), ('min_importance', 'float'), ('instant_importance', 'float'),
('episode_gap', 'int'), ('long_episode_msgs', 'int'), ('type_rules', 'dict[str, TypeRule]'), ('protagonist', 'tuple[str, ...]'), ('excluded_types', 'tuple[str, ...]'), ('apply_mode', 'str'), ('conflict_policy', 'str'), ('player_authoritative', 'bool'), ('static_match', 'str'),
('on_manual_edit', 'str'), ('include_uncertain', 'bool'), ('evidence_strictness', 'str'), ('static_books', 'tuple[str, ...]'), ('auto_detect_static', 'bool'), ('book_prefix', 'str'), ('position', 'int'), ('depth', 'int'), ('order', 'int'), ('role', 'int'), ('max_chars', 'int'), ('max_keys', 'int'), ('extra_rules', 'str')) t(member, kind)""")
