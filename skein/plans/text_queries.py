"""Scalar functions (C, B1) over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import lexicon as L
from skein.functions import text as X
from skein.plans import sql as Q
from skein.plans.inputs import table
from skein.plans.registry import add

NAMES = ("Dragon",)


def _over(name: str, keys: list[str], value: Callable[[], Column]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, name).select(*keys, value().alias("value"))

    return run


def _text(key: str, value: Callable[[], Column], sql: str, name: str = "conversations", keys: tuple[str, ...] = ("conv_id", "turn")) -> None:
    add(key, _over(name, list(keys), value), f"SELECT {', '.join(keys)}, {sql} AS value FROM {name}")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message's text beside the one before it in its conversation."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("a"), F.coalesce(before, "text").alias("b"))


PAIRS = "SELECT conv_id, turn, text AS a, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), text) AS b FROM conversations"


def _pair(key: str, value: Callable[[], Column], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = pairs(spark, sf_dir).withColumn("ta", X.content_tokens("a")).withColumn("tb", X.content_tokens("b"))
        return rows.select("conv_id", "turn", value().alias("value"))

    add(key, run, f"WITH p AS ({PAIRS}), t AS (SELECT *, {Q.content('a')} AS ta, {Q.content('b')} AS tb FROM p) SELECT conv_id, turn, {sql} AS value FROM t")


_text("b1_msg_text", lambda: X.collapse("text"), Q.collapse("text"))
_text("c1_hash53", lambda: X.hash53("text"), Q.hash53("coalesce(text, '')"))
_text("c2_norm", lambda: X.norm("text"), Q.norm("text"))
_text("c3_tokens", lambda: F.array_join(X.tokens("text"), "|"), f"array_to_string({Q.tokens('text')}, '|')")
_text("c4_content_tokens", lambda: F.array_join(X.content_tokens("text"), "|"), f"array_to_string({Q.content('text')}, '|')")
_pair("c5_jaccard", lambda: F.round(X.jaccard(F.col("ta"), F.col("tb")), 6), f"round({Q.jaccard('ta', 'tb')}, 6)")
_pair("c6_containment", lambda: F.round(X.containment(F.col("ta"), F.col("tb")), 6), f"round({Q.containment('ta', 'tb')}, 6)")
_text("c7_bigrams", lambda: F.array_join(X.bigrams(X.norm("text")), "|"), f"array_to_string(list_transform(generate_series(1, length({Q.norm('text')}) + 1), lambda i: (' ' || {Q.norm('text')} || ' ')[i : i + 1]), '|')")


def _c8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name against its brand and type: short texts, as names are."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(X.dice("p_name", "p_type"), 6).alias("value"))


add("c8_dice", _c8, f"""
WITH p AS (SELECT p_partkey, {Q.norm('p_name')} AS a, {Q.norm('p_type')} AS b FROM part),
ga AS (SELECT p_partkey, g, count(*) AS n FROM (SELECT p_partkey, unnest(list_transform(generate_series(1, length(a) + 1), lambda i: (' ' || a || ' ')[i : i + 1])) AS g FROM p) GROUP BY ALL),
gb AS (SELECT p_partkey, g, count(*) AS n FROM (SELECT p_partkey, unnest(list_transform(generate_series(1, length(b) + 1), lambda i: (' ' || b || ' ')[i : i + 1])) AS g FROM p) GROUP BY ALL),
m AS (SELECT p_partkey, sum(least(ga.n, gb.n)) AS inter FROM ga JOIN gb USING (p_partkey, g) GROUP BY p_partkey)
SELECT p_partkey, round(CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 ELSE 2.0 * coalesce(inter, 0) / (length(a) + length(b) + 2) END, 6) AS value
FROM p LEFT JOIN m USING (p_partkey)""")  # fmt: skip
_pair("c9_similar_text", lambda: X.similar(F.col("ta"), F.col("tb"), 0.05), Q.similar("ta", "tb", 0.05))
_text("c10_slug", lambda: X.slug("text"), Q.slug("text"))
_text("c11_clamp", lambda: X.clamp("value", 5, 60), "least(greatest(value, 5.0), 60.0)", "events", ("event_id",))
ORDERED_DISTINCT = f"""
WITH t AS (SELECT conv_id, turn, unnest({Q.tokens('text')}) AS w, generate_subscripts({Q.tokens('text')}, 1) AS i FROM conversations),
f AS (SELECT conv_id, turn, w, min(i) AS i FROM t GROUP BY ALL),
g AS (SELECT conv_id, turn, string_agg(w, '|' ORDER BY i) AS value FROM f GROUP BY ALL)
SELECT conv_id, turn, coalesce(value, '') AS value FROM conversations LEFT JOIN g USING (conv_id, turn)"""
add("c12_uniq", _over("conversations", ["conv_id", "turn"], lambda: F.array_join(F.array_distinct(X.tokens("text")), "|")), ORDERED_DISTINCT)
_text("c13_sanitize_text", lambda: X.sanitize("html", 2000), Q.sanitize("html", 2000), "pages", ("page_id",))
_text("c15_sanitize_key", lambda: X.sanitize_key("p_name"), Q.sanitize_key("p_name"), "part", ("p_partkey",))


def _c14(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(X.tokens("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.where(X.is_generic("word"))


add("c14_is_generic", _c14, f"SELECT word, count(*) AS n FROM (SELECT unnest({Q.tokens('text')}) AS word FROM documents) WHERE word IN ({Q.quote(L.GENERIC_WORDS)}) GROUP BY word")


def _c17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.props wrapped as a model might: fenced, with prose, with a trailing comma, as a bare list."""
    raw = F.when(F.col("event_type") == "view", F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_type") == "click", F.concat(F.lit("Sure: "), F.replace("props", F.lit("}"), F.lit(",}")), F.lit(" done")))
    raw = raw.when(F.col("event_type") == "error", F.concat(F.lit("["), "props", F.lit("]"))).when(F.col("event_type") == "signup", F.lit("no answer")).otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_id", X.tolerant_json(raw).alias("v"))
    return rows.select("event_id", F.coalesce(F.try_variant_get("v", "$.k", "bigint"), F.try_variant_get("v", "$[0].k", "bigint")).alias("value"))


add("c17_parse_model_json", _c17, "SELECT event_id, CASE WHEN event_type <> 'signup' THEN (props->>'$.k')::BIGINT END AS value FROM events")
for _key, _list in (("c18_re_hedge", L.HEDGE), ("c19_re_future", L.FUTURE), ("c20_re_claim", L.CLAIM), ("c21_re_mental", L.MENTAL), ("c22_protagonist_regex", X.protagonist_words(NAMES))):
    _text(_key, lambda words=_list: X.has_words("text", words), Q.has_words("text", _list), "documents", ("doc_id",))
_text("c23_is_protagonist", lambda: X.is_protagonist("role", ("assistant",)), f"{Q.norm('role')} IN ('assistant', 'user', 'you', 'player')")
_text("c24_violates_agency", lambda: X.violates_agency("text", ("the",)), f"{Q.has_words('text', X.protagonist_words(('the',)))} AND {Q.has_words('text', L.MENTAL)}", "documents", ("doc_id",))
_text("c25_guard_status", lambda: X.guard_status("text", F.lit("confirmed")), Q.guard("text", "'confirmed'"), "documents", ("doc_id",))


def _c26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("conv_id", "turn", X.evidence_holds("a", "b").alias("value"))


add("c26_evidence_holds", _c26, f"""
WITH p AS ({PAIRS}), n AS (SELECT conv_id, turn, {Q.norm('a')} AS ev, {Q.norm('b')} AS hay, {Q.content('a')} AS said, {Q.tokens('b')} AS there FROM p)
SELECT conv_id, turn, length(ev) >= 6 AND (contains(hay, ev) OR (len(said) >= 3 AND len([t FOR t IN said IF list_contains(there, t)]) >= 0.8 * len(said))) AS value FROM n""")  # fmt: skip
_text("c27_family_of", lambda: X.family_of(F.element_at(F.array(*map(F.lit, L.TYPES)), F.pmod(F.col("event_id"), F.lit(14)).cast("int") + 1)), Q.family(f"[{Q.quote(L.TYPES)}][event_id % 14 + 1]"), "events", ("event_id",))
_text("c28_core_tokens", lambda: F.array_join(X.core_tokens("text"), "|"), f"array_to_string(CASE WHEN len([t FOR t IN {Q.tokens('text')} IF t NOT IN ({Q.quote(L.HONORIFICS)})]) > 0 THEN [t FOR t IN {Q.tokens('text')} IF t NOT IN ({Q.quote(L.HONORIFICS)})] ELSE {Q.tokens('text')} END, '|')")
_text("c29_fact_id", lambda: X.fact_id(F.lit("e"), F.col("text")), f"'F' || left(md5('e|' || {Q.norm('text')}), 12)")
_text("c30_entry_comment", lambda: X.entry_comment(F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_type")), "'DL:' || p_partkey || ' | ' || p_name || ' [' || p_type || ']'", "part", ("p_partkey",))
_text("c31_parse_managed_id", lambda: X.managed_id(F.when(F.col("p_size") > 25, X.entry_comment(F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_type"))).otherwise(F.col("p_name"))), "CASE WHEN p_size > 25 THEN p_partkey::VARCHAR END", "part", ("p_partkey",))
_text("c32_trim_end", lambda: X.trim_end("text"), "regexp_replace(text, '[.;,\\s]+$', '')")
_text("c33_op_key", lambda: X.op_key("p_brand", "p_name", F.when(F.col("p_size") > 25, F.col("p_type")), F.array("p_brand", "p_type")), "md5(p_brand || '|' || p_name || '|' || CASE WHEN p_size > 25 THEN md5(p_type || '|' || p_brand || '|' || p_type) ELSE 'x' END)", "part", ("p_partkey",))
_text("c34_html_escape", lambda: X.html_escape("html"), "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')", "pages", ("page_id",))
_text("c36_scrub", lambda: X.scrub("text", F.lit("the"), 500), "left(replace(text, 'the', ''), 500)")


def _c35(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nonces differ from row to row and are of twelve digits."""
    made = table(spark, sf_dir, "customer").select(X.nonce().alias("n"))
    return made.agg(F.count("*").alias("n"), F.count_distinct("n").alias("different"), F.count_if(F.col("n").rlike("^[0-9a-f]{12}$")).alias("formed"))


add("c35_make_nonce", _c35, "SELECT count(*) AS n, count(*) AS different, count(*) AS formed FROM customer")
add("c16_stable_stringify", lambda spark, sf_dir: table(spark, sf_dir, "nation").select("n_nationkey", X.stable_json("n_regionkey", "n_name", "n_nationkey").alias("value")),
    "SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' AS value FROM nation")
