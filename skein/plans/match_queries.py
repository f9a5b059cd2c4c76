"""Names, mentions and identities (D2-D6, D9, D15, J, G7, O3) over parts and conversations: a brand is a chat, a part an entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import lexicon as L
from skein.functions import text as X
from skein.operators import chain as C
from skein.operators import derive as D
from skein.operators import extract as E
from skein.operators import resolve as J
from skein.plans import inputs as I
from skein.plans import sql as Q
from skein.plans.inputs import table
from skein.plans.registry import add

NONE = "array<string>"


def _parts(spark: SparkSession, sf_dir: str, name: str = "p_name") -> DataFrame:
    none = F.array().cast(NONE)
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("chat_id"), F.col("p_partkey").cast("string").alias("entity_id"), F.lit("character").alias("type"), F.expr(name).alias("name"), none.alias("aliases"), none.alias("keys"), F.lit(None).cast("string").alias("static_id"), "p_partkey", "p_size")


def _names(spark: SparkSession, sf_dir: str, name: str = "p_name", where: str = "true") -> DataFrame:
    """A registry: parts by brand, each called by its name."""
    return J.registry(_parts(spark, sf_dir, name).where(where), spark.createDataFrame([], D.STATICS))


def _mentions(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("chat_id"), F.col("p_partkey").alias("mention_id"), F.expr(name).alias("name"), F.array().cast(NONE).alias("aliases"), F.lit("character").alias("type"))


add("j1_registry_build", _names, f"SELECT DISTINCT p_brand AS chat_id, p_partkey::VARCHAR AS entity_id, 'character' AS type, 'dyn' AS src, p_name AS display, NULL::VARCHAR AS static_of, {Q.norm('p_name')} AS norm_name FROM part")
EXACT = "exact AS (SELECT p_brand AS chat_id, p_partkey AS mention_id, CASE WHEN count(*) OVER (PARTITION BY p_brand, k) = 1 THEN p_partkey::VARCHAR END AS entity_id, 'exact' AS how FROM (SELECT p_brand, p_partkey, {k} AS k FROM part))"
add("d2_exact_name", lambda s, d: J.exact(J.queries(_mentions(s, d, "upper(p_name)")), _names(s, d)), "WITH " + EXACT.format(k=Q.norm("p_name")) + " SELECT * FROM exact")

# Names of two words: of a part's name, one is not a descriptor if it is none of these.
ODD = "concat('lord ', p_name, ' ', if(p_size > 25, 'elf', 'smith'))"
WORDS = f"""asked AS (SELECT p_brand AS chat_id, p_partkey AS mention_id, {{q}} AS q FROM part),
q AS (SELECT *, [t FOR t IN string_split(q, ' ') IF t NOT IN ({Q.quote(L.HONORIFICS)})] AS qt FROM asked),
q2 AS (SELECT *, [t FOR t IN qt IF t NOT IN ({Q.quote(L.DESCRIPTORS)})] AS qs FROM q),
n AS (SELECT p_brand AS chat_id, p_partkey::VARCHAR AS entity_id, string_split({Q.norm("p_name")}, ' ') AS nt FROM part),
n2 AS (SELECT *, [t FOR t IN nt IF t NOT IN ({Q.quote(L.DESCRIPTORS)})] AS ns FROM n),
near AS (SELECT q2.chat_id, mention_id, count(*) AS n, min(entity_id) AS one FROM q2 JOIN n2 ON q2.chat_id = n2.chat_id
  WHERE len(qs) > 0 AND len(ns) > 0 AND NOT (len(qs) = 1 AND qs[1] IN ({Q.quote(L.GENERIC_WORDS)})) AND NOT (len(ns) = 1 AND ns[1] IN ({Q.quote(L.GENERIC_WORDS)}))
    AND NOT list_has_any(qt, [{Q.quote(L.RELATIONAL)}]) AND (list_has_all(qt, ns) OR list_has_all(nt, qs)) GROUP BY ALL),
words AS (SELECT chat_id, mention_id, CASE WHEN n = 1 THEN one END AS entity_id, CASE WHEN n = 1 THEN 'tokens' ELSE 'tokens-dyn' END AS how FROM near)"""
ODD_SQL = "p_name || CASE WHEN p_size > 25 THEN ' elf' ELSE ' smith' END"
add("d3_token_containment", lambda s, d: J.by_tokens(J.queries(_mentions(s, d, ODD)), _names(s, d)), "WITH " + WORDS.replace("{q}", "'lord ' || " + ODD_SQL) + " SELECT * FROM words")

# A part's name with its key and a wrong letter, against names with their keys.
LONG, WRONG = "concat('keeper of the ', p_name, ' number ', p_partkey)", "concat('keeqer of the ', p_name, ' number ', p_partkey)"
SPELLED = f"""names AS (SELECT p_brand AS chat_id, p_partkey, 'keeper of the ' || p_name || ' number ' || p_partkey AS name FROM part), asked AS (SELECT p_brand AS chat_id, p_partkey, 'keeqer of the ' || p_name || ' number ' || p_partkey AS name FROM part),
ng AS (SELECT chat_id, p_partkey, length(name) + 1 AS size, g, count(*) AS c FROM (SELECT *, unnest({Q.grams('name')}) AS g FROM names) GROUP BY ALL), qg AS (SELECT chat_id, p_partkey, length(name) + 1 AS size, g, count(*) AS c FROM (SELECT *, unnest({Q.grams('name')}) AS g FROM asked) GROUP BY ALL),
dice AS (SELECT q.chat_id, q.p_partkey AS mention_id, n.p_partkey::VARCHAR AS entity_id, 2.0 * sum(least(q.c, n.c)) / (q.size + n.size) AS dice FROM qg q JOIN ng n ON q.chat_id = n.chat_id AND q.g = n.g GROUP BY q.chat_id, q.p_partkey, n.p_partkey, q.size, n.size),
ranked AS (SELECT *, row_number() OVER w AS r, coalesce(lead(dice) OVER w, 0) AS second FROM dice WINDOW w AS (PARTITION BY chat_id, mention_id ORDER BY dice DESC, entity_id)),
fuzzy AS (SELECT chat_id, mention_id, entity_id, 'fuzzy' AS how FROM ranked WHERE r = 1 AND dice >= 0.88 AND dice - second > 0.04)"""
add("d4_fuzzy_name", lambda s, d: J.fuzzy(J.queries(_mentions(s, d, WRONG)), _names(s, d, LONG)), f"WITH {SPELLED} SELECT * FROM fuzzy")

# One in three is asked for as it is, one in three with an epithet, the rest misspelt.
CASCADE = "case p_partkey % 3 when 0 then p_name when 1 then concat('lord ', p_name, ' smith') else concat(left(p_name, 2), 'qqq', p_partkey) end"
MIXED = f"CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'lord ' || p_name || ' smith' ELSE left(p_name, 2) || 'qqq' || p_partkey END"
add("j2_resolve_cascade", lambda s, d: J.resolve(_mentions(s, d, CASCADE), _names(s, d)), f"""WITH {WORDS.replace('{q}', Q.norm(MIXED))},
exact AS (SELECT a.chat_id, mention_id, count(*) AS n, min(p_partkey)::VARCHAR AS one FROM asked a JOIN part ON p_brand = a.chat_id AND {Q.norm('p_name')} = a.q GROUP BY ALL)
SELECT a.chat_id, a.mention_id, CASE WHEN e.n IS NULL THEN w.entity_id WHEN e.n = 1 THEN e.one END AS entity_id, CASE WHEN e.n IS NULL THEN CASE WHEN w.entity_id IS NOT NULL THEN w.how END WHEN e.n = 1 THEN 'exact' END AS how
FROM asked a LEFT JOIN exact e USING (chat_id, mention_id) LEFT JOIN words w USING (chat_id, mention_id)""")


def _ids(s: SparkSession, d: str) -> DataFrame:
    """Ids for new entities: what a large part is called may be taken by a place."""
    p = table(s, d, "part")
    return p.select("p_partkey", J.new_id(F.col("p_name"), F.lit("character"), F.when(F.col("p_size") > 25, "location").when(F.col("p_size") > 10, "creature")).alias("id"))


add("j3_new_id", _ids, f"SELECT p_partkey, {Q.slug('p_name')} || CASE WHEN p_size > 25 THEN '-character' ELSE '' END AS id FROM part")


# ---- identities in order. Names are hashes, so that only equal ones meet.
def _met(s: SparkSession, d: str) -> DataFrame:
    """Small parts are known, large ones stand in a static book; each part is mentioned twice, the second time with an alias; some mentions come with a hint."""
    parts = _parts(s, d, "concat('n', md5(cast(p_partkey as string)))")
    statics = parts.where("p_size > 40").select("chat_id", F.concat(F.lit("static:b:"), "entity_id").alias("static_id"), "name", F.array().cast(NONE).alias("keys"), F.lit("character").alias("type"), F.lit("").alias("content"))
    names = J.registry(parts.where("p_size <= 10").drop("p_partkey", "p_size"), statics)
    again = parts.crossJoin(F.broadcast(s.range(2).withColumnRenamed("id", "batch_id")))
    hint = F.when((F.col("p_size") <= 10) & (F.col("p_partkey") % 2 == 0), F.col("entity_id")).otherwise("")
    asked = F.when(F.col("batch_id") == 0, F.col("name")).otherwise(F.concat(F.lit("m"), F.md5("entity_id")))
    alias = F.when(F.col("batch_id") == 1, F.array("name")).otherwise(F.array().cast(NONE))
    # A hint comes with a name of its own, which the entity then has as well.
    m = again.select("chat_id", "batch_id", F.col("p_partkey").cast("int").alias("ent"), asked.alias("name"), hint.alias("matches_id"), F.lit("character").alias("type"), alias.alias("aliases"), F.array().cast(NONE).alias("keys"))
    return J.take_in(m, names)


IDENTITY = """SELECT p_brand AS chat_id, b.id::BIGINT AS batch_id, p_partkey::INT AS ent,
  CASE WHEN p_size <= 10 THEN p_partkey::VARCHAR WHEN p_size > 40 THEN 'd-n' || md5(p_partkey::VARCHAR) ELSE 'n' || md5(p_partkey::VARCHAR) END AS entity_id,
  CASE WHEN p_size <= 10 AND p_partkey % 2 = 0 THEN 'model' WHEN p_size BETWEEN 11 AND 40 AND b.id = 0 THEN 'new' ELSE 'exact' END AS how,
  CASE WHEN p_size > 40 AND b.id = 0 THEN 'static:b:' || p_partkey END AS static_id,
  CASE WHEN b.id = 1 THEN 'm' || md5(p_partkey::VARCHAR) ELSE '' END AS aliases
FROM part, range(0, 2) b(id)"""
add("j4_resolve_incremental", lambda s, d: _met(s, d).select("chat_id", "batch_id", "ent", "entity_id", "how", F.array_join("aliases", "|").alias("aliases")), f"SELECT * EXCLUDE (static_id) FROM ({IDENTITY})")
add("d5_id_hint", lambda s, d: _met(s, d).where("how = 'model'").select("chat_id", "batch_id", "ent", "entity_id"), f"SELECT chat_id, batch_id, ent, entity_id FROM ({IDENTITY}) WHERE how = 'model'")
add("d6_static_delta_id", lambda s, d: _met(s, d).where("entity_id like 'd-%'").select("chat_id", "batch_id", "ent", "entity_id", "static_id"), f"SELECT chat_id, batch_id, ent, entity_id, static_id FROM ({IDENTITY}) WHERE entity_id LIKE 'd-%'")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part points to the one its size below, so far as there is one."""
    p = table(spark, sf_dir, "part").select(F.lit("c").alias("chat_id"), F.col("p_partkey").cast("string").alias("entity_id"), F.when(F.col("p_partkey") > F.col("p_size"), (F.col("p_partkey") - F.col("p_size")).cast("string")).alias("merge_into"))
    known = p.select("entity_id")
    kept = p.join(known.withColumnRenamed("entity_id", "merge_into"), "merge_into", "left_semi")
    return D.merge_redirect(kept).select("entity_id", "target")


add("d9_merge_redirect", _merged, """
WITH RECURSIVE s AS (SELECT p.p_partkey AS a, p.p_partkey - p.p_size AS b FROM part p WHERE p.p_partkey > p.p_size AND EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = p.p_partkey - p.p_size)),
w(a, b, hop) AS (SELECT a, b, 1 FROM s UNION ALL SELECT w.a, s.b, hop + 1 FROM w JOIN s ON s.a = w.b WHERE hop < 8)
SELECT a::VARCHAR AS entity_id, arg_max(b, hop)::VARCHAR AS target FROM w GROUP BY a""")


# ---- mentions
def _mentioned(s: SparkSession, d: str) -> DataFrame:
    """Of each chat, the first two and the first three words of every message as names, in windows of three messages."""
    c = I.chain(s, d)
    windows = C.with_context(c, C.batches(c, 3), 0).withColumnRenamed("batch", "batch_id")
    first = lambda k: c.select("chat_id", F.concat(F.lit(f"p{k}-"), "pos").alias("entity_id"), F.array_join(F.slice(X.tokens("text"), 1, k), " ").alias("norm_name"))
    return E.mentioned(first(2).unionByName(first(3)), windows)


add("d15_mention_match", _mentioned, f"""WITH {Q.CHAIN}, w AS (SELECT chat_id, pos // 3 AS batch_id, ' ' || {Q.norm("string_agg(text, ' ' ORDER BY pos)")} || ' ' AS said FROM chain GROUP BY chat_id, pos // 3),
t AS (SELECT chat_id, pos, {Q.tokens('text')} AS t FROM chain), n AS (SELECT chat_id, 'p2-' || pos AS entity_id, array_to_string(t[1:2], ' ') AS name FROM t UNION ALL SELECT chat_id, 'p3-' || pos, array_to_string(t[1:3], ' ') FROM t)
SELECT DISTINCT n.chat_id, batch_id, entity_id FROM n JOIN w ON n.chat_id = w.chat_id AND contains(said, ' ' || name || ' ') WHERE length(name) >= 3""")


def _known(s: SparkSession, d: str) -> DataFrame:
    """Brands as chats: two windows each, one that names every part of size 20 or less and every other static entry, one that names none."""
    e = _parts(s, d, "concat('n', md5(cast(p_partkey as string)))")
    view = D.View(e.select("chat_id", "entity_id", "type", "name", "aliases", "keys", "static_id", F.lit("promoted").alias("state"), F.col("p_partkey").alias("first_at")), s.createDataFrame([], "chat_id string, entity_id string, state string, ord int, fact_id string, status string, text string"), None)
    statics = table(s, d, "supplier").select(F.concat(F.lit("Brand#"), F.col("s_suppkey") % 25 + 1).alias("chat_id"), F.format_string("s:%09d", "s_suppkey").alias("static_id"), F.concat(F.lit("s"), F.md5(F.col("s_suppkey").cast("string"))).alias("name"), F.array().cast(NONE).alias("keys"), F.lit(None).cast("string").alias("type"), F.lit("old lore").alias("content"), "s_suppkey")
    said = e.where("p_size <= 20").select("chat_id", "name").unionByName(statics.where("s_suppkey % 2 = 0").select("chat_id", "name"))
    windows = said.groupBy("chat_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("text")).select("chat_id", F.lit(0).cast("long").alias("batch_id"), F.lit(1).alias("n"), "text")
    windows = windows.unionByName(windows.withColumn("batch_id", F.lit(1).cast("long")).withColumn("text", F.lit("nothing")))
    statics = statics.drop("s_suppkey")
    return E.known_block(view, statics, windows, J.registry(view.entities, statics))


KNOWN = """every AS (SELECT p_brand AS chat_id, p_partkey::VARCHAR AS id, 0 AS src, p_partkey AS k, 'n' || md5(p_partkey::VARCHAR) AS name, p_size <= 20 AS hit FROM part
  UNION ALL SELECT 'Brand#' || (s_suppkey % 25 + 1), printf('s:%09d', s_suppkey), 1, s_suppkey, 's' || md5(s_suppkey::VARCHAR), s_suppkey % 2 = 0 FROM supplier),
w AS (SELECT e.* REPLACE (hit AND b.id = 0 AS hit), b.id AS batch_id FROM every e, range(0, 2) b(id) WHERE e.chat_id IN (SELECT chat_id FROM every WHERE hit)),
a AS (SELECT *, row_number() OVER (PARTITION BY chat_id, batch_id, src, hit ORDER BY k) AS mine FROM w),
b AS (SELECT *, hit AND (src = 1 OR mine <= 14) AS f FROM a), c AS (SELECT * REPLACE (f AND row_number() OVER (PARTITION BY chat_id, batch_id, f ORDER BY src, k) <= 22 AS f) FROM b),
e AS (SELECT *, NOT f AND (src = 1 OR row_number() OVER (PARTITION BY chat_id, batch_id, src, f ORDER BY k) <= 120) AS g FROM c), h AS (SELECT * REPLACE (g AND row_number() OVER (PARTITION BY chat_id, batch_id, f, g ORDER BY src, k) <= 220 AS g) FROM e)"""
add("o3_known_block", _known, f"""WITH {KNOWN} SELECT chat_id, batch_id, 'Entities that this part names (reuse their ids):' || chr(10) || coalesce(string_agg('* ' || id || ' = ' || name || CASE WHEN src = 0 THEN ' (character, promoted)' ELSE ' (lore, written by hand, not to be changed): old lore' END, chr(10) ORDER BY src, k) FILTER (WHERE f), 'none')
  || chr(10) || chr(10) || 'Further ids and names: ' || coalesce(string_agg(id || '=' || name, ', ' ORDER BY src, k) FILTER (WHERE g), 'none') AS known FROM h GROUP BY chat_id, batch_id""")
add("g7_cap_known", lambda s, d: _known(s, d).select("chat_id", "batch_id", (F.size(F.split("known", "\n\\* ")) - 1).alias("detailed"), F.regexp_count("known", F.lit("[0-9]=")).alias("listed")),
    f"WITH {KNOWN} SELECT chat_id, batch_id, (count(*) FILTER (WHERE f))::INT AS detailed, (count(*) FILTER (WHERE g))::INT AS listed FROM h GROUP BY chat_id, batch_id")
