"""Chains, batches, liveness (A1, B2-B14, E11-E14, H) over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.settings import Settings
from skein.operators import chain as C
from skein.operators import report as P
from skein.operators.ledger import prune_dormant
from skein.plans import inputs as I
from skein.plans import sql as Q
from skein.plans.registry import add

LAG, EVERY, SIZE, CONTEXT = 1, 2, 3, 2


def _chain(f):
    return lambda spark, sf_dir: f(I.chain(spark, sf_dir))


def _with(*ctes: str, then: str) -> str:
    return "WITH " + ",".join([Q.CHAIN, *ctes]) + "\n" + then


def read_before(chain: DataFrame) -> DataFrame:
    """What counts as read: the first message of each chat."""
    return chain.where("pos = 0").select("chat_id", "sig")


def todo(chain: DataFrame) -> DataFrame:
    return C.unscanned(C.settled(chain, LAG), read_before(chain))


TODO = f"todo AS (SELECT * FROM (SELECT *, max(pos) OVER (PARTITION BY chat_id) AS newest FROM chain) c WHERE pos < newest + 1 - {LAG} AND NOT EXISTS (SELECT 1 FROM chain s WHERE s.pos = 0 AND s.chat_id = c.chat_id AND s.sig = c.sig))"
BATCHED = f"batched AS (SELECT *, (row_number() OVER (PARTITION BY chat_id ORDER BY pos) - 1) // {SIZE} AS batch FROM todo)"
SHOWN = f"""shown AS (
  SELECT chat_id, batch, pos, sig, text, is_user, false AS is_context FROM batched
  UNION ALL
  SELECT c.chat_id, f.batch, c.pos, c.sig, c.text, c.is_user, true FROM (SELECT chat_id, batch, min(pos) AS first FROM batched GROUP BY ALL) f
  JOIN chain c ON c.chat_id = f.chat_id AND c.pos BETWEEN f.first - {CONTEXT} AND f.first - 1
)"""

add("a1_scan_messages", lambda spark, sf_dir: I.messages(spark, sf_dir).select("chat_id", "idx", "role", "text"), "SELECT conv_id::VARCHAR AS chat_id, turn AS idx, role, text FROM conversations")
add("b2_msg_sig", _chain(lambda c: c.select("chat_id", "idx", "sig")), _with(then="SELECT chat_id, idx, sig FROM chain"))
add("b3_build_chain", _chain(lambda c: c), _with(then="SELECT chat_id, idx, pos, sig, is_user, name, text FROM chain"))
add("b4_chain_positions", _chain(C.positions), _with(then="SELECT chat_id, sig, min(pos) AS pos FROM chain GROUP BY ALL"))
add("b5_settled_prefix", _chain(lambda c: C.settled(c, 2).select("chat_id", "pos")), _with(then="SELECT chat_id, pos FROM (SELECT *, max(pos) OVER (PARTITION BY chat_id) AS m FROM chain) WHERE pos < m - 1"))
add("b6_unscanned", _chain(lambda c: todo(c).select("chat_id", "pos")), _with(TODO, then="SELECT chat_id, pos FROM todo"))
add("b7_trigger_gate", _chain(lambda c: C.due(todo(c), EVERY)), _with(TODO, then=f"SELECT chat_id, count(*) AS n FROM todo GROUP BY chat_id HAVING count(*) >= {EVERY}"))
add("b8_batch_window", _chain(lambda c: C.batches(todo(c), SIZE).select("chat_id", "pos", "batch")), _with(TODO, BATCHED, then="SELECT chat_id, pos, batch FROM batched"))


def _shown(c: DataFrame) -> DataFrame:
    return C.with_context(c, C.batches(todo(c), SIZE), CONTEXT)


add("b9_context_lookback", _chain(lambda c: _shown(c).where("is_context").select("chat_id", "batch", "pos")), _with(TODO, BATCHED, SHOWN, then="SELECT chat_id, batch, pos FROM shown WHERE is_context"))
add("b10_window_number", _chain(lambda c: _shown(c).select("chat_id", "batch", "pos", "n")), _with(TODO, BATCHED, SHOWN, then="SELECT chat_id, batch, pos, row_number() OVER (PARTITION BY chat_id, batch ORDER BY is_context DESC, pos) AS n FROM shown"))
add("q4_holdback", _chain(lambda c: c.join(C.settled(c, LAG).select("chat_id", "idx"), ["chat_id", "idx"], "left_anti").select("chat_id", "pos")), _with(then=f"SELECT chat_id, pos FROM (SELECT *, max(pos) OVER (PARTITION BY chat_id) AS m FROM chain) WHERE pos >= m + 1 - {LAG}"))
add("q6_overlap_context", _chain(lambda c: _shown(c).groupBy("is_context").agg(F.count("*").alias("n"))), _with(TODO, BATCHED, SHOWN, then="SELECT is_context, count(*) AS n FROM shown GROUP BY ALL"))


# Observations of messages: each cites its message and the next one; deleted are the messages whose signature begins with 0 to 3.
def cited(c: DataFrame) -> DataFrame:
    after = c.select("chat_id", (F.col("pos") - 1).alias("pos"), F.col("sig").alias("next"))
    rows = c.join(after, ["chat_id", "pos"], "left")
    return rows.select("chat_id", F.col("pos").cast("long").alias("obs_id"), F.when(F.col("next").isNull(), F.array("sig")).otherwise(F.array("sig", "next")).alias("sigs"), "text")


def left_over(c: DataFrame) -> DataFrame:
    return C.positions(c.where("substr(sig, 1, 1) >= '4'"))


LIVE = """cited AS (SELECT chat_id, pos AS obs_id, sig, text FROM chain UNION ALL SELECT c.chat_id, c.pos, n.sig, c.text FROM chain c JOIN chain n ON n.chat_id = c.chat_id AND n.pos = c.pos + 1),
place AS (SELECT chat_id, sig, min(pos) AS pos FROM chain WHERE left(sig, 1) >= '4' GROUP BY ALL),
live AS (SELECT chat_id, obs_id, min(place.pos) AS "at" FROM cited JOIN place USING (chat_id, sig) GROUP BY ALL),
whole AS (SELECT chat_id, obs_id FROM cited LEFT JOIN place USING (chat_id, sig) GROUP BY ALL HAVING bool_and(place.pos IS NOT NULL))"""

add("b11_live_obs", _chain(lambda c: C.alive(cited(c), left_over(c)).select("chat_id", "obs_id", "at")), _with(LIVE, then='SELECT chat_id, obs_id, "at" FROM live'))
add("b12_live_fact", _chain(lambda c: C.all_alive(cited(c), ["obs_id"], left_over(c)).select("chat_id", "obs_id")), _with(LIVE, then="SELECT chat_id, obs_id FROM whole"))
add("b13_live_update", _chain(lambda c: C.all_alive(cited(c).where("size(sigs) > 1"), ["obs_id"], left_over(c)).groupBy("chat_id").agg(F.count("*").alias("n"))), _with(LIVE, then="SELECT chat_id, count(*) AS n FROM whole WHERE (chat_id, obs_id) IN (SELECT (chat_id, obs_id) FROM cited GROUP BY chat_id, obs_id HAVING count(*) > 1) GROUP BY chat_id"))
add("f1_chrono_order", _chain(lambda c: C.alive(cited(c), left_over(c)).selectExpr("chat_id", "obs_id", "row_number() over (partition by chat_id order by at, obs_id) AS ord")), _with(LIVE, then='SELECT chat_id, obs_id, row_number() OVER (PARTITION BY chat_id ORDER BY live."at", obs_id) AS ord FROM live'))
add("h5_prune_dormant", _chain(lambda c: prune_dormant(cited(c), left_over(c), 3).select("chat_id", "obs_id")), _with(LIVE, then="""
SELECT chat_id, obs_id FROM live UNION ALL
SELECT chat_id, obs_id FROM (SELECT c.chat_id, c.obs_id, row_number() OVER (PARTITION BY c.chat_id ORDER BY c.obs_id DESC) AS r, (SELECT count(*) FROM live l WHERE l.chat_id = c.chat_id) AS n
  FROM (SELECT DISTINCT chat_id, obs_id FROM cited) c WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.chat_id = c.chat_id AND l.obs_id = c.obs_id)) WHERE r <= greatest(0, 3 - n)"""))  # fmt: skip
add("n1_prune", _chain(lambda c: prune_dormant(cited(c), C.positions(c.where("pos > 3")), 0).groupBy("chat_id").agg(F.count("*").alias("kept"))), _with(then="SELECT chat_id, count(DISTINCT p) AS kept FROM (SELECT c.chat_id, c.pos AS p, c.sig FROM chain c UNION ALL SELECT c.chat_id, c.pos, n.sig FROM chain c JOIN chain n ON n.chat_id = c.chat_id AND n.pos = c.pos + 1) x WHERE EXISTS (SELECT 1 FROM chain l WHERE l.chat_id = x.chat_id AND l.sig = x.sig AND l.pos > 3) GROUP BY chat_id"))
ESTIMATE = "SELECT chat_id, count(*) AS n, sum(length(text))::BIGINT AS chars, ceil(sum(length(text)) / 4.0)::BIGINT AS tokens, ceil(count(*) / 12.0)::BIGINT AS calls FROM todo GROUP BY chat_id"
add("e13_unscanned_estimate", _chain(lambda c: P.estimate(todo(c), Settings())), _with(TODO, then=ESTIMATE))
add("p5_report_tools", lambda spark, sf_dir: I.engine(spark, sf_dir).report()["tools"], "WITH " + Q.OBSERVED + " SELECT chat_id, count(*) AS n, sum(length('event ' || obs_id))::BIGINT AS chars, ceil(sum(length('event ' || obs_id)) / 4.0)::BIGINT AS tokens, ceil(count(*) / 12.0)::BIGINT AS calls FROM obs WHERE value >= 1 GROUP BY chat_id")
META = "SELECT c.chat_id, count(DISTINCT c.obs_id) AS observations, count(DISTINCT l.obs_id) AS live, 1::BIGINT AS scanned FROM cited c LEFT JOIN live l USING (chat_id, obs_id) GROUP BY c.chat_id"
add("p6_report_meta", _chain(lambda c: P.meta(cited(c), left_over(c), read_before(c))), _with(LIVE, then=META))
add("e14_live_ratio", _chain(lambda c: P.meta(cited(c), left_over(c), todo(c).select("chat_id", "sig")).select("chat_id", F.round(F.col("live") / F.col("observations"), 6).alias("ratio"), "scanned")),
    _with(LIVE, TODO, then="SELECT c.chat_id, round(count(DISTINCT l.obs_id) / count(DISTINCT c.obs_id), 6) AS ratio, (SELECT count(DISTINCT sig) FROM todo t WHERE t.chat_id = c.chat_id) AS scanned FROM cited c LEFT JOIN live l USING (chat_id, obs_id) GROUP BY c.chat_id"))
