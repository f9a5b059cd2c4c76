"""What steps send and compare, by the counts of their plans: it grows as the input does, whatever is alike in it."""

import hashlib
import random

from pyspark.sql import functions as F

from skein.functions import plain as P
from skein.functions import text as X
from skein.functions.settings import Settings
from skein.operators import extract as E
from skein.operators import fold as K
from skein.operators import resolve as J
from skein.operators import validate as V

N = 400
MENTIONS = "chat_id string, mention_id long, name string, type string, aliases array<string>"
REGISTRY = "chat_id string, entity_id string, type string, src string, display string, static_of string, norm_name string"


def counts(df, metric):
    """A metric of all steps of a plan that has run."""
    df.collect()

    def walk(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            yield from walk(node.executedPlan())
            return
        if "QueryStage" in node.nodeName():
            yield from walk(node.plan())
            return
        found = node.metrics().get(metric)
        if found.isDefined():
            yield found.get().value()
        children = node.children()
        for i in range(children.size()):
            yield from walk(children.apply(i))

    return list(walk(df._jdf.queryExecution().executedPlan()))


def asked_and_named(spark, called, known):
    asked = J.queries(spark.createDataFrame([("c", i, n, "character", []) for i, n in enumerate(called)], MENTIONS))
    return asked, spark.createDataFrame([("c", f"e{i:04d}", "character", "dyn", n, None, n) for i, n in enumerate(known)], REGISTRY)


def test_names_that_many_share_are_met_once(spark):
    asked, names = asked_and_named(spark, ["Red Bolt"] * N, ["red bolt"] * N)
    for df, how in ((J.exact(asked, names), "exact"), (J.by_tokens(asked, names), "tokens-dyn")):
        assert max(counts(df, "numOutputRows")) <= 2 * N
        assert {(r["entity_id"], r["how"]) for r in df.collect()} == {(None, how)} and df.count() == N


def test_spellings_are_compared_without_a_row_for_each_pair(spark):
    asked, names = asked_and_named(spark, [f"keeqer of the bolt number {i}" for i in range(N)], [f"keeper of the bolt number {i}" for i in range(N)])
    df = J.fuzzy(asked, names)
    assert max(counts(df, "numOutputRows")) <= 2 * N
    want = {}
    for i in range(N):
        scores = sorted(((P.dice(f"keeqer of the bolt number {i}", f"keeper of the bolt number {k}"), k) for k in range(N)), reverse=True)
        if scores[0][0] >= J.FUZZY and scores[0][0] - scores[1][0] > J.MARGIN:
            want[i] = f"e{scores[0][1]:04d}"
    assert want and {r["mention_id"]: r["entity_id"] for r in df.collect()} == want


def test_two_ways_to_ask_for_one_spelling_are_ambiguous(spark):
    asked = J.queries(spark.createDataFrame([("c", 1, "Baroness Vaskowich", "character", ["baroness vaskowich!"]), ("c", 2, "Baroness Vaskowich", "character", [])], MENTIONS))
    _, names = asked_and_named(spark, [], ["baroness vaskovich"])
    assert [r["mention_id"] for r in J.fuzzy(asked, names).collect()] == [2]


def test_new_names_are_not_compared_with_all_before_them(monkeypatch):
    calls, dice = [], P.dice
    monkeypatch.setattr(J.P, "dice", lambda a, b: calls.append(1) or dice(a, b))
    names = J.Names([])
    for i in range(N):
        made = names.take({"name": "n" + hashlib.md5(str(i).encode()).hexdigest(), "aliases": [], "keys": [], "type": "character", "matches_id": ""})
        assert made["how"] == "new"
    assert len(calls) < N


def test_sketches_lose_no_spelling():
    draw = random.Random(7)
    words = ["".join(draw.choices("abc ", k=draw.randint(5, 14))).strip() or "x" for _ in range(300)]
    kept = {}
    for w in dict.fromkeys(words):
        kept.setdefault(len(w), J.Spellings()).add(w)
    for q in words[:60]:
        for length, spellings in kept.items():
            near = set(spellings.near(len(q) + 1, J.sketch(q)))
            assert near >= {t for t in spellings.texts if P.dice(q, t) >= J.NEARLY}


def test_mentions_send_a_text_once(spark, tmp_path):
    words = [f"word{i:04d}" for i in range(2000)]
    spark.createDataFrame([("c", 0, n, " ".join(words[n * 500 : n * 500 + 500])) for n in range(4)], "chat_id string, batch_id long, n int, text string").write.parquet(f"{tmp_path}/w")
    called = [*words[:50], "word0499 word0500", "word0001 word0002 word0003", "word0003 word0001", "word1999 word2000", "wo"]
    spark.createDataFrame([("c", f"e{i}", n) for i, n in enumerate(called)], "chat_id string, entity_id string, norm_name string").write.parquet(f"{tmp_path}/n")
    df = E.mentioned(spark.read.parquet(f"{tmp_path}/n"), spark.read.parquet(f"{tmp_path}/w"))
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert sum(counts(df, "dataSize")) < 100 * len(" ".join(words))
    assert {int(r["entity_id"][1:]) for r in df.collect()} == {*range(50), 50, 51}


def test_norm_of_plain_texts_skips_the_tables(spark):
    texts = ["It's  a `Test`-case, no. 5!\t\x1c", "  ", "", "Æther & Co", "naïve  café", "ﬁne", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.norm("t").alias("n")).collect()
    assert [r["n"] for r in rows] == [P.norm(t) for t in texts]


def test_answers_are_checked_only_as_far_as_asked(spark):
    fact = '{"text": "has a red door", "status": "confirmed", "evidence": "the red door", "messages": [1]}'
    raw = ['{"entities": [{"name": "Inn", "type": "location", "messages": [1], "facts": [%s]}], "fact_updates": [{"fact_id": "F1", "new_status": "done", "evidence": "the red door", "messages": [1]}]}' % fact, "no"]
    window = spark.createDataFrame([("c", k, 1, "s", False, "Here is the red door.") for k in range(2)], "chat_id string, batch_id long, n int, sig string, is_user boolean, text string")
    cuts = []
    checked = V.validate(spark.createDataFrame([("c", k, r) for k, r in enumerate(raw)], "chat_id string, batch_id long, raw string"), window, Settings(), cut=lambda df: cuts.append(df.columns) or df)
    assert [r["batch_id"] for r in checked.unusable.collect()] == [1] and len(cuts) == 1
    assert [r["name"] for r in checked.entities.collect()] == ["Inn"] and len(cuts) == 2
    assert [r["ref"] for r in checked.updates.collect()] == ["F1"] and len(cuts) == 3
    assert [r["text"] for r in checked.facts.collect()] == ["has a red door"] and len(cuts) == 4
    assert [(r["what"], r["why"]) for r in checked.dropped.collect()] == [("response", V.WHY["no_shape"])] and len(cuts) == 5


class Counted(str):
    hashed = 0

    def __hash__(self):
        Counted.hashed += 1
        return str.__hash__(self)


def test_a_fact_that_is_often_restated_keeps_its_sources_as_they_come():
    fold = K.Fold("who", Settings(), {})
    sigs = [Counted(f"s{i % 1500}") for i in range(2000)]
    for i, s in enumerate(sigs):
        fold.add({"text": "has a red door", "status": "confirmed", "slot": "", "sigs": [s], "by": "story", "changed": False, "at": i, "obs_id": i, "ord": 0})
    (row,) = fold.rows("c")
    assert row["sigs"] == [f"s{i}" for i in range(1500)] and Counted.hashed < 10 * len(sigs)
