"""Names in order against brute force, and against the joins over a registry that does not grow."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import plain as P
from skein.operators import derive as D
from skein.operators import extract as E
from skein.operators import resolve as J

NAMES = ["Elena", "Elenna", "Elena Marr", "Lord Marr", "the fox girl Elena", "Grey Tower", "Grey Towers", "East Parada", "Parada", "Marrow", "Elena's brother", "Tomas Grey", "the guard", "Baron Vaskovich", "Baron Vaskowich", "Vaskovich"]
KINDS = ["character", "location", "other", "item"]


def by_rule(known, query, kind):
    """Every entity against a name, rule after rule, with no index."""
    fits = [(k, n) for k, (t, ns) in known.items() for n in ns if P.compatible(kind, t)]
    q = P.norm(query)
    found = list(dict.fromkeys(k for k, n in fits if n == q))
    if not found:
        found = list(dict.fromkeys(k for k, n in fits if J.absorbs(q, n, known[k][0])))
    if found:
        return found[0] if len(found) == 1 else None
    scores = sorted(((P.dice(q, n), k) for k, n in fits if len(q) >= 5), reverse=True)
    if scores and scores[0][0] >= J.FUZZY and (len(scores) < 2 or scores[0][0] - scores[1][0] > J.MARGIN):
        return scores[0][1]
    return None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(NAMES), st.sampled_from(KINDS)), max_size=8), st.sampled_from(NAMES), st.sampled_from(KINDS))
def test_names_find_what_the_rules_find(entries, query, kind):
    known, names = {}, J.Names([])
    for i, (name, t) in enumerate(entries):
        known[f"e{i}"] = (t, [P.norm(name)])
        names.learn(f"e{i}", J.Known(t, True, name), [P.norm(name)])
    got = names.find([P.norm(query)], kind)
    assert (got and got[0]) == by_rule(known, query, kind)


def test_joins_find_what_the_rules_find(spark):
    none = F.array().cast("array<string>")
    entities = spark.createDataFrame([("c", f"e{i}", KINDS[i % 3], n) for i, n in enumerate(NAMES)], "chat_id string, entity_id string, type string, name string")
    names = J.registry(entities.select("*", none.alias("aliases"), none.alias("keys"), F.lit(None).cast("string").alias("static_id")), spark.createDataFrame([], D.STATICS))
    asked = [*NAMES, "Elenaa", "Miss Elena", "grey   tower", "Baron Vaskovitch", "nobody at all", "Tower of Grey"]
    mentions = spark.createDataFrame([("c", i, n, "character") for i, n in enumerate(asked)], "chat_id string, mention_id long, name string, type string").withColumn("aliases", none)
    known = {f"e{i}": (KINDS[i % 3], [P.norm(n)]) for i, n in enumerate(NAMES)}
    got = {r["mention_id"]: r["entity_id"] for r in J.resolve(mentions, names).collect()}
    assert got == {i: by_rule(known, n, "character") for i, n in enumerate(asked)}


def test_answers_that_can_be_used():
    good = ['{"entities": []}', 'Sure: ```json\n{"entities": [1,],}\n```', "[1, 2]"]
    assert all(map(E.usable, good)) and not any(map(E.usable, [None, "", "no", "{", '{"a": 1}', '{"entities": 3}']))
