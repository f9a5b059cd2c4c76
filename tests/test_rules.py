"""The rules in Python and on columns agree; the fold's policies; the validators' edge cases."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from skein.functions import plain as P
from skein.functions import text as X
from skein.functions.settings import Settings, TypeRule, merge_settings
from skein.operators.fold import Fold
from skein.sources.books import assert_writable

TEXTS = ["", None, "Elena the Herbalist", "Éléna's  “garden”", "plans to rob the bank", "{{char}} <b>x</b>", "ﬁne ½", "/zed.*/", "12-34", "the", "x" * 60]


def test_columns_and_python_agree(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    rows = df.select("t", X.norm("t").alias("n"), X.slug("t").alias("s"), X.sanitize_key("t").alias("k"), X.core_tokens("t").alias("c"), X.dice("t", F.lit("Elena herbalist")).alias("d")).collect()
    for r in rows:
        assert (r["n"], r["s"], r["k"]) == (P.norm(r["t"]), P.slug(r["t"] or ""), P.sanitize_key(r["t"]))
        assert r["c"] == P.core(r["t"] or "") and r["d"] == pytest.approx(P.dice(P.norm(r["t"]), "elena herbalist"))


def test_one_norm_for_every_character(spark):
    """Between letters, every character that this Python and the JVM both know the kind of; and the ids made of them."""
    codes = [c for c in range(0x20, 0x30000) if not 0xD800 <= c <= 0xDFFF and not 0xE000 <= c <= 0xF8FF]
    df = spark.createDataFrame([(chr(c),) for c in codes], "c string").withColumn("t", F.concat(F.lit("x"), "c", F.lit("y ")))
    letter = F.col("c").rlike(r"^[\p{L}\p{N}]$")
    rows = df.select("c", X.norm("t").alias("n"), X.fact_id(F.lit("e"), "t").alias("f"), letter.alias("known")).collect()
    both = lambda r: unicodedata.category(r["c"]) != "Cn" and r["known"] == (unicodedata.category(r["c"])[0] in "LN")
    odd = [r["c"] for r in rows if r["n"] != P.norm(f"x{r['c']}y ") and both(r)]
    assert odd == []
    assert all(r["f"] == P.fact_id("e", f"x{r['c']}y ") for r in rows if r["n"] == P.norm(f"x{r['c']}y "))
    assert spark.createDataFrame([("owns ½ of the ﬁne mill 가 Ł",)], "t string").select(X.norm("t")).first()[0] == P.norm("owns ½ of the ﬁne mill 가 Ł")


def test_hash53(spark):
    def rule(text):
        data = text.encode("utf-16-le", "surrogatepass")
        a, b, mask = 0xDEADBEEF, 0x41C6CE57, (1 << 32) - 1
        for k in range(0, len(data), 2):
            unit = int.from_bytes(data[k : k + 2], "little")
            a, b = (a ^ unit) * 2654435761 & mask, (b ^ unit) * 1597334677 & mask
        a = ((a ^ a >> 16) * 2246822507 ^ (b ^ b >> 13) * 3266489909) & mask
        b = ((b ^ b >> 16) * 2246822507 ^ (a ^ a >> 13) * 3266489909) & mask
        return (b & 2097151) * 4294967296 + a

    texts = ["", "a", "hello", "Ünï 𝄞 中文", "x" * 500]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.hash53("t")).collect()]
    assert [int(g, 36) for g in got] == [rule(t) for t in texts]


def test_tolerant_json(spark):
    raw = ['```json\n{"entities": [1]}\n```', 'Sure! {"entities": [1, 2,],} ok', "[1]", "no json", "", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "raw string").select(F.to_json(X.tolerant_json("raw"))).collect()]
    assert got == ['{"entities":[1]}', '{"entities":[1,2]}', "[1]", None, None, None]


def row(text, **o):
    return {"text": text, "status": "confirmed", "slot": "", "by": "story", "changed": False, "sigs": [text], "at": 0, "obs_id": 0, "ord": 0} | o


def outcome(policy, *rows, **settings):
    fold = Fold("e", Settings(conflict_policy=policy, **settings), {})
    for r in rows:
        fold.add(r)
    return [(f["text"], f["state"], f["disputed"]) for f in fold.facts], len(fold.conflicts)


A, B = row("lives in the northern harbour", slot="residence"), row("dwells at Kestrel Keep", slot="residence")


@pytest.mark.parametrize("policy, states, conflicts", [("both", ("active", "active"), 0), ("latest", ("superseded", "active"), 0), ("ask", ("active", "conflict"), 1), ("?", ("active", "active"), 0)])
def test_conflict_policies(policy, states, conflicts):
    facts, n = outcome(policy, A, B)
    assert tuple(f[1] for f in facts) == states and n == conflicts


def test_change_player_and_decision():
    assert [f[1] for f in outcome("ask", A, B | {"changed": True})[0]] == ["superseded", "active"]
    assert [f[1] for f in outcome("ask", A, B | {"by": "player"})[0]] == ["superseded", "active"]
    assert [f[1] for f in outcome("ask", A | {"by": "player"}, B)[0]] == ["active", "rejected"]
    fold = Fold("e", Settings(), {P.pair_key(P.fact_id("e", A["text"]), P.fact_id("e", B["text"])): "old"})
    fold.add(A)
    fold.add(B)
    assert [f["state"] for f in fold.facts] == ["active", "rejected"]


def test_flip_back_is_lost_and_refinement_merges():
    facts, _ = outcome("latest", A, B | {"changed": True}, A | {"changed": True})
    assert [f[1] for f in facts] == ["superseded", "active"]
    facts, _ = outcome("both", row("herbalist", slot="occupation"), row("herbalist shop owner", slot="occupation"))
    assert facts == [("herbalist shop owner", "active", False)]


def test_rumor_is_settled_and_updates_apply():
    fold = Fold("e", Settings(), {})
    fold.add(row("owns the old mill", status="rumor"))
    fold.add(row("owns the old mill today"))
    assert [f["state"] for f in fold.facts] == ["superseded", "active"]
    fold.add(row("will sail west", status="plan"))
    ids = [f["fact_id"] for f in fold.facts]
    fold.update(ids[2], "done")
    fold.update(ids[1], "false")
    fold.update("F?", "false")
    assert [f["state"] for f in fold.facts] == ["superseded", "false", "done"]


def test_settings_merge_and_guard():
    s = merge_settings({"max_keys": 3, "unknown": 1, "type_rules": {"other": {"on": True}, "ship": {"min_importance": 7}}})
    assert s.max_keys == 3 and s.rule("other") == TypeRule(True, 3, 5) and s.rule("ship") == TypeRule(True, 2, 7) and s.rule("?") == s.rule("other")
    assert_writable("Skein_a", "Skein_a", set(), s)
    for book, owned, static in (("a", "a", set()), ("Skein_a", "Skein_b", set()), ("Skein_a", "Skein_a", {"Skein_a"})):
        with pytest.raises(PermissionError):
            assert_writable(book, owned, static, s)
