"""The view over a few observations, without a store."""

from skein.functions.settings import Settings
from skein.operators import chain as C
from skein.operators import derive as D


def test_view(spark, tmp_path):
    rows = [("c", i, "user" if i % 2 == 0 else "assistant", None, f"message {i} of the story") for i in range(20)]
    chain = C.build_chain(spark.createDataFrame(rows, "chat_id string, idx int, role string, name string, text string"))
    sig = {r["pos"]: r["sig"] for r in chain.collect()}

    def obs(k, at, text, **o):
        fact = (text, "confirmed", "", False, "", "story", [sig.get(at, "gone")], None, None)
        base = {"chat_id": "c", "obs_id": k, "entity_id": "elena", "name": "Elena", "type": "character", "aliases": ["the healer"], "keys": ["herb shop"], "sigs": [sig.get(at, "gone")], "importance": 4.0, "confidence": 0.9, "reason": "", "static_id": None, "how": "new", "facts": [fact], "updates": []}
        return tuple((base | o).values())

    seen = spark.createDataFrame([obs(1, 1, "heals people"), obs(2, 15, "keeps bees"), obs(3, 99, "was never there"), obs(4, 2, "sells maps", entity_id="mira", name="Mira", importance=2.0)], D.OBSERVATIONS)
    number = iter(range(100))

    def cut(df):
        path = f"{tmp_path}/{next(number)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    view = D.derive(spark, seen, chain, Settings(), cut=cut)
    e = {r["entity_id"]: r for r in view.entities.collect()}
    assert (e["elena"]["state"], e["elena"]["reason"], e["elena"]["episodes"], e["elena"]["live_obs"]) == ("promoted", "2 scenes, importance 4.0", 2, 2)
    assert (e["elena"]["aliases"], e["elena"]["keys"]) == (["the healer"], ["herb shop"])
    assert (e["mira"]["state"], e["mira"]["reason"]) == ("candidate", "importance 2.0 < 3")
    assert sorted((r["entity_id"], r["text"], r["state"]) for r in view.facts.collect()) == [("elena", "heals people", "active"), ("elena", "keeps bees", "active"), ("mira", "sells maps", "active")]
    assert view.conflicts.count() == 0
