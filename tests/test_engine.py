"""Scenarios over the engine: many chats go through every step at once."""

import json

import pytest
from pyspark.sql import functions as F

from skein.engine import Engine
from skein.functions.settings import Settings
from skein.operators import chain as C

PLAYER, STORY = True, False


def filler(n, tag):
    return [(k % 2 == 0, f"{tag} turn {k}: the road goes on and nothing of note occurs.") for k in range(n)]


def ent(name, kind, **o):
    base = {"name": name, "type": kind, "action": "create", "importance": 5, "confidence": 0.9, "reason": "test", "messages": [1], "aliases": [], "keys": [], "matches_id": "", "facts": [], "relationships": []}
    return base | o


def fact(text, evidence, **o):
    return {"text": text, "status": "confirmed", "slot": "", "evidence": evidence, "messages": [1], "changes_previous": False} | o


def said(*entities, updates=()):
    return json.dumps({"entities": list(entities), "fact_updates": list(updates)})


def frame(spark, chats):
    rows = [(c, i, "user" if u else "assistant", None, t) for c, ms in chats.items() for i, (u, t) in enumerate(ms)]
    return spark.createDataFrame(rows, "chat_id string, idx int, role string, name string, text string")


def step(engine, spark, given):
    """given: chat -> (first, last, raw); the window is the chain's messages [first, last)."""
    bounds = spark.createDataFrame([(c, a, b) for c, (a, b, _) in given.items()], "chat_id string, a int, b int")
    window = engine.chain().join(bounds, "chat_id").where("pos >= a and pos < b").withColumn("n", F.col("pos") - F.col("a") + 1)
    window = window.withColumn("batch", F.lit(0).cast("long")).withColumn("is_context", F.lit(False)).drop("a", "b")
    raw = spark.createDataFrame([(c, 0, r) for c, (_, _, r) in given.items()], "chat_id string, batch_id long, raw string")
    return engine.ingest(raw, engine.cut(window))


def cards(engine):
    out = {}
    for r in engine.store.read("book").collect():
        out.setdefault(r["chat_id"], []).append(r)
    return out


def states(engine):
    return {(r["chat_id"], r["entity_id"]): r for r in engine.view().entities.collect()}


TWO = [(PLAYER, "I walk into the herb shop."), (STORY, "Elena, a healer of the old quarter, greets you with dried mint.")]
BACK = [(PLAYER, "I return to the shop."), (STORY, "Elena shows you her new garden behind the shop.")]


@pytest.fixture(scope="module", autouse=True)
def small(spark):
    """Tiny tables: one partition, and no plans that are made anew."""
    own = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    chats = {
        "one-off": [(PLAYER, "I order soup."), (STORY, "Tomas the waiter brings soup."), *filler(10, "a")],
        "recurring": [*TWO, *filler(14, "b"), *BACK],
        "lie": [(PLAYER, "I listen."), (STORY, 'Baron Vask claims he is king of the isles. The Baron Vask wears a red cloak.')],
        "agency": [(PLAYER, "I meet Mira."), (STORY, "Dragon feels love for Mira. Mira sells maps. Mira knows Dragon.")],
        "alias": [(PLAYER, "Elena waves."), (STORY, "Elena the herbalist smiles and the fox girl Elena laughs. Elenna nods.")],
        "apart": [(PLAYER, "We ride."), (STORY, "We pass Parada, then East Parada, where Elena's brother Rian waits for Elena.")],
        "static": [(PLAYER, "I visit the tower."), (STORY, "The Grey Tower is an ancient tower of stone by the sea. The Grey Tower now holds a dragon egg.")],
        "evidence": [(PLAYER, "Hello."), (STORY, "Korin forges blades in the harbour.")],
        "hostile": [(PLAYER, "Hello."), (STORY, "Zed the scribe keeps old records.")],
        "no-json": [(PLAYER, "Hello."), (STORY, "Nothing to see.")],
        "plan": [(PLAYER, "I wait."), (STORY, "Orla plans to rob the bank at dusk."), (PLAYER, "Then?"), (STORY, "Orla robs the bank.")],
    }
    engine = Engine(spark, f"file://{tmp_path_factory.mktemp('ledger')}", Settings(enabled=True), buckets=1)
    engine.messages = frame(spark, chats)
    engine.store.write("statics", spark.createDataFrame([("static", "static:world:1", "Grey Tower", ["grey tower", "the tower of ash"], "location", "The Grey Tower is an ancient tower of stone by the sea.")], "chat_id string, static_id string, name string, keys array<string>, type string, content string"))
    healer = fact("is a healer of the old quarter", "a healer of the old quarter", messages=[2])
    strong = {"importance": 9, "messages": [2]}
    added = step(engine, spark, {
        "one-off": (0, 2, said(ent("Tomas", "character", importance=2, messages=[2], facts=[fact("brings soup to guests", "brings soup", messages=[2])]))),
        "recurring": (0, 2, said(ent("Elena", "character", importance=4, messages=[2], facts=[healer]))),
        "lie": (0, 2, said(ent("Baron Vask", "character", **strong, facts=[fact("claims he is king of the isles", "claims he is king of the isles", messages=[2]), fact("wears a red cloak", "wears a red cloak", messages=[2])]))),
        "agency": (0, 2, said(ent("Dragon", "character", **strong), ent("Mira", "character", **strong, facts=[fact("Dragon loves Mira", "feels love for Mira", messages=[2]), fact("sells maps", "Mira sells maps", messages=[2])], relationships=[
            {"other": "Dragon", "kind": "romantic_interest", "text": "in love", "explicit": False, "evidence": "love for Mira", "messages": [2]}, {"other": "Dragon", "kind": "knows", "text": "knows", "evidence": "Mira knows Dragon", "messages": [2]}]))),
        "alias": (0, 2, said(ent("Elena", "character"), ent("Elena the herbalist", "character"), ent("the fox girl Elena", "character"), ent("Elenna", "character"))),
        "apart": (0, 2, said(ent("Parada", "location"), ent("East Parada", "location"), ent("Elena", "character"), ent("Elena's brother Rian", "character"))),
        "static": (0, 2, said(ent("Grey Tower", "location", **strong, facts=[fact("is an ancient tower of stone by the sea", "an ancient tower of stone", messages=[2]), fact("holds a dragon egg", "now holds a dragon egg", messages=[2])]))),
        "evidence": (0, 2, said(ent("Korin", "character", **strong, facts=[fact("forges blades in the harbour", "forges blades in the harbour", messages=[2]), fact("once killed a giant", "slew the giant of Morrow", messages=[2])]))),
        "hostile": (0, 2, said(ent("Zed {{user}} <b>the</b> scribe", "wizard", importance="11", confidence="0.9", messages=[2, 99, "1.7", "x"], keys=["/zed.*/", "{{char}}", "the", "Zed", "a"], facts=[fact("keeps old records", "keeps old records", messages=[2])]), "no object", None)),
        "no-json": (0, 2, "I am sorry, I cannot do that."),
        "plan": (0, 2, said(ent("Orla", "character", **strong, facts=[fact("plans to rob the bank", "plans to rob the bank", messages=[2])]))),
    })
    return engine, chats, added


def test_first_step(world, spark):
    engine, _, added = world
    e, book = states(engine), cards(engine)
    assert added == 16
    assert e["one-off", "tomas"]["state"] == "candidate" and "one-off" not in book
    assert e["recurring", "elena"]["state"] == "candidate" and "recurring" not in book
    lie = book["lie"][0]["content"].split("\n")
    assert lie == ["Baron Vask (character): wears a red cloak.", "Claims (may be false): claims he is king of the isles."]
    assert book["agency"][0]["content"] == "Mira (character): sells maps. Relations: Dragon: knows."
    assert [k for k in e if k[0] == "alias"] == [("alias", "elena")] and len([k for k in e if k[0] == "apart"]) == 4
    tower = book["static"][0]
    assert tower["content"] == "Grey Tower (location): holds a dragon egg." and "the tower of ash" in tower["key"]
    assert book["evidence"][0]["content"] == "Korin (character): forges blades in the harbour."
    zed = e["hostile", "zed-user-the-scribe"]
    assert (zed["name"], zed["type"], zed["imp_max"], zed["keys"]) == ("Zed { {user} } the scribe", "other", 10.0, ["Zed"]) or zed["keys"] == ["zed.*", "Zed"]
    runs = {r["chat_id"]: r for r in engine.store.read("runs").collect()}
    assert not runs["no-json"]["ok"] and runs["agency"]["dropped"] == 3 and runs["evidence"]["dropped"] == 1
    assert engine.store.read("scanned").where("chat_id = 'no-json'").count() == 0
    plan = book["plan"][0]["content"]
    assert plan == "Orla (character).\nPlans (not yet done): plans to rob the bank." or e["plan", "orla"]["state"] == "promoted"


def test_later_steps(world, spark):
    engine, chats, _ = world
    plan = engine.view().facts.where("chat_id = 'plan'").first()["fact_id"]
    step(engine, spark, {
        "recurring": (16, 18, said(ent("Elena", "character", importance=4, messages=[2], facts=[fact("has a new garden behind the shop", "her new garden behind the shop", messages=[2])]))),
        "plan": (2, 4, said(ent("Orla", "character", action="update", messages=[2]), updates=[{"fact_id": plan, "new_status": "done", "evidence": "Orla robs the bank", "messages": [2]}, {"fact_id": "F0", "new_status": "done", "evidence": "Orla robs the bank", "messages": [2]}])),
    })
    book = cards(engine)
    assert book["recurring"][0]["content"] == "Elena (character): is a healer of the old quarter. has a new garden behind the shop."
    assert engine.view().facts.where("chat_id = 'plan'").first()["state"] == "done"
    # A replaced message takes its facts along; its return brings them back.
    engine.messages = frame(spark, chats | {"recurring": [*TWO, *filler(14, "b"), BACK[0], (STORY, "Elena is out.")]})
    engine.sync()
    assert "recurring" not in cards(engine)
    # A card that was changed by hand is left alone and locked.
    engine.messages = frame(spark, chats)
    own = F.col("chat_id") == "lie"
    engine.store.write("book", engine.store.read("book").withColumn("content", F.when(own, "By hand.").otherwise(F.col("content"))))
    engine.sync()
    assert len(cards(engine)["recurring"]) == 1
    assert cards(engine)["lie"][0]["content"] == "By hand." and engine.store.read("entity_state").where(own).first()["lock"]
    # Undoing a removal restores the card and keeps it.
    removed = engine.store.read("change_log").where("chat_id = 'recurring' and kind = 'remove'").first()["seq"]
    engine.set_entity("recurring", "elena", status="reject")
    assert "recurring" not in cards(engine)
    assert engine.rollback("recurring", removed)
    assert len(cards(engine)["recurring"]) == 1
    report = engine.report()
    assert report["meta"].where("chat_id = 'recurring'").first()["live"] == 2 and report["history"].where("chat_id = 'recurring'").count() >= 3


def test_review_and_branch(world, spark):
    engine, chats, _ = world
    engine.settings = Settings(enabled=True, apply_mode="review")
    engine.set_entity("one-off", "tomas", status="promote")
    pending = {r["entity_id"]: r["op_key"] for r in engine.store.read("pending").collect()}
    assert "tomas" in pending and "one-off" not in cards(engine)
    engine.approve([("one-off", pending["tomas"])])
    assert cards(engine)["one-off"][0]["content"] == "Tomas (character): brings soup to guests."
    engine.branch(spark.createDataFrame([("one-off", "branch")], "chat_id string, new_id string"))
    assert engine.store.read("observations").where("chat_id = 'branch'").count() == 1 and "branch" not in cards(engine)
    engine.rescan("one-off")
    assert engine.store.read("observations").where("chat_id = 'one-off'").count() == 0
    assert engine.store.read("entity_state").where("chat_id = 'one-off'").count() == 1
    assert C.build_chain(engine.messages).where("chat_id = 'lie'").count() == 2
    # What no message bears any more is forgotten; a book that is no longer ours is not written.
    engine.messages = engine.messages.where("chat_id <> 'evidence'")
    assert engine.prune(0) == 1
    engine.store.write("static_books", engine.store.read("books").where("chat_id = 'lie'").select("chat_id", "book"))
    with pytest.raises(PermissionError):
        engine.rollback("lie", engine.store.read("change_log").where("chat_id = 'lie' and kind = 'create'").first()["seq"])
    # A new engine finds what was committed; cleaning leaves it whole.
    before = engine.store.read("observations").count()
    assert engine.store.clean(keep=1) > 10
    again = Engine(spark, engine.store.path, Settings(enabled=True))
    assert again.store.number == engine.store.number and again.store.read("observations").count() == before and again.store.read("book").count() == engine.store.read("book").count()
    engine.store.write("messages", engine.messages)
    with pytest.raises(Exception, match="exist"):
        again.store.write("messages", again.messages)
