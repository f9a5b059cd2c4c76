"""The ordered fold of facts (K1-K7): per entity, in order of chain position.

Near-duplicate merging depends on order, so facts of an entity are folded one by one; entities are independent of each
other and spread over the cluster. Updates name facts by id and are routed to the entity that holds the id, decisions to
the entities that hold both facts of their pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import plain as P
from skein.functions.settings import Settings

FACT = (
    "fact_id string, text string, status string, slot string, val string, by string, evidence string, rel_kind string, other string, changed boolean, "
    "sigs array<string>, at int, obs_id long, ord int, state string, disputed boolean, sup_by string"
)
OUT = f"chat_id string, entity_id string, kind string, {FACT}, key string, old_id string, new_id string, old_text string, new_text string"
ARROW = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
OUT_SCHEMA = pa.schema([(name, ARROW[kind]) for name, kind in (x.split(" ") for x in OUT.split(", "))])
FACT_NAMES = [x.split(" ")[0] for x in FACT.split(", ")]
POLICY = {"latest": "new", "both": "both", "ask": "ask"}
OPEN = ("rumor", "claim", "unresolved")
KEY = ["chat_id", "entity_id"]
#: Rows of a result batch.
BATCH = 4_096


class Fold:
    """The facts of one entity so far. Words, ids and slots lead to the facts that have them, so no step goes through all."""

    def __init__(self, entity: str, settings: Settings, decisions: dict[str, str]):
        self.entity, self.settings, self.decisions = entity, settings, decisions
        self.facts: list[dict[str, Any]] = []
        self.words: list[list[str]] = []
        self.sets: list[frozenset[str]] = []
        self.having: dict[str, dict[int, None]] = {}
        self.with_id: dict[str, list[int]] = {}
        self.in_slot: dict[str, list[int]] = {}
        self.conflicts: list[dict[str, Any]] = []

    def add(self, row: dict[str, Any]) -> None:
        new = {**row, "fact_id": P.fact_id(self.entity, row["text"]), "val": P.norm(row["text"]), "state": "active", "disputed": False, "sup_by": None}
        own = P.content(new["text"])
        shared = self._shared(own)
        if self._restates(new, own, shared):
            return
        if new["status"] == "confirmed":
            self._settle(new, own, shared)
            if new["slot"] and (at := self._rival(new)) is not None and self._decide(at, new, own):
                return
        self.facts.append(new)
        self.words.append([])
        self.sets.append(frozenset())
        at = len(self.facts) - 1
        self._word(at, own)
        self.with_id.setdefault(new["fact_id"], []).append(at)
        self._place(at)

    def _word(self, at: int, own: list[str]) -> None:
        for w in self.sets[at]:
            del self.having[w][at]
        self.words[at], self.sets[at] = own, frozenset(own)
        for w in self.sets[at]:
            self.having.setdefault(w, {})[at] = None

    def _place(self, at: int) -> None:
        """Keeps the facts that may be a slot's value in order."""
        fact = self.facts[at]
        if fact["slot"] and fact["status"] == "confirmed":
            own = self.in_slot.setdefault(fact["slot"], [])
            if at not in own:
                own.append(at)
                own.sort()

    def _shared(self, own: list[str]) -> dict[int, int]:
        """How many different words of own each fact has, of facts that have any."""
        out: dict[int, int] = {}
        for w in set(own):
            for k in self.having.get(w, ()):
                out[k] = out.get(k, 0) + 1
        return out

    def _similar(self, at: int, own: list[str], shared: int, threshold: float = 0.75) -> bool:
        mine, theirs = len(set(own)), len(self.sets[at])
        return shared / (mine + theirs - shared) >= threshold or (min(len(own), len(self.words[at])) >= 3 and shared / min(mine, theirs) >= 0.95)

    def _restates(self, new: dict[str, Any], own: list[str], shared: dict[int, int]) -> bool:
        """A fact of the same status that says the same takes over the sources, and the longer wording if active."""
        for k in sorted({*shared, *self.with_id.get(new["fact_id"], ())}):
            old = self.facts[k]
            if old["state"] in ("false", "abandoned") or old["status"] != new["status"]:
                continue
            if old["fact_id"] == new["fact_id"] or (k in shared and self._similar(k, own, shared[k])):
                self._source(old, new)
                if old["state"] == "active" and len(new["text"]) > len(old["text"]):
                    old["text"] = new["text"]
                    self._word(k, own)
                return True
        return False

    def _source(self, old: dict[str, Any], new: dict[str, Any]) -> None:
        """old takes over the sources of new. They are held as the keys of a dict from then on: a fact may be restated by every message."""
        if not isinstance(old["sigs"], dict):
            old["sigs"] = dict.fromkeys(old["sigs"])
        old["sigs"].update(dict.fromkeys(new["sigs"]))

    def _settle(self, new: dict[str, Any], own: list[str], shared: dict[int, int]) -> None:
        for k, n in shared.items():
            old = self.facts[k]
            if old["state"] == "active" and old["status"] in OPEN and self._similar(k, own, n, 0.6):
                old["state"], old["sup_by"] = "superseded", new["fact_id"]

    def _rival(self, new: dict[str, Any]) -> int | None:
        own = [k for k in self.in_slot.get(new["slot"], ()) if self.facts[k]["state"] == "active"]
        if own:
            self.in_slot[new["slot"]] = own  # others return only by an update, which places them again
        return next((k for k in own if self.facts[k]["val"] != new["val"]), None)

    def _decide(self, at: int, new: dict[str, Any], own: list[str]) -> bool:
        """What becomes of two values of one slot; true if the new one went into the old one."""
        old, before = self.facts[at], self.words[at]
        merges = old["slot"] != "status" and not new["slot"].startswith("rel:")
        if merges and before and own and P.containment(before, own) >= 0.99:
            if len(own) >= len(before):
                old["text"], old["val"] = new["text"], new["val"]
                self._word(at, own)
            self._source(old, new)
            return True
        key = P.pair_key(old["fact_id"], new["fact_id"])
        verdict = self.decisions.get(key) or self._verdict(old, new)
        if verdict == "new":
            old["state"], old["sup_by"] = "superseded", new["fact_id"]
        elif verdict == "old":
            new["state"] = "rejected"
        elif verdict == "both":
            old["disputed"] = new["disputed"] = True
        elif verdict == "ask":
            new["state"] = "conflict"
            self.conflicts.append({"key": key, "slot": new["slot"], "old_id": old["fact_id"], "new_id": new["fact_id"], "old_text": old["text"], "new_text": new["text"]})
        return False

    def _verdict(self, old: dict[str, Any], new: dict[str, Any]) -> str:
        if new["changed"]:
            return "new"
        if self.settings.player_authoritative and (old["by"] == "player") != (new["by"] == "player"):
            return "new" if new["by"] == "player" else "old"
        return POLICY.get(self.settings.conflict_policy, "both")

    def update(self, ref: str, to: str) -> None:
        at = self.with_id.get(ref, [None])[-1]
        if at is None:
            return
        fact = self.facts[at]
        if to == "confirmed" and fact["status"] in OPEN:
            fact["status"], fact["state"] = "confirmed", "active"
            self._place(at)
        elif to == "false" or (to in ("done", "abandoned") and fact["status"] == "plan"):
            fact["state"] = to

    def take(self, row: dict[str, Any]) -> None:
        """A row of kind fact, update or decision; decisions come first."""
        if row["kind"] == "fact":
            self.add({k: row.get(k) for k in FACT_NAMES})
        elif row["kind"] == "update":
            self.update(row["ref"], row["to"])
        else:
            self.decisions[row["ref"]] = row["to"]

    def rows(self, chat: str) -> Iterator[dict[str, Any]]:
        """Facts and conflicts as rows of OUT."""
        key = {"chat_id": chat, "entity_id": self.entity}
        for k, fact in enumerate(self.facts):
            yield {**key, "kind": "fact", **fact, "sigs": list(fact["sigs"]), "ord": k}
        for conflict in self.conflicts:
            yield {**key, "kind": "conflict", **conflict}


def fold_facts(rows: DataFrame, settings: Settings) -> DataFrame:
    """Folds (chat_id, entity_id, kind, at, obs_id, ord, fact columns, ref, to) by entity; Fold.rows has the result.

    One shuffle into as many parts as the session sets (not fewer where the rows are few: folding costs time, not bytes),
    sorted within; a task then walks from row to row and holds the facts of one entity at a time.
    """
    names = [*KEY, "kind", *FACT_NAMES, "ref", "to"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*names).repartition(parts, *KEY).sortWithinPartitions(*KEY, "at", "obs_id", "ord", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fold, out = None, None, []
        for batch in batches:
            for values in zip(*[batch.column(n).to_pylist() for n in names]):
                if values[:2] != at:
                    if fold is not None:
                        out += fold.rows(at[0])
                    at, fold = values[:2], Fold(values[1], settings, {})
                    while len(out) >= BATCH:
                        yield pa.RecordBatch.from_pylist(out[:BATCH], schema=OUT_SCHEMA)
                        del out[:BATCH]
                fold.take(dict(zip(names, values)))
        if fold is not None:
            out += fold.rows(at[0])
        for k in range(0, len(out), BATCH):
            yield pa.RecordBatch.from_pylist(out[k : k + BATCH], schema=OUT_SCHEMA)

    return dealt.mapInArrow(run, OUT)


def route_updates(facts: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates (chat_id, ref, to, at, obs_id, ord) with the entity whose facts include the id they name."""
    return updates.join(facts.select("chat_id", "entity_id", F.col("fact_id").alias("ref")).distinct(), ["chat_id", "ref"])


def route_decisions(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (chat_id, pair_key, decision) with the entities that have facts in a slot, the only ones with pairs."""
    entities = facts.where("slot <> ''").select("chat_id", "entity_id").distinct()
    return decisions.join(entities, "chat_id").select("chat_id", "entity_id", F.col("pair_key").alias("ref"), F.col("decision").alias("to"))


def fold_input(facts: DataFrame, updates: DataFrame, decisions: DataFrame) -> DataFrame:
    """One table for the fold."""
    first = [F.lit("decision").alias("kind"), F.lit(-1).alias("at"), F.lit(-1).cast("long").alias("obs_id"), F.lit(-1).alias("ord")]
    parts = [facts.withColumn("kind", F.lit("fact")), route_updates(facts, updates).withColumn("kind", F.lit("update")), route_decisions(facts, decisions).select("*", *first)]
    rows = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    missing = [x for x in FACT.split(", ") if x.split(" ")[0] not in rows.columns]
    return rows.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in (x.split(" ") for x in missing)])
