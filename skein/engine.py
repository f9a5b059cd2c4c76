"""The engine: a ledger of observations per chat, kept as tables in a folder, and what users do with it (A, J5, M9-M10, N, R).

Every step takes and gives tables of all chats at once, or of the chats named; what one action changes is committed by
one manifest, so that a lost job leaves the state before it in force.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.settings import Settings
from skein.operators import chain as C
from skein.operators import derive as D
from skein.operators import extract as E
from skein.operators import ledger as G
from skein.operators import reconcile as M
from skein.operators import report as P
from skein.operators import resolve as J
from skein.operators import validate as V
from skein.sources import books as B
from skein.sources.store import BUCKETS, Scope, Store, upserted

TABLES = {
    "messages": "chat_id string, idx int, role string, name string, text string",
    "observations": D.OBSERVATIONS,
    "scanned": "chat_id string, sig string",
    "entity_state": D.ENTITY_STATE,
    "decisions": D.DECISIONS,
    "written": M.WRITTEN,
    "rejected": "chat_id string, op_key string",
    "pending": f"op_key string, {M.OPS}",
    "change_log": M.LOG,
    "runs": "chat_id string, seq long, ok boolean, n int, added int, dropped int, error string",
    "book": M.BOOK,
    "books": "chat_id string, book string, bound string",
    "static_books": "chat_id string, book string",
    "statics": D.STATICS,
}
#: What a branch takes along; it gets a book of its own.
INHERITED = ("messages", "observations", "scanned", "entity_state", "decisions", "rejected", "change_log", "runs", "static_books", "statics")


class Engine:
    """All chats of a store."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None, extractor: E.Extractor | None = None, extractors: dict[str, E.Extractor] | None = None, buckets: int = BUCKETS):
        self.spark, self.settings = spark, settings or Settings(enabled=True)
        self.extractors = extractors or ({"default": extractor} if extractor else {})
        self.extractor = extractor or next(iter(self.extractors.values()), None)
        self.store = Store(spark, path, TABLES, buckets)
        self.cancelled = False
        self._view: tuple | None = None

    cut = property(lambda self: self.store.cut)

    @property
    def messages(self) -> DataFrame:
        return self.store.read("messages")

    @messages.setter
    def messages(self, rows: DataFrame) -> None:
        self.store.write("messages", rows)

    # ---- reading. Actions take chats as a table or a Scope; the steps below work on a Scope, or on all chats without one.
    def _scope(self, chats: DataFrame | Scope | str | None) -> Scope | None:
        if isinstance(chats, str):
            chats = self.spark.createDataFrame([(chats,)], "chat_id string")
        return chats if chats is None or isinstance(chats, Scope) else self.store.scope(chats)

    def read(self, name: str, scope: Scope | None = None) -> DataFrame:
        return self.store.of(name, scope)

    def chain(self, scope: Scope | None = None) -> DataFrame:
        return C.build_chain(self.read("messages", scope))

    def view(self, scope: Scope | None = None) -> D.View:
        """The view of the chats; the one made last is taken again while nothing that it is made of has changed."""
        key = (id(scope), [self.store.folders.get(n) for n in ("observations", "messages", "entity_state", "decisions", "statics")], self.settings)
        if self._view is None or self._view[0] != key:
            self._view = (key, self._derived(scope), scope)
        return self._view[1]

    def _derived(self, scope: Scope | None) -> D.View:
        tables = (self.read(n, scope) for n in ("entity_state", "decisions", "statics"))
        return D.derive(self.spark, self.read("observations", scope), self.chain(scope), self.settings, *tables, self.cut)

    def profiles(self) -> list[str]:
        return E.profiles(self.extractors)

    def choose(self, profile: str) -> None:
        self.extractor = self.extractors[profile]

    # ---- sources
    def load_statics(self, entries: DataFrame) -> None:
        """The static entries of each chat, from the books named in static_books and the settings."""
        own = self.store.read("books").select("chat_id", "book")
        self.store.write("statics", B.static_entries(entries, B.static_names(self.store.read("static_books"), own, self.settings), self.settings))

    def ensure_books(self, chats: DataFrame | Scope, existing: DataFrame | None = None) -> DataFrame:
        """Names and binds a book for each chat that has none; what was made, and which chats are bound elsewhere."""
        scope = self._scope(chats)
        have = self.read("books", scope)
        asked = scope.chats.join(have, "chat_id", "left").withColumn("label", F.col("chat_id"))
        made = self.cut(B.ensure_books(asked, self.store.read("books").select("book") if existing is None else existing, self.settings))
        self.store.replace("books", made, scope)
        return made

    def _assert_writable(self, scope: Scope) -> None:
        """Makes missing books, and refuses if any book of the chats is not ours to write (A10)."""
        have = self.read("books", scope)
        own = have if scope.chats.join(have, "chat_id", "left_anti").isEmpty() else self.ensure_books(scope)
        fixed = own.select("chat_id", F.explode(F.array(*map(F.lit, self.settings.static_books))).alias("book")) if self.settings.static_books else own.select("chat_id", "book").limit(0)
        static = self.read("static_books", scope).select("chat_id", "book").unionByName(fixed)
        if bad := B.writable(own.withColumn("target", F.col("book")), static, self.settings).where("not ok").first():
            raise PermissionError(f"{bad['book']} is not ours to write")

    # ---- extraction
    def scan(self, force: bool = False, chats: DataFrame | Scope | None = None, calls: int | None = None) -> int:
        """Reads what is due with the extractor, takes it in, and syncs; how many observations were added.

        calls bounds the batches of a chat; cancel() stops before the next step, and what was not taken in stays unread.
        """
        if self.extractor is None:
            raise ValueError("no extractor")
        self.cancelled, scope = False, self._scope(chats)
        window = self.cut(C.windows(self.read("messages", scope), self.read("scanned", scope), self.settings, force, calls))
        if window.isEmpty():
            return 0
        due = self._scope(window)
        view = self.view(due)
        raw = self.cut(E.call(E.requests(window, view, self.read("statics", due), self.settings), self.extractor))
        return 0 if self.cancelled else self.ingest(raw, window, view, due)

    def cancel(self) -> None:
        self.cancelled = True

    def ingest(self, extractions: DataFrame, window: DataFrame, view: D.View | None = None, scope: Scope | None = None) -> int:
        """Parse, validate, resolve, append, mark as read (J5). Batches whose answer is no JSON stay unread (Q9)."""
        read, window = self.cut(extractions.withColumn("ok", V.X.tolerant_json("raw").isNotNull())), self.cut(window.withColumnRenamed("batch", "batch_id"))
        scope = scope or self._scope(read)
        view = view or self.view(scope)
        good = read.where("ok").select("chat_id", "batch_id", "raw")
        checked = V.validate(good, window, self.settings, view.facts.select("chat_id", "fact_id"), self.cut)
        identity = self.cut(J.take_in(checked.entities, J.registry(view.entities, self.read("statics", scope))))
        at = ["chat_id", "batch_id", "ent"]
        named = checked.entities.drop("name", "aliases", "matches_id", "action").join(identity, at).join(G.told(checked), at, "left")
        new = named.unionByName(G.update_observations(checked.updates), allowMissingColumns=True)
        with self.store.change():
            self.store.replace("observations", G.appended(self.read("observations", scope), new), scope)
            self.store.replace("scanned", G.marked(self.read("scanned", scope), window, good), scope)
            self.store.replace("runs", G.newest_runs(self.read("runs", scope), G.run_rows(read, window, identity, checked.dropped)), scope)
        added = identity.count()
        self.sync(scope)
        return added

    # ---- syncing
    def _plan(self, scope: Scope | None) -> M.Plan:
        view = self.view(scope)
        return M.plan(view.entities, view.facts, *(self.read(n, scope) for n in ("book", "written", "entity_state")), self.settings)

    def sync(self, chats: DataFrame | Scope | None = None) -> None:
        """Derive, plan, and apply or queue for review (M10). Nothing to do writes nothing."""
        if not self.settings.enabled:
            return
        scope = self._scope(chats)
        ops = self.cut(self._plan(scope).ops)
        with self.store.change():
            if self.settings.apply_mode == "review":
                ops, waiting = M.review(ops, self.read("rejected", scope))
                self.store.replace("pending", waiting, scope)
                ops = self.cut(ops)
            self._apply(ops)

    def _apply(self, ops: DataFrame) -> None:
        if not ops.isEmpty():
            scope = self._scope(ops)
            self._keep(M.apply_ops(ops, *(self.read(n, scope) for n in ("book", "written", "entity_state", "change_log")), self.settings), scope)

    def _keep(self, done: M.Applied, scope: Scope) -> None:
        """Writes the books of the chats, if all of them are ours to write, and what belongs to them."""
        with self.store.change():
            self._assert_writable(scope)
            for name, df in (("book", done.book), ("written", done.written), ("entity_state", done.state), ("change_log", done.log)):
                self.store.replace(name, df, scope)

    # ---- what users decide
    def set_entities(self, rows: DataFrame, sync: bool = True) -> None:
        """rows (chat_id, entity_id, ...) over what users set before: status, lock, protected, keep, name, type, merge_into."""
        scope = self._scope(rows)
        self.store.replace("entity_state", upserted(self.read("entity_state", scope), ["chat_id", "entity_id"], rows), scope)
        if sync:
            self.sync(scope)

    def set_entity(self, chat_id: str, entity_id: str, sync: bool = True, **flags: Any) -> None:
        """For one entity."""
        kinds = ", ".join(f"{k} {'boolean' if k in ('lock', 'protected', 'keep') else 'string'}" for k in flags)
        self.set_entities(self.spark.createDataFrame([(chat_id, entity_id, *flags.values())], f"chat_id string, entity_id string, {kinds}"), sync)

    def merge(self, chat_id: str, entity_id: str, into: str) -> None:
        self.set_entity(chat_id, entity_id, merge_into=into)

    def decide(self, rows: DataFrame, sync: bool = True) -> None:
        """rows (chat_id, pair_key, decision): new, old or both for a conflict."""
        scope = self._scope(rows)
        self.store.replace("decisions", upserted(self.read("decisions", scope), ["chat_id", "pair_key"], rows), scope)
        if sync:
            self.sync(scope)

    def approve(self, picks: list[tuple[str, str]] | DataFrame, reject: bool = False) -> None:
        """Applies or rejects queued proposals (chat_id, op_key), planned afresh."""
        chosen = self.cut((picks if isinstance(picks, DataFrame) else self.spark.createDataFrame(picks, TABLES["rejected"])).select("chat_id", "op_key"))
        scope = self._scope(chosen)
        left = self.read("pending", scope).join(chosen, ["chat_id", "op_key"], "left_anti")
        with self.store.change():
            if reject:
                self.store.replace("rejected", self.read("rejected", scope).unionByName(chosen).distinct(), scope)
            else:
                self._apply(self.cut(M.approved(self._plan(scope).ops, chosen)))
            self.store.replace("pending", left, scope)

    def rollback(self, chat_id: str, seq: int) -> bool:
        """Undoes one row of the change log (M8)."""
        scope = self._scope(chat_id)
        row = self.cut(self.read("change_log", scope).where((F.col("seq") == seq) & F.col("kind").isin(P.UNDOABLE)))
        if row.isEmpty():
            return False
        self._keep(M.rollback(row, *(self.read(n, scope) for n in ("book", "written", "entity_state", "change_log")), self.settings), scope)
        return True

    # ---- upkeep
    def prune(self, keep_newest: int = 1500) -> int:
        """Forgets dormant observations beyond the newest ones; how many went (H5)."""
        old = self.store.read("observations")
        before = old.count()
        self.store.write("observations", G.prune_dormant(old, C.positions(self.chain()), keep_newest))
        return before - self.store.read("observations").count()

    def rescan(self, chats: DataFrame | str, read: bool = False) -> None:
        """Forgets what was read of the chats; users' decisions stay (N2). With read, everything is read anew at once."""
        scope = self._scope(chats)
        with self.store.change():
            for name in ("observations", "scanned", "pending"):
                self.store.replace(name, G.forgotten(self.read(name, scope), scope.chats), scope)
            self.store.replace("change_log", M.noted(self.read("change_log", scope), scope.chats, "rescan", F.lit("read anew")), scope)
        if read:
            self.scan(force=True, chats=scope)

    def branch(self, branches: DataFrame) -> None:
        """Copies of ledgers, (chat_id, new_id), without books."""
        scope = self._scope(branches.select("chat_id").union(branches.select("new_id")))
        copies = branches.select(F.col("new_id").alias("chat_id"), F.col("chat_id").alias("origin"))
        with self.store.change():
            for name in INHERITED:
                rows = G.branched(self.read(name, scope), branches)
                self.store.replace(name, M.noted(rows, copies, "branch", F.concat(F.lit("copied from "), "origin")) if name == "change_log" else rows, scope)

    def export_json(self, path: str) -> None:
        """Every table as JSON rows, and the settings."""
        for name in TABLES:
            self.store.read(name).write.mode("overwrite").json(f"{path}/{name}")
        self.spark.createDataFrame([(json.dumps(self.settings, default=vars),)], "settings string").write.mode("overwrite").text(f"{path}/settings")

    def import_json(self, path: str) -> None:
        """An export's tables, but for the books and what is written, which stay this store's own."""
        with self.store.change():
            for name, ddl in TABLES.items():
                if name not in ("book", "books", "written", "messages"):
                    self.store.write(name, self.spark.read.schema(ddl).json(f"{path}/{name}"))

    def report(self) -> dict[str, DataFrame]:
        """The dashboard's tables (P, R2)."""
        view, read = self.view(), self.store.read
        return {
            "entities": P.entities(view), "pending": read("pending"), "conflicts": view.conflicts, "history": P.history(read("change_log")),
            "tools": P.estimate(C.unscanned(C.settled(self.chain(), 0), read("scanned")), self.settings), "meta": P.meta(read("observations"), C.positions(self.chain()), read("scanned")),
        }


#: What a user may do, by the name of the command or button.
COMMANDS: dict[str, Callable[..., Any]] = {
    "scan": Engine.scan, "dashboard": Engine.report, "set": Engine.set_entities, "merge": Engine.merge, "decide": Engine.decide, "approve": Engine.approve, "rollback": Engine.rollback,
    "rederive": Engine.sync, "prune": Engine.prune, "rescan": Engine.rescan, "branch": Engine.branch, "export": Engine.export_json, "import": Engine.import_json, "cancel": Engine.cancel,
}
