"""Books as sources and sinks (A6-A10): protected entries are read, only an owned book is written."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.settings import Settings

#: Seconds for which the entries of a book are taken from memory.
FRESH = 60.0


def book_name(chat_id: str, settings: Settings, label: str = "label") -> Column:
    """The managed book of a chat: prefix, readable part, hash."""
    readable = F.substring(F.regexp_replace(F.col(label), "[^A-Za-z0-9_-]", "_"), 1, 40)
    return F.concat(F.lit(settings.book_prefix), readable, F.lit("_"), F.substring(F.md5(F.col(chat_id)), 1, 5))


def ensure_books(chats: DataFrame, books: DataFrame, settings: Settings) -> DataFrame:
    """(chat_id, book, created, bound, warn) for chats (chat_id, label, book, bound) and books (book) that exist.

    A chat without a book gets its own name; created says that the book must be made, warn that the chat is bound to
    another one, which is left as it is.
    """
    named = chats.withColumn("book", F.when(F.coalesce("book", F.lit("")) != "", F.col("book")).otherwise(book_name("chat_id", settings)))
    met = named.join(books.select("book", F.lit(True).alias("_there")).distinct(), "book", "left")
    unbound = F.coalesce("bound", F.lit("")) == ""
    return met.select("chat_id", "book", F.col("_there").isNull().alias("created"), F.when(unbound, F.col("book")).otherwise(F.col("bound")).alias("bound"), (~unbound & (F.col("bound") != F.col("book"))).alias("warn"))


def static_names(books: DataFrame, own: DataFrame, settings: Settings) -> DataFrame:
    """(chat_id, book): the configured and detected books of each chat but for its own and all managed ones (H4)."""
    configured = [F.lit(b) for b in settings.static_books]
    fixed = own.select("chat_id", F.explode(F.array(*configured) if configured else F.array().cast("array<string>")).alias("book"))
    every = books.select("chat_id", "book").unionByName(fixed).where(~F.col("book").startswith(settings.book_prefix)).distinct()
    return every.join(own.select("chat_id", "book"), ["chat_id", "book"], "left_anti")


def static_entries(entries: DataFrame, books: DataFrame, settings: Settings) -> DataFrame:
    """(chat_id, static_id, name, keys, type, content): usable entries of the named books, never of managed ones.

    entries: (book, uid, comment, content, key, disable); books: (chat_id, book).
    """
    named = books.where(~F.col("book").startswith(settings.book_prefix)).distinct()
    keys = F.filter(F.coalesce("key", F.array().cast("array<string>")), lambda k: F.coalesce(k, F.lit("")) != "")
    name = F.trim(F.coalesce(F.when(F.col("comment") != "", F.col("comment")), F.get("keys", F.lit(0)), F.lit("")))
    rows = entries.withColumn("keys", keys).withColumn("name", name)
    usable = rows.where(~F.coalesce("disable", F.lit(False)) & (F.coalesce("content", F.lit("")) != "") & ((F.col("name") != "") | (F.size("keys") > 0)))
    own = usable.join(named, "book")
    return own.select("chat_id", F.concat(F.lit("static:"), "book", F.lit(":"), "uid").alias("static_id"), "name", "keys", F.lit("other").alias("type"), "content")


class StaticCache:
    """The entries of books, read again when they are older than FRESH seconds."""

    def __init__(self, read: Callable[[], DataFrame], clock: Callable[[], float] = time.monotonic):
        self.read, self.clock = read, clock
        self.held: tuple[float, DataFrame] | None = None

    def get(self) -> DataFrame:
        now = self.clock()
        if self.held is None or now - self.held[0] > FRESH:
            self.held = (now, self.read())
        return self.held[1]


def writable(owned: DataFrame, static: DataFrame, settings: Settings) -> DataFrame:
    """(chat_id, book, ok) for owned (chat_id, book, target): whether target is the owned, prefixed book and no static one (A10)."""
    fixed = static.select("chat_id", F.col("book").alias("target"), F.lit(True).alias("_static")).distinct()
    ok = F.col("target").eqNullSafe(F.col("book")) & F.coalesce("target", F.lit("")).startswith(settings.book_prefix) & F.col("_static").isNull()
    return owned.join(fixed, ["chat_id", "target"], "left").select("chat_id", "book", ok.alias("ok"))


def assert_writable(book: str, owned: str, static: set[str], settings: Settings) -> None:
    """Only the owned, prefixed book that is no static one may be written (A10)."""
    if book != owned or not book.startswith(settings.book_prefix) or book in static:
        raise PermissionError(f"{book} is not ours to write")
