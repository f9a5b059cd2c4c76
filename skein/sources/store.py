"""Versioned tables under one path, dealt into buckets of chats.

A table is a set of buckets, each a folder of Parquet files; a change writes new folders for the buckets it touches and
leaves the others as they are. One manifest names the folders of all tables. It is written last, under the next number,
and creating that file is the commit: before it nothing of a change is seen, after it all of it is, and of two writers
one fails. Nothing that is being read is overwritten; clean() removes what no recent manifest names.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16


def shared_path(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a local session (tests) may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/skein-{uuid.uuid4().hex}"


def bucket_of(chat: str = "chat_id", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(chat), F.lit(buckets)).cast("int")


def migrated(df: DataFrame, ddl: str) -> DataFrame:
    """df with exactly the members of ddl, in order: those that it lacks are null, others go (A4)."""
    names = [c.name for c in df.schema.fields]
    schema = df.sparkSession.createDataFrame([], ddl).schema
    return df.select(*[(F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


@dataclass
class Scope:
    """Some chats, and the buckets that hold them."""

    chats: DataFrame
    buckets: list[int]


class Store:
    """Tables by name; those without a manifest entry are empty (A3)."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str], buckets: int = BUCKETS):
        self.spark, self.path, self.tables, self.buckets = spark, path.rstrip("/"), tables, buckets
        self.number, self.folders = 0, {}
        self._open: dict[str, dict[str, str]] | None = None
        if found := self._listed("manifests"):
            self.number = int(found[-1])
            self.folders = json.loads(self._text(f"manifests/{found[-1]}"))
            self.buckets = self.folders.pop("", {"buckets": buckets})["buckets"]

    # ---- files, by the file system that Spark finds for the path
    def _at(self, name: str):
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _listed(self, name: str) -> list[str]:
        system, place = self._at(name)
        return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []

    def _text(self, name: str) -> str:
        system, place = self._at(name)
        stream = system.open(place)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _commit(self, folders: dict[str, dict[str, str]]) -> None:
        system, place = self._at(f"manifests/{self.number + 1:012d}")
        stream = system.create(place, False)  # fails if another writer has committed
        try:
            stream.write(bytearray(json.dumps({**folders, "": {"buckets": self.buckets}}).encode()))
        finally:
            stream.close()
        self.number, self.folders = self.number + 1, folders

    # ---- tables
    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some buckets of it."""
        own = self.folders.get(name, {})
        paths = [f"{self.path}/{p}" for b, p in own.items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.tables[name])
        return self.spark.read.schema(self.tables[name]).parquet(*paths)

    @contextmanager
    def change(self) -> Iterator[None]:
        """All writes within are seen together, or not at all."""
        if self._open is not None:
            yield
            return
        self._open = dict(self.folders)
        try:
            yield
            if self._open != self.folders:
                self._commit(self._open)
        finally:
            self._open = None

    def write(self, name: str, df: DataFrame, buckets: list[int] | None = None) -> None:
        """The table's new rows, or those of some buckets (A5)."""
        with self.change():
            folder = f"{name}/{uuid.uuid4().hex}"
            rows = migrated(df, self.tables[name]).withColumn("bucket", bucket_of(buckets=self.buckets))
            rows.write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            made = {x.split("=")[1]: f"{folder}/{x}" for x in self._listed(folder) if x.startswith("bucket=")}
            kept = {} if buckets is None else {b: p for b, p in self._open.get(name, {}).items() if int(b) not in buckets}
            self._open[name] = kept | made

    def scope(self, chats: DataFrame) -> Scope:
        """The chats (chat_id) of a table; the numbers of their buckets are all that reaches the driver."""
        own = self.cut(chats.select("chat_id").distinct())
        return Scope(own, sorted(r[0] for r in own.select(bucket_of(buckets=self.buckets)).distinct().collect()))

    def of(self, name: str, scope: Scope | None) -> DataFrame:
        """The table's rows of some chats, read from their buckets alone; all rows without a scope."""
        if scope is None:
            return self.read(name)
        return self.read(name, scope.buckets).join(scope.chats, "chat_id", "left_semi")

    def replace(self, name: str, rows: DataFrame, scope: Scope | None = None) -> None:
        """rows instead of all rows of the chats, of all chats without a scope; only their buckets are written."""
        if scope is None:
            return self.write(name, rows)
        others = self.read(name, scope.buckets).join(scope.chats, "chat_id", "left_anti")
        self.write(name, migrated(others, self.tables[name]).unionByName(migrated(rows, self.tables[name])), scope.buckets)

    def cut(self, df: DataFrame) -> DataFrame:
        """df written beside the tables and read back: short plans, and lost executors cost no more than a step."""
        path = f"{self.path}/steps/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clean(self, keep: int = 2) -> int:
        """Removes steps and folders that none of the newest manifests names, and older manifests; how many went."""
        found = self._listed("manifests")
        named = {p.rsplit("/", 1)[0] for number in found[-keep:] for own in json.loads(self._text(f"manifests/{number}")).values() for p in map(str, own.values())}
        gone = [f"manifests/{n}" for n in found[:-keep]] + [f"{t}/{f}" for t in self.tables for f in self._listed(t) if f"{t}/{f}" not in named] + [f"steps/{f}" for f in self._listed("steps")]
        for name in gone:
            system, place = self._at(name)
            system.delete(place, True)
        return len(gone)


def upserted(old: DataFrame, keys: list[str], rows: DataFrame) -> DataFrame:
    """rows instead of those with the same keys; members that rows lack are kept where a row was there before."""
    new = [c for c in rows.columns if c not in keys]
    joined = old.join(rows.select(*keys, *[F.col(c).alias(f"_{c}") for c in new], F.lit(True).alias("_hit")), keys, "full")
    hit = F.coalesce("_hit", F.lit(False))
    return joined.select(*[F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in old.columns])
