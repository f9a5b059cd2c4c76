"""SimHash near-duplicates, found exactly with distributed vantage-point trees.

Fingerprints of 64 bits link when they differ in at most `radius` bits. Distinct fingerprints alone are searched, so
exact copies cost nothing. The search has three parts:

1. Forest. The bits are dealt into blocks. With radii r_b such that sum(r_b + 1) > radius, two linked fingerprints are
   within r_b of each other on at least one block b (pigeonhole), so one vantage-point tree for each block, searched
   with that block's smaller radius, misses no link. A tree is fitted on a bounded sample (SAMPLE, drawn by hash), but
   every fingerprint is routed through it: a node holds a vantage point p and a median distance m; fingerprints with
   d(p, x) <= m go left, the others right. A leaf that gets many rows is given a tree of its own, fitted by a task on a
   sample of that leaf, and so on for DEPTH levels: leaves stay small at any size, and the driver's sample does not grow.
2. Shards. A leaf is a shard. A fingerprint is stored in the leaf that holds it, and asks all other leaves that its ball
   overlaps: by the triangle inequality the left branch can be skipped if d(p, x) > m + r and the right one if
   d(p, x) <= m - r. Of two leaves only the earlier one asks, so each pair is compared in one place for each tree.
3. Pairs. Within a shard, rows are sorted by distance to a local vantage point, and only rings within `radius` are
   compared (triangle bound again, now with all 64 bits), exactly, by XOR and bit count. A shard of many rows is cut
   into cells of at most `cell` x `cell` rows, so neither a large group of near copies nor a badly filled leaf goes to
   one task. A cell returns a spanning forest of its links, never its pairs.

Components of the links come from alternating stars over written tables.

Defined cases: null text counts as empty; a text without words has fingerprint zero and links like any other; rows that
repeat a doc_id are documents of their own with the same id, also where they are in several components; a null doc_id is
never the least of its component (the id is null if all are); the longest texts are hashed whole, in pieces; an empty
table gives no rows; near_duplicates() ignores extra columns, whatever their names, and keep_one() keeps them. keep_one()
keeps one row of each component: that with the least id, of these with the least fingerprint and text hash, and any one
of rows that are alike in id and text.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import LOWER_BYTES, few, join_unique, only, packed, shared_dir, slices, stored, table, texts_of
from skein.llm.components import stars

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Bits of each block, from the highest, and the radius searched in it: (1 + 1) + (1 + 1) + (0 + 1) > 4.
BLOCKS = ((22, 1), (22, 1), (20, 0))
#: Fingerprints that a tree is fitted on, rows of a leaf that are aimed at, rows of a cell's side.
SAMPLE, LEAF_ROWS, CELL = 16_384, 2_048, 2_048
#: Levels of trees below the first, leaves of a tree at most (its sample), rows that are routed together.
DEPTH, LEAVES, ROUTED = 3, 1 << 16, 1 << 16


def fingerprint(text: str | None, width: int = SHINGLE) -> bytes:
    """8 bytes, highest bit first: a bit is 1 if it is set in over half the hashes of the shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    n = max(1, len(words) - width + 1) if words else 0
    if not n:
        return bytes(8)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    ends = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    digest, total = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for k in range(0, n, 65_536):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + 65_536], ends[k : k + 65_536])])
        total += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > n).tobytes()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            prints = b"".join(map(fingerprint, texts_of(part)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("row"), pa.array(np.frombuffer(prints, ">i8").astype(np.int64))], ["doc_id", "row", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row, fp): a hash of the text, which tells rows with the same id apart, and the fingerprint as a signed 64-bit integer."""
    return only(docs, "doc_id", "text").withColumn("row", F.xxhash64("text")).mapInArrow(_fingerprints, "doc_id long, row long, fp long")


@dataclass
class Tree:
    """A vantage-point tree over the bits of a mask. Nodes are dealt in order; a leaf has left = -1 and a number."""

    mask: int
    radius: int
    vantage: np.ndarray
    median: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, mask: int, radius: int, leaf_rows: int, seed: int = 7) -> Tree:
        rng, nodes = np.random.default_rng(seed), []
        bits = sample & np.uint64(mask)

        def grow(own: np.ndarray) -> int:
            at = len(nodes)
            nodes.append([0, 0, -1, -1, -1])
            if len(own) <= leaf_rows:
                return at
            best = None
            for p in rng.choice(own, 12):
                d = np.bitwise_count(own ^ p)
                counts = np.bincount(d, minlength=65)
                below = np.cumsum(counts)
                for m in {int(np.median(d)), max(0, int(np.median(d)) - 1)}:
                    low = below[m] / len(own)
                    if 0 < low < 1:
                        near = counts[max(0, m - radius + 1) : m + radius + 1].sum() / len(own) if radius else 0
                        cost = near + 2 * abs(low - 0.5)
                        if best is None or cost < best[0]:
                            best = (cost, p, m, d <= m)
            if best is None:  # all alike
                return at
            _, p, m, low = best
            nodes[at][:2] = int(p), m
            nodes[at][2] = grow(own[low])
            nodes[at][3] = grow(own[~low])
            return at

        grow(bits)
        leaves = 0
        for node in nodes:
            if node[2] < 0:
                node[4] = leaves
                leaves += 1
        v, m, a, b, leaf = map(list, zip(*nodes))
        return cls(mask, radius, np.array(v, np.uint64), np.array(m, np.int64), np.array(a), np.array(b), np.array(leaf))

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(home leaf of each row; (row, leaf) of every other leaf that the ball of a row overlaps)."""
        home, rows, leaves = np.zeros(len(fps), np.int64), [], []
        bits = fps & np.uint64(self.mask)
        stack = [(0, np.arange(len(fps)), np.ones(len(fps), bool))]
        while stack:
            at, own, inside = stack.pop()
            if not len(own):
                continue
            if self.left[at] < 0:
                home[own[inside]] = self.leaf[at]
                rows.append(own[~inside])
                leaves.append(np.full(int((~inside).sum()), self.leaf[at]))
                continue
            d, m = np.bitwise_count(bits[own] ^ self.vantage[at]).astype(np.int64), self.median[at]
            left, right = d <= m + self.radius, d > m - self.radius
            stack.append((self.left[at], own[left], inside[left] & (d[left] <= m)))
            stack.append((self.right[at], own[right], inside[right] & (d[right] > m)))
        return home, np.array([np.concatenate(rows or [[]]), np.concatenate(leaves or [[]])], np.int64)


def masks(blocks=BLOCKS) -> list[tuple[int, int]]:
    out, high = [], 64
    for width, radius in blocks:
        out.append((((1 << width) - 1) << (high - width), radius))
        high -= width
    return out


def fit_forest(distinct: DataFrame, rows: int, radius: int = RADIUS, blocks=BLOCKS) -> list[Tree]:
    """Trees on at most SAMPLE fingerprints, those first in hash order: bounded, and the same at every run.

    The hash's own range is cut first, so that all tasks together send hardly more than the sample to the driver.
    """
    if sum(r + 1 for _, r in blocks) <= radius:
        raise ValueError("the blocks' radii would miss links")
    share = min(1.0, 1.1 * SAMPLE / max(1, rows))
    order = F.xxhash64(F.lit(1), "fp")
    low = distinct.where(order <= F.lit(int(-(2**63) + share * (2**64 - 1025))))
    drawn = [r[0] for r in low.orderBy(order, "fp").limit(SAMPLE).select("fp").collect()]
    own = np.array(drawn, np.int64).view(np.uint64)
    least = max(1, math.floor(LEAF_ROWS * len(own) / max(1, rows)))
    return [Tree.fit(own, mask, r, least) for mask, r in masks(blocks)]


def shards(distinct: DataFrame, forest: list[Tree]) -> DataFrame:
    """(tree, leaf, home, fp): where each fingerprint is stored, and the later leaves that it asks."""
    shared = distinct.sparkSession.sparkContext.broadcast(forest)  # nodes over a bounded sample

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for k, tree in enumerate(shared.value):
                home, (row, leaf) = tree.route(fps)
                row, leaf = (x[leaf > home[row]] for x in (row, leaf))
                n, own = len(fps) + len(row), np.concatenate((fps, fps[row])).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(np.concatenate((home, leaf))), pa.array(np.arange(n) < len(fps)), pa.array(own)], ["tree", "leaf", "home", "fp"])

    return distinct.select("fp").mapInArrow(route, "tree int, leaf long, home boolean, fp long")


def refined(routed: DataFrame, folder: str, blocks=BLOCKS) -> DataFrame:
    """routed with leaves of more than 4 LEAF_ROWS stored rows dealt on, each by a tree that is fitted on a sample of it."""
    kinds, at = masks(blocks), ["tree", "leaf"]

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        mask, radius = kinds[key[0]]
        own = np.sort(pdf["fp"].to_numpy().view(np.uint64))[: LEAVES]
        tree = Tree.fit(own, mask, radius, max(1, math.floor(LEAF_ROWS * len(own) / int(pdf["n"].iloc[0]))))
        grown = [(key[0], key[1], int(pdf["every"].iloc[0]) // ROUTED + 1, pickle.dumps(tree))] if tree.leaf.max() > 0 else []
        return pd.DataFrame(grown, columns=["tree", "leaf", "parts", "grown"])

    def deal(rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"tree": pd.Series(dtype="int32"), "leaf": pd.Series(dtype="int64"), "home": pd.Series(dtype="bool"), "fp": pd.Series(dtype="int64")})
        tree: Tree = pickle.loads(trees["grown"].iloc[0])  # written by fit() above
        fps, stored_here, below = rows["fp"].to_numpy().view(np.uint64), rows["home"].to_numpy(), (int(rows["leaf"].iloc[0]) + 1) * LEAVES
        home, (row, leaf) = tree.route(fps)
        # A guest asks every leaf that its ball overlaps, a stored row those after its own.
        later = leaf > np.where(stored_here, home, -1)[row]
        guests, row, asks = np.flatnonzero(~stored_here), row[later], leaf[later]
        own = np.concatenate((np.flatnonzero(stored_here), guests, row))
        leaves = np.concatenate((home[stored_here], home[guests], asks)) + below
        return pd.DataFrame({"tree": int(rows["tree"].iloc[0]), "leaf": leaves, "home": np.arange(len(own)) < stored_here.sum(), "fp": fps[own].view(np.int64)})

    for level in range(DEPTH):
        size = routed.groupBy(*at).agg(F.sum(F.col("home").cast("long")).alias("n"), F.count("*").alias("every")).where(F.col("n") > 4 * LEAF_ROWS)
        size = stored(size, f"{folder}/large{level}")
        if size.isEmpty():
            break
        drawn = routed.where("home").join(few(size), at).where(F.pmod(F.xxhash64(F.lit(level + 4), "fp"), F.col("n")) < SAMPLE)  # about SAMPLE a leaf
        trees = stored(drawn.groupBy(*at).applyInPandas(fit, "tree int, leaf long, parts long, grown binary"), f"{folder}/trees{level}")
        names = few(trees.select(*at, "parts"))
        rows = routed.join(names, at).withColumn("part", F.pmod(F.xxhash64(F.lit(3), "fp"), "parts")).drop("parts")
        spread = trees.select(*at, "grown", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        dealt = rows.groupBy(*at, "part").cogroup(spread.groupBy(*at, "part")).applyInPandas(deal, "tree int, leaf long, home boolean, fp long")
        routed = stored(routed.join(names, at, "left_anti").unionByName(dealt), f"{folder}/shards{level}")
    return routed


def _join_roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the sets of a[i] and b[i]; afterwards each row points at the least of its set."""
    while len(a):
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
    while not np.array_equal(up := parent[parent], parent):
        parent[:] = up


def linked(stored_here: np.ndarray, asking: np.ndarray, within: bool, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (row, least row of its set) of the links between the two sides, and within the first side."""
    if not len(stored_here):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    pivot = stored_here[0]
    here = stored_here[np.argsort(np.bitwise_count(stored_here ^ pivot), kind="stable")]
    ring = np.bitwise_count(here ^ pivot).astype(np.int64)
    every = np.concatenate((here, asking))
    parent = np.arange(len(every))
    there = np.concatenate((ring, np.bitwise_count(asking ^ pivot).astype(np.int64)))
    first = 0 if within else len(here)
    order = first + np.argsort(there[first:], kind="stable")
    step = max(1, (1 << 19) // len(here))
    for k in range(0, len(order), step):
        rows = order[k : k + step]
        low, high = np.searchsorted(ring, (there[rows[0]] - radius, there[rows[-1]] + radius + 1))
        i, j = np.nonzero(np.bitwise_count(every[rows, None] ^ here[None, low:high]) <= radius)
        _join_roots(parent, rows[i], low + j)
    moved = np.flatnonzero(parent != np.arange(len(every)))
    return every[moved], every[parent[moved]]


def _cell(pdf: pd.DataFrame) -> pd.DataFrame:
    own, home = pdf["fp"].to_numpy().view(np.uint64), pdf["home"].to_numpy()
    u, v = linked(own[home], own[~home], bool(pdf["within"].iloc[0]))
    return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})


def links(distinct: DataFrame, folder: str, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that connect exactly what is linked by fingerprints within the radius."""
    if radius != RADIUS:
        raise ValueError("BLOCKS are made for this radius")
    spark = distinct.sparkSession
    forest = fit_forest(distinct, distinct.count(), radius)
    routed = refined(stored(shards(distinct, forest), f"{folder}/shards"), folder)
    # A leaf's rows are dealt into equal parts by hash: its stored rows into a, its asking rows into b parts.
    size = routed.groupBy("tree", "leaf").agg(F.sum(F.col("home").cast("long")).alias("h"), F.count("*").alias("n"))
    size = size.select("tree", "leaf", F.greatest(F.lit(1), F.ceil(F.col("h") / CELL)).alias("a"), F.ceil((F.col("n") - F.col("h")) / CELL).alias("b"))
    dealt = routed.join(few(stored(size, f"{folder}/sizes")), ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64(F.lit(2), "fp"), F.when(F.col("home"), F.col("a")).otherwise(F.col("b"))))
    # Cells (i, j): stored part i against stored part j >= i, or against asking part j - a.
    home_cells = F.transform(F.sequence(F.col("part"), F.col("a") + F.col("b") - 1), lambda j: F.struct(F.col("part").alias("i"), j.alias("j"), F.lit(True).alias("home")))
    as_guest = F.when(F.col("part") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("part") - 1), lambda i: F.struct(i.alias("i"), F.col("part").alias("j"), F.lit(False).alias("home")))).otherwise(F.array().cast("array<struct<i:bigint,j:bigint,home:boolean>>"))
    asking = F.transform(F.sequence(F.lit(0).cast("long"), F.col("a") - 1), lambda i: F.struct(i.alias("i"), (F.col("a") + F.col("part")).alias("j"), F.lit(False).alias("home")))
    cells = dealt.select("tree", "leaf", "fp", F.explode(F.when(F.col("home"), F.concat(home_cells, as_guest)).otherwise(asking)).alias("c"))
    cells = cells.select("tree", "leaf", "fp", "c.i", "c.j", "c.home", (F.col("c.i") == F.col("c.j")).alias("within"))
    return cells.groupBy("tree", "leaf", "i", "j").applyInPandas(_cell, "u long, v long")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, row, fp) of every row, (fp, component_id, root, n) of every fingerprint, n rows with it), both written."""
    folder = shared_dir(docs.sparkSession)
    prints = stored(fingerprints(docs), f"{folder}/fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), f"{folder}/distinct")
    roots = stars(links(distinct, folder), f"{folder}/stars").select(F.col("u").alias("fp"), F.col("v").alias("root"))
    member = distinct.join(roots, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    member = stored(member, f"{folder}/members")
    of_root = stored(member.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("fps")), f"{folder}/roots")
    return prints, stored(join_unique(member, of_root, ["root"], "fps").select("fp", "component_id", "root", "n"), f"{folder}/classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs."""
    prints, classes = _classes(docs)
    return join_unique(prints, classes, ["fp"], "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, columns unchanged."""
    prints, classes = _classes(docs)
    first = join_unique(prints, classes, ["fp"], "n").where("doc_id <=> component_id").groupBy("root").agg(F.min(F.struct("doc_id", "fp", "row")).alias("first"))
    kept = first.select(F.coalesce("first.doc_id", F.lit(0)).alias("id"), F.col("first.doc_id").isNull().alias("none"), F.col("first.row").alias("row"))
    key = ["id", "none", "row"]
    kept = stored(kept, shared_dir(docs.sparkSession))
    # Copies in every part collapse to one row of each id and text before they are sent.
    rows = packed(docs, F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNull().alias("none"), F.xxhash64("text").alias("row"))
    return rows.dropDuplicates(key).join(kept, key, "left_semi").select("doc.*")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
