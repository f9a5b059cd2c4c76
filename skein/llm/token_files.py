"""Token ids in compact shard files: Re-Pair grammar compression with random access.

Documents are range-partitioned by doc_id and every partition writes files of blocks, each block as soon as it is full,
so that a task holds one block at a time. A block is a shard with a grammar of its own: frequent pairs of neighbouring
ids are replaced by nonterminals, again and again, each round on what the round before has left, until no pair occurs
LEAST times. A round counts all pairs exactly by sorting them (occurrences that overlap in a run of one symbol count
once), ranks them by count and replaces every occurrence that has a better rank than its neighbours', so overlaps
resolve the same way everywhere. No pair crosses the end of a document, so each document is a run of symbols of its own.

File: blocks one after the other. Block, little-endian: 8 unsigned 64-bit integers (documents, rules, symbols, bytes of
a symbol, first nonterminal, ids, CRC-32 of the rest, bytes of the rest); doc_id (int64 each) and a mask of null ids
(uint8); the symbol at which each document begins and the end (uint64); rules as left, right and expansion length
(uint32 each, by column); symbols (of 2, 3 or 4 bytes, as their number needs). Rule k is nonterminal first + k and
refers to lower symbols only, so expansion lengths give the place of any id without decoding what is before it.

Encoding is the tokenizers library's. It is given each whole text where a text has any character BEYOND the Latin blocks; of other
texts, all words of a chunk are found at once, and the library's model is given each word it has not had before in this worker,
many in a call, as its words are independent of each other and of the rest of a text (whole=True gives the library every whole
text, with the same files).

Defined cases: null text counts as empty (just the end id); a repeated doc_id has an entry for each row, ordered by
length, hash and text; null ids come first; the longest text is one entry of one block; an empty table makes no files;
extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import codecs
import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from skein.llm import files
from skein.llm.bpe import SPACE, Encoder, byte_symbols, chunks, default_path
from skein.llm.common import only, shared_dir, stored, table

END = 1
#: Ids of a block at least (a document is never cut), bytes of a file at least before the next one is begun.
BLOCK_IDS, FILE_BYTES = 1 << 20, 256 << 20
#: Least count of a pair that is replaced, and new rules a round at most; rounds go on while there is such a pair.
LEAST, ROUND_RULES = 12, 6_000
#: Texts without these characters are split into words here; all others go to the library whole.
BEYOND = re.compile("[^\x00-\u024f]")
HEAD = struct.Struct("<8Q")


def repair(ids: np.ndarray, last: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair over ids, where last marks the end of each document and nonterminals begin at first.

    Returns the symbols, their end marks, the rules (n x 2) and the expansion length of each rule. No pair is left that
    occurs LEAST times.
    """
    ids, last = ids.astype(np.uint32), last.copy()
    rules, lengths = np.zeros((0, 2), np.uint32), np.zeros(0, np.uint32)
    # A pair and its place are one number, so that one sort counts pairs and tells where they are.
    most = len(ids) // LEAST + 1  # a rule takes away LEAST symbols at least
    width, place = np.uint64((first + most).bit_length()), np.uint64(len(ids).bit_length())
    low = lambda bits: (np.uint64(1) << bits) - np.uint64(1)
    if len(ids) and max(int(ids.max()) >> int(width), 2 * int(width) + int(place) - 64) > 0:
        raise ValueError("a block has too many ids or symbols")
    # Counts never grow: places whose pair was rare are not looked at again until a new symbol stands there.
    live = np.ones(len(ids), bool)
    while len(ids) > 1:
        live &= ~last
        live[-1] = False
        counted = live.copy()
        same = np.flatnonzero(ids[1:] == ids[:-1])
        same = same[~last[same]]
        if len(same):  # in a run of one symbol every other pair counts: the others overlap these
            begin = np.maximum.accumulate(np.where(np.diff(same, prepend=-2) != 1, same, 0))
            counted[same[(same - begin) % 2 == 1]] = False
        at = np.flatnonzero(counted)
        if len(at) < LEAST:
            break
        keyed = (ids[at].astype(np.uint64) << width | ids[at + 1]) << place | at.astype(np.uint64)
        keyed.sort()
        pair, places = keyed >> place, (keyed & low(place)).view(np.int64)
        begins = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        counts = np.diff(begins, append=len(pair))
        best = np.flatnonzero(counts >= LEAST)
        if not len(best):
            break
        live[places[np.repeat(counts < LEAST, counts)]] = False
        best = best[np.argsort(-counts[best], kind="stable")][:ROUND_RULES]
        rank_of = np.full(len(counts), ROUND_RULES, np.int32)
        rank_of[best] = np.arange(len(best), dtype=np.int32)
        own = np.repeat(rank_of, counts)
        ranked = np.flatnonzero(own < ROUND_RULES)
        places, own = places[ranked], own[ranked]
        rank = np.full(len(ids) + 1, ROUND_RULES, np.int32)  # one more at either end: the last is before the first
        rank[places] = own
        won = np.flatnonzero((own < rank[places - 1]) & (own < rank[places + 1]))
        taken, own = places[won], own[won]
        # A pair that keeps fewer than LEAST places waits; the best one keeps all of its own.
        worth = np.bincount(own, minlength=len(best)) >= LEAST
        taken, own = taken[worth[own]], own[worth[own]]
        made = pair[begins[best[worth]]]
        added = np.stack([(made >> width).astype(np.uint32), (made & low(width)).astype(np.uint32)], axis=1)
        size = np.concatenate((np.ones(first, np.uint32), lengths))
        ids[taken] = (first + len(rules) + np.cumsum(worth) - 1)[own].astype(np.uint32)
        rules, lengths = np.concatenate((rules, added)), np.concatenate((lengths, size[added[:, 0]] + size[added[:, 1]]))
        last[taken] = last[taken + 1]
        live[taken] = True
        live[taken[taken > 0] - 1] = True
        kept = np.ones(len(ids), bool)
        kept[taken + 1] = False
        kept = np.flatnonzero(kept)
        ids, last, live = ids[kept], last[kept], live[kept]
    return ids, last, rules, lengths


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids that the symbols stand for: the rules in use are expanded once, level by level, and then copied."""
    symbols = symbols.astype(np.uint32)
    deep = symbols >= first
    own = symbols[deep] - np.uint32(first)
    used = np.zeros(len(rules), bool)
    used[own] = True
    out = np.flatnonzero(used).astype(np.uint32) + np.uint32(first)
    rule = np.arange(len(out))
    while (more := out >= first).any():
        at = np.cumsum(1 + more) - 1 - more
        grown = np.empty(len(out) + int(more.sum()), np.uint32)
        grown[at[~more]] = out[~more]
        grown[at[more]], grown[at[more] + 1] = rules[out[more] - first].T
        out, rule = grown, np.repeat(rule, 1 + more)
    length = np.bincount(rule, minlength=int(used.sum()))
    number = (np.cumsum(used) - 1)[own]
    size, source = np.ones(len(symbols), np.int64), len(out) + np.arange(len(symbols))
    size[deep], source[deep] = length[number], (np.cumsum(length) - length)[number]
    shift = np.repeat(source - (np.cumsum(size) - size), size)
    return np.concatenate((out, symbols))[shift + np.arange(len(shift))]


def pack(doc_ids: list, ids: list[np.ndarray], first: int) -> bytes:
    """A block of the documents' ids (end ids included)."""
    flat = np.concatenate(ids)
    last = np.zeros(len(flat), bool)
    last[np.cumsum([len(x) for x in ids]) - 1] = True
    symbols, marks, rules, lengths = repair(flat, last, first)
    begins = np.concatenate(([0], np.flatnonzero(marks) + 1)).astype("<u8")
    wide = next(w for w in (2, 3, 4) if first + len(rules) <= 1 << 8 * w)
    body = b"".join(
        [
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            begins.tobytes(),
            rules[:, 0].astype("<u4").tobytes(),
            rules[:, 1].astype("<u4").tobytes(),
            lengths.astype("<u4").tobytes(),
            np.ascontiguousarray(symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :wide]).tobytes(),
        ]
    )
    return HEAD.pack(len(doc_ids), len(rules), len(symbols), wide, first, len(flat), zlib.crc32(body), len(body)) + body


class Block:
    """A block, read from its bytes."""

    def __init__(self, data: bytes, at: int = 0):
        docs, rules, symbols, wide, self.first, self.ids, crc, size = HEAD.unpack_from(data, at)
        at += HEAD.size
        if zlib.crc32(memoryview(data)[at : at + size]) != crc:
            raise ValueError("a block of a token file is damaged")

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        doc_ids, absent, self.begins = take(docs, "<i8"), take(docs, "u1"), take(docs + 1, "<u8").astype(np.int64)
        self.rules = np.stack([take(rules, "<u4"), take(rules, "<u4")], axis=1)
        self.lengths, packed = take(rules, "<u4"), take(symbols * wide, "u1").reshape(-1, wide)
        full = np.zeros((symbols, 4), np.uint8)
        full[:, :wide] = packed
        self.symbols, self.end = full.reshape(-1).view("<u4").astype(np.uint32), at
        self.doc_ids = [None if gone else d for d, gone in zip(doc_ids.tolist(), absent)]

    def sizes(self) -> np.ndarray:
        """Ids of each symbol."""
        return np.where(self.symbols < self.first, 1, np.concatenate((self.lengths, [0]))[np.where(self.symbols < self.first, len(self.lengths), self.symbols.astype(np.int64) - self.first)])

    def document(self, k: int) -> np.ndarray:
        return expand(self.symbols[self.begins[k] : self.begins[k + 1]], self.rules, self.first)

    def span(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop) of the block; only the symbols that hold them are expanded."""
        ends = np.cumsum(self.sizes())
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skip = start - (int(ends[a - 1]) if a else 0)
        return expand(self.symbols[a:b], self.rules, self.first)[skip : skip + stop - start]


def blocks(path: str) -> Iterator[Block]:
    """The blocks of a file, one read after the other."""
    at, end = 0, files.size(path)
    while at < end:
        size = HEAD.size + HEAD.unpack(files.read(path, at, HEAD.size))[-1]
        yield Block(files.read(path, at, size))
        at += size


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of each simple character: 0 white space, 1 a letter, 2 a digit, 3 any other."""
    blank = re.compile(f"[{SPACE}]")
    return np.array([0 if blank.match(c) else {"L": 1, "N": 2}.get(unicodedata.category(c)[0], 3) for c in map(chr, range(0x250))], np.uint8)


def split(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words of lower-cased texts of simple characters as bpe.WORDS has them, found in all texts at once.

    Returns the distinct words, which of them each word is, and where each text's words begin and the last ends.
    """
    codes = np.frombuffer(" ".join([*texts, "    "]).encode("utf-16-le"), "<u2")  # two bytes a character; blanks after the last
    kind = _kinds()[codes]
    starts = np.ones(len(codes), bool)
    starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    # A single apostrophe before letters takes the first or the first two of them along if they are an ending.
    at = np.flatnonzero(codes[:-3] == ord("'"))
    at = at[(kind[at + 1] == 1) & ((kind[at - 1] != 3) | (at == 0))]
    one, two = codes[at + 1], codes[at + 1].astype(np.uint32) << 16 | codes[at + 2]
    short, long = at[np.isin(one, [ord(c) for c in "stmd"])], at[np.isin(two, [ord(a) << 16 | ord(b) for a, b in ("re", "ve", "ll")])]
    starts[short + 1] = starts[long + 1] = False
    starts[short + 2] = starts[long + 3] = True
    bounds = np.flatnonzero(starts)  # the last run is blanks
    word = np.flatnonzero(kind[bounds])
    begin = bounds[word]
    offsets = np.concatenate(([0], np.cumsum(2 * (bounds[word + 1] - begin))))
    words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(codes[kind != 0])])
    found = words.dictionary_encode()
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))
    _, cuts, distinct = found.dictionary.buffers()
    cuts, distinct = (np.frombuffer(cuts, np.int64, len(found.dictionary) + 1) // 2).tolist(), str(distinct or b"", "utf-16-le")
    return [distinct[a:b] for a, b in zip(cuts, cuts[1:])], found.indices.to_numpy(), np.searchsorted(begin, begins)


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    """The tokenizers library with the vocabulary, one a worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    return library


@lru_cache(maxsize=2)
def _library(path: str, whole: bool = False) -> Callable[[list[str]], list[np.ndarray]]:
    """Texts to ids by the tokenizers library; with whole, nothing else ever touches a text."""
    library = _tokenizer(path)

    def texts_whole(texts: list[str]) -> list[np.ndarray]:
        made = [x.ids for k in range(0, len(texts), 64) for x in library.encode_batch_fast(texts[k : k + 64], add_special_tokens=False)]
        return [np.array(x, "<u4") for x in made]

    if whole:
        return texts_whole
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import CharDelimiterSplit

    mark = library.model.end_of_word_suffix
    # Words are normalised and split when they come to the library's model; all that is left is to write them as byte symbols.
    model = Tokenizer(library.model)
    model.pre_tokenizer = CharDelimiterSplit(" ")
    symbols = "".join(" " if b == ord(" ") else s for b, s in enumerate(byte_symbols()))

    class ByLibrary(Encoder):
        def numbered(self, texts: list[str], special: bool = True) -> tuple[np.ndarray, np.ndarray]:
            # Special tokens, and characters that lower-case to ones beyond, are left to words().
            low = [t.lower() for t in texts]
            easy = [not (special and "<|" in t) and (t.isascii() or not BEYOND.search(x)) for t, x in zip(texts, low)]
            words, which, begins = split([x for x, plain in zip(low, easy) if plain])
            flat = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))[which]
            if all(easy):
                return flat, begins
            done = iter(np.split(flat, begins[1:-1]))
            laid = [next(done) if plain else np.array([self.numbers[w] for w in self.words(t, special)], np.int64) for t, plain in zip(texts, easy)]
            return np.concatenate(laid), np.cumsum([0, *map(len, laid)])

        def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            # Many words in one call, apart by a space; each ends with the one symbol that has the end mark.
            some = [" ".join(words[k : k + 500]).encode() for k in range(0, len(words), 500)]
            made = [x.ids for x in model.encode_batch_fast([codecs.charmap_decode(x, "strict", symbols)[0] for x in some], add_special_tokens=False)]
            ids = np.fromiter(chain.from_iterable(made), np.uint32, sum(map(len, made)))
            ends = np.flatnonzero(closes[ids]) + 1
            if len(ends) != len(words):
                raise ValueError("the library split a word")
            return ids, np.concatenate(([0], ends))

    own = ByLibrary(path)
    closes = np.array([t.endswith(mark.encode()) for t in own.vocabulary.tokens])

    def texts_by_word(texts: list[str]) -> list[np.ndarray]:
        simple = [t.isascii() or not BEYOND.search(t) for t in texts]
        words = iter(own.encode([t for t, plain in zip(texts, simple) if plain]))
        others = iter(texts_whole([t for t, plain in zip(texts, simple) if not plain]))
        return [next(words if plain else others) for plain in simple]

    return texts_by_word


@lru_cache(maxsize=1)
def _first_nonterminal(path: str) -> int:
    return 1 + max(_tokenizer(path).get_vocab().values())


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = END, whole: bool = False) -> DataFrame:
    """Writes docs as shard files; the manifest (path, n_docs, n_ids, part, k), a row a file, in stored form.

    Parts are ranges of doc_id in ascending order, k counts the files of a part; documents ascend throughout.
    """
    path = path or default_path()
    files.make_folder(f"{folder}/files")
    order = ["doc_id", "size", "hash"]
    rows = only(docs, "doc_id", "text").withColumn("size", F.length("text")).withColumn("hash", F.xxhash64("text"))
    # Hash and length take part in the ranges, so that rows that share an id, or have none, are spread as well.
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, first = _library(path, whole), _first_nonterminal(path)
        part, made = [0], 0

        def watched() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    part[0] = batch.column("part")[0].as_py()
                yield batch

        def packed() -> Iterator[tuple[int, int, bytes]]:
            """(documents, ids, bytes) of each block."""
            doc_ids, ids, held = [], [], 0
            for some, texts in chunks(watched()):
                for d, own in zip(some, encode(texts)):
                    doc_ids.append(d)
                    ids.append(np.append(own, np.uint32(end)))
                    held += len(ids[-1])
                    if held >= BLOCK_IDS:
                        yield len(doc_ids), held, pack(doc_ids, ids, first)
                        doc_ids, ids, held = [], [], 0
            if ids:
                yield len(doc_ids), held, pack(doc_ids, ids, first)

        todo = packed()
        block = next(todo, None)
        while block is not None:
            n_docs, n_ids, written = 0, 0, 0
            with files.writing(f"{folder}/files") as (name, out):
                while block is not None and written < FILE_BYTES:
                    out.write(block[2])
                    n_docs, n_ids, written = n_docs + block[0], n_ids + block[1], written + len(block[2])
                    block = next(todo, None)
            yield pa.RecordBatch.from_pydict({"path": [name], "n_docs": [n_docs], "n_ids": [n_ids], "part": pa.array([part[0]], pa.int32()), "k": pa.array([made], pa.int32())})
            made += 1

    return stored(ordered.mapInArrow(run, "path string, n_docs long, n_ids long, part int, k int"), f"{folder}/manifest")


def shard_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with `start`, the ids in all files before. A row a file: the only table that is ordered as a whole."""
    before = Window.orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone; start counts from the first file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                for block in blocks(path):
                    ids = expand(block.symbols, block.rules, block.first)
                    size = np.add.reduceat(block.sizes(), block.begins[:-1])
                    ends = np.cumsum(size)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - size).tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(block.doc_ids, pa.int64()), "start": pa.array(start + ends - size), "n_tokens": pa.array(size.astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())})
                    start += block.ids

    spread = shard_starts(manifest).repartition(manifest.sparkSession.sparkContext.defaultParallelism, "path")
    return spread.select("path", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents"), shared_dir(spark)))
