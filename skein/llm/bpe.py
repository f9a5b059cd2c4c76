"""BPE encoding and decoding with a pair occurrence index.

The words of a whole chunk of texts are encoded together. Each distinct word is laid out once in a flat array of
symbols; an index maps every pair that has a rank to all its positions in the chunk. Ranks are taken in ascending
order; all positions of the pair at hand are merged at once, and only the lists of the pairs beside them are updated.
That gives the greedy merge order of each word, because a merge can only make pairs of higher rank (checked when the
vocabulary is read). Encoded words are remembered between chunks within bounds.

Results are those of the tokenizers library for a vocabulary of this kind (NFC, lower case, words with an end mark,
byte-level symbols), without added special tokens; the special tokens' strings in a text become their ids. Decoding
gives the tokens' strings joined by a space, as the library does for a vocabulary without a decoder.

Defined cases: null text counts as empty and has no ids; repeated rows are encoded each, as are rows without an id; the
longest texts are processed whole; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skein.llm.common import only, table, texts_of

#: Texts encoded together, in characters, and what may be remembered of words.
CHUNK_CHARS, MEMORY_WORDS, MEMORY_CHARS = 4_000_000, 600_000, 12_000_000
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The words of normalised text; {L}, {N} and {S} are letters, digits and white space.
WORDS = "[{L}]+|'s|'t|'re|'ve|'m|'ll|'d|[{N}]|[^{S}{L}{N}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """For ASCII and for low code points (built from their categories) fast patterns, and what lies beyond."""
    low = [chr(c) for c in range(0x250)]
    letters, digits = ("".join(re.escape(c) for c in low if unicodedata.category(c)[0] == k) for k in "LN")
    return (
        re.compile(WORDS.format(L="a-z", N="0-9", S="\t-\r ")),
        re.compile(WORDS.format(L=letters, N=digits, S=SPACE)),
        re.compile("[^\x00-\u024f]"),
    )


@lru_cache(maxsize=2)
def _splitter(path: str) -> Callable[[str], list[str]]:
    """The words of any text by the library's own tables, as other tables know other characters."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    normalise, split = library.normalizer.normalize_str, library.pre_tokenizer[0].pre_tokenize_str
    return lambda text: [word for word, _ in split(normalise(text))]


class Vocabulary:
    """The file's symbols and ranked merges as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges, end = spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, k in [*vocab.items(), *self.special.items()]:
            self.tokens[k] = token.encode()
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + end] for s in symbols], np.int32)
        self.left, self.right, self.made = (np.array(x, np.int32) for x in zip(*[(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]))
        self.width = len(self.tokens)
        keys = self.left.astype(np.int64) * self.width + self.right
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        rank_of = dict(zip(self.made.tolist(), range(len(self.made))))
        if len(rank_of) != len(self.made) or any(rank_of.get(x, -1) >= r for r, pair in enumerate(zip(self.left.tolist(), self.right.tolist())) for x in pair):
            raise ValueError("a merge makes pairs of lower rank: ascending ranks would not be the greedy order")

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it has none (or a symbol is missing, below 0)."""
        keys = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (a >= 0) & (b >= 0), self.order[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, where each word's begin and the last ends), by the pair occurrence index."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(words) else 0
        data = np.frombuffer(b"".join(words), np.uint8)
        sym = np.append(self.inner[data], np.int32(-1))
        sym[ends - 1] = self.last[data[ends - 1]]
        after, before = np.arange(1, n + 2), np.arange(-1, n)  # n: none
        after[ends - 1] = n
        before[ends - lengths] = n
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            ranks = self.ranks(sym[at], sym[after[at]])
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for r, own in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts) if len(cuts) else [at]):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(own)

        add(np.arange(n))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            a, b = self.left[r], self.right[r]
            at = at[(sym[at] == a) & (sym[after[at]] == b)]
            if a == b and len(at) > 1:  # from the left, none overlapping the one before it
                kept, taken = [], -1
                for p in np.sort(at).tolist():
                    if p != taken:
                        kept.append(p)
                        taken = int(after[p])
                at = np.array(kept)
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            sym[at], sym[gone] = self.made[r], -1
            after[at], before[beyond] = beyond, at
            ahead = before[at]
            add(np.unique(np.concatenate((ahead[ahead < n], at))))
        alive = sym[:n] >= 0
        counts = np.concatenate(([0], np.cumsum(alive)))
        return sym[:n][alive].astype(np.uint32), counts[np.concatenate(([0], ends))]


class Words(dict):
    """A number for each word, given when it is met first; fresh are the words met since it was emptied."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class Encoder:
    """Texts to ids, with the words met so far remembered."""

    def __init__(self, path: str):
        self.path, self.vocabulary = path, Vocabulary(path)
        self.split = re.compile("(" + "|".join(map(re.escape, self.vocabulary.special)) + ")")
        self.forget()

    def forget(self) -> None:
        # No word looks like the special tokens: they mix letters and signs.
        self.numbers = Words()
        for token in self.vocabulary.special:
            self.numbers[token]
        self.numbers.fresh.clear()
        self.chars = 0
        # The ids of all words one after the other, and where each word's begin.
        self.ids = np.array(list(self.vocabulary.special.values()), "<u4")
        self.begins = np.arange(len(self.ids) + 1)

    def words(self, text: str, special: bool = True) -> list[str]:
        """The words of a text; with special, the special tokens' strings are words of their own."""
        out: list[str] = []
        for part in self.split.split(text) if special and "<|" in text else [text]:
            if special and part in self.vocabulary.special:
                out.append(part)
                continue
            plain, fast, beyond = _patterns()
            low = part.lower()
            if part.isascii():
                out += plain.findall(low)
            else:
                out += _splitter(self.path)(part) if beyond.search(low) else fast.findall(low)
        return out

    def numbered(self, texts: list[str], special: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all words, where each text's begin and the last ends)."""
        laid = [self.words(text, special) for text in texts]
        ends = np.cumsum([0, *map(len, laid)])
        return np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(laid)), np.int64, int(ends[-1])), ends

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, where each word's begin and the last ends)."""
        return self.vocabulary.merge([w.encode("utf-8", "surrogatepass") for w in words])

    def encode(self, texts: list[str], special: bool = True) -> list[np.ndarray]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if len(self.numbers) > MEMORY_WORDS or self.chars > MEMORY_CHARS:
            self.forget()
        numbers, ends = self.numbered(texts, special)
        if fresh := self.numbers.fresh:
            ids, begins = self.learn(fresh)
            self.begins = np.concatenate((self.begins, self.begins[-1] + begins[1:]))
            self.ids = np.concatenate((self.ids, ids.astype("<u4")))
            self.chars += sum(map(len, fresh))
            fresh.clear()
        begin = self.begins[numbers]
        size = self.begins[numbers + 1] - begin
        after = np.concatenate(([0], np.cumsum(size)))
        out = self.ids[np.repeat(begin - after[:-1], size) + np.arange(after[-1])]
        return [out[a:b] for a, b in zip(after[ends[:-1]].tolist(), after[ends[1:]].tolist())]

    def decode(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8."""
        return b" ".join(map(self.vocabulary.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One a worker."""
    return Encoder(path)


def chunks(batches: Iterator[pa.RecordBatch], chars: int | None = None) -> Iterator[tuple[list, list[str]]]:
    """(doc_id values, texts) of about `chars` characters at once."""
    chars = chars or CHUNK_CHARS
    ids, texts, size = [], [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            for d, text in zip(part.column("doc_id").to_pylist(), texts_of(part)):
                ids.append(d)
                texts.append(text)
                size += len(text) + 100
                if size >= chars:
                    yield ids, texts
                    ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) for every row."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            made = [x.astype(np.int32) for x in encoder(path).encode(texts)]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in made]))).astype(np.int32)
            values = np.concatenate(made) if made else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "ids"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [encoder(path).decode(np.array(x or [], "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return only(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes and decodes every row in one pass: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for ids, texts in chunks(batches):
            made = own.encode(texts)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(ids, pa.int64()),
                    "n_tokens": pa.array([len(x) for x in made], pa.int64()),
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in made],
                    "decoded_sha256": [hashlib.sha256(own.decode(x)).hexdigest() for x in made],
                }
            )

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
