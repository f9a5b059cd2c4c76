"""Language identification with spans: script ranges, per-word scores, Viterbi with a switching penalty.

A word's script (by code point ranges) leaves as candidates the languages whose training text uses that script. Each
word gets, for each candidate, the log-likelihood of its character trigrams (hashed into BUCKETS). Viterbi over the
words, with a penalty for each change of language, labels spans of mixed text; a document's language is the one with
the most letters, and its score the share of letters so labelled.

Viterbi runs over all texts of a chunk at once: texts are cut into segments, every segment is solved for every language
that could precede it, and segments are then chained: the exact best path, in a few hundred vector steps.

The model is learned from at most TRAIN_ROWS labelled rows, the first in hash order of those that are not held out;
its size, and that of the counts that reach the driver, is languages x BUCKETS, so of such rows alone. Predictions use
the text alone.

Defined cases: null text and text without a letter is `und` with score 0, as is everything if nothing can be learned;
ties go to the language first in order; a null doc_id is never trained on nor held out; rows that repeat a doc_id are
learned from and predicted each; the longest texts are read whole; an empty table gives a model without languages and
no predictions; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.bpe import chunks
from skein.llm.common import only, slices, table, texts_of

TRAIN_ROWS, BUCKETS, PENALTY, SMOOTH, SEGMENT = 4_000, 1 << 16, 12.0, 0.05, 128
#: A language uses a script that at least this share of its training words are in.
SCRIPT_SHARE = 0.01
#: First and last code point of each range, and its script.
SCRIPTS = (
    (0x0041, 0x024F, "Latin"), (0x1E00, 0x1EFF, "Latin"), (0x0370, 0x03FF, "Greek"), (0x1F00, 0x1FFF, "Greek"), (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x077F, "Arabic"), (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"),
    (0x0B80, 0x0BFF, "Tamil"), (0x0E00, 0x0E7F, "Thai"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0xAC00, 0xD7AF, "Hangul"),
    (0x3040, 0x30FF, "Kana"), (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"),
)
SCRIPT_NAMES = sorted({s for _, _, s in SCRIPTS}) + ["other"]
WORD = re.compile(r"[^\W\d_]+")
#: Words that are remembered, and cells of scores (words x languages) that are.
MEMORY_WORDS, MEMORY_CELLS = 300_000, 1 << 25


def script_of(word: str) -> int:
    c = ord(word[0])
    return next((SCRIPT_NAMES.index(name) for a, b, name in SCRIPTS if a <= c <= b), len(SCRIPT_NAMES) - 1)


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all trigrams, where each word's begin); words have a mark at either end."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    marked = np.frombuffer(" ".join(["", *words, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    a, b, c = marked[:-2], marked[1:-1], marked[2:]
    mixed = (a * np.uint64(0x9E3779B1) ^ b * np.uint64(0x85EBCA77) ^ c * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))
    inside = np.ones(len(mixed), bool)
    inside[begins[1:-1] - 1] = False  # no trigram over the mark between two words
    kept = np.cumsum(inside) - inside
    return (mixed >> np.uint64(48)).astype(np.int64)[inside], kept[begins[:-1]] if len(words) else begins[:0]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages, log-likelihoods
    scripts: np.ndarray  # scripts x languages, whether the language uses the script

    def score(self, words: list[str]) -> np.ndarray:
        """Of each word and language, the best one's being 0; so many words at once that memory is bounded."""
        step = max(1, MEMORY_CELLS // (16 * max(1, len(self.languages))))
        return np.concatenate([self._score(words[k : k + step]) for k in range(0, len(words), step)])

    def _score(self, words: list[str]) -> np.ndarray:
        buckets, begins = trigrams(words)
        scores = np.add.reduceat(self.weights[buckets], begins, axis=0)
        used = self.scripts[[script_of(w) for w in words]]
        scores = np.where(used, scores, scores.min(axis=1, keepdims=True) - 20)
        scores[~used.any(axis=1)] = 0  # nobody's script: no evidence
        return (scores - scores.max(axis=1, keepdims=True)).astype(np.float32)


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Counts over a bounded sample of the rows that are not held out."""
    labelled = only(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (held_out() != 1))
    ids = labelled.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().orderBy("h", "doc_id").limit(rows).select("doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                for lang, text in zip(part.column("lang").to_pylist(), texts_of(part)):
                    if words := WORD.findall(text.lower()):
                        own = sums.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                        own[:BUCKETS] += np.bincount(trigrams(words)[0], minlength=BUCKETS)
                        own[BUCKETS:] += np.bincount([script_of(w) for w in words], minlength=len(SCRIPT_NAMES))
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bucket": pa.array(at, pa.int64()), "n": pa.array(own[at])})

    sampled = labelled.join(F.broadcast(ids), "doc_id").select("lang", "text")  # at most `rows` ids
    counts = sampled.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(counts["lang"]))
    table_ = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(languages)))
    table_[counts["bucket"], [languages.index(x) for x in counts["lang"]]] = counts["n"]
    seen, words = table_[:BUCKETS], table_[BUCKETS:]
    total = seen.sum(axis=0)
    prior = (seen.sum(axis=1, keepdims=True) + 1) / (total.sum() + BUCKETS)
    weights = np.log((seen + SMOOTH * 1000 * prior) / (total + SMOOTH * 1000)) if languages else seen
    used = words >= SCRIPT_SHARE * np.maximum(1, words.sum(axis=0)) if languages else words > 0
    return Model(languages, weights.astype(np.float32), used)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = PENALTY, segment: int | None = None) -> np.ndarray:
    """The best label of each row of scores, for sequences of the given lengths that follow each other.

    Memory is a few numbers a cell of scores, whatever the number of labels: the first pass over the segments keeps only
    what each one leads to from every label before it; when segments are chained, that label is known, and the second
    pass remembers one step back for each row and label.
    """
    n, width = scores.shape
    if not n:
        return np.zeros(0, np.int64)
    segment = segment or max(SEGMENT, width * width // 32)
    lengths = lengths[lengths > 0]
    per = -(-lengths // segment)
    doc_begin = np.cumsum(lengths) - lengths
    number = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)  # of a segment within its text
    begin = np.repeat(doc_begin, per) + number * segment
    size = np.minimum(segment, np.repeat(lengths, per) - number * segment)
    order = np.argsort(-size, kind="stable")
    b, s = begin[order], size[order]
    alive = [int(np.searchsorted(-s, -t, "left")) for t in range(int(s[0]))]
    # ends[segment, label before, label]: the best path within the segment that ends in the label.
    moves = (penalty * (1 - np.eye(width))).astype(scores.dtype)
    value = scores[b][:, None, :] - moves[None]
    for t in range(1, int(s[0])):
        own = value[: alive[t]]
        np.maximum(own, own.max(axis=2, keepdims=True) - own.dtype.type(penalty), out=own)
        own += scores[b[: alive[t]] + t][:, None, :]
    ends = np.empty_like(value)
    ends[order] = value
    # Chain the segments of each text. Nothing precedes the first one: to be preceded by its own first label is free.
    first_of = np.cumsum(per) - per
    before = np.zeros((len(number), width), np.int32)
    by_count = np.argsort(-per, kind="stable")
    before[first_of] = ends[first_of].argmax(axis=1)
    state = ends[first_of].max(axis=1)[by_count]
    for j in range(1, int(per.max())):
        k = int(np.searchsorted(-per[by_count], -j, "left"))
        seg = first_of[by_count[:k]] + j
        joined = state[:k, :, None] + ends[seg]
        before[seg] = joined.argmax(axis=1)
        state[:k] = joined.max(axis=1)
    label_at_end, label_before = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    now = state.argmax(axis=1)
    for j in range(int(per.max()) - 1, -1, -1):
        k = int(np.searchsorted(-per[by_count], -j, "left"))
        seg = first_of[by_count[:k]] + j
        label_at_end[seg] = now[:k]
        label_before[seg] = before[seg, now[:k]]
        now[:k] = label_before[seg]
    # All segments once more, each from its label before, and back.
    value = scores[b] - moves[label_before[order]]
    stays, best = np.ones((n, width), bool), np.zeros(n, np.int32)
    for t in range(1, int(s[0])):
        own, rows = value[: alive[t]], b[: alive[t]] + t
        best[rows] = own.argmax(axis=1)
        jump = own.max(axis=1, keepdims=True) - own.dtype.type(penalty)
        stays[rows] = own >= jump
        value[: alive[t]] = np.maximum(own, jump) + scores[rows]
    out, at = np.zeros(n, np.int64), label_at_end[order]
    for t in range(int(s[0]) - 1, -1, -1):
        rows = b[: alive[t]] + t
        out[rows] = at[: alive[t]]
        at[: alive[t]] = np.where(stays[rows, at[: alive[t]]], at[: alive[t]], best[rows])
    return out


class Labeller:
    """Labels words of texts; remembers the scores of words within bounds."""

    def __init__(self, model: Model):
        self.model = model
        self.most = max(1_000, min(MEMORY_WORDS, MEMORY_CELLS // max(1, len(model.languages))))
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)), np.float32)
        self.scripts, self.letters = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def label(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language of each word, letters of each word, words of each text); the words are in lower case."""
        if len(self.codes) > self.most:
            self.forget()
        fresh = sorted(set().union(*texts).difference(self.codes))
        if fresh:
            self.codes.update(zip(fresh, range(len(self.codes), len(self.codes) + len(fresh))))
            self.scores = np.concatenate((self.scores, self.model.score(fresh)))
            self.scripts = np.concatenate((self.scripts, np.array([script_of(w) for w in fresh], np.int64)))
            # A "word" may consist of number signs alone; only letters count.
            self.letters = np.concatenate((self.letters, [len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in fresh]))
        lengths = np.array([len(x) for x in texts], np.int64)
        own = np.fromiter((c for x in texts for c in map(self.codes.__getitem__, x)), np.int64, int(lengths.sum()))
        # Languages that use none of the scripts at hand cannot win; the first one stays for words of nobody's script.
        may = self.model.scripts[np.bincount(self.scripts[own], minlength=len(SCRIPT_NAMES)) > 0].any(axis=0)
        may[:1] = True
        columns = np.flatnonzero(may)
        return columns[viterbi(self.scores[:, columns][own], lengths)], self.letters[own], lengths


def held_out(doc_id: str = "doc_id") -> Column:
    """1 for rows that are held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3))


def _predictions(labeller: Labeller, texts: list[str]) -> dict[str, pa.Array]:
    names = [*labeller.model.languages, "und"]
    winner, score, spans = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    if width := len(names) - 1:
        labels, letters, lengths = labeller.label([WORD.findall(t.lower()) for t in texts])
        text_of = np.repeat(np.arange(len(texts)), lengths)
        share = np.bincount(text_of * width + labels, letters, len(texts) * width).reshape(-1, width)
        total = share.sum(axis=1)
        winner = np.where(total > 0, share.argmax(axis=1), -1)
        score = np.where(total > 0, share.max(axis=1) / np.maximum(1, total), 0.0)
        change = np.flatnonzero((np.diff(labels, prepend=-1) != 0) | (np.diff(text_of, prepend=-1) != 0))
        spans = np.bincount(text_of[change], minlength=len(texts))
    return {"lang_pred": pa.array([names[w] for w in winner], pa.string()), "score": pa.array(score), "n_spans": pa.array(spans, pa.int64())}


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, n_spans) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for ids, texts in chunks(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), **_predictions(labeller, texts)})

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, n_spans long")


def identified(docs: DataFrame, model: Model, least: float = 0.0) -> DataFrame:
    """The rows of docs in a learned language, columns unchanged; one pass, no shuffle.

    Those go whose language is `und`, and those of whose letters no language has a share of at least `least`. If no
    language was learned, all rows with a letter stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            for part in slices(batch, 512):
                texts = texts_of(part)
                if shared.value.languages:
                    made = _predictions(labeller, texts)
                    yield part.filter(pa.compute.and_(pa.compute.not_equal(made["lang_pred"], "und"), pa.compute.greater_equal(made["score"], least)))
                else:
                    yield part.filter(pa.array([any(map(str.isalpha, t)) for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start, end, lang): runs of words of one language, in code points, end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, names = Labeller(shared.value), shared.value.languages
        for ids, texts in chunks(batches):
            found = [list(WORD.finditer(t)) for t in texts] if names else [[] for _ in texts]
            labels, _, _ = labeller.label([[m[0].lower() for m in x] for x in found]) if names else ([], [], [])
            rows, at = [], 0
            for d, words in zip(ids, found):
                own, at = labels[at : at + len(words)], at + len(words)
                for k, m in enumerate(words):
                    if k and own[k] == own[k - 1]:
                        rows[-1][2] = m.end()
                    else:
                        rows.append([d, m.start(), m.end(), names[own[k]]])
            d, a, b, lang = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(d, pa.int64()), "start": pa.array(a, pa.int64()), "end": pa.array(b, pa.int64()), "lang": pa.array(lang, pa.string())})

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, start long, end long, lang string")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, train(docs))
    return out.select("doc_id", F.coalesce(held_out() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_spans")
