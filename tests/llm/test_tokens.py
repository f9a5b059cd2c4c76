import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import example, given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skein.llm import bpe, token_counts, token_files
from skein.llm.common import shared_dir

ODD = ["Hello world's ÉTÉ <|endoftext|> héé12\n x ΑΣ İ", "", None, "   ", "''s 'sx aaaaaaaaa aaaa <|startoftext|><|STARTOFTEXT|>", "一二 ½ Ⅷ ١٢ ​\x1c\x1dab\x85c 👩‍👩‍👧 नमस्ते", "é́ Å 가 <|endoftext|", "x" * 30_000, "a b " * 40_000]
ROWS = [(k, t) for k, t in enumerate(ODD + ODD[:2])]


def library():
    return Tokenizer.from_file(bpe.default_path())


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, ids string")


@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]) | st.sampled_from("abct 's'nÉß<|>endoftext12"), max_size=60), max_size=5))
@example([":\U0003d000", "a\u0345\u03a3 \u1c89\U0001e6c0"])
def test_encoder_is_the_librarys(texts):
    own = bpe.encoder(bpe.default_path())
    want = [library_().encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want


_LIBRARY = []


def library_():
    if not _LIBRARY:
        _LIBRARY.append(library())
    return _LIBRARY[0]


def test_small_memory_and_chunks_change_nothing(spark, monkeypatch):
    own = bpe.Encoder(bpe.default_path())
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 3)
    for t in ODD:
        assert np.frombuffer(own.encode([t or ""])[0], "<u4").tolist() == library_().encode(t or "", add_special_tokens=False).ids


def test_digests_and_round_trip(spark):
    got = {tuple(r) for r in bpe.digests(frame(spark)).collect()}
    want = set()
    for d, t in ROWS:
        ids = library_().encode(t or "", add_special_tokens=False).ids
        text = library_().decode(ids, skip_special_tokens=False)
        want.add((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == want
    decoded = dict(map(tuple, bpe.decode(bpe.encode(frame(spark))).collect()))
    assert all(decoded[d] == library_().decode(library_().encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for d, t in ROWS)
    assert bpe.digests(frame(spark, [])).collect() == []


@given(st.lists(st.lists(st.integers(0, 5), max_size=50), min_size=1, max_size=20), st.integers(0, 100))
def test_repair_round_trip(docs, seed):
    ids = [np.array([*x, 1] * 20, np.uint32) for x in docs]
    block = token_files.Block(token_files.pack(list(range(len(ids))), ids, 50), 0)
    flat = np.concatenate(ids)
    assert (token_files.expand(block.symbols, block.rules, 50) == flat).all() and block.sizes().sum() == len(flat)
    assert all((block.document(k) == x).all() for k, x in enumerate(ids))
    a, b = sorted(np.random.default_rng(seed).integers(0, len(flat) + 1, 2))
    assert (block.span(a, b) == flat[a:b]).all() or a == b
    assert all(r < 50 + k for k, pair in enumerate(block.rules.tolist()) for r in pair)


def test_repair_compresses():
    ids = np.tile(np.arange(40, dtype=np.uint32), 500)
    symbols, _, rules, lengths = token_files.repair(ids, np.zeros(len(ids), bool), 50)
    assert len(symbols) < len(ids) / 4 and lengths.max() > 4 and len(rules) == len(lengths)


def test_repair_leaves_no_frequent_pair():
    # Pairs that occur 12 times each, apart by ids that hardly repeat: little gain, and more pairs than a small table holds.
    rng = np.random.default_rng(3)
    rows = np.stack([np.tile(np.arange(3_000), 12), np.tile(np.arange(3_000, 6_000), 12), rng.integers(6_000, 45_000, 36_000)], axis=1)
    ids = np.concatenate((np.full(3_000, 45_001), rows.ravel())).astype(np.uint32)
    last = np.zeros(len(ids), bool)
    last[[99, 5_000, len(ids) - 1]] = True
    symbols, ends, rules, _ = token_files.repair(ids, last, 50_000)
    assert (token_files.expand(symbols, rules, 50_000) == ids).all() and ends.sum() == 3
    counts, overlaps = {}, False
    for a, b, c, end in zip([None, *symbols[:-2].tolist()], symbols[:-1].tolist(), symbols[1:].tolist(), ends[:-1].tolist()):
        overlaps = a == b == c and not end and not overlaps
        if not end and not overlaps:
            counts[b, c] = counts.get((b, c), 0) + 1
    assert max(counts.values()) < token_files.LEAST, {k: n for k, n in counts.items() if n >= token_files.LEAST}


def test_token_files(spark, monkeypatch):
    rows = [(7, "b"), (3, "a"), (3, None), (None, "z"), *[(k, t) for k, t in enumerate(ODD, 10)]]
    got = sorted(map(tuple, token_files.read(token_files.write(frame(spark, rows), shared_dir(spark))).collect()), key=lambda r: r[1])
    start, want = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -1 if r[1] is None else len(r[1]))):
        ids = np.array([*library_().encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert token_files.read(token_files.write(frame(spark, []), shared_dir(spark))).collect() == []
    # The library with every whole text writes the same ids; small blocks and files, which are begun anew, hold them too.
    whole = token_files.read(token_files.write(frame(spark, rows), shared_dir(spark), whole=True))
    assert sorted(map(tuple, whole.collect()), key=lambda r: r[1]) == want


def test_files_are_begun_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 40)
    ids = [np.array([k, k + 1, 7, 1] * 15, np.uint32) for k in range(5)]
    with token_files.files.writing(f"file://{tmp_path}") as (path, out):
        for k in range(0, 5, 2):
            out.write(token_files.pack(list(range(k, min(5, k + 2))), ids[k : k + 2], 50))
    found = list(token_files.blocks(path))
    assert [b.doc_ids for b in found] == [[0, 1], [2, 3], [4]]
    assert all((b.document(k - b.doc_ids[0]) == ids[k]).all() for b in found for k in b.doc_ids)
    broken = bytearray(token_files.files.read(path))
    broken[100] ^= 1
    with pytest.raises(ValueError):
        token_files.Block(bytes(broken))


def test_rules_are_not_capped():
    """More rules than two bytes hold: symbols take three."""
    rng = np.random.default_rng(5)
    pairs = np.stack([np.arange(22_000), np.arange(22_000, 44_000)], axis=1)
    ids = np.concatenate([pairs[rng.permutation(22_000)].ravel() for _ in range(13)]).astype(np.uint32)
    block = token_files.Block(token_files.pack([1], [ids], 49_408))
    assert len(block.rules) >= 22_000 and (block.document(0) == ids).all() and (block.span(5, 999) == ids[5:999]).all()


@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]) | st.sampled_from("abct 's'n\u00c9\u00df<|>endoftext12\u0130\u024f\u0307"), max_size=60), max_size=5))
def test_words_make_the_ids_of_whole_texts(texts):
    path = bpe.default_path()
    for a, b in zip(token_files._library(path)(texts), token_files._library(path, True)(texts), strict=True):
        assert a.tolist() == b.tolist()


def test_simple_characters_one_by_one():
    """Every character that may stand in a text split here, between letters, digits and signs."""
    path = bpe.default_path()
    texts = [f"a{c}b 1{c}2 {c}'s {c}{c} ,{c}." for c in map(chr, range(0x250))]
    for t, a, b in zip(texts, token_files._library(path)(texts), token_files._library(path, True)(texts), strict=True):
        assert a.tolist() == b.tolist(), t


@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x24F) | st.sampled_from("'stmdrevl 1,\u00c9\u00df\xa0\x85\x1c"), max_size=40), max_size=5))
@example([])
@example(["", "", "'"])
@example(["'s", "x''s 'sx,'s 's's", "'re'rx 'v 'l", "'ll", "'", "s", "1'd1'", " 'm ", "\u00e9'\u00e9't"])
def test_words_are_split_as_one_by_one(texts):
    own = bpe.encoder(bpe.default_path())
    low = [t for t in (t.lower() for t in texts) if not token_files.BEYOND.search(t)]
    words, which, begins = token_files.split(low)
    found = [words[k] for k in which.tolist()]
    assert [found[a:b] for a, b in zip(begins[:-1].tolist(), begins[1:].tolist())] == [own.words(t, False) for t in low]
    assert len(words) == len(set(words)) and len(begins) == len(low) + 1 and begins[-1] == len(found)


def test_work_by_distinct_word(monkeypatch):
    """The words of a chunk are looked up once each, however often they occur."""
    asked = []

    class Counted(bpe.Words):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    monkeypatch.setattr(bpe, "Words", Counted)
    encode, text = token_files._library.__wrapped__(bpe.default_path()), "The dog's caf\u00e9, 12 " * 500
    asked.clear()
    want = library_().encode(text, add_special_tokens=False).ids
    assert all(x.tolist() == want for x in encode([text] * 3))
    assert len(asked) == 7, len(asked)


def test_token_counts(spark, monkeypatch):
    own = library()
    own.encode_special_tokens = True
    for size in (4, 64, 1 << 20):
        files, who = token_counts.write(frame(spark), shared_dir(spark))
        got = token_counts.scan(files, 49407, size).join(who, ["path", "k"]).select("doc_id", "n_tokens", "ended").collect()
        assert {tuple(r) for r in got} == {(d, len(own.encode(t or "", add_special_tokens=False).ids), True) for d, t in ROWS}
        assert len(got) == len(ROWS)


def test_token_counts_query(spark, tmp_path):
    """op6 itself: every row, whatever its text, and an empty table."""
    own = library()
    own.encode_special_tokens = True
    rows = [*ROWS, (None, "no id"), (3, "again"), (3, "again")]
    frame(spark, rows).withColumn("k", F.lit("clash")).withColumn("path", F.lit("clash")).write.parquet(f"{tmp_path}/a/documents.parquet")
    frame(spark, []).write.parquet(f"{tmp_path}/b/documents.parquet")
    want = [(d, len(own.encode(t or "", add_special_tokens=False).ids)) for d, t in rows]
    assert sorted(map(tuple, token_counts.op6_token_counts(spark, f"{tmp_path}/a").collect()), key=str) == sorted(want, key=str)
    assert token_counts.op6_token_counts(spark, f"{tmp_path}/b").collect() == []


def test_token_counts_without_a_last_end(spark, tmp_path):
    ids = np.array([5, 9, 9, 6, 7, 9, 8, 8, 8], "<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    files = spark.createDataFrame([(f"file://{tmp_path}/a.bin", ids.nbytes, 2), (f"file://{tmp_path}/b.bin", 0, 2)], "path string, bytes long, width long")
    for size in (2, 4, 6, 100):
        assert sorted(tuple(r)[1:] for r in token_counts.scan(files, 9, size).collect()) == [(0, 1, True), (1, 0, True), (2, 2, True), (3, 3, False)]
