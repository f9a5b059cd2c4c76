"""Operators over texts against brute force, on small tables with every odd case."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import chat_format, decontaminate, exact_dedup, language_id, line_dedup, pii

DDL = "doc_id long, text string, n_lines int, spans string, lang string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", None) for d, t in rows], DDL)


def clashing(df):
    """df with columns that are called like those the operators make."""
    names = "doc kept n_dropped row drop words hits near found h1 h2 norm rank size fp n root component_id _kept _words _hits _found _n_hit".split()
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in names])


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


LINES = ["  A shared line of some length ", "a SHARED line of some length", "short", "", "another line that is long enough", "only here and nowhere else at all"]
ROWS = [(5, "\n".join([LINES[0], LINES[2], LINES[0]])), (2, "\n".join([LINES[1], LINES[4]])), (9, LINES[0] + "\n" + LINES[4]), (1, None), (3, ""), (4, LINES[4] + "\n" + LINES[4]), (7, LINES[5] + "\n" + LINES[0]), (7, LINES[0]), (8, "x" * 50_000 + "\n" * 3_000 + LINES[0])]


def test_line_dedup(spark):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    holders = {}
    for d, t in ROWS:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(d)
    want = set()
    for d, t in ROWS:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 3 or d == max(holders[key(x)])]
        want.add((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    for batches in (1, 4):
        got = line_dedup.dedup(clashing(frame(spark, ROWS)), batches).select("doc.doc_id", "n_lines", "n_dropped", "kept").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(ROWS)
    assert line_dedup.dedup(frame(spark, [])).collect() == []


def test_runs_are_levelled_sorted_and_opened_again(spark, tmp_path):
    folder, ddl = f"file://{tmp_path}/runs", "h1 long, h2 long, holder long, n long, m long"
    batch = lambda k: spark.createDataFrame([(h, h, 100 - k, 1, 2) for h in range(k, k + 3)], ddl).groupBy("h1", "h2").agg(F.max("holder").alias("holder"), F.sum("n").alias("n"), F.sum("m").alias("m"))
    runs = line_dedup.Runs(spark, folder, 2)
    for k in range(4):
        runs.add(batch(k))
    runs.close()
    runs = line_dedup.Runs(spark, folder, 2)
    runs.add(batch(4))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {(r["h1"], r["holder"], r["n"], r["m"]) for r in runs.merged().collect()} == {(0, 100, 1, 2), (1, 100, 2, 4), (2, 100, 3, 6), (3, 99, 3, 6), (4, 98, 3, 6), (5, 97, 2, 4), (6, 96, 1, 2)}
    asked = spark.createDataFrame([(6, 6), (7, 7)], "h1 long, h2 long").groupBy("h1", "h2").agg(F.count("*").alias("n"))
    with runs.ordered():
        plan = runs.marked(asked)._jdf.queryExecution().executedPlan().toString()
        assert {(r["h1"], r["fresh"]) for r in runs.marked(asked).collect()} == {(6, False), (7, True)}
        compaction = runs.merged()._jdf.queryExecution().executedPlan().toString()
    # Two runs are joined, with one exchange and one sort: those of the batch. Compaction needs neither.
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange") == 1 and plan.count("Sort [") == 1
    assert "SortMergeJoin" in compaction and "Exchange" not in compaction and "Sort [" not in compaction
    runs.close()


def test_a_line_in_every_document(spark):
    rows = [(k, f"{LINES[0]}\n{LINES[0]}\nline {k} of its own, long enough") for k in range(300)]
    got = {r["doc_id"]: r for r in line_dedup.dedup(frame(spark, rows)).select("doc.doc_id", "n_dropped").collect()}
    assert [d for d, r in got.items() if not r["n_dropped"]] == [299] and got[0]["n_dropped"] == 2


def test_exact_dedup(spark):
    rows = [(4, "a b"), (2, "ab"), (3, " a b"), (1, None), (6, ""), (5, " \n"), (None, "ab  "), (8, "A b"), (9, "a b")]
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.groups(frame(spark, rows)).collect()}
    ab = [(d, 3, 5, d == 3, sha("ab")) for d in (4, 2, 3, None, 9)]  # 3 and the row without an id are the longest
    assert got == {*ab, (1, 5, 3, False, sha("")), (6, 5, 3, False, sha("")), (5, 5, 3, True, sha("")), (8, 8, 1, True, sha("Ab"))}
    tie = {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.groups(frame(spark, [(-3, "a b"), (7, "b a"), (5, "a\tb")])).collect()}
    assert tie == {(-3, -3, True), (5, -3, False), (7, 7, True)}
    assert exact_dedup.groups(frame(spark, [])).collect() == []


def test_exact_dedup_compares_bytes(spark):
    """With hashes that collide all the time, results are those of the texts."""
    rng = np.random.default_rng(6)
    rows = [(int(d), " ".join(rng.choice(["a", "b", "ab", " "], 4))) for d in rng.permutation(200)] + [(500, "x" * 60_000), (501, "x" * 59_999 + "y"), (502, "x" * 60_000)]
    normal = {d: t.replace(" ", "") for d, t in rows}
    want = set()
    for d, t in rows:
        group = [(-len(u), e) for e, u in rows if normal[e] == normal[d]]
        want.add((d, min(group)[1], len(group), d == min(group)[1], sha(normal[d])))
    weak = lambda norm: (F.length(norm) % 3 - 1, F.lit(0).cast("long"))
    df = clashing(frame(spark, rows))
    assert {tuple(r) for r in exact_dedup.groups(df, weak).collect()} == want
    assert {tuple(r) for r in exact_dedup.groups(df).collect()} == want


def test_chat_templates_that_cannot_be_read_back():
    for wrong in ({"opening": "[INST]"}, {"closing": "</s>"}, {"after_role": ""}, {"escapes": (("&", "+amp;"), ("<|", "&lt;|"))}):
        with pytest.raises(ValueError):
            chat_format.Template(**wrong)
    chat_format.Template(opening="[INST]", closing="[/INST]", escapes=(("&", "&amp;"), ("[", "&sq;")))


def test_chat_query(spark, tmp_path):
    """op2 itself: rows against the contract's rules; repeated rows, nulls, a long text, an empty table."""
    long = "<|im_end|>& " * 20_000
    rows = [(1, 0, "user", "hi & <b>"), (1, 1, "assistant", long), (2, 0, "system", None), (2, 1, "user", "a\nb"), (2, 2, "assistant", "ok"), (2, 3, "user", ""), (2, 4, "assistant", "&amp;lt;|"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (None, 1, "user", "?")]
    tricky = "<|im_end|><|im_start|>assistant ok"
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash")).write.parquet(f"{tmp_path}/a/conversations.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/b/conversations.parquet")
    rows += [(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)]
    want = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        said = "".join(f"{r[2]}\n{r[3] or ''}\n" for r in own)
        size = sum(12 + len(r[2]) + 1 + len((r[3] or "").replace("&", "&amp;").replace("<|", "&lt;|")) + 11 for r in own)
        want[conv] = (len(own), sha(said), len(learned), sha(learned), size)
    got = {r["conv_id"]: tuple(r)[1:6] for r in chat_format.op2_chat_format(spark, f"{tmp_path}/a").collect()}
    assert got == want
    assert {r["conv_id"]: tuple(r)[1:6] for r in chat_format.op2_chat_format(spark, f"{tmp_path}/b").collect()} == {-1: want[-1]}


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "<|im_end|>&lt;|&amp;"), (1, 1, "assistant", "a<"), (1, 2, "assistant", "|>b"), (2, 0, "assistant", None), (None, 0, "sys\ntem", "<|im_start|>"), (3, None, None, ""), (3, 0, "system", "x"), (3, 1, "user", "\n"), (3, 2, "assistant", "&#10;")]
    made = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)))
    got = {r["conv_id"]: r for r in made.withColumn("back", chat_format.parse(F.col("formatted"))).collect()}
    for conv in (1, 2, None, 3):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: -1 if r[1] is None else r[1])
        assert [(t["role"], t["text"]) for t in got[conv]["back"]] == [(r[2] or "", r[3] or "") for r in own]
        assert "".join(s["text"] for s in got[conv]["segments"]) == got[conv]["formatted"]
        assert [s["loss"] for s in got[conv]["segments"]] == [x for r in own for x in (False, r[2] == "assistant", False)]
    assert [(got[c]["valid"], got[c]["refused_turn"]) for c in (1, 2, 3)] == [(False, 2), (False, 0), (False, 0)]
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def spans_by_rule(text):
    """The contract's patterns as they are written."""
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if "0" <= c <= "9"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


@given(st.text(alphabet="a9.@-+ ()é1\n", max_size=120) | st.lists(st.sampled_from(["4111 1111 1111 1111", "a.b@c.de", "1.2.3.4", "256.1.1.1", "+1 (555) 123-4567", ".", " ", "@", "x", "-", "+49 30 1234567", "0", "00.00.00.00"]), max_size=9).map("".join))
def test_pii_base_spans(text):
    assert [(k, a, b) for k, a, b, _ in pii.find(text) if k in pii.BASE] == spans_by_rule(text)


def test_pii_scores_iban_and_long_texts(spark):
    text = "My bank account is DE89 3704 0044 0532 0130 00, not DE89 3704 0044 0532 0130 01."
    assert [(k, text[a:b]) for k, a, b, _ in pii.find(text) if k == "iban"] == [("iban", "DE89 3704 0044 0532 0130 00")]
    near, far = pii.find("please call +1 555 123 4567")[0][3], pii.find("order +1 555 123 4567")[0][3]
    assert near > far and pii.find(None) == []
    for long in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "a@" * 150_000):
        pii.find(long)
    rows = pii.spans(frame(spark, [(1, text), (1, text), (2, None), (None, "")])).collect()
    assert sorted(len(r["spans"]) for r in rows) == [0, 0, 1, 1]


def test_pii_iban_lengths_and_context():
    text = "BE68 5390 0754 7034 BANK holds it, gb82 west 1234 5698 7654 32 and DE89370400440532013000."
    assert [text[a:b] for k, a, b, _ in pii.find(text) if k == "iban"] == ["BE68 5390 0754 7034", "gb82 west 1234 5698 7654 32", "DE89370400440532013000"]
    # One character more or less than the country has, other groups, an unknown country, a wrong sum.
    for wrong in ("BE68 5390 0754 7034 1", "BE685390075470341", "BE68 5390 0754 703", "BE68 539 00754 7034", "ZZ68 5390 0754 7034", "BE69 5390 0754 7034"):
        assert [k for k, a, b, _ in pii.find(wrong) if k == "iban" and b - a != 19] == []
    plain, ipsum, tell = (pii.find(f"{w} 10.0.0.1 +1 555 123 4567") for w in ("x", "ipsum", "tell"))
    assert [s for *_, s in plain] == [s for *_, s in ipsum] == [s for *_, s in tell]


def test_pii_query(spark, tmp_path):
    """op7 itself against the contract's patterns."""
    texts = ["mail a.b@c.de or 10.0.0.1, card 4111 1111 1111 1111", None, "", "+1 (555) 123-4567 is DE89 3704 0044 0532 0130 00", "x" * 100_000 + " 1.2.3.4", "1.2.3.4", "1.2.3.4"]
    clashing(frame(spark, list(enumerate(texts)))).drop("spans").withColumn("spans", F.lit(1)).write.parquet(f"{tmp_path}/a/documents.parquet")
    frame(spark, []).write.parquet(f"{tmp_path}/b/documents.parquet")
    for r in pii.op7_pii(spark, f"{tmp_path}/a").collect():
        base = spans_by_rule(texts[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in base) for k in pii.BASE]
        assert r["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        assert r["spans"].startswith(",".join(f"{k}:{a}:{b}" for k, a, b in base)) and ("iban:" in r["spans"]) == (r["doc_id"] == 3)
    assert pii.op7_pii(spark, f"{tmp_path}/b").collect() == []


def test_pii_iban_before_upper_case_words():
    for iban, rest in (("ES9121000418450200051332", " 2024-01-01"), ("BE68 5390 0754 7034", " NOW"), ("BE68539007547034", " 12 EUR"), ("BE68539007547034", " BE68539007547034")):
        found = [(iban + rest)[a:b] for k, a, b, _ in pii.find(iban + rest) if k == "iban"]
        assert found[0] == iban and len(found) == 1 + (rest.strip() == iban)
    assert not [x for x in pii.find("BE68539007547035 12 EUR ABE68539007547034") if x[0] == "iban"]
    pii.find("AA11 " * 20_000)


def test_language_stage_without_labels(spark):
    docs = frame(spark, [(1, "some words"), (2, None), (3, "12 34"), (4, "слова"), (None, "x")]).withColumn("lang", F.lit(None).cast("string"))
    model = language_id.train(docs)
    assert model.languages == []
    assert {r["text"] for r in language_id.identified(docs, model).collect()} == {"some words", "слова", "x"}


def test_decontaminate_near_match_at_the_start(spark):
    docs = frame(spark, [(1, "brown quick fox"), (2, "quick fox"), (3, "quick fox and then more brown")])
    bench = spark.createDataFrame([(1, "quick brown fox")], "item_id long, text string")
    near = decontaminate.matches(docs, bench, slop=2).collect()
    assert {(r["doc_id"], r["start"], r["kind"]) for r in near if r["doc_id"] == 1} == {(1, 0, "near")}
    assert decontaminate.matches(docs, bench).collect() == []


def test_decontaminate(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(40)]
    bench = [(k, " ".join(rng.choice(vocabulary, n))) for k, n in enumerate([30, 12, 10, 10, 3, 1])] + [(10, None), (11, "..."), (12, "Ünique wörd")]
    bench.append((13, bench[2][1].upper()))
    docs = [(k, " ".join(rng.choice(vocabulary, 40)) + ", " + " ".join(bench[k % 9][1].split(" ")[:11] if bench[k % 9][1] else []) + " tail") for k in range(60)]
    docs += [(100, None), (101, ""), (102, bench[1][1]), (102, bench[3][1]), (None, bench[0][1]), (103, "w1 " * 30_000)]
    b = spark.createDataFrame([(k, t, "x") for k, t in bench], "item_id long, text string, doc_id string")
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for k, t in bench:
        w = split(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(k))
    want = []
    for d, t in docs:
        w, hit, items = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    items |= own
        want.append((d, len(w), len(hit), ",".join(sorted(items))))
    got = decontaminate.summary(clashing(frame(spark, docs)), b).select("doc_id", "n_words", "n_hit", F.array_join("items", ",")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    clean = decontaminate.clean(clashing(frame(spark, docs)), b)
    assert clean.columns == clashing(frame(spark, docs)).columns
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _, h, _ in want if not h} - ({102} if any(h for d, _, h, _ in want if d == 102) else set())
    near = decontaminate.matches(frame(spark, [(1, "the quick brown red fox jumps over a lazy dog now and then")]), spark.createDataFrame([(1, "quick brown fox jumps over")], "item_id long, text string"), slop=2)
    assert [(r["kind"], r["item_id"]) for r in near.collect()] == [("near", "1")]
    assert decontaminate.summary(frame(spark, []), b).collect() == []
    nothing = decontaminate.summary(frame(spark, docs), b.where("false"), slop=2).agg(F.sum("n_hit"), F.sum("n_near"), F.count("*")).first()
    assert tuple(nothing) == (0, 0, len(docs))


def near_by_rule(docs, bench, slop, length=10):
    """Near matches a document, window by window, by the docstring's rule."""
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())
    words = [(d, split(t)) for d, t in docs]
    df = {}
    for _, w in words:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    windows = {tuple(w[i : i + length]) for _, t in bench for w in [split(t)] if w for i in range(max(1, len(w) - length + 1))}
    out = []
    for d, w in words:
        n = 0
        for x in windows:
            if len(x) > 1 and all(t in df for t in x):
                (_, o1, t1), (_, o2, t2) = sorted((df[t], o, t) for o, t in enumerate(x))[:2]
                for s in [p - o1 for p in range(len(w)) if w[p] == t1 and p - o1 >= -slop]:
                    placed = any(0 <= s + o2 + k < len(w) and w[s + o2 + k] == t2 for k in range(-slop, slop + 1))
                    n += placed and set(x) <= set(w[max(0, s - slop) : s + len(x) + slop]) and not (s >= 0 and tuple(w[s : s + len(x)]) == x)
        out.append((d, n))
    return out


@pytest.mark.parametrize("slop", [1, 2, 4])
def test_near_matches_by_rule(spark, slop):
    rng = np.random.default_rng(slop)
    vocabulary = [f"w{i}" for i in range(25)]
    bench = [(k, " ".join(rng.choice(vocabulary, n))) for k, n in enumerate([14, 10, 6, 3, 2, 1])]
    docs = []
    for k in range(40):
        own = bench[k % 6][1].split(" ")
        i, j = rng.integers(0, len(own), 2)
        own[i], own[j] = own[j], own[i]
        own.insert(int(rng.integers(0, len(own))), "extra")
        docs.append((k, " ".join([*rng.choice(vocabulary, 8), *own, *rng.choice(vocabulary, k % 3)][8 * (k % 2) :])))
    docs += [(90, None), (91, bench[0][1]), (92, bench[0][1][3:])]
    want = near_by_rule(docs, bench, slop)
    got = decontaminate.summary(frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string"), slop=slop).select("doc_id", "n_near").collect()
    assert {tuple(r) for r in got} == set(want) and sum(n for _, n in want) > 10


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    lengths = np.array([5, 0, 1, 300, 128, 129, 256, 2])
    scores = rng.normal(0, 4, (lengths.sum(), 3)).astype(np.float32)
    path, at = language_id.viterbi(scores, lengths, 5.0), 0
    value = lambda s, p: sum(s[i, x] for i, x in enumerate(p)) - 5 * sum(a != b for a, b in zip(p, p[1:]))
    for n in lengths:
        own = scores[at : at + n]
        if n:
            best = own[0].copy()
            for row in own[1:]:
                best = np.maximum(best, best.max() - 5) + row
            assert value(own, path[at : at + n]) == pytest.approx(best.max(), abs=1e-2)
        at += n


def test_viterbi_with_many_labels():
    """More labels than a byte holds; and memory that does not grow with their square."""
    rng = np.random.default_rng(1)
    lengths = np.array([40, 3, 1, 700])
    scores = -rng.exponential(6, (lengths.sum(), 200)).astype(np.float32)
    scores[10:20, 180] = scores[50:400, 199] = 0
    for segment in (None, 16):
        path, at = language_id.viterbi(scores, lengths, 9.0, segment), 0
        assert (path[12:18] == 180).all() and (path[60:390] == 199).all() and path.min() >= 0
        for n in lengths:
            own, best = scores[at : at + n].astype(float), None
            for row in own:
                best = row if best is None else np.maximum(best, best.max() - 9) + row
            made = path[at : at + n]
            assert own[np.arange(n), made].sum() - 9 * (np.diff(made) != 0).sum() == pytest.approx(best.max(), abs=1e-2)
            at += n


def languages_by_rule(rows, held):
    """lang_pred, score and spans of every row, word by word, by the docstring's rules."""
    import math

    word, scripts = re.compile(r"[^\W\d_]+"), language_id.SCRIPT_NAMES
    bucket = lambda a, b, c: ((ord(a) * 0x9E3779B1 ^ ord(b) * 0x85EBCA77 ^ ord(c) * 0xC2B2AE3D) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 48
    grams = lambda w: [bucket(*f" {w} "[i : i + 3]) for i in range(len(w))]
    counts, words = {}, {}
    for d, t, lang in rows:
        if d is not None and d not in held and t is not None and lang is not None:
            for w in word.findall(t.lower()):
                words.setdefault(lang, {}).setdefault(language_id.script_of(w), []).append(w)
                for g in grams(w):
                    own = counts.setdefault(lang, {})
                    own[g] = own.get(g, 0) + 1
    names = sorted(counts)
    every = {g: sum(counts[x].get(g, 0) for x in names) for x in names for g in counts[x]}
    total, all_grams, weight = {x: sum(counts[x].values()) for x in names}, sum(every.values()), language_id.SMOOTH * 1000
    chance = lambda x, g: math.log((counts[x].get(g, 0) + weight * (every.get(g, 0) + 1) / (all_grams + language_id.BUCKETS)) / (total[x] + weight))
    used = {x: {k for k in range(len(scripts)) if len(words[x].get(k, ())) >= language_id.SCRIPT_SHARE * max(1, sum(map(len, words[x].values())))} for x in names}
    out = []
    for d, t, _ in rows:
        said = word.findall((t or "").lower())
        told = []
        for w in said:
            plain = [sum(chance(x, g) for g in grams(w)) for x in names]
            inside = [language_id.script_of(w) in used[x] for x in names]
            told.append([v if i else min(plain) - 20 for v, i in zip(plain, inside)] if any(inside) else [0.0] * len(names))
        value, back = None, []
        for row in told:
            if value is None:
                value = row
                continue
            top = max(range(len(names)), key=lambda k: value[k])
            back.append([k if value[k] >= value[top] - language_id.PENALTY else top for k in range(len(names))])
            value = [value[b] - language_id.PENALTY * (b != k) + row[k] for k, b in enumerate(back[-1])]
        path = []
        if value is not None:
            path = [max(range(len(names)), key=lambda k: value[k])]
            for step in reversed(back):
                path.append(step[path[-1]])
            path.reverse()
        letters = [sum(c.isalpha() for c in w) for w in said]
        share = [sum(n for n, p in zip(letters, path) if p == k) for k in range(len(names))]
        spans = sum(a != b for a, b in zip([None, *path], path))
        out.append((d, "und", 0.0, spans) if not sum(share) else (d, names[max(range(len(names)), key=lambda k: share[k])], max(share) / sum(share), spans))
    return out


def test_language_id_by_rule(spark):
    rng = np.random.default_rng(7)
    stems = {"en": "the house and garden of other day was this".split(), "de": "der hund und die katze sind nicht haus".split(), "ru": "это дом и сад другой день был".split(), "fr": "le chien et la maison ne sont pas".split()}
    rows = []
    for k in range(90):
        lang = sorted(stems)[k % 4]
        own = [*rng.choice(stems[lang], 25), *rng.choice(stems[sorted(stems)[(k // 4) % 4]], 20 * (k % 3 == 0))]
        rows.append((k, " ".join(own), lang if k % 5 else None))
    rows += [(200, None, "en"), (201, "", None), (202, "12 34", "de"), (203, "\u03b1\u03b2\u03b3 \u03b4", None), (204, "the дом " * 200, None), (None, "der hund", "de"), (3, "the house", "en"), (205, "\u00bd \u2167 a", None)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    held = {r["doc_id"] for r in df.where(language_id.held_out() == 1).select("doc_id").collect()}
    got = language_id.predict(df, language_id.train(df)).collect()
    want = languages_by_rule(rows, held)
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2]) and a[3] == b[3], (a, b)
    assert language_id.predict(df.where("false"), language_id.train(df)).collect() == []


def test_language_stage_by_share(spark):
    df = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate([("the house and the garden", "en"), ("der hund und die katze", "de")] * 30)] + [(900, "the house and the garden of the house der hund und die katze sind der hund", None)], "doc_id long, text string, lang string")
    model = language_id.train(df)
    assert language_id.identified(df, model).count() == 61
    assert {r["doc_id"] for r in language_id.identified(df, model, 0.9).collect()} == set(range(60))


def test_language_id(spark):
    en, de = "the house and the garden of the other day was this", "der hund und die katze sind nicht in dem haus mit"
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(rng.choice((en if k % 2 else de).split(), 30)), "en" if k % 2 else "de") for k in range(80)]
    rows += [(200, None, "en"), (201, "123 !!", "de"), (202, "Привет мир", None), (203, en + " " + de, None), (None, en, "en"), (204, "", None), (205, "½ Ⅷ²", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df)
    got = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    assert all(got[k]["lang_pred"] == lang for k, _, lang in rows[:80])
    assert [got[k]["lang_pred"] for k in (200, 201, 204, 205)] == ["und"] * 4 and got[200]["score"] == 0
    assert got[202]["lang_pred"] in ("de", "en") and 0 < got[203]["score"] < 1 and got[203]["n_spans"] == 2
    mixed = [(r["lang"], r["start"], r["end"]) for r in language_id.spans(df.where("doc_id = 203"), model).collect()]
    assert mixed == [("en", 0, len(en)), ("de", len(en) + 1, len(en + de) + 1)]
    nothing = language_id.train(df.where("false"))
    assert {r["lang_pred"] for r in language_id.predict(df, nothing).collect()} == {"und"}
    assert language_id.identified(df, model).count() == len(rows) - 4
