"""The pipeline against brute force, stage by stage, and the registry's names."""

import hashlib
import re

import numpy as np
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from skein.llm import bpe
from skein.llm.simhash_dedup import fingerprint

WORDS = {"en": "the of and house garden other day this that with from river stone light".split(), "de": "der die und haus garten andere tag nicht mit von fluss stein licht auch".split(), "fr": "le chien est dans une maison avec la pluie pour toujours elle".split()}


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def corpus():
    rng = np.random.default_rng(8)
    line = lambda lang, n: " ".join(rng.choice(WORDS[lang], n))
    footer, item = "All rights reserved by the makers of this page.", line("en", 14)
    rows = []
    for k in range(60):
        lang = "fr" if k % 7 == 3 else "en" if k % 3 else "de"
        rows.append([k, "\n".join(line(lang, 12) for _ in range(6)), lang])
        if k % 5 == 0:
            rows[-1][1] += "\n" + footer
    rows += [[100 + k, rows[k][1] + " end" * (k % 2), rows[k][2]] for k in range(0, 20, 4)]
    rows += [[200, None, "en"], [201, "", "en"], [202, "12 34", None], [203, item, None], [204, line("de", 20) + "\n" + low(item).upper() + " more", "de"], [205, footer, "en"]]
    rows += [[MIXED, "\n".join(line(lang, 12) for lang in ("en", "de", "fr") for _ in range(2)), "en"], [MIXED + 1, "\n".join(line(lang, 12) for lang in ("en", "en", "en", "fr", "de")), None]]
    return rows, [(1, item), (2, None), (3, line("de", 30))]


#: A document in three languages, a third each: none has half of its letters. The next one has one for the most part.
MIXED = 300


def brute(rows, bench):
    docs = {d: t for d, t, _ in rows if t and any(c.isalpha() for c in t) and d != MIXED}
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for d, t in docs.items():
        for x in t.split("\n"):
            if len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(d)
    docs = {d: "\n".join(x for x in t.split("\n") if len(holders.get(key(x), ())) < 3 or d == max(holders[key(x)])) for d, t in docs.items()}
    ids = sorted(docs)
    prints = {d: int.from_bytes(fingerprint(docs[d])) for d in ids}
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    docs = {d: docs[d] for d in ids if find(d) == d}
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t or ""))
    windows = {tuple(w[i : i + 10]) for _, t in bench for w in [split(t)] if w for i in range(max(1, len(w) - 9))}
    docs = {d: t for d, t in docs.items() if not any(tuple(split(t)[i : i + n]) in windows for n in {len(w) for w in windows} for i in range(len(split(t))))}
    library = Tokenizer.from_file(bpe.default_path())
    out = set()
    for d, t in docs.items():
        made = library.encode(t, add_special_tokens=False).ids
        out.add((d, len(made), hashlib.sha256(np.array(made, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(made, skip_special_tokens=False).encode()).hexdigest()))
    return out


def test_run(spark, tmp_path):
    rows, bench = corpus()
    spark.createDataFrame([(d, t, lang, "src", len(t or "")) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = brute(rows, bench)
    assert got == want and 40 < len(want) < 66 and MIXED + 1 in {r[0] for r in want}


def test_run_over_clashing_columns_repeated_rows_and_nothing(spark, tmp_path):
    rows, bench = corpus()
    own = " ".join(f"'own' AS {c}" + "," for c in ("doc", "kept", "row", "hits", "words", "fp", "_kept", "_words"))[:-1].split(",")
    docs = spark.createDataFrame([(d, t, lang, "src", len(t or "")) for d, t, lang in [*rows, *rows[:3], (None, "the house and a garden that nobody gave an id to", "en")]], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *own)
    spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "'own' AS terms", "1 AS wid").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/a").cache()
        assert docs.columns[-8:] == ["doc", "kept", "row", "hits", "words", "fp", "_kept", "_words"], name
    assert {r["doc_id"] for r in docs.collect()} - {None} == {r[0] for r in brute(rows, bench)}
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").collect() == []


def test_stages_and_registry():
    names = __spark_entry__.queries()
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "decontaminate", "bpe"]
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
