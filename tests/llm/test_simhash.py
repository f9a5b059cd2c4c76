import numpy as np
import pandas as pd
import pytest
import xxhash

from skein.llm import simhash_dedup as S


def brute(rows):
    """doc_id, text -> fingerprint hex and least id of the component, by all pairs."""
    fps = []
    for _, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
        grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {(d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)}


def test_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):
        base = " ".join(rng.choice(words, 60))
        rows.append((len(rows), base))
        for _ in range(i % 4):
            parts = base.split(" ")
            parts[int(rng.integers(60))] = "Changed"
            rows.append((len(rows), " ".join(parts)))
    rows += [(1000, ""), (1001, None), (1002, " \t\n"), (1003, "one two"), (1004, "ONE\ttwo"), (1005, "Ä B c D É"), (1006, "x " * 70_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"'own' AS {c}" for c in ("fp", "row", "doc", "root", "component_id", "id", "none")])
    assert {tuple(r) for r in S.near_duplicates(df).collect()} == brute(rows)


def test_forest_finds_every_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False)) for _ in range(1500)], np.uint64)
    fps = np.unique(np.concatenate((base, base ^ flips)))
    truth = {(i, j) for i, j in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4)) if i < j}
    found = set()
    for mask, radius in S.masks():
        tree = S.Tree.fit(fps, mask, radius, 40)
        home, (row, leaf) = tree.route(fps)
        assert (home >= 0).all() and len(set(home)) > 10
        asks = {(int(r), int(x)) for r, x in zip(row, leaf)} | {(r, int(h)) for r, h in enumerate(home)}
        found |= {(i, j) for i, j in truth if (i, home[j]) in asks and (j, home[i]) in asks}
    assert found == truth


@pytest.mark.parametrize("within", [True, False])
def test_cells_span_the_links(within):
    rng = np.random.default_rng(9)
    center = np.uint64(12345678901234567)
    own = np.unique(center ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(400)], np.uint64))
    here, asking = own[:150], own[150:]
    u, v = S.linked(here, asking, within)
    rows = np.concatenate((here, asking))
    near = np.bitwise_count(rows[:, None] ^ rows[None]) <= 4
    if not within:
        near[:150, :150] = False
    near[150:, 150:] = False
    near |= near.T

    def groups(pairs):
        root = {int(x): int(x) for x in rows}
        for a, b in pairs:
            a, b = int(a), int(b)
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        out = {}
        for x in root:
            y = x
            while root[y] != y:
                y = root[y]
            out.setdefault(y, set()).add(x)
        return sorted(map(sorted, out.values()))

    assert groups(zip(u, v)) == groups((rows[i], rows[j]) for i, j in zip(*np.nonzero(near)))


def test_large_shard_is_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(S, "CELL", 16)
    rng = np.random.default_rng(1)
    fps = pd.DataFrame({"fp": np.unique(np.array([sum(1 << int(b) for b in rng.choice(60, 3, replace=False)) for _ in range(200)], np.int64)), "least": 1})
    df = spark.createDataFrame(fps)
    edges = {tuple(r) for r in S.links(df, S.shared_dir(spark)).collect()}
    own = fps["fp"].to_numpy()
    root = {int(x): int(x) for x in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        assert bin((a ^ b) & (2**64 - 1)).count("1") >= 0
        root[find(a)] = find(b)
    got = len({find(int(x)) for x in own})
    near = np.bitwise_count(own.view(np.uint64)[:, None] ^ own.view(np.uint64)[None]) <= 4
    want, seen = 0, set()
    for i in range(len(own)):
        if i not in seen:
            want += 1
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in seen:
                    seen.add(k)
                    todo += list(np.flatnonzero(near[k]))
    assert got == want


@pytest.mark.parametrize("sample", [64, 400])
def test_leaves_are_refined_and_no_link_is_lost(spark, monkeypatch, sample):
    """A tiny sample and tiny leaves: trees below trees, with the links of brute force."""
    monkeypatch.setattr(S, "SAMPLE", sample)
    monkeypatch.setattr(S, "LEAF_ROWS", 8)
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**63, 700, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False)) for _ in range(700)], np.uint64)
    own = np.unique(np.concatenate((base, base ^ flips)))
    df = spark.createDataFrame(pd.DataFrame({"fp": own.view(np.int64), "least": 1}))
    folder = S.shared_dir(spark)
    forest = S.fit_forest(df, len(own))
    deep = S.refined(S.stored(S.shards(df, forest), f"{folder}/shards"), folder)
    assert (deep.where(f"home and leaf >= {S.LEAVES}").count() > 0) == (sample == 64)
    assert deep.where("home").groupBy("tree").count().toPandas()["count"].tolist() == [len(own)] * 3
    root = {int(x): int(x) for x in own.view(np.int64)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in S.links(df, folder + "x").collect():
        root[find(a)] = find(b)
    near = np.bitwise_count(own[:, None] ^ own[None]) <= 4
    names = own.view(np.int64).tolist()
    for i, j in zip(*np.nonzero(near)):
        assert find(names[i]) == find(names[j])
    groups = {find(x) for x in names}
    todo, want = set(range(len(own))), 0
    while todo:
        want, stack = want + 1, [todo.pop()]
        while stack:
            more = set(np.flatnonzero(near[stack.pop()]).tolist()) & todo
            todo -= more
            stack += more
    assert len(groups) == want


def test_keep_one_keeps_a_row_and_not_an_id(spark):
    a, b = "one text of some words that has copies here", "quite another thing which nobody has said before now"
    rows = [(3, a), (5, a), (5, b), (9, b), (9, b), (None, a), (None, "nobody gave an id to this one text"), (None, "nobody gave an id to this one text"), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "map('a', 1) AS extra", "'own' AS row", "'own' AS none", "1 AS `a.b`")
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(3, a), (5, b), (None, rows[6][1]), (7, None)], key=str)
    assert {(r["doc_id"], r["component_id"]) for r in S.near_duplicates(df).collect()} == {(3, 3), (5, 3), (5, 5), (9, 5), (None, 3), (None, None), (7, 7), (8, 7)}


def test_many_copies_of_one_text(spark):
    rows = [(k, "the same text for every second document" if k % 2 else f"text {k} " + " ".join(str(k * j) for j in range(9))) for k in range(400)]
    got = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == 1 for k in range(1, 400, 2)) and len(got) == 400


def test_the_shared_folder_must_be_named_on_a_cluster():
    class Conf(dict):
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        S.shared_dir(Session())


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert S.near_duplicates(df).collect() == []
    assert S.keep_one(df).columns == ["doc_id", "text", "source"]
