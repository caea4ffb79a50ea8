import random

import pytest

from artiscope.llm import jaccard_groups as jg
from artiscope.llm.components import components


def shingle_set(text, n):
    ws = (text or "").encode().translate(jg._LOWER).split()
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)) or frozenset([tuple(ws)])


def brute(rows, n, num, den):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingle_set(t, n)) for i, t in rows]
    by = {}
    for i, s in sets:
        for w in s:
            by.setdefault(w, []).append((i, s))
    seen = set()
    for group in by.values():
        for k, (i, a) in enumerate(group):
            for j, b in group[:k]:
                if (i, j) in seen:
                    continue
                seen.add((i, j))
                inter = len(a & b)
                if den * inter >= num * (len(a) + len(b) - inter):
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def corpus(seed, families=12, size=14, length=60, edits=3):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    common = [rng.choice(vocab) for _ in range(25)]
    rows = []
    for f in range(families):
        base = [rng.choice(vocab) for _ in range(rng.randint(20, length))]
        for _ in range(rng.randint(1, size)):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            if rng.random() < 0.3:
                copy[:0] = common
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


def run(spark, rows, **how):
    got = jg.join(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in got)


@pytest.mark.parametrize("n,num,den,length,edits", [(3, 90, 100, 60, 3), (5, 80, 100, 90, 3), (3, 90, 100, 12, 1)])
def test_random_near_copies_against_brute_force(spark, monkeypatch, n, num, den, length, edits):
    monkeypatch.setattr(jg, "GROUP", 5)
    monkeypatch.setattr(jg, "QUERIES_PER_TASK", 4)
    rows = corpus(n * length, length=max(length, 21), edits=edits)
    assert run(spark, rows, n=n, num=num, den=den) == brute(rows, n, num, den)


def test_hot_star_and_chain(spark, monkeypatch):
    monkeypatch.setattr(jg, "GROUP", 8)
    rng = random.Random(9)
    base = [f"b{k}" for k in range(100)]
    rows = [(1000, " ".join(base))]
    for k in range(120):
        copy = list(base)
        for _ in range(2):
            copy[rng.randrange(100)] = f"x{k}"
        rows.append((k, " ".join(copy)))
    chain = [f"c{k}" for k in range(80)]
    for k in range(40):
        rows.append((2000 + k, " ".join(chain[:])))
        chain[(k * 7) % 80] = f"y{k}"
    assert run(spark, rows) == brute(rows, 3, 90, 100)


def test_whole_small_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jg.op7_token_group_join(spark, sf_dir).collect())
    assert got == brute(rows, 3, 90, 100)
    assert any(i != c for i, _, c in got)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "One TWO"), (4, "one two"), (5, "one  two three"), (5, "one  two three"), (6, "one\ntwo\tthree É"), (None, "one two three"), (7, "é b c"), (8, "É b c"), (9, "z " * 30_000), (10, "z z z")]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, node string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jg.join(docs).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (5, 1, 5), (5, 1, 5), (6, 2, 6), (None, 1, None), (7, 1, 7), (8, 1, 8), (9, 1, 9), (10, 1, 9)], key=str)
    kept = jg.keep_one(docs, 3, 90, 100)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 5, 6, None, 7, 8, 9]))
    assert jg.join(docs.limit(0)).count() == 0 and jg.keep_one(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_join_their_sets(spark):
    rows = [(3, "a b c"), (5, "a b c"), (5, "d e f"), (9, "d e f"), (7, "g h i")]
    assert run(spark, rows) == [(3, 1, 3), (5, 1, 3), (5, 1, 3), (7, 1, 7), (9, 1, 3)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
