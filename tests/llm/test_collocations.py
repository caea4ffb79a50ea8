import random
import re
from collections import Counter

import pytest

from artiscope.llm import collocations as co


def brute(rows, top, least):
    """Contract, word by word."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").encode().lower().decode()):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    dead = {(g, w[i : i + 2]) for (g, w), a in cand.items() if len(w) == 3 for i in (0, 1) if 100 * a >= 50 * f[g, w[i : i + 2]]}
    out = {}
    for (g, w), a in cand.items():
        if (g, w) not in dead:
            s, k = min((10**6 * a * a // (f[g, w[:k]] * f[g, w[k:]]), k) for k in range(1, len(w)))
            out.setdefault(g, []).append((-s, -a, " ".join(w).encode(), f[g, w[:k]], f[g, w[k:]]))
    return sorted((g, r, p.decode(), -a, x, y, n[g], -s) for g, found in out.items() for r, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1))


def corpus(seed, docs=300):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["Été", "École", "x\x00y", "naïve's"]
    fixed = ["New York", "new york city", "in spite of", "a\tb  c", "rare pair", "W1 w2 w3"]
    rows = []
    for _ in range(docs):
        words = [rng.choice(fixed) if rng.random() < 0.15 else vocab[min(int(rng.expovariate(0.12)), len(vocab) - 1)] for _ in range(rng.randrange(60))]
        rows.append((rng.choice(["en", "fr", None, "und", ""]), "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?"]) for w in words)))
    return rows + [(None, None), ("en", ""), ("xx", "... \t"), ("yy", "one two three")] + [("zz", "tie one tie two tie one tie two")] * 12


@pytest.mark.parametrize(("top", "least", "slack"), [(2000, 10, 2), (5, 3, 1), (30, 2, 1), (12, 10, 2), (1, 2, 1)])
def test_brute_force(spark, top, least, slack):
    rows = corpus(top)
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "lang string, text string, rank string")
    got = co.mine(docs, top=top, least=least, slack=slack).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == brute(rows, top, least)


def test_guesses_go_deeper_until_settled(spark, monkeypatch):
    # frequent pairs all swallowed by longer phrases, so the first guess yields too few
    rows = [("en", ". ".join(f"a{i} b{i} c{i}" for i in range(40)))] * 12 + [("en", ". ".join(f"p{i} q{i % 7}" for i in range(60)))] * 11
    passes = []
    monkeypatch.setattr(co, "count_grown", lambda *a, f=co.count_grown: passes.append(1) or f(*a))
    got = co.mine(spark.createDataFrame(rows, "lang string, text string"), top=50, slack=1).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == brute(rows, 50, 10)
    assert len(passes) >= 2


def test_slices_lose_nothing(monkeypatch):
    texts = [r[1].encode() for r in corpus(7) if r[1]] + [b"no delimiter " * 50]
    monkeypatch.setattr(co, "SLICE", 64)
    whole = Counter(x for t in texts for x in t.translate(co.FOLD).split(b"\n") if x)
    assert Counter(x for part in co._slices(texts) for x in part.split(b"\n") if x) == whole


def test_bit_table_holds_what_it_was_given(spark):
    import numpy as np

    pairs = [("en", f"p{i} é{i}") for i in range(500)]
    table = co.bit_table(spark.createDataFrame(pairs, "lang string, phrase string"))
    assert co._has(table, co.slot("en", [p.encode() for _, p in pairs])).all()
    assert np.mean(co._has(table, co.slot("fr", [p.encode() for _, p in pairs]))) < 0.01


def test_large_counts_stay_exact(spark):
    rows = [(3 * 10**15, 4 * 10**15, 5 * 10**15), (10**18, 10**18, 10**18), (10, 10, 10)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select(co.score("a", "l", "r").alias("s")).collect()
    assert [r.s for r in got] == [10**6 * a * a // (x * y) for a, x, y in rows]


def test_empty_table(spark):
    assert co.mine(spark.createDataFrame([], "lang string, text string")).count() == 0
