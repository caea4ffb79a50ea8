import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from artiscope.llm import packing as pk


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(pk.tokenizer_file())


ODD = ["", "Don't STOP'S we'LL ''s 's", "naïve İstanbul ΣΑΣ ſ ﬁ é a\u0085b c\x1cd", "1234 x² ½ ¼ _ __ \U0001f600\U0001f600", "<|endoftext|> <|startoftext|>x", "<|EndOfText|> a...b. c?! 'S. 9. x9: «é». ***.", "a" * 30_000, "\t\r\n", "Ǆ ß ẞ"]


def test_encoder_equals_the_tokenizer(spark, sf_dir, tokenizer):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    enc = pk.Encoder(pk.tokenizer_file())
    for t, got in zip(texts, enc.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def check_plan(bins, hist, capacity):
    held = Counter()
    for p, m in bins.items():
        assert m > 0 and sum(p) <= capacity
        for x in p:
            held[x] += m
    assert held == +Counter(hist)


def test_individuals_pack_everything_once():
    rng = random.Random(2)
    for _ in range(30):
        hist = Counter({rng.randint(1, 100): rng.randint(1, 40) for _ in range(rng.randint(1, 60))})
        a, b = pk.fill(hist, 100), pk.fill(hist, 100, rng)
        check_plan(a, hist, 100)
        check_plan(b, hist, 100)
        child = pk.cross(a, b, hist, 100, rng)
        check_plan(child, hist, 100)
        best = pk.evolve(hist, 100, 1, [a], 4, 6)
        check_plan(best, hist, 100)
        assert pk.n_bins(best) <= pk.n_bins(a)


@pytest.mark.parametrize(
    "hist",
    [
        {28: 24, 45: 17, 48: 5, 47: 28, 30: 24, 59: 16, 44: 23, 39: 18},
        {29: 14, 35: 14, 40: 23, 31: 25, 54: 12, 34: 25},
        {50: 14, 30: 26, 53: 8, 47: 17, 31: 23, 20: 19, 40: 10, 39: 25},
    ],
)
def test_evolution_beats_greedy_and_as_many_random_starts(hist):
    """Fewer bins than the greedy filling, and than as many random fillings as the evolution makes children: crossover does it."""
    hist = Counter(hist)
    rng = random.Random(3)
    starts = [pk.fill(hist, 100), *(pk.fill(hist, 100, rng) for _ in range(66))]
    best = pk.evolve(hist, 100, 3, [], 20, 6)
    check_plan(best, hist, 100)
    assert pk.n_bins(best) < min(map(pk.n_bins, starts))


def test_islands_beat_greedy_and_migrate(spark):
    hist = Counter({28: 24, 45: 17, 48: 5, 47: 28, 30: 24, 59: 16, 44: 23, 39: 18})
    best = pk.islands(spark, hist, 100)
    check_plan(best, hist, 100)
    assert pk.n_bins(best) < pk.n_bins(pk.fill(hist, 100))


def valid(rows, texts, tokenizer, capacity):
    by_seq = {}
    docs = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
    for places in by_seq.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    for k, t in texts.items():
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        parts = sorted(docs[k], key=lambda r: r.piece)
        assert [p.start for p in parts] == list(range(0, len(ids), capacity))
        assert [p.ids_crc32 for p in parts] == [zlib.crc32(ids[s : s + capacity].tobytes()) for s in range(0, len(ids), capacity)]
    total = sum(r.length for r in rows)
    return len(by_seq), -(-total // capacity)


def test_small_table_is_packed_tightly(spark, sf_dir, tokenizer):
    rows = pk.op5_genetic_packing(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got, least = valid(rows, texts, tokenizer, pk.CAPACITY)
    assert got <= least + 1


def test_odd_rows(spark, tokenizer):
    texts = dict(enumerate([*ODD, None, "b " * 100]))
    docs = spark.createDataFrame([(k, t, 7) for k, t in texts.items()], "doc_id long, text string, length int")
    valid(pk.pack(docs, pk.tokenizer_file(), 64).collect(), texts, tokenizer, 64)
    twice = spark.createDataFrame([(1, "x"), (1, "x"), (None, None)], "doc_id long, text string")
    assert pk.pack(twice, pk.tokenizer_file(), 64).count() == 3
    assert pk.pack(docs.limit(0), pk.tokenizer_file()).count() == 0
