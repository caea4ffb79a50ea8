import random

import pytest

from artiscope.llm import decontaminate as dc


def brute_scores(index, terms):
    total = {}
    for t in terms:
        for k, s in index.postings[t]:
            total[k] = total.get(k, 0) + s
    return total


def test_wand_against_full_scoring():
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(120)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 25)))) for k in range(90)]
    index = dc.Index(items, block=4)
    for _ in range(150):
        terms = sorted({index.term[w] for w in (rng.choice(vocab) for _ in range(40)) if w in index.term})
        for threshold in (0.2, 0.4, 0.7):
            want = {k: s for k, s in brute_scores(index, terms).items() if s >= threshold - 1e-9}
            got = dict(index.wand(terms, threshold))
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def brute(texts, items, overlap=dc.OVERLAP):
    out = set()
    for d, t in texts.items():
        ws = dc.words(t)
        for i, x in items.items():
            iw = dc.words(x)
            n = min(dc.SHINGLE, len(iw))
            want = dc.shingles(iw, n) if n else set()
            longest = max(len(dc.words(y)) for y in items.values())
            if want and any(len(want & dc.shingles(ws[s : s + 2 * longest], n)) / len(want) >= overlap for s in range(0, max(1, len(ws)), longest)):
                out.add((d, i))
    return out


def test_documents_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()}
    got = {(r.doc_id, r.item_id) for r in dc.op6_bm25_decontamination(spark, sf_dir).collect()}
    assert got == brute(texts, items) and got


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = {k: " ".join(say(rng.randint(12, 40))) + ". " + " ".join(say(6)) + "." for k in range(30)}
    texts = {}
    for k in range(80):
        body = say(rng.randint(0, 600))
        if k % 4 == 0:
            at = rng.randint(0, len(body))
            leak = items[k % 30].split()
            if k % 8 == 0:
                leak[len(leak) // 2] = "edited"
            body[at:at] = leak
        texts[k] = " ".join(body).upper() if k % 5 == 0 else " ".join(body)
    return texts, items


def test_planted_leaks_in_several_shards(spark, planted):
    texts, items = planted
    docs = spark.createDataFrame([(k, t, 1.0) for k, t in texts.items()], "doc_id long, text string, score double")
    bench = spark.createDataFrame([*items.items(), (99, None), (98, ""), (97, "...")], "item_id long, text string")
    want = brute(texts, items)
    for size in (1024, 7):
        rows = dc.search(docs, bench, shard_items=size).collect()
        assert {(r.doc_id, r.item_id) for r in rows} >= {(k, k % 30) for k in range(0, 80, 4) if k % 8 or len(items[k % 30].split()) > 30}
    assert {(r.doc_id, r.item_id) for r in dc.search(docs, bench).collect()} == want
    kept = dc.clean(docs, bench, shard_items=11)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(texts) - {d for d, _ in want}


def test_odd_rows(spark, planted):
    _, items = planted
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, items[3]), (3, items[3]), (None, items[4] + " x" * 50_000)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.item_id) for r in dc.search(docs, bench).collect()))
    assert got == [(0, 4), (3, 3), (3, 3)]
    assert dc.search(docs.limit(0), bench).count() == 0
    assert dc.search(docs, bench.limit(0)).count() == 0 and dc.clean(docs, bench.limit(0)).count() == 5


def test_questions_leak_without_their_answers(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(900)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    asked = {k: say(rng.randint(8, 25) if k < 20 else 5) for k in range(24)}
    told = {k: say(rng.randint(15, 40)) for k in asked}
    items = {k: " ".join(asked[k]) + "? " + " ".join(told[k]) + "." for k in asked}
    assert all(dc.question_and_answer(items[k]) == (asked[k], told[k]) for k in items)
    texts = {}
    for k in items:
        texts[k] = say(rng.randint(0, 500)) + asked[k] + say(rng.randint(0, 500))
        texts[100 + k] = say(90) + told[k] + say(70)
        half = len(asked[k]) // 2
        texts[200 + k] = say(90) + asked[k][:half] + ["edited"] + asked[k][half + 1 :] + say(90)
    docs = spark.createDataFrame([(k, " ".join(ws)) for k, ws in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    near = lambda k: len(asked[k]) - 4 - 5 >= dc.OVERLAP * (len(asked[k]) - 4)
    shares = {k: len(dc.shingles(told[k], 5)) / len(dc.shingles(asked[k] + told[k], 5)) for k in items}
    want = {(k, k) for k in range(20)} | {(200 + k, k) for k in range(20) if near(k)} | {(100 + k, k) for k in items if shares[k] >= dc.OVERLAP}
    for size in (1024, 7):
        rows = dc.search(docs, bench, shard_items=size).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want)
        assert all(r.question_overlap == 1 and r.overlap < dc.OVERLAP for r in rows if r.doc_id < 20)
        assert {r.doc_id for r in dc.clean(docs, bench, shard_items=size).collect()} == set(texts) - {d for d, _ in want}


def test_recall_of_the_gate_on_the_larger_table(spark):
    """Items that repeat in a document anywhere, by shingles of whole texts, against what retrieval and verification find."""
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r.item_id: dc.shingles(dc.words(r.text), dc.SHINGLE) for r in bench.collect()}
    holders = {}
    for i, want in items.items():
        for g in want:
            holders.setdefault(g, []).append(i)
    want = set()
    for r in docs.select("doc_id", "text").collect():
        seen = {}
        for g in dc.shingles(dc.words(r.text), dc.SHINGLE):
            for i in holders.get(g, ()):
                seen[i] = seen.get(i, 0) + 1
        want |= {(r.doc_id, i) for i, n in seen.items() if n >= dc.OVERLAP * len(items[i])}
    found = {(r.doc_id, r.item_id) for r in dc.search(docs, bench).collect()}
    assert len(want) > 10 and len(found & want) >= 0.9 * len(want)


def test_passes_of_several_indexes_equal_one(spark, sf_dir, monkeypatch):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    pairs = lambda df: {(r.doc_id, r.item_id) for r in df.collect()}
    want = pairs(dc.search(docs, bench, shard_items=30))
    monkeypatch.setattr(dc, "PASS_INDEXES", 1)
    assert pairs(dc.search(docs, bench, shard_items=30)) == want
