import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from artiscope.llm import line_crf, toxicity
from artiscope.llm._labels import held_out

WORDS = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in "rstvz"]


def make(n=600, seed=4):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        toxic, bad = k % 5 == 0, k % 4 == 1
        lines = [" ".join(rng.choice(WORDS) for _ in range(9)).capitalize() + "." for _ in range(5)]
        if toxic:
            lines[4] = f"You {rng.choice(['grubling', 'snotface'])} there."
        if bad:
            for j in (1, 2, 3):
                lines[j] = " | ".join(rng.choice(WORDS) + "***" for _ in range(6))
        docs.append((k, "\n".join(lines)))
        labels.append((k, int(not bad), int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(rows, want):
    rows = [r for r in rows if r.held_out]
    return sum(r.predicted == want[r.doc_id] for r in rows) / len(rows)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = make()
    d, lab = frames(spark, docs, labels)
    model = toxicity.train(d, lab)
    out = toxicity.score(d, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), (F.col("score") >= 0.3).cast("int").alias("predicted"))
    assert accuracy(out.collect(), {k: t for k, _, t in labels}) > 0.97
    # labels of held-out rows change nothing
    flipped = lab.withColumn("toxic", F.when(held_out("doc_id", 4, 2), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(d, flipped) == model


def plain_risk(z, n_p, prior):
    """Prior-corrected risk in plain Python, clipped at zero."""
    lose = lambda t: math.log1p(math.exp(t))
    negative = sum(map(lose, z[n_p:])) / (len(z) - n_p) - prior * sum(map(lose, z[:n_p])) / n_p
    return prior * sum(lose(-t) for t in z[:n_p]) / n_p + max(0.0, negative), negative


def test_risk_and_its_step_against_plain_sums():
    rng = np.random.default_rng(3)
    for shift in (0.0, -3.0, 2.0):
        z = rng.normal(shift, 1.0, 30)
        z[:10] += 4 if shift < 0 else 0  # positives that look positive make the difference negative
        value, step = toxicity.risk(z, 10, 0.6)
        want, negative = plain_risk(z.tolist(), 10, 0.6)
        assert math.isclose(value, want)

        def target(y):
            v, n = plain_risk(y.tolist(), 10, 0.6)
            return v if negative >= 0 else -n

        for k in range(30):
            up, down = z.copy(), z.copy()
            up[k] += 1e-5
            down[k] -= 1e-5
            assert abs((target(up) - target(down)) / 2e-5 - step[k]) < 1e-6
    assert plain_risk(np.array([4.0] * 10 + [-4.0] * 20), 10, 0.6)[1] < 0


def test_field_gradient_against_enumeration():
    rng = np.random.default_rng(5)
    sizes, weight = np.array([3, 1, 4]), np.array([0.5, 0.2, 0.3])
    x = rng.integers(0, 2, (8, line_crf.WIDTH)).astype(float)
    y = np.array([1, 0, 1, 0, 0, 0, 1, 1.0])
    theta = rng.normal(scale=0.3, size=line_crf.WIDTH + 4)

    def loss(th):
        e, t, at, out = x @ th[: line_crf.WIDTH], th[line_crf.WIDTH :].reshape(2, 2), 0, 0.0
        for n, w in zip(sizes, weight):
            value = lambda ys: sum(e[at + i] * b for i, b in enumerate(ys)) + sum(t[a, b] for a, b in zip(ys, ys[1:]))  # noqa: B023, E731
            every = [value(ys) for ys in itertools.product((0, 1), repeat=int(n))]
            out -= w * (value([int(b) for b in y[at : at + n]]) - math.log(sum(map(math.exp, every))))
            at += n
        return out + 0.01 / 2 * (th**2).sum()

    got, _ = line_crf.gradient(theta, x, y, sizes, weight, 0.01)
    for k in [*range(0, line_crf.WIDTH, 7), *range(line_crf.WIDTH, line_crf.WIDTH + 4)]:
        up, down = theta.copy(), theta.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - got[k]) < 1e-6


def test_repeated_ids_and_long_texts_are_learnt_from_once_or_not(spark, monkeypatch):
    monkeypatch.setattr(line_crf, "MAX_LINES", 40)
    docs, labels = make(120)
    d, lab = frames(spark, docs, labels)
    more, more_labels = frames(spark, [*docs, *docs[:7], (900, "spam *** " * 9000), (901, "x\n" * 200)], [*labels, *labels[:5], (900, 2, 1), (901, 1, 0)])
    a, b = line_crf.train(d, lab), line_crf.train(more, more_labels)
    assert np.allclose(a.weights, b.weights) and a.slope == b.slope
    assert len(line_crf._sample(more, more_labels.selectExpr("doc_id", "quality as label").distinct(), "doc_id", "text", 1000)) == 120


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 3), (1, None, 3), (2, "", 3), (None, "word", 3), (4, "x" * 40_000, 3)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    got = toxicity.score(docs, toxicity.train(docs, none)).collect()
    assert len(got) == 5 and all(r.score == 0 for r in got)
    assert toxicity.score(docs.limit(0), toxicity.train(docs, none)).count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = make()
    d, lab = frames(spark, docs, labels)
    field = line_crf.train(d, lab)
    out = line_crf.score(d, field).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), (F.col("score") >= 0.5).cast("int").alias("predicted"))
    assert accuracy(out.collect(), {k: q for k, q, _ in labels}) > 0.97


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 1, 5])
    score, t = rng.normal(size=9), rng.normal(size=(2, 2))
    p, pairs = line_crf.marginals(score, sizes, t)
    want, want_pairs, at = [], np.zeros((2, 2)), 0
    for n in sizes:
        total, one, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for ys in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(score[at + i] * y for i, y in enumerate(ys)) + sum(t[a, b] for a, b in zip(ys, ys[1:])))
            total += w
            one += w * np.array(ys)
            for a, b in zip(ys, ys[1:]):
                two[a, b] += w
        want += (one / total).tolist()
        want_pairs += two / total
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 3), (1, None, 3), (2, "", 3), (None, "word", 3), (4, "x " * 40_000, 3), (5, "\n" * 3000, 3)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    got = line_crf.score(docs, line_crf.train(docs, none)).collect()
    assert len(got) == 6 and all(r.score == 0.5 for r in got)
    assert max(r.n_lines for r in got) == 3001
    assert line_crf.score(docs.limit(0), line_crf.train(docs, none)).count() == 0


def test_queries_score_odd_rows_with_a_trained_model(spark, tmp_path):
    import zlib

    docs, labels = make()
    toxic, clean = docs[0][1], docs[2][1]
    odd = [(9001, None), (9002, ""), (9003, " \n\n"), (9004, clean + ("\n" + clean) * 300), (9005, "x" * 300_000), (9006, toxic), (9006, toxic), (None, clean), (9007, "\u0000 \U0001d400 ß")]
    spark.createDataFrame([(*d, "z", 0.5) for d in docs + odd], "doc_id long, text string, lang string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (9004, 1, 0), (9004, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for query, parts, part, cut, want in ((toxicity.op8_pu_toxicity, 4, 2, 0.3, {k: t for k, _, t in labels}), (line_crf.op10_line_crf_quality, 3, 1, 0.5, {k: q for k, q, _ in labels})):
        got = query(spark, str(tmp_path)).collect()
        assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in got)
        assert all(r.predicted == int(r.score >= cut) for r in got)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % parts == part) for r in got)
        assert accuracy([r for r in got if r.doc_id is not None and r.doc_id < 9000], want) > 0.9
        assert len({r.score for r in got}) > 1  # a trained model, not a constant
        by = {}
        for r in got:
            by.setdefault(r.doc_id, set()).add(r.score)
        assert len(by[9006]) == 1 and by[9001] == by[9002] and by[None] == by[2]
    assert query is line_crf.op10_line_crf_quality and min(by[9004]) >= 0.5  # long and clean


def test_samples_are_bounded_as_a_whole(spark):
    from artiscope.llm._labels import first_rows, within

    texts = spark.createDataFrame([(k, "y" * 10) for k in range(100)] + [(3, "y")], "doc_id long, text string")
    ids = first_rows(texts.select("doc_id").distinct(), 40)
    order = [r.doc_id for r in ids.collect()]
    kept = {r.doc_id for r in within(ids, texts, F.length("text"), 95).collect()}
    assert kept == set(order[:9])
    assert within(ids, texts, F.length("text"), 5).count() == 0
    docs, labels = frames(spark, *make())
    assert toxicity.train(docs, labels, max_chars=20_000) is not None and line_crf.train(docs, labels, max_lines=300) is not None
