"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; the text of other documents, labelled or not, is the
unlabelled part, of which a share (the class prior) is toxic too. A linear classifier over words and
their beginnings minimizes the class-prior-corrected risk: prior * R+(positives) plus the risk of the
unlabelled as negatives less the positives' part in it, kept from going below zero.

The classifier is fitted on a bounded sample of rows (``MAX_POSITIVE``, ``MAX_UNLABELLED``, ``MAX_SAMPLE_CHARS``); every
document is scored, over its whole text. A word's weight is computed once and remembered, so scoring is a
sum over a document's distinct words.

Results for odd input: a null text is an empty text; it scores by the bias alone, like every text without
words. Repeated rows score alike; of a repeated id one text is learnt from, and of repeated labels the larger
one. Texts beyond ``MAX_CHARS`` characters are scored whole but not learnt from. Ties at the cut count as toxic. Without confirmed toxic rows every score is 0. Extra columns are
ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from artiscope.llm._labels import first_rows, held_out, training_labels, within
from artiscope.llm._scratch import table
from artiscope.llm._worker import worker

PREFIXES = (4, 5, 6, 7, 8, 9)
#: Rows of the training sample, at most, and characters of a text in it; longer texts are scored, not learnt from.
MAX_POSITIVE, MAX_UNLABELLED, MAX_CHARS = 2500, 6000, 1 << 20
#: Characters of all texts of a sample together, at most: the driver holds four bytes or so for each.
MAX_SAMPLE_CHARS = 64 << 20
#: A feature is kept if positives hold it so much oftener than the unlabelled that chance is below this.
CHANCE, MAX_FEATURES = 1e-5, 20_000
EPOCHS, BATCH, RATE, DECAY = 60, 400, 0.05, 3e-3
THRESHOLD = 0.3
CACHE_WORDS = 400_000
_WORD = re.compile(r"[^\W\d_]+").findall


def features(word: str) -> list[int]:
    """Hashed features of a word: itself and its beginnings."""
    raw = [word + "$", *(word[:n] for n in PREFIXES if len(word) >= n)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in raw]


def words(text: str | None) -> set[str]:
    return set(_WORD((text or "").lower()))


@dataclass(frozen=True)
class Model:
    weights: dict[int, float]
    bias: float
    prior: float

    def word(self, w: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(w))


def distinct_documents(docs: list[np.ndarray], bands: int = 6, rows: int = 8) -> list[np.ndarray]:
    """Without near copies of earlier documents, which would make the words of one text look like evidence from many."""
    seen: set = set()
    out = []
    mix = np.array([(2 * k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF for k in range(1, bands * rows + 1)], np.uint64)
    for d in docs:
        if not len(d):
            continue
        x = d.astype(np.uint64)
        low = [int((((y := x * m + (m >> np.uint64(7))) ^ (y >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).min()) for m in mix]
        keys = {(b, *low[b * rows : (b + 1) * rows]) for b in range(bands)}
        if not keys & seen:
            out.append(d)
        seen |= keys
    return out


def _tail(k: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Upper bound of the chance that a Poisson count reaches k (Chernoff), 1 where k is below the mean."""
    k, mean = k.astype(float), np.maximum(mean, 1e-12)
    return np.where(k > mean, np.exp(np.minimum(0, k - mean - k * np.log(np.maximum(k, 1e-12) / mean))), 1.0)


def select(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Features that tell positives from the unlabelled, sorted."""
    in_p, n_p = np.unique(np.concatenate([np.unique(d) for d in positive]), return_counts=True)
    n_u = np.zeros(len(in_p), np.int64)
    for d in unlabelled:
        at = np.searchsorted(in_p, u := np.unique(d))
        at[at == len(in_p)] = 0
        n_u[at[in_p[at] == u]] += 1
    chance = _tail(n_p, (n_u + 0.5) / (len(unlabelled) + 1) * len(positive))
    good = np.flatnonzero((chance < CHANCE) & (n_p >= 3))
    good = good[np.lexsort((in_p[good], chance[good]))][:MAX_FEATURES]
    return np.sort(in_p[good])


def risk(z: np.ndarray, n_p: int, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of scores, positives first, and what to step along.

    With logistic losses: prior * mean of log(1 + e^-z) of the positives, plus what the unlabelled lose as negatives,
    mean of log(1 + e^z), less prior times what the positives would lose so, but not below zero. While that
    difference is negative the step raises it instead: the positives' losses wait.
    """
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    n_u = max(1, len(z) - n_p)
    gain = prior * np.logaddexp(0, -z[:n_p]).mean()
    negative = np.logaddexp(0, z[n_p:]).sum() / n_u - prior * np.logaddexp(0, z[:n_p]).mean()
    down = np.concatenate([-prior * s[:n_p] / n_p, s[n_p:] / n_u])  # of the difference
    if negative < 0:
        return gain, -down
    return gain + negative, down + np.concatenate([prior * (s[:n_p] - 1) / n_p, np.zeros(len(z) - n_p)])


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, decay: float = DECAY, seed: int = 11, recut: bool = True) -> Model:
    """Minimize the non-negative risk by Adam; documents are arrays of features (with repeats: each word adds its own)."""
    positive, unlabelled = distinct_documents(positive), distinct_documents(unlabelled)
    if not positive:
        return Model({}, -np.inf, 0.0)
    chosen = select(positive, unlabelled) if unlabelled else np.unique(np.concatenate(positive))
    size = len(chosen)

    def known(d: np.ndarray) -> np.ndarray:
        at = np.searchsorted(chosen, d)
        at[at == size] = 0
        return at[chosen[at] == d] if size else at[:0]

    docs = [known(d) for d in positive + unlabelled]
    rng = np.random.default_rng(seed)
    w = np.zeros(size + 1)
    w[size] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    n_p, n_u, step = len(positive), len(unlabelled), 0
    turns = max(1, -(-(n_p + n_u) // batch))
    for _ in range(epochs):
        # every batch holds its share of both parts, as the correction needs both
        p_order, u_order = rng.permutation(n_p), n_p + rng.permutation(n_u)
        for turn in range(turns):
            rows_p, rows_u = p_order[turn::turns], u_order[turn::turns]
            if not len(rows_p):
                rows_p = p_order[turn % n_p : turn % n_p + 1]
            rows = np.concatenate([rows_p, rows_u])
            parts = [docs[r] for r in rows]
            feats, of = np.concatenate(parts), np.repeat(np.arange(len(rows)), [len(x) for x in parts])
            z = np.bincount(of, weights=w[feats], minlength=len(rows)) + w[size]
            _, g = risk(z, len(rows_p), prior)
            grad = np.bincount(feats, weights=g[of], minlength=size + 1) + decay * w
            grad[size] = g.sum()
            step += 1
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
    z = np.array([w[d].sum() for d in docs])
    shift = np.log(THRESHOLD / (1 - THRESHOLD)) - cut_point(z[:n_p], z[n_p:]) if recut and n_u and size else float(w[size])
    return Model(dict(zip(chosen.tolist(), w[:size].tolist())), float(shift), prior)


def cut_point(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Where recall squared over the share of the unlabelled above is greatest: F1's counterpart that needs no negatives."""
    order = np.unique(np.concatenate([positive, unlabelled]))
    middle = (order[1:] + order[:-1]) / 2
    if not len(middle):
        return float(order[0])
    recall = 1 - np.searchsorted(np.sort(positive), middle) / len(positive)
    above = 1 - np.searchsorted(np.sort(unlabelled), middle) / len(unlabelled)
    gain = recall**2 / np.maximum(above, 1 / len(unlabelled))
    return float(middle[len(gain) - 1 - np.argmax(gain[::-1])])


def _feature_rows(docs: DataFrame, id_col: str, text_col: str) -> list[np.ndarray]:
    @worker("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.array([f for w in sorted(words(t)) for f in features(w)], "<u4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], names=["id", "feats"])

    fed = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = fed.mapInArrow(run, "id string, feats binary").collect()
    return [np.frombuffer(bytes(r["feats"]), "<u4") for r in sorted(rows, key=lambda r: (r["id"] or "", bytes(r["feats"])))]


def train(docs: DataFrame, labels: DataFrame, parts: int = 4, part: int = 2, id_col: str = "doc_id", text_col: str = "text", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_chars: int = MAX_SAMPLE_CHARS) -> Model:
    known = training_labels(labels, "toxic", parts, part, id_col)
    counts = known.groupBy().agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).first()
    if not counts["toxic"]:
        return fit([], [], 0.5)
    prior = min(0.9, max(0.005, counts["toxic"] / counts["n"]))
    toxic = first_rows(known.where("label = 1").select(id_col), max_positive, id_col)
    # of repeated ids one text counts
    texts = docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).where(F.length(text_col) <= MAX_CHARS)
    fitting = lambda ids: within(ids, texts, F.length(text_col), max_chars, id_col)
    one = lambda ids: texts.join(F.broadcast(fitting(ids)), id_col).groupBy(id_col).agg(F.min(text_col).alias(text_col))
    positive = _feature_rows(one(toxic), id_col, text_col)
    # text of any document that isn't held out, confirmed or not: the unlabelled part must have the prior's share of toxic text
    others = first_rows(docs.where(~held_out(id_col, parts, part)).where(f"{id_col} is not null").select(id_col).distinct(), max_unlabelled, id_col)
    unlabelled = _feature_rows(one(others), id_col, text_col)
    return fit(positive, unlabelled, prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fed = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))

    @worker("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        m = shared.value
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                ws = words(text)
                for w in ws.difference(known):
                    known[w] = m.word(w)
                z = sum(sorted(map(known.__getitem__, ws))) + m.bias  # sorted: the sum doesn't depend on the set's order
                out.append(1 / (1 + np.exp(-max(-500.0, min(500.0, z)))) if z > -500 else 0.0)
                if len(known) > CACHE_WORDS:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=[id_col, "score"])

    return fed.mapInArrow(run, T.StructType([fed.schema[id_col], T.StructField("score", T.DoubleType())]))


def op8_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op8_pu_toxicity": op8_pu_toxicity}
