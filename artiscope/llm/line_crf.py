"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features, and those of the lines before and after, give emission scores;
a transition matrix ties neighbours. The field is fitted to documents with a known quality: lines of good
documents are good; lines of bad documents begin as bad and are relabelled by the field's own marginals
between rounds (a bad document keeps at least one bad line). Forward-backward marginals, weighted by the
lines' lengths, are a document's quality; a logistic curve fitted to the same documents turns that into a
score.

Fitting uses a bounded sample of labelled rows (``MAX_ROWS``, ``MAX_SAMPLE_LINES``); every document is scored, over all lines of
its whole text.

Results for odd input: a null or empty text is one empty line. Repeated rows score alike; of a repeated id
one text is learnt from, and of repeated labels the larger one. Texts of ``MAX_LINES`` lines or more are scored
whole but not learnt from. A score of exactly ``THRESHOLD`` counts as good. Without labelled
rows every score is 0.5. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

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

#: Labelled rows that the field is fitted to, at most, of either quality, and lines of a text among them; longer texts are scored, not learnt from.
MAX_ROWS, MAX_LINES = 2500, 500
#: Lines of all texts of a sample together, at most: the driver holds a few hundred bytes for each.
MAX_SAMPLE_LINES = 400_000
ROUNDS, STEPS, RATE, DECAY = 3, 120, 0.1, 1e-4
THRESHOLD = 0.5

NAMES = (
    "bias", "empty", "one_word", "under_5_words", "under_20_words", "over_100_words", "any_symbol", "symbols_10", "symbols_40", "pipes_10", "bangs_20", "digits_20",
    "upper_30", "upper_70", "repeats_15", "repeats_40", "few_distinct", "short_words", "long_words", "dup_line", "no_end", "lower_start", "near_dup_words", "only_line",
)
_SYMBOLS, _DIGITS = b"#*$%&<>", b"0123456789"


def line_features(lines: list[bytes]) -> np.ndarray:
    """One row of 0/1 features for each line of a document."""
    out = np.zeros((len(lines), len(NAMES)), np.uint8)
    seen: set[bytes] = set()
    filled = sum(1 for x in lines if x.strip())
    for k, raw in enumerate(lines):
        words = raw.split()
        n = len(words)
        if not n:
            out[k, :2] = 1
            continue
        chars = len(raw)
        symbols = chars - len(raw.translate(None, _SYMBOLS))
        pipes = raw.count(b"|")
        up, low = 0, 0
        if raw != raw.lower():
            codes = np.frombuffer(raw, np.uint8)
            up, low = int(((codes >= 65) & (codes <= 90)).sum()), int(((codes >= 97) & (codes <= 122)).sum())
        same = sum(map(bytes.__eq__, words, words[1:]))
        distinct = len(set(words))
        mean = (chars - n) / n
        last = raw.rstrip()[-1:]
        out[k] = (
            1, 0, n == 1, n < 5, n < 20, n > 100, symbols > 0, 10 * symbols > n, 5 * symbols > 2 * n, 10 * pipes > n, 5 * raw.count(b"!!") > n,
            5 * (chars - len(raw.translate(None, _DIGITS))) > chars, 10 * up > 3 * (up + low), 10 * up > 7 * (up + low) and up > 0,
            100 * same > 15 * n, 10 * same > 4 * n, n >= 10 and 2 * distinct < n, mean < 2.5, mean > 12, raw in seen, last not in (b".", b"!", b"?", b":", b'"'),
            97 <= raw.lstrip()[0] <= 122, n >= 6 and 10 * distinct < 7 * n, filled == 1,
        )
        seen.add(raw)
    return out


def split_lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def with_neighbours(feats: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Features of each line, of the one before and of the one after it in its document."""
    n, f = feats.shape
    first = np.zeros(n, bool)
    first[starts] = True
    last = np.append(first[1:], True)[:n]
    before, after = np.zeros_like(feats), np.zeros_like(feats)
    before[1:], after[:-1] = feats[:-1], feats[1:]
    before[first], after[last] = 0, 0
    return np.concatenate([feats, before, after, first[:, None], last[:, None]], axis=1)


WIDTH = 3 * len(NAMES) + 2


@dataclass(frozen=True)
class Field:
    weights: np.ndarray  # of good against bad, by feature
    transition: np.ndarray  # 2 x 2, from and to; 0 bad, 1 good
    slope: float
    offset: float


def marginals(score: np.ndarray, sizes: np.ndarray, transition: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and pair marginals summed (2 x 2), by the documents' weights, of documents whose lines lie one after another.

    score: emission of good against bad. All documents advance together, longest first.
    """
    order = np.argsort(-sizes, kind="stable")
    share = np.ones(len(sizes)) if weight is None else weight[order]
    sizes_, start = sizes[order], (np.cumsum(sizes) - sizes)[order]
    depth = int(sizes.max()) if len(sizes) else 0
    e = np.stack([np.zeros(len(score)), np.clip(score, -60, 60)], axis=1)
    e = np.exp(e - e.max(axis=1, keepdims=True))
    t = np.exp(transition - transition.max())
    live = [int(np.searchsorted(-sizes_, -k, side="left")) for k in range(depth)]  # documents with more than k lines
    fwd, bwd = np.ones((len(score), 2)), np.ones((len(score), 2))
    for k in range(depth):
        at = start[: live[k]] + k
        a = e[at] if k == 0 else e[at] * (fwd[at - 1] @ t)
        fwd[at] = a / a.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for k in range(depth - 2, -1, -1):
        at = start[: live[k + 1]] + k
        ahead = e[at + 1] * bwd[at + 1]
        b = ahead @ t.T
        bwd[at] = b / b.sum(axis=1, keepdims=True)
        joint = fwd[at][:, :, None] * t[None] * ahead[:, None, :]
        pairs += (joint * (share[: live[k + 1]] / joint.sum(axis=(1, 2)))[:, None, None]).sum(axis=0)
    p = fwd * bwd
    return p[:, 1] / p.sum(axis=1), pairs


def gradient(theta: np.ndarray, x: np.ndarray, y: np.ndarray, sizes: np.ndarray, weight: np.ndarray, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the weighted negative log likelihood of the documents' labels, with a penalty decay / 2 * theta^2, and P(good) of the lines.

    Emissions and transitions belong to one likelihood: a document counts with one weight in both.
    """
    p, pairs = marginals(x @ theta[:WIDTH], sizes, theta[WIDTH:].reshape(2, 2), weight)
    of = np.repeat(np.arange(len(sizes)), sizes)
    seen = np.zeros((2, 2))
    inner = np.flatnonzero(of[1:] == of[:-1]) + 1
    np.add.at(seen, (y[inner - 1].astype(int), y[inner].astype(int)), weight[of[inner]])
    return np.concatenate([x.T @ ((p - y) * weight[of]), (pairs - seen).reshape(-1)]) + decay * theta, p


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = ROUNDS, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> Field:
    """docs: features of the lines, their lengths, quality 0 or 1."""
    if not docs:
        return Field(np.zeros(WIDTH), np.zeros((2, 2)), 0.0, 0.0)
    sizes = np.array([len(f) for f, _, _ in docs])
    starts = np.cumsum(sizes) - sizes
    x = with_neighbours(np.concatenate([f for f, _, _ in docs]), starts).astype(np.float32)
    length = np.concatenate([n for _, n, _ in docs]).astype(float) + 1
    quality = np.array([q for _, _, q in docs])
    bad_doc = np.repeat(quality == 0, sizes)
    of = np.repeat(np.arange(len(docs)), sizes)
    y = (~bad_doc).astype(float)
    # both qualities weigh alike, and within them every document, however many lines it has
    share = np.where(quality == 1, 0.5 / max(1, (quality == 1).sum()), 0.5 / max(1, (quality == 0).sum()))
    weight = share / sizes
    theta = np.zeros(WIDTH + 4)
    p = y
    for turn in range(rounds):
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            grad, p = gradient(theta, x, y, sizes, weight, decay)
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        if turn == rounds - 1:
            break
        # lines of bad documents that look good under the field become good, but for the worst one
        worst = np.full(len(docs), np.inf)
        np.minimum.at(worst, of, p)
        y = np.where(bad_doc, (p > 0.9) & (p > worst[of]), True).astype(float)
    p, _ = marginals(x @ theta[:WIDTH], sizes, theta[WIDTH:].reshape(2, 2))
    mean = np.bincount(of, weights=p * length) / np.bincount(of, weights=length)
    slope, offset = logistic(mean, quality)
    return Field(theta[:WIDTH].copy(), theta[WIDTH:].reshape(2, 2).copy(), slope, offset)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Newton's method for a curve with two numbers, slightly held back."""
    a = np.zeros(2)
    z = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(steps):
        s = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        g = z.T @ (s - y) + np.array([1e-2, 0]) * a
        h = (z * (s * (1 - s))[:, None]).T @ z + np.diag([1e-2, 1e-6])
        move = np.linalg.solve(h, g)
        a -= np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return float(a[0]), float(a[1])


def _sample(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, max_rows: int, max_lines: int = MAX_SAMPLE_LINES) -> list[tuple[np.ndarray, np.ndarray, int]]:
    chosen = first_rows(known.where("label = 1"), max_rows, id_col).unionByName(first_rows(known.where("label = 0"), max_rows, id_col))
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    texts = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(breaks < MAX_LINES)
    chosen = chosen.join(F.broadcast(within(chosen.select(id_col), texts, breaks + 1, max_lines, id_col)), id_col)
    # of repeated ids one text counts
    rows = texts.join(F.broadcast(chosen), id_col).groupBy(F.col(id_col).cast("string").alias("id"), "label").agg(F.min("text").alias("text")).select("id", "text", "label")

    @worker("quality field")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [split_lines(t) for t in batch.column(1).to_pylist()]
            feats = [np.packbits(line_features(x)).tobytes() for x in lines]
            sizes = [np.array([len(y) for y in x], "<u4").tobytes() for x in lines]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(feats, pa.binary()), pa.array(sizes, pa.binary())], names=["id", "label", "feats", "sizes"])

    got = rows.mapInArrow(run, "id string, label int, feats binary, sizes binary").collect()  # a few bytes a line
    out = []
    for r in sorted(got, key=lambda r: r["id"]):
        sizes = np.frombuffer(bytes(r["sizes"]), "<u4")
        n = len(sizes) * len(NAMES)
        out.append((np.unpackbits(np.frombuffer(bytes(r["feats"]), np.uint8))[:n].reshape(-1, len(NAMES)), sizes, r["label"]))
    return out


def train(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, max_lines: int = MAX_SAMPLE_LINES) -> Field:
    return fit(_sample(docs, training_labels(labels, "quality", parts, part, id_col), id_col, text_col, max_rows, max_lines))


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, n_lines and good_share (length-weighted marginals before the curve) of every row."""
    fed = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    weights = field.weights.astype(np.float64)

    @worker("quality field")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            row = 0
            scores, counts, shares = [], [], []
            while row < len(texts):
                lines = []
                size = 0
                while row < len(texts) and (size < 1 << 21 or not lines):
                    size += len(texts[row] or "")
                    lines.append(split_lines(texts[row]))
                    row += 1
                sizes = np.array([len(x) for x in lines])
                x = with_neighbours(np.concatenate([line_features(y) for y in lines]), np.cumsum(sizes) - sizes)
                p, _ = marginals(x @ weights, sizes, field.transition)
                length = np.array([len(y) + 1 for d in lines for y in d], float)
                of = np.repeat(np.arange(len(lines)), sizes)
                share = np.bincount(of, weights=p * length) / np.bincount(of, weights=length)
                shares += share.tolist()
                counts += sizes.tolist()
                scores += (1 / (1 + np.exp(-np.clip(field.slope * share + field.offset, -500, 500)))).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(shares, pa.float64())], names=[id_col, "score", "n_lines", "good_share"])

    return fed.mapInArrow(run, T.StructType([fed.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("n_lines", T.LongType()), T.StructField("good_share", T.DoubleType())]))


def op10_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, field).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op10_line_crf_quality": op10_line_crf_quality}
