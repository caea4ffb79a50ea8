"""Benchmark decontamination: a BM25 index of the test items, queried by every passage of the corpus.

The items are the indexed side: each has an impact for each of its words, as a share of the item's score
against itself, so one threshold serves all items. Passages are overlapping windows of words, long enough
that any stretch as long as the longest item lies in one whole. A passage asks for every item whose score
reaches the threshold. Block-max WAND answers: the sum of the words' largest impacts must reach the
threshold (tested for all passages at once), then the sum of their largest impacts in some block of items
(again at once), and only for the few passages left does the search walk the posting lists by pivots.
Questions of ``MIN_QUESTION`` words or more are indexed as well, beside their items, so that a passage with
the question alone is retrieved however long the answer is. What is retrieved is verified in shingles of five
words: a passage leaks an item when it repeats enough of the whole item, or enough of such a question.
The answer's share is reported; an answer alone, or a shorter question alone, is too common a text to decide.

An index holds at most ``SHARD_ITEMS`` items; more items make more indexes, and one pass over the corpus serves
``PASS_INDEXES`` of them, so what is broadcast at a time is bounded by that many items.

Results for odd input: null and empty texts, of items or documents, match nothing. Repeated rows of
documents or items give repeated results. Very long texts are read whole, as many passages. Items tied in
score are all retrieved. Items below five words use shingles of their own length. Extra
columns are ignored by ``search`` and pass through ``clean``. Empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from artiscope.llm._scratch import table
from artiscope.llm._worker import worker

K1, B = 1.2, 0.75
#: Share of an item's score against itself that a passage must reach to be looked at, and share of its shingles to be a leak.
THRESHOLD, OVERLAP, SHINGLE = 0.5, 0.8, 5
#: Words of a question that is a leak without the answer.
MIN_QUESTION = 8
SHARD_ITEMS, BLOCK_ITEMS, PASS_INDEXES = 1024, 2, 4
#: Characters of text that are worked on together.
CHUNK = 1 << 20
_WORDS = re.compile(r"[^\W_]+").findall


def words(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words before and in the last sentence or line; of one sentence the last quarter is the answer."""
    parts = [p for p in (words(p) for p in re.split(r"(?<=[.!?])\s+|\n", text)) if p]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    one = parts[0] if parts else []
    cut = len(one) - max(1, len(one) // 4) if len(one) > 1 else len(one)
    return one[:cut], one[cut:]


def shingles(ws: list[str], n: int) -> set[tuple]:
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}


def floor(shares: dict[str, float], ws: list[str], overlap: float) -> float:
    """What the words of a passage score at least that repeats this share of the shingles of ``ws``."""
    want = shingles(ws, SHINGLE)
    inside = Counter(w for g in want for w in set(g))
    # a word is missing only with all its shingles, and a missing shingle has SHINGLE words at most
    room = SHINGLE * int((1 - overlap) * len(want) + 1e-9)
    left = sum(shares[w] for w in inside)
    for w in sorted(inside, key=lambda w: (-shares[w] / inside[w], w)):
        part = min(1.0, room / inside[w])
        left -= part * shares[w]
        room -= part * inside[w]
        if room <= 0:
            break
    return max(left, 1e-6)


class Index:
    """Impacts of a shard of items and their questions: posting lists by word, their maxima, and the maxima by block.

    What is retrieved is a unit, an item or its question; ``of`` has the item of each unit. The two stand side by
    side, so they share blocks. Both take the words' weights and the mean length from the items. A question is no
    unit where its words alone bring the item to the threshold; else its impacts are scaled so that whatever
    repeats enough of it reaches the threshold, and little else does.
    """

    def __init__(self, items: list[tuple], block: int = BLOCK_ITEMS, threshold: float = THRESHOLD, overlap: float = OVERLAP):
        self.ids = [i for i, _ in items]
        tokens = [words(t) for _, t in items]
        self.block = block
        self.longest = max([1, *map(len, tokens)])
        mean = sum(map(len, tokens)) / max(1, len(tokens)) or 1
        df = Counter(w for ws in tokens for w in set(ws))
        self.term = {w: k for k, w in enumerate(sorted(df))}
        n = len(items)
        idf = {w: np.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
        self.postings: list[list[tuple[int, float]]] = [[] for _ in self.term]
        pairs = [question_and_answer(t or "") for _, t in items]
        self.asks = [len(q) >= MIN_QUESTION for q, _ in pairs]
        self.of: list[int] = []
        self.whole: list[bool] = []
        self.shares: list[dict[int, float]] = []

        def shares_of(ws: list[str]) -> dict[str, float]:
            norm = K1 * (1 - B + B * len(ws) / mean)
            impact = {w: idf[w] * tf * (K1 + 1) / (tf + norm) for w, tf in Counter(ws).items()}
            total = sum(impact[w] for w in sorted(impact))
            return {w: impact[w] / total for w in sorted(impact)}

        def add(item: int, shares: dict[str, float], whole: bool) -> None:
            for w, s in shares.items():
                self.postings[self.term[w]].append((len(self.of), s))
            self.of.append(item)
            self.whole.append(whole)

        for k, ws in enumerate(tokens):
            own, question = shares_of(ws), pairs[k][0]
            add(k, own, True)
            self.shares.append({self.term[w]: s for w, s in own.items()})
            if self.asks[k] and floor(own, question, overlap) < threshold:
                asked = shares_of(question)
                scale = threshold / floor(asked, question, overlap)
                add(k, {w: s * scale for w, s in asked.items()}, False)
        self.top = np.array([max(s for _, s in p) for p in self.postings])
        self.block_top = np.zeros((len(self.postings), -(-len(self.of) // block)), np.float32)
        for t, p in enumerate(self.postings):
            for k, s in p:
                self.block_top[t, k // block] = max(self.block_top[t, k // block], np.nextafter(np.float32(s), np.float32(2)))
        self.parts = []
        for both, (q, a) in zip(tokens, pairs):
            size = min(SHINGLE, len(both))
            own = lambda ws: shingles(ws, min(size, len(ws))) if ws else set()
            self.parts.append((shingles(both, size) if size else set(), own(q), own(a)))

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Units whose score reaches the threshold, with the score: document-at-a-time with pivots and block maxima."""
        end = len(self.of)
        cursors = [[self.postings[t][0][0], t, 0] for t in terms]
        found = []
        while True:
            cursors = [c for c in cursors if c[0] < end]
            cursors.sort()
            bound, pivot = 0.0, None
            for k, (at, t, _) in enumerate(cursors):
                bound += self.top[t]
                if bound >= threshold - 1e-9:
                    pivot = k
                    break
            if pivot is None:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            b = item // self.block
            if sum(float(self.block_top[t, b]) for _, t, _ in cursors[: pivot + 1]) < threshold - 1e-9:
                # no item of this block up to the next cursor can reach it
                target = (b + 1) * self.block
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                self._advance(cursors[: pivot + 1], max(target, item + 1), end)
            elif cursors[0][0] == item:
                score = sum(self.postings[t][k][1] for _, t, k in cursors[: pivot + 1])
                if score >= threshold - 1e-9:
                    found.append((item, score))
                self._advance(cursors[: pivot + 1], item + 1, end)
            else:
                self._advance([c for c in cursors[:pivot] if c[0] < item], item, end)

    def _advance(self, cursors: list, target: int, end: int) -> None:
        for c in cursors:
            p = self.postings[c[1]]
            while c[2] < len(p) and p[c[2]][0] < target:
                c[2] += 1
            c[0] = p[c[2]][0] if c[2] < len(p) else end

    def retrieve(self, terms: list[int], threshold: float) -> dict[int, float]:
        """Items that reach the threshold, or whose question does, with the share of the item's own score."""
        found = self.wand(terms, threshold)
        out = {self.of[k]: score for k, score in found if self.whole[k]}
        for item in {self.of[k] for k, _ in found} - out.keys():
            own = self.shares[item]
            out[item] = sum(own[t] for t in terms if t in own)
        return out

    def leaked(self, item: int, shares: tuple[float, float, float], overlap: float) -> bool:
        """Whether a passage with these shares leaks the item: the whole of it, or a question that tells it."""
        return shares[0] >= overlap or (self.asks[item] and shares[1] >= overlap)

    def verify(self, item: int, passage: list[str]) -> tuple[float, float, float]:
        """Shares of the item's shingles, of its question's and of its answer's that the passage repeats."""
        out = []
        have: dict[int, set] = {}
        for want in self.parts[item]:
            if not want:
                out.append(0.0)
                continue
            n = len(next(iter(want)))
            if n not in have:
                have[n] = shingles(passage, n)
            out.append(len(want & have[n]) / len(want))
        return tuple(out)

    def passages(self, tokens: list[list[str]], threshold: float) -> Iterator[tuple[int, int, int, list[int]]]:
        """Passages whose bounds reach the threshold: document, first word, end, terms."""
        stride, width = self.longest, 2 * self.longest
        get = self.term.get
        sizes = np.array([len(t) for t in tokens])
        ids = np.fromiter((get(w, -1) for t in tokens for w in t), np.int64, int(sizes.sum()))
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return
        starts = np.cumsum(sizes) - sizes
        of = np.searchsorted(starts, at, side="right") - 1
        inside = at - starts[of]
        counts = -(-np.maximum(sizes, 1) // stride)  # windows of each document: one for each stride
        base = np.cumsum(counts) - counts
        slot = inside // stride
        window = np.concatenate([base[of] + slot, (base[of] + slot - 1)[slot > 0]])
        term = np.concatenate([ids[at], ids[at][slot > 0]])
        key = np.unique(window * len(self.term) + term)
        window, term = key // len(self.term), key % len(self.term)
        bound = np.bincount(window, weights=self.top[term], minlength=int(counts.sum()))
        keep = bound[window] >= threshold - 1e-9
        window, term = window[keep], term[keep]
        if not len(window):
            return
        first = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
        last = np.append(first[1:], len(window))
        step = max(1, (1 << 22) // max(1, self.block_top.shape[1]))
        k = 0
        while k < len(first):
            upto = max(k + 1, int(np.searchsorted(last, first[k] + step, side="right")))
            lo, hi = first[k], last[upto - 1]
            best = np.add.reduceat(self.block_top[term[lo:hi]], first[k:upto] - lo, axis=0).max(axis=1)
            for j in (np.flatnonzero(best >= threshold - 1e-4) + k).tolist():
                w = int(window[first[j]])
                d = int(np.searchsorted(base, w, side="right") - 1)
                s = (w - int(base[d])) * stride
                yield d, s, s + width, term[first[j] : last[j]].tolist()
            k = upto


_OUT = (("score", T.DoubleType(), pa.float64()), ("overlap", T.DoubleType(), pa.float64()), ("question_overlap", T.DoubleType(), pa.float64()), ("answer_overlap", T.DoubleType(), pa.float64()), ("n_passages", T.LongType(), pa.int64()))


def leaks(indexes: list[Index], texts: list[str | None], threshold: float, overlap: float) -> dict[int, dict[tuple[int, int], list]]:
    """By document, by index and item: best score, overlaps, number of passages that hold the leak."""
    out: dict[int, dict[tuple[int, int], list]] = defaultdict(dict)
    row = 0
    while row < len(texts):
        upto, size = row, 0
        while upto < len(texts) and (size < CHUNK or upto == row):
            size += len(texts[upto] or "")
            upto += 1
        tokens = [words(t) for t in texts[row:upto]]
        for n, index in enumerate(indexes):
            for d, s, e, terms in index.passages(tokens, threshold):
                for item, score in index.retrieve(terms, threshold).items():
                    shares = index.verify(item, tokens[d][s:e])
                    if not index.leaked(item, shares, overlap):
                        continue
                    old = out[row + d].get((n, item))
                    out[row + d][n, item] = [max(score, old[0]) if old else score, *(max(a, b) for a, b in zip(shares, old[1:4] if old else shares)), (old[4] if old else 0) + 1]
        row = upto
    return out


def shards(items: DataFrame, id_col: str, text_col: str, size: int) -> Iterator[list[tuple]]:
    """Items with words, by id, ``size`` at a time."""
    part = []
    for r in items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").orderBy("id", "text").toLocalIterator():
        if words(r["text"]):
            part.append((r["id"], r["text"]))
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def passes(items: DataFrame, id_col: str, text_col: str, size: int, threshold: float, overlap: float) -> Iterator[list[Index]]:
    """The indexes of all items, as many at a time as one pass over the corpus serves."""
    held: list[Index] = []
    for part in shards(items, id_col, text_col, size):
        held.append(Index(part, threshold=threshold, overlap=overlap))
        if len(held) == PASS_INDEXES:
            yield held
            held = []
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Leaks: id, item, the score as a share of the item's own, the overlaps and the number of passages that hold it."""
    fed = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    item_kind = items.schema[item_col]
    schema = T.StructType([fed.schema[id_col], T.StructField(item_col, item_kind.dataType), *(T.StructField(n, k) for n, k, _ in _OUT)])
    id_kind = pa.int64() if isinstance(item_kind.dataType, T.LongType) else None
    found = []
    for indexes in passes(items, item_col, item_text, shard_items, threshold, overlap):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)

        @worker("decontaminate")
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                by_document = leaks(shared.value, batch.column(1).to_pylist(), threshold, overlap)
                got = [(d, shared.value[n].ids[k], row) for d, by in sorted(by_document.items()) for (n, k), row in sorted(by.items())]
                cols = [batch.column(0).take(pa.array([g[0] for g in got], pa.int64())), pa.array([g[1] for g in got], id_kind)]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array([g[2][k] for g in got], kind) for k, (_, _, kind) in enumerate(_OUT))], names=schema.fieldNames())

        found.append(fed.mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The rows of ``docs`` that leak no item, with exactly its columns."""
    at = docs.columns.index(text_col)
    for indexes in passes(items, item_col, item_text, shard_items, threshold, overlap):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)

        @worker("decontaminate")
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = leaks(shared.value, batch.column(at).to_pylist(), threshold, overlap)
                mask = pa.array([k not in hit for k in range(batch.num_rows)], pa.bool_())
                yield pa.RecordBatch.from_arrays([pc.filter(c, mask) for c in batch.columns], schema=batch.schema)

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES = {"op6_bm25_decontamination": op6_bm25_decontamination}
