"""Best-fit packing of tokenized documents by a grouping genetic algorithm on islands.

Sequences hold a fixed number of tokens, so what has to be packed is a histogram with at most that many
bars, however many documents there are. An individual is a set of bins, written as patterns (the lengths
in a bin) with multiplicities. Crossover injects whole well-filled bins of one parent into the other,
takes out the bins whose documents are then packed twice, and best-fits the displaced documents into the
slack, then into new bins. Islands evolve populations in Spark tasks; after each epoch the elite of each
island moves to the next one. The best individual's patterns become runs of slots, and each piece finds
its slot by its rank among the pieces of its length; ranks are counted in parts, so a length that a third
of all pieces have is no single task's work.

Results for odd input: a null text is an empty text, a document of its end mark only. Repeated rows are
packed once each. Very long texts are encoded whole and cut into pieces. Ties between pieces of a length go by
id, piece and checksum. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import os
import pickle
import random
import re
import zlib
from bisect import bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from artiscope.llm._scratch import cut, table
from artiscope.llm._worker import worker

CAPACITY = 2048
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4, 3, 5, 6
#: Stretches (of 64 characters or less) whose ids a worker remembers in either of two generations, stretches that it
#: encodes in one call, and characters of text that it works on at a time.
CACHE_WORDS, CALL_WORDS, BLOCK = 200_000, 8192, 1 << 20

#: Text for which splitting here equals the tokenizer's own: no characters that its normalizer would compose or treat unlike str.lower.
_MARKS = ".,;:!?"
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-įı-ȳ]*")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes; stretches between white space are encoded once while remembered.

    Stretches that were in use lately are in ``known``; when it is full it becomes ``older``, and what was older and
    not used again is forgotten. So frequent stretches stay, and memory has a bound.
    """

    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # stretches of plain texts are lower case and composed already, and none of them is an added token
        self.quick = Tokenizer.from_file(path)
        self.quick.encode_special_tokens = True
        self.quick.normalizer = None
        self.split = regex.compile(self.SPLIT).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word of the split
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def stretches(self, new: list[str]) -> list[bytes]:
        """Ids of each stretch, from one call for all: every word of the split ends with one id that says so."""
        ids = np.array(self.quick.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        stop = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        upto = np.cumsum([0, *(1 if t.isalpha() else len(self.split(t)) for t in new)])
        if upto[-1] != len(stop) - 1 or stop[-1] != len(ids):
            return [np.array(e.ids, "<u4").tobytes() for e in self.quick.encode_batch_fast(new, add_special_tokens=False)]
        cuts, raw = (4 * stop[upto]).tolist(), ids.tobytes()
        return [raw[x:y] for x, y in zip(cuts, cuts[1:])]

    def learn(self, fresh: list[str]) -> None:
        """Remember the ids of new stretches; marks at the end of a word are words of their own, so what precedes them is encoded once."""
        tails = [(w, c) for w in fresh if w[-1] in _MARKS and (c := w.rstrip(_MARKS)) and c[-1].isalnum()]
        whole = set(fresh).difference(w for w, _ in tails)
        parts = {p for w, c in tails for p in (c, w[len(c) :])}.difference(self.known)
        todo = list(whole | parts)
        for k in range(0, len(todo), CALL_WORDS):
            some = todo[k : k + CALL_WORDS]
            self.known.update(zip(some, self.stretches(some)))
        for w, c in tails:
            self.known[w] = self.known[c] + self.known[w[len(c) :]]

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [_PLAIN.fullmatch(t) is not None and not any(a in t for a in self.added) for t in texts]
        words = [t.lower().split() if ok else () for t, ok in zip(texts, plain)]
        new = set(chain.from_iterable(words)).difference(self.known)
        again = new.intersection(self.older)
        self.known.update((w, self.older[w]) for w in again)
        fresh = list(new - again)
        self.learn(fresh)
        get = self.known.__getitem__
        out = [b"".join(map(get, w)) if ok else self.whole([t])[0] for t, w, ok in zip(texts, words, plain)]
        for w in fresh:
            if len(w) > 64:
                del self.known[w]
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder; a function of this module, so that tasks don't bring tables of their own along."""
    return _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))


def forget() -> None:
    _ENCODERS.clear()


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length and ids_crc32 of each piece: ids, then the end mark 0; only longer documents are cut."""
    fed = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    kind = fed.schema[id_col]

    @worker("packing", forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        step = 4 * capacity
        for batch in batches:
            texts = batch.column(1).to_pylist()
            row = 0
            while row < len(texts):
                upto, size = row, 0
                while upto < len(texts) and (size < BLOCK or upto == row):
                    size += len(texts[upto] or "")
                    upto += 1
                out: tuple[list, ...] = ([], [], [], [], [])
                for k, ids in enumerate(enc.encode([t or "" for t in texts[row:upto]]), row):
                    ids += b"\0\0\0\0"
                    for n, s in enumerate(range(0, len(ids), step)):
                        part = ids[s : s + step]
                        for col, x in zip(out, (k, n, s // 4, len(part) // 4, zlib.crc32(part))):
                            col.append(x)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], names=[id_col, "piece", "start", "length", "ids_crc32"])
                row = upto

    return fed.mapInArrow(run, T.StructType([kind, T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))]))


# --- individuals: {pattern (lengths, falling): multiplicity} ---


def fill(need: Counter, capacity: int, rng: random.Random | None = None, bins: dict | None = None) -> dict:
    """New bins for ``need``: the longest first, then always the longest that still fits (now and then the second, by ``rng``)."""
    bins = {} if bins is None else bins
    need = Counter({k: n for k, n in need.items() if n > 0})
    lengths = sorted(need)
    while lengths:
        held = Counter()
        rest, at = capacity, len(lengths) - 1
        pattern = []
        while True:
            size = lengths[at]
            times = min(rest // size, need[size] - held[size])
            if rng and times > 1 and rng.random() < 0.2:
                times = rng.randint(1, times)
            pattern += [size] * times
            held[size] += times
            rest -= size * times
            at = min(bisect_right(lengths, rest), at) - 1
            if at >= 1 and rng and rng.random() < 0.1:
                at -= 1
            if at < 0:
                break
        m = min(need[size] // n for size, n in held.items())
        key = tuple(pattern)
        bins[key] = bins.get(key, 0) + m
        for size, n in held.items():
            need[size] -= m * n
            if not need[size]:
                del need[size]
                lengths.remove(size)
    return bins


def best_fit(bins: dict, need: Counter, capacity: int, rng: random.Random) -> dict:
    """Displaced documents, the longest first, into the bins with the least slack that takes them; the rest into new bins."""
    slack: dict[int, list] = defaultdict(list)
    for p, m in bins.items():
        slack[capacity - sum(p)].append([p, m])
    slack.pop(0, None)
    open_ = sorted(slack)
    left: Counter = Counter()
    for size in sorted(need, reverse=True):
        n = need[size]
        while n > 0:
            k = bisect_right(open_, size - 1)
            if k == len(open_):
                left[size] = n
                break
            s = open_[k]
            p, m = slack[s].pop()
            take = min(n, m)
            if take < m:
                slack[s].append([p, m - take])
            elif not slack[s]:
                open_.pop(k)
                del slack[s]
            bins[p] -= take
            if not bins[p]:
                del bins[p]
            q = tuple(sorted((*p, size), reverse=True))
            bins[q] = bins.get(q, 0) + take
            if s - size:
                if s - size not in slack:
                    insort(open_, s - size)
                slack[s - size].append([q, take])
            n -= take
    return fill(left, capacity, rng, bins)


def cross(a: dict, b: dict, hist: Counter, capacity: int, rng: random.Random) -> dict:
    """Inject well-filled bins of ``b`` into ``a``, drop the bins of ``a`` that pack a document again, best-fit what is displaced."""
    order = sorted(b, key=lambda p: (-sum(p), p))
    keep = order[: max(1, int(len(order) * rng.uniform(0.1, 0.6)))]
    child: dict = {}
    left = Counter(hist)

    def put(p, m):
        need = Counter(p)
        m = min([m, *(left[x] // n for x, n in need.items())])
        if m > 0:
            child[p] = child.get(p, 0) + m
            for x, n in need.items():
                left[x] -= m * n

    for p in keep:
        if rng.random() < 0.7:
            put(p, b[p])
    for p in sorted(a, key=lambda p: (-sum(p), p)):
        put(p, a[p])
    return best_fit(child, Counter({x: n for x, n in left.items() if n}), capacity, rng)


def n_bins(x: dict) -> int:
    return sum(x.values())


def fitness(x: dict, capacity: int) -> tuple:
    """Fewer bins first, then fuller ones: the mean squared fill."""
    n = n_bins(x)
    return n, -sum(m * (sum(p) / capacity) ** 2 for p, m in x.items()) / max(1, n)


def evolve(hist: Counter, capacity: int, seed: int, immigrants: list[dict], generations: int, population: int) -> dict:
    """One island's epoch; its best individual."""
    rng = random.Random(seed)
    least = -(-sum(k * n for k, n in hist.items()) // capacity)
    people = [*immigrants, fill(hist, capacity)]
    while len(people) < population and n_bins(min(people, key=n_bins)) > least:
        people.append(fill(hist, capacity, rng))
    for _ in range(generations):
        people.sort(key=lambda x: fitness(x, capacity))
        if n_bins(people[0]) <= least or len(people) < 2:
            break
        young = [cross(*rng.sample(people[: max(2, population // 2)], 2), hist, capacity, rng) for _ in range(population // 2)]
        people = sorted(people + young, key=lambda x: fitness(x, capacity))[:population]
    return min(people, key=lambda x: fitness(x, capacity))


def islands(spark: SparkSession, hist: Counter, capacity: int = CAPACITY, n_islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION) -> dict:
    """The best packing of a histogram. Data that moves: one individual per island, its size bounded by the capacity."""
    least = -(-sum(k * n for k, n in hist.items()) // capacity)
    elites: list[dict] = []
    bars = dict(hist)
    for epoch in range(epochs):
        # ring migration: island k receives the elites of k and k - 1
        guests = {k: [elites[k], elites[k - 1]] if elites else [] for k in range(n_islands)}
        frozen = pickle.dumps(guests)

        @worker("packing", forget)
        def run(batches, epoch=epoch, frozen=frozen):
            for batch in batches:
                ids = batch.column(0).to_pylist()
                got = [pickle.dumps(evolve(Counter(bars), capacity, 1000 * epoch + k, pickle.loads(frozen)[k], generations, population)) for k in ids]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(got, pa.binary())], names=["island", "elite"])

        rows = spark.range(0, n_islands, 1, n_islands).mapInArrow(run, "island long, elite binary").collect()
        elites = [pickle.loads(bytes(r["elite"])) for r in sorted(rows, key=lambda r: r["island"])]
        if min(map(n_bins, elites)) <= least:
            break
    return min(elites, key=lambda x: fitness(x, capacity))


def slots(bins: dict) -> dict[int, np.ndarray]:
    """For each length the runs of its slots: first rank, first sequence, offset, documents of the length in one bin."""
    runs: dict[int, list] = defaultdict(list)
    given: Counter = Counter()
    base = 0
    for p, m in sorted(bins.items(), reverse=True):
        offset = 0
        for size, n in sorted(Counter(p).items(), reverse=True):
            runs[size].append((given[size], base, offset, n))
            given[size] += n * m
            offset += n * size
        base += m
    return {k: np.array(v, np.int64) for k, v in runs.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Pieces with sequence_id and offset."""
    spark = docs.sparkSession
    cutup = cut(pieces(docs, tokenizer_path, capacity, id_col, text_col), "pack-pieces")
    hist = Counter({r["length"]: r["n"] for r in cutup.groupBy("length").agg(F.count("*").alias("n")).collect()})  # capacity rows at most
    runs = spark.sparkContext.broadcast(slots(islands(spark, hist, capacity, **how)) if hist else {})

    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cutup.withColumn("__part", F.pmod(F.xxhash64(F.col(id_col), "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("length", "__part").agg(F.count("*").alias("__n"))  # one row for each length and part
    first = counts.withColumn("__first", F.sum("__n").over(W.partitionBy("length").orderBy("__part").rowsBetween(W.unboundedPreceding, -1))).select("length", "__part", F.coalesce("__first", F.lit(0)).alias("__first"))
    ranked = dealt.withColumn("__row", F.row_number().over(W.partitionBy("length", "__part").orderBy(id_col, "piece", "ids_crc32"))).join(first, ["length", "__part"])
    ranked = ranked.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("__first") + F.col("__row") - 1).alias("sequence_id"))
    out = T.StructType([*ranked.schema, T.StructField("offset", T.LongType())])

    @worker("packing", forget)
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(3).to_numpy(zero_copy_only=False)
            rank = batch.column(5).to_numpy(zero_copy_only=False)
            seq, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for size in np.unique(length).tolist():
                at = length == size
                r = runs.value[size]
                k = np.searchsorted(r[:, 0], rank[at], side="right") - 1
                inside = rank[at] - r[k, 0]
                seq[at] = r[k, 1] + inside // r[k, 3]
                offset[at] = r[k, 2] + inside % r[k, 3] * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(offset)], names=out.fieldNames())

    return ranked.mapInArrow(place, out)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_genetic_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path or tokenizer_file())


QUERIES = {"op5_genetic_packing": op5_genetic_packing}
