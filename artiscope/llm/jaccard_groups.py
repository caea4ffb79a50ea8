"""Exact n-gram Jaccard join by a token-group matrix, and the components of its links.

Texts become sets of hashed word n-grams. Equal sets fold into one node first. Nodes that could link share
a token among the first of an order that all sets follow (rare before common), so an index of those tokens
finds all that could link, and everything else is alone.

Nodes that share their most shared token form groups; a group has a centre, the node whose tokens are most
shared. First each node is compared with its group's centre only: near copies of one text are mostly
connected by that, with a link each. Then the token-group matrix does the rest: groups are split to a
bounded number of members, each with the union of its members' tokens (by bucket of hash values); a query
node meets a group only if they share an index token and aren't connected yet, the group is opened only if
the query's overlap with the union leaves room for a link, and then all its members are compared at once.
Pairs that the bounds leave are counted exactly, each node's likeliest partner first. No pair that could link is left out; pairs that are
connected already are not looked at.

Results for odd input: null and empty texts have no tokens and link with nothing. Rows with one id are one
document; a null id links with nothing and has a null component. Extra columns are ignored by ``join`` and
pass through ``keep_one``. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from artiscope.llm._scratch import among, cut, table
from artiscope.llm._worker import worker
from artiscope.llm.components import components

#: Members of a group, queries that meet it in one task, bits of the tables of common tokens and of candidate ids.
GROUP, QUERIES_PER_TASK, BITS = 256, 512, 24
#: A token counts as common if this many of one in so many documents have it. It only orders the tokens.
COMMON, ONE_IN = 4, 32
#: Buckets of a sketch at least, and of the short one that meets groups.
MIN_BUCKETS, SHORT_BUCKETS = 256, 128
DROP_BROADCAST = 500_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) > 200_000:
                self.clear()
            self[word] = value
        return value


_HASHES = _Hashes()


def forget() -> None:
    """Of this worker's own table; a function of this module, so that tasks don't bring a copy along."""
    _HASHES.clear()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def tokens(text: str | None, n: int) -> np.ndarray:
    """The set of a text as sorted 64-bit numbers: its n-grams of words, or all words as one where there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    s = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        s = _mix(s * _M1 + h[k : len(h) - width + 1 + k])
    return np.unique(s)


def links(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sets (sorted) overlap by at least num / den."""
    if not len(a) or not len(b) or den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    i = int((both[1:] == both[:-1]).sum())
    return den * i >= num * (len(a) + len(b) - i)


def _bit_rows(slots: DataFrame) -> np.ndarray:
    """A bit table of 2 ** BITS bits with the numbers in column slot set; at most 2 ** (BITS - 6) rows come to the driver."""
    rows = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _has(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) == 1


def common_tokens(docs: DataFrame, n: int) -> np.ndarray:
    """Bit table of tokens that many documents have, by one in ``ONE_IN`` of them."""

    @worker("jaccard", forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [tokens(t, n) for t in batch.column(0).to_pylist()]
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat)], names=["t"])

    sample = docs.where(F.pmod(F.xxhash64("id"), F.lit(ONE_IN)) == 0).select("text")
    found = sample.mapInArrow(run, "t long").groupBy("t").count().where(f"count >= {COMMON}")
    return _bit_rows(found.select(F.shiftrightunsigned("t", 64 - BITS).alias("slot")))


def sketch(s: np.ndarray) -> bytes:
    """One byte for each bucket of hash values: the sum of its tokens' bytes. Sets differ at least as often as their sketches do.

    The number of buckets is a power of two and grows with the set; adding the halves of a sketch gives the
    sketch with half as many.
    """
    m = MIN_BUCKETS
    while 4 * m < len(s):
        m *= 2
    bucket = (s & np.uint64(m - 1)).astype(np.int64)
    return np.bincount(bucket, weights=(_mix(s) >> np.uint64(56)).astype(float), minlength=m).astype(np.int64).astype(np.uint8).tobytes()


def _fold(sketches: np.ndarray, m: int) -> np.ndarray:
    while sketches.shape[-1] > m:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] + sketches[..., half:]
    return sketches


def room(a, b, num: int, den: int):
    """Tokens that linked sets of sizes a and b may differ in at most."""
    return (den - num) * (a + b) // (den + num)


_SETS = "id long, n long, s1 long, s2 long, prefix array<long>, sketch binary"


def scan_sets(docs: DataFrame, n: int, num: int, den: int, common: np.ndarray) -> DataFrame:
    """id, size, two signatures of the set, the tokens that the index holds, and the sketch, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    @worker("jaccard", forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            sizes, one, two, prefix, own = [], [], [], [], []
            for text in batch.column(1):
                s = tokens(text.as_py(), n)
                sizes.append(len(s))
                one.append(int(_mix(s).sum(dtype=np.uint64)))
                two.append(int(_mix(s * _M3).sum(dtype=np.uint64)))
                own.append(sketch(s) if len(s) else b"")
                often = _has(bits, (s >> np.uint64(64 - BITS)).astype(np.int64))
                first = np.concatenate([s[~often], s[often]])
                prefix.append(first[: len(s) - -(-num * len(s) // den) + 1 if len(s) else 0].view(np.int64))
            long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *prefix])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), long(one), long(two), lists, pa.array(own, pa.binary())], names=["id", "n", "s1", "s2", "prefix", "sketch"])

    return docs.mapInArrow(run, _SETS)


def short_sketches(sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Sketches folded to what still tells unrelated sets apart: somewhat more buckets than linked sets may differ in."""

    @worker("jaccard", forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for size, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                m = SHORT_BUCKETS
                while 10 * m < 13 * room(size, size * den // num, num, den):
                    m *= 2
                out.append(_fold(np.frombuffer(own, np.uint8), m).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["node", "size", "sketch"])

    return sketches.select("node", "size", "sketch").mapInArrow(run, "node long, size long, sketch binary")


def texts_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """node and text of the nodes of pairs (a, b), and of the few others that the bit table can't tell from them."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    return among(docs.where("id is not null").select(F.col("id").alias("node"), "text"), nodes, "node")


def near_pairs(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches leave room for a link."""

    @worker("jaccard", forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, x, nb, y in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5))):
                m = min(len(x), len(y))
                keep.append(den * min(na, nb) >= num * max(na, nb) and int((_fold(np.frombuffer(x, np.uint8), m) != _fold(np.frombuffer(y, np.uint8), m)).sum()) <= room(na, nb, num, den))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([pc.filter(batch.column(k), mask) for k in (0, 1)], names=["a", "b"])

    left = sketches.select(F.col("node").alias("a"), F.col("size").alias("na"), F.col("sketch").alias("x"))
    right = sketches.select(F.col("node").alias("b"), F.col("size").alias("nb"), F.col("sketch").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "x", "nb", "y").mapInArrow(run, "a long, b long").distinct()


def exact_links(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, as a written table; many pairs may have one b."""
    texts = texts_of(docs, pairs)

    @worker("jaccard", forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            hit = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                other = known.get(y)
                if other is None:
                    if len(known) >= 64:
                        known.clear()
                    other = known[y] = tokens(y, n)
                hit.append(links(tokens(x, n), other, num, den))
            mask = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([pc.filter(batch.column(k), mask) for k in (0, 1)], names=["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return cut(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "jaccard-links", 500)


def open_groups(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of a query and a member that leave room for a link. rows: group, chunk, part, query (whether it is one), node, size, sketch.

    A task holds a group and a part of its queries. The matrix is the group's union by bucket: which bytes
    its members have there. In a bucket where the union lacks the query's byte, the query differs from every
    member; if there are too many such buckets for any link, the group stays shut.
    """

    def run(got: pa.Table) -> pa.Table:
        node, is_query, size = got["node"].to_numpy(), got["query"].to_numpy(zero_copy_only=False), got["size"].to_numpy()
        raw = got["sketch"].to_pylist()
        width = np.array([len(x) for x in raw])
        out_a, out_b, out_d = [], [], []
        asks = np.flatnonzero(is_query & (size > 0))
        for m in np.unique(width[asks]).tolist():
            for w in np.unique(width[~is_query]).tolist():
                small = min(m, w)
                members = np.flatnonzero(~is_query & (width == w) & (size > 0))
                if not len(members):
                    continue
                matrix = _fold(np.frombuffer(b"".join(raw[k] for k in members), np.uint8).reshape(len(members), w), small)
                union = np.zeros((small, 256), bool)
                union[np.arange(small)[None, :], matrix] = True
                sizes = size[members]
                for k in asks[width[asks] == m].tolist():
                    fits = (den * np.minimum(sizes, size[k]) >= num * np.maximum(sizes, size[k])) & (node[members] != node[k])
                    if not fits.any():
                        continue
                    mine = _fold(np.frombuffer(raw[k], np.uint8), small)
                    if small - int(union[np.arange(small), mine].sum()) > room(int(sizes[fits].max()), int(size[k]), num, den):
                        continue
                    at = np.flatnonzero(fits)
                    differ = (matrix[at] != mine).sum(axis=1)
                    few = differ <= room(sizes[at], size[k], num, den)
                    hit = node[members[at[few]]]
                    out_a += [node[k]] * len(hit)
                    out_b += hit.tolist()
                    out_d += differ[few].tolist()
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64()), "differ": pa.array(out_d, pa.int64())})

    return rows.groupBy("group", "chunk", "part").applyInArrow(run, "a long, b long, differ long")


def _matrix_links(shared: DataFrame, groups: DataFrame, stars: DataFrame, labels: DataFrame, sketches: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame | None:
    """Links between nodes that aren't connected yet."""
    about = groups.join(labels, "node", "left").join(sketches.select("node", F.col("size").alias("n")), "node")
    st = cut(shared.select("t", "node").join(about, "node").select("t", "node", "n", F.coalesce("comp", "node").alias("comp"), "group", "chunk"), "jaccard-open")
    per = st.groupBy("t", "comp").agg(F.count("*").alias("k")).groupBy("t").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("k", "comp")).alias("big")).where("comps > 1").select("t", "big")
    st = cut(st.join(per, "t"), "jaccard-cross")
    # of two nodes that aren't connected, one at least is outside the token's largest component
    queries = st.where("comp <> big").select("t", F.col("node").alias("q"), F.col("n").alias("nq"), F.col("comp").alias("cq"))
    index = st.groupBy("t", "group", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
    meet = queries.join(index, "t").where(f"not (c1 = cq and c2 = cq) and {den} * nq >= {num} * low and {num} * nq <= {den} * high")
    meet = cut(meet.select("q", "group", "chunk").distinct(), "jaccard-meet")
    if meet.isEmpty():
        return None
    parts = meet.groupBy("group", "chunk").agg(F.ceil(F.count("*") / QUERIES_PER_TASK).cast("int").alias("parts"))
    asked = meet.join(parts, ["group", "chunk"]).select("group", "chunk", F.pmod(F.xxhash64("q"), "parts").cast("int").alias("part"), F.lit(True).alias("query"), F.col("q").alias("node"))
    held = groups.join(parts, ["group", "chunk"]).select("group", "chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("query"), "node")
    rows = asked.unionByName(held).join(short_sketches(sketches, num, den), "node")
    near = open_groups(rows.select("group", "chunk", "part", "query", "node", "size", "sketch"), num, den)
    # one direction of each pair is enough
    near = cut(near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "differ").groupBy("a", "b").agg(F.min("differ").alias("differ")), "jaccard-near")

    def apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
        side = comps.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
        return pairs.join(side, "a", "left").join(side.toDF("b", "cb"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b", "differ")

    # first every node with its likeliest partner, so that near copies of one text connect by few links; then all that is still apart
    near = apart(near, labels)
    best = near.groupBy("a").agg(F.min_by("b", F.struct("differ", "b")).alias("b")).unionByName(near.groupBy("b").agg(F.min_by("a", F.struct("differ", "a")).alias("a")))
    first = exact_links(cut(near_pairs(best.distinct(), sketches, num, den), "jaccard-best", 2000), docs, n, num, den)
    labels = components(stars.unionByName(first), "jaccard-comp")
    rest = exact_links(cut(near_pairs(apart(near, labels).select("a", "b"), sketches, num, den), "jaccard-rest", 2000), docs, n, num, den)
    return first.unionByName(rest)


def join(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id of every row; two documents link where den * intersection >= num * union."""
    fed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = cut(scan_sets(fed, n, num, den, common_tokens(fed, n)), "jaccard-sets", 2000)
    # equal sets: the smallest id stands for all; rows of one id with different sets are one document
    real = sets.where("n > 0 and id is not null")
    same = cut(real.groupBy("s1", "s2", "n").agg(F.count("*").alias("k"), F.min("id").alias("node")).where("k > 1").drop("k"), "jaccard-same")
    folded = cut(real.select("id", "s1", "s2", "n").join(same, ["s1", "s2", "n"]).where("id <> node").select("id", "s1", "s2").distinct(), "jaccard-folded")
    if folded.count() <= DROP_BROADCAST:
        folded = F.broadcast(folded)
    nodes = real.join(folded, ["id", "s1", "s2"], "left_anti").withColumnRenamed("id", "node")
    index = nodes.select("node", F.explode("prefix").alias("t"))
    often = index.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    shared = cut(index.join(often, "t"), "jaccard-index")
    popular = shared.groupBy("node").agg(F.sum("df").alias("pop"), F.max(F.struct("df", "t"))["t"].alias("group"))
    size = popular.groupBy("group").agg(F.count("*").alias("k"), F.max_by("node", F.struct("pop", -F.col("node"))).alias("centre"))
    groups = cut(popular.join(size, "group").select("node", "group", "centre", F.pmod(F.xxhash64("node"), F.ceil(F.col("k") / GROUP)).cast("int").alias("chunk")), "jaccard-groups")
    sketches = nodes.select("node", F.col("n").alias("size"), "sketch")

    near = cut(near_pairs(groups.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")), sketches, num, den), "jaccard-star", 2000)
    stars = exact_links(near, fed, n, num, den)
    labels = components(stars, "jaccard-comp")
    more = _matrix_links(shared, groups.select("node", "group", "chunk"), stars, labels, sketches, fed, n, num, den)
    if more is not None:
        labels = components(stars.unionByName(more), "jaccard-comp")
    of = sets.select("id", "n", "s1", "s2").join(same, ["s1", "s2", "n"], "left").select("id", "n", F.coalesce("node", "id").alias("node"))
    # a document whose rows have different sets joins their nodes
    split = of.where("n > 0 and id is not null").groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("a")).where("a <> b")
    if not split.isEmpty():
        every = of.where("n > 0 and id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))
        labels = components(labels.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(every), "jaccard-comp")
    out = of.join(labels, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNull(), None).when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("comp", "node")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; rows that repeat an id go too, rows without an id stay."""
    found = join(docs, n, num, den, id_col, text_col)
    gone = cut(found.where(f"{id_col} <> component_id").select(F.col(id_col).alias("__gone")).distinct(), "jaccard-gone")
    twice = found.where(f"{id_col} is not null").groupBy(id_col).count().where("count > 1")
    if gone.count() <= DROP_BROADCAST:
        gone = F.broadcast(gone)
    kept = docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
    if twice.isEmpty():
        return kept
    return kept.where(f"{id_col} is not null").dropDuplicates([id_col]).unionByName(kept.where(f"{id_col} is null"))


def op7_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op7_token_group_join": op7_token_group_join}
