"""Removal of repeated byte strings, by interleave refinement of suffixes as in the merging of Burrows-Wheeler transforms.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else in the corpus goes. A
string can only repeat where its anchor does: the smallest hash of its ``GRAM``-byte grams, leftmost on
ties, which equal strings have at equal places. Successive strings with one anchor make a segment. Anchors
that occur once need no further look, however many there are, and of equal segments one is kept with
their number: both are counted with map-side combination, so no group of copies meets in one task.

What is left are anchors with several different segments. Each segment is a shard of a few hundred
suffixes, and the shards of an anchor are merged by interleave refinement: from the interleave of all
suffixes by their first h bytes comes the interleave by h + 8 by one stable distribution on the eight bytes
that stand before them (the LF step in text coordinates, with eight bytes as a symbol). Where two neighbours
part in a pass, their common prefix ends; suffixes that share theirs with nobody leave the refinement, and
after ``LENGTH`` / 8 passes its classes are the repeated intervals. No suffix array is sorted. Suffixes of
different distance from the anchor never share a class, so a large group is dealt out by that distance.

Results for odd input: a null text is an empty text; texts below ``LENGTH`` bytes lose nothing. Repeated
rows are copies of each other. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from artiscope.llm._scratch import among, cut, table
from artiscope.llm._worker import worker

#: Bytes of a repeated string and of a gram. Strings with one anchor start within ``LENGTH - GRAM + 1`` bytes.
LENGTH, GRAM, SYMBOL = 200, 64, 8
REACH = LENGTH - GRAM + 1
#: Bytes of text that are hashed together, bytes of segments that are refined together, segments of an anchor in one task.
BLOCK, REFINE, GROUP = 1 << 17, 1 << 20, 4096
LONG_TEXT = 1 << 18
#: A kind of segment with more than one in HOT of the rows is joined by broadcast.
HOT = 256

_TABLE = np.frombuffer(b"".join(hashlib.blake2b(bytes([k]), digest_size=8).digest() for k in range(256)), "<u8").copy()
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(n + (n >> 2), base, np.uint64)
        got[0] = 1
        got = _powers[base] = np.multiply.accumulate(got)
    return got[:n]


def segments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of all strings of ``LENGTH`` bytes in the texts, those in a row with one anchor: text, start, strings, anchor's place in the segment, hash of the anchor, hash of the segment."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    x = np.frombuffer(b"".join(texts), np.uint8)
    n = len(x)
    if n < LENGTH:
        return none
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[x] * _power(_BASE, n), out=sums[1:])
    back = _power(_INVERSE, n)
    h = (sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    # the place in the low bits makes the minimum the leftmost of equal ones, and tells where it is
    key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    rows = np.concatenate([key, np.full(-len(h) % REACH + REACH, 0xFFFFFFFFFFFFFFFF, np.uint64)]).reshape(-1, REACH)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - LENGTH + 1
    low = np.minimum(behind[:count], ahead[REACH - 1 : REACH - 1 + count])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    valid = np.arange(LENGTH, count + LENGTH) <= np.repeat(ends, sizes)[:count]
    turn = np.ones(count, bool)
    turn[1:] = (low[1:] != low[:-1]) | ~valid[:-1]
    first = np.flatnonzero(turn & valid)
    if not len(first):
        return none
    stops = np.append(np.flatnonzero(turn | ~valid), count)
    strings = stops[np.searchsorted(stops, first, side="right")] - first
    place = (low[first] & np.uint64(0xFFFFFF)).astype(np.int64)
    whole = (sums[first + strings + LENGTH - 1] - sums[first]) * back[first] + strings.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    of = np.searchsorted(ends, first, side="right")
    return of, first - (ends - sizes)[of], strings, place - first, h[place], whole


def _split(text: bytes) -> list[tuple[int, bytes]]:
    """A very long text in parts that overlap so that every string lies in one."""
    if len(text) <= LONG_TEXT:
        return [(0, text)]
    return [(s, text[s : s + LONG_TEXT + LENGTH - 1]) for s in range(0, len(text) - LENGTH + 1, LONG_TEXT)]


_OCCURRENCES = "u long, start int, strings int, place int, h long, g long"


def scan(docs: DataFrame) -> DataFrame:
    """The segments of all texts; docs: u (of the row), text."""

    @worker("bytes")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = batch.column(0).to_numpy(zero_copy_only=False)
            texts, owner, shift, size = [], [], [], 0

            def flush():
                of, start, strings, place, h, g = segments(texts)
                cols = (u[np.array(owner, np.int64)[of]], (start + np.array(shift, np.int64)[of]).astype(np.int32), strings.astype(np.int32), place.astype(np.int32), h.view(np.int64), g.view(np.int64))
                return pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=["u", "start", "strings", "place", "h", "g"])

            for k, text in enumerate(batch.column(1)):
                for at, part in _split(text.as_py() or b""):
                    if len(part) >= LENGTH:
                        texts.append(part)
                        owner.append(k)
                        shift.append(at)
                        size += len(part)
                if size >= BLOCK:
                    yield flush()
                    texts, owner, shift, size = [], [], [], 0
            if texts:
                yield flush()

    return docs.mapInArrow(run, _OCCURRENCES)


def refine(group: np.ndarray, place: np.ndarray, strings: np.ndarray, raw: list[bytes], parts: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Masks (a row of three 64-bit numbers each) of the strings of segments that another segment of the group has too."""
    count = len(raw)
    x = np.frombuffer(b"".join(raw) + b"\0" * SYMBOL, np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, count)
    base = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(count), strings)
    j = np.arange(int(strings.sum())) - np.repeat(np.cumsum(strings) - strings, strings)
    distance = place[owner] - j
    mine = distance % parts[owner] == part[owner]
    owner, j, distance = owner[mine], j[mine], distance[mine]
    pos = base[owner] + j
    symbols = np.ndarray(len(x) - SYMBOL + 1, "<u8", x.tobytes(), 0, (1,))  # the eight bytes at every place
    # the interleave of depth 0: suffixes that end their strings, by group and distance
    start = group[owner] * (2 * LENGTH) + distance
    order = np.argsort(start, kind="stable")
    edge = np.append(True, start[order][1:] != start[order][:-1])
    for depth in range(LENGTH - SYMBOL, -1, -SYMBOL):
        # those alone in their class share no longer prefix
        alone = edge & np.append(edge[1:], True)
        cls = np.cumsum(edge)[~alone]
        order = order[~alone]
        if not len(order):
            break
        symbol = symbols[pos[order] + depth]
        move = np.argsort(symbol, kind="stable")
        order, cls, symbol = order[move], cls[move], symbol[move]
        edge = np.append(True, (symbol[1:] != symbol[:-1]) | (cls[1:] != cls[:-1]))
    out = np.zeros((count, 3), np.uint64)
    if len(order):
        hit = order[~(edge & np.append(edge[1:], True))]
        np.bitwise_or.at(out, (owner[hit], j[hit] >> 6), np.uint64(1) << (j[hit] & 63).astype(np.uint64))
    return out


def merge_groups(rows: DataFrame) -> DataFrame:
    """Masks of segments. rows: h, g, parts, part, place, strings, raw; a task works on whole groups, as many as fit ``REFINE``."""

    @worker("bytes")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(rows_):
            key = {}
            group = np.array([key.setdefault((r[0], r[3]), len(key)) for r in rows_], np.int64)
            cols = [np.array([r[k] for r in rows_], np.int64) for k in (4, 5, 2, 3)]
            masks = refine(group, cols[0], cols[1], [r[6] for r in rows_], cols[2], cols[3])
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows_], pa.int64()), pa.array([r[1] for r in rows_], pa.int64()), *(pa.array(masks[:, k].view(np.int64)) for k in range(3))], names=["h", "g", "m0", "m1", "m2"])

        last = None
        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if size >= REFINE and (r[0], r[3]) != last:
                    yield flush(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[6])
                last = (r[0], r[3])
        if held:
            yield flush(held)

    near = rows.repartition("h", "part").sortWithinPartitions("h", "part")
    return near.mapInArrow(run, "h long, g long, m0 long, m1 long, m2 long").groupBy("h", "g").agg(*[F.bit_or(m).alias(m) for m in ("m0", "m1", "m2")])


def _segment_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (h, g, parts, u, start, strings, place) with the bytes of each segment, once for each part."""
    lists = wanted.groupBy("u").agg(F.collect_list(F.struct("h", "g", "parts", "start", "strings", "place")).alias("want"))
    texts = among(docs.select("u", "text"), lists, "u").dropDuplicates(["u"])
    rows = texts.join(lists, "u").select("text", "want")

    @worker("bytes")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            flush = lambda rows_: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows_)) or [()] * 7, kinds)], names=["h", "g", "parts", "part", "place", "strings", "raw"])
            out: list[tuple] = []
            for text, want in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                for w in want.as_py():
                    raw = text[w["start"] : w["start"] + w["strings"] + LENGTH - 1]
                    out += [(w["h"], w["g"], w["parts"], p, w["place"], w["strings"], raw) for p in range(w["parts"])]
                if len(out) >= 4096:
                    yield flush(out)
                    out = []
            yield flush(out)

    return rows.mapInArrow(run, "h long, g long, parts int, part int, place int, strings int, raw binary")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """u and the list of (start, strings, masks) of its segments with repeated strings; docs: u, text as bytes."""
    found = scan(docs)
    anchors = found.groupBy("h").agg(F.count("*").alias("n"), F.min("g").alias("low"), F.max("g").alias("high")).where("n > 1")
    anchors = cut(anchors.select("h", (F.col("low") != F.col("high")).alias("several")), "bytes-anchors")
    again = cut(found.join(anchors, "h"), "bytes-again")
    kinds = cut(again.where("several").groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("u", "start", "strings", "place")).alias("one")), "bytes-kinds")
    parts = kinds.groupBy("h").agg(F.least(F.ceil(F.count("*") / GROUP), F.lit(REACH)).cast("int").alias("parts"))
    merged = merge_groups(_segment_bytes(docs, kinds.join(parts, "h").select("h", "g", "parts", "one.*")))
    full = F.lit(-1).cast("long")
    masks = kinds.join(merged, ["h", "g"], "left").select("h", "g", "n", *[F.when(F.col("n") > 1, full).otherwise(F.coalesce(m, F.lit(0).cast("long"))).alias(m) for m in ("m0", "m1", "m2")])
    one = again.where("not several").select("u", "start", "strings", *[full.alias(m) for m in ("m0", "m1", "m2")])
    masks = cut(masks.where("m0 <> 0 or m1 <> 0 or m2 <> 0"), "bytes-masks")
    # a kind of segment that holds more than one row in HOT: there are fewer than HOT of them, so their masks are broadcast
    # and their rows don't meet in one task
    rows, cols = again.where("several"), ("u", "start", "strings", "m0", "m1", "m2")
    hot = F.broadcast(masks.where(F.col("n") * HOT > again.count()))
    few = rows.join(hot, ["h", "g"]).select(*cols)
    more = few.unionByName(rows.join(hot, ["h", "g"], "left_anti").join(masks, ["h", "g"]).select(*cols))
    # rows with one u are copies of each other with the same segments
    return one.unionByName(more).groupBy("u").agg(F.collect_set(F.struct("start", "strings", "m0", "m1", "m2")).alias("found"))


def covered(size: int, found: list[dict]) -> np.ndarray:
    """Which bytes of a text go."""
    edge = np.zeros(size + 1, np.int32)
    for f in found:
        start, strings = f["start"], f["strings"]
        bits = (f["m0"] & (1 << 64) - 1) | (f["m1"] & (1 << 64) - 1) << 64 | (f["m2"] & (1 << 64) - 1) << 128
        bits &= (1 << strings) - 1
        at = start
        while bits:
            skip = (bits & -bits).bit_length() - 1
            bits >>= skip
            at += skip
            run = (~bits & bits + 1).bit_length() - 1
            edge[at] += 1
            edge[at + run + LENGTH - 1] -= 1
            bits >>= run
            at += run
    return np.cumsum(edge[:-1]) > 0


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start, end of each removed run) for every row."""
    fed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    fed = fed.select(F.xxhash64(F.col("id").cast("string"), "t").alias("u"), F.col("t").cast("binary").alias("text"), "id")
    found = cut(repeated_spans(fed.select("u", "text")), "bytes-found")
    touched = among(fed, found, "u").join(found, "u", "left").select("id", "text", "found")
    untouched = among(fed, found, "u", inside=False).select("id", "text", F.lit(None).cast(found.schema["found"].dataType).alias("found"))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField(id_col, fed.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(span))])

    @worker("bytes")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for text, got in zip(batch.column(1), batch.column(2)):
                text, got = text.as_py(), got.as_py()
                kept, spans, gone = text, [], 0
                if got:
                    mask = covered(len(text), got)
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                    spans = [{"start": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2])]
                    gone = int(mask.sum())
                    kept = np.frombuffer(text, np.uint8)[~mask].tobytes()
                for col, v in zip(cols, (len(text), gone, len(spans), hashlib.sha256(kept).hexdigest(), spans)):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], kind)], names=schema.fieldNames())

    return touched.unionByName(untouched).mapInArrow(run, schema)


def op2_bwt_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op2_bwt_byte_dedup": op2_bwt_byte_dedup}
