"""Personal data by bootstrapped contextual extraction.

Four regular expressions find base entities (email, ip, card, phone). They seed a graph of instances
and lexical patterns: the word before a mention (L1), the two before (L2), the word after (R1), the word
two before whatever is between (G), the word before without its marks, as in "tel:" and "Tel" (N), and a
name glued to its value, as in "mail:x" (K). A pattern's confidence is the smoothed share of all its
occurrences in the corpus that hold known instances; occurrences that hold something of the kind's shape
that isn't known count half. Instances score by the patterns they occur in, in turns; a candidate that no
expression matched becomes an identifier of a kind when strong patterns of that kind hold it and its shape
allows the kind. Whole words make patterns, however long they are.

Nothing of the corpus comes to the driver: mentions, patterns and scores are tables. What is broadcast
is a bit table of fixed size (``BITMAP_BITS``) that says which words need counting at all; its false
hits fall away in a join.

Results for odd input: a null text is an empty text and has no spans. Repeated rows each get the same
result. Very long texts and words are read whole. Ties (spans with one start, kinds with one score) order by
kind as listed in ``KINDS``. Extra columns are ignored by
``extract`` and pass through ``redact``. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from artiscope.llm._scratch import cut, drop, free_name, table
from artiscope.llm._worker import worker

KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match begins where a run of digits begins, so that a long run is read once
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9][0-9().\x20-]*")
# an email in disguise from its (at) on; what stands before that is looked for backwards
_SPOKEN = re.compile(r"[\[(]at[\])]\s*[A-Za-z0-9-]++(?:\s*[\[(]dot[\])]\s*[A-Za-z0-9-]++)+", re.I)
_SPOKEN_LOCAL = re.compile(r"[A-Za-z0-9._%+-]", re.I)
_EDGE = ".,;:!?\"'()[]{}<>*#$%&|=`"
#: What ends a name that is glued to its value, looked at backwards.
_APART = ",;:=&?|<>{}[]()\"'"

#: Distinct known instances that a pattern needs, the confidence it needs, and rounds of scoring.
MIN_SUPPORT, MIN_CONFIDENCE, ROUNDS = 3, 0.6, 3
BITMAP_BITS = 1 << 22
#: Accepted spans up to this many rows are broadcast to the texts; beyond it the join shuffles.
BROADCAST_ROWS = 50_000


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of ``_EMAIL``, looked for only around each @."""
    at, done = text.find("@"), 0
    while at >= 0:
        tail = _DOMAIN.match(text, at)
        if tail:
            start = at
            while start > done and (c := text[start - 1]) and (c.isascii() and c.isalnum() or c in "._%+-"):
                start -= 1
            if start < at:
                yield start, tail.end()
                done = tail.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base entities, by start, then kind."""
    out = [(s, e, 0) for s, e in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out, key=lambda x: (x[0], x[2]))


def shape_allows(kind: int, value: str) -> bool:
    """Whether a candidate looks enough like an identifier of the kind."""
    digits = sum(c.isdigit() for c in value)
    letters = sum(c.isalpha() for c in value)
    low = value.lower()
    return (
        ("@" in value or "(at)" in low or "[at]" in low) and letters >= 4,
        digits >= 4 and letters <= 12 and value.count(".") + value.count(":") >= 3,
        12 <= digits <= 19 and letters == 0,
        7 <= digits <= 15 and letters == 0,
    )[kind]


def fits(value: str) -> int:
    """The kinds that a value's shape allows, a bit each."""
    return sum(1 << k for k in range(len(KINDS)) if shape_allows(k, value))


def _disguised(text: str) -> Iterator[tuple[int, int]]:
    """Emails written with (at) and (dot)."""
    done = 0
    for m in _SPOKEN.finditer(text):
        end = m.start()
        while end > done and text[end - 1].isspace():
            end -= 1
        start = end
        while start > done and _SPOKEN_LOCAL.match(text[start - 1]):
            start -= 1
        if start < end:
            yield start, m.end()
            done = m.end()


def candidates(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Identifier-shaped spans that overlap no base span: tokens with four digits or more, groups of digits, emails in disguise."""
    found: list[tuple[int, int]] = []
    if "@" in text:
        at, done = text.find("@"), 0
        while at >= 0:
            s, e = at, at + 1
            while s > done and not text[s - 1].isspace():
                s -= 1
            while e < len(text) and not text[e].isspace():
                e += 1
            found.append((s, e))
            done = e
            at = text.find("@", e)
    if "at)" in text or "at]" in text or "AT)" in text or "AT]" in text:
        found += _disguised(text)
    done = 0
    for m in _DIGITS.finditer(text):
        if m.start() < done:
            continue
        s, e = m.start(), m.end()
        while e > s and text[e - 1] in " ().-":
            e -= 1
        while s > done and not text[s - 1].isspace():
            s -= 1
        while e < len(text) and not text[e].isspace():
            e += 1
        done = e
        if sum(map(text[s:e].count, "0123456789")) >= 4:
            found.append((s, e))
    out, last = [], 0
    spans = sorted(known)
    k = 0
    for s, e in sorted(found):
        while s < e and text[s] in _EDGE and not (text[s] == "(" and text[s + 1 : s + 2].isdigit()):
            s += 1
        while e > s and text[e - 1] in _EDGE:
            e -= 1
        while k < len(spans) and spans[k][1] <= s:
            k += 1
        if e - s >= 5 and s >= last and not any(a < e and b > s for a, b, _ in spans[k : k + 8]):
            out.append((s, e))
            last = e
    return out


def _beside(text: str, at: int, step: int) -> list[str]:
    """Up to four whole words before (step -1) or after ``at``; the nearest may be what is glued to it."""
    size = 160
    while True:
        end = max(0, at - size) if step < 0 else min(len(text), at + size)
        ws = text[min(at, end) : max(at, end)].split()
        if end in (0, len(text)):
            return ws[-4:] if step < 0 else ws[:4]
        if len(ws) > 4:  # the outermost may be cut
            return ws[1:][-4:] if step < 0 else ws[:-1][:4]
        size *= 8


def contexts(text: str, start: int, end: int) -> list[str]:
    """Patterns of a mention, in lower case. No part of a text that lies between two mentions is read more than a few times."""
    out = []
    if start and text[start - 1] in ":=":
        at = start - 1
        while at and not text[at - 1].isspace() and text[at - 1] not in _APART:
            at -= 1
        if name := text[at : start - 1].strip(_EDGE).lower():
            out.append("K " + name)
    at = start
    while at and text[at - 1] in _EDGE:
        at -= 1
    # a mention that is a part of a word has no words before it
    before = [w.lower() for w in _beside(text, at, -1)] if at and text[at - 1].isspace() else []
    if before:
        out.append("L1 " + before[-1])
        if name := before[-1].strip(_EDGE):
            out.append("N " + name)
        if len(before) > 1:
            out += [f"L2 {before[-2]} {before[-1]}", "G " + before[-2]]
    at = end
    while at < len(text) and text[at] in _EDGE:
        at += 1
    after = [w.lower() for w in _beside(text, at, 1)] if at < len(text) and text[at].isspace() else []
    if after:
        out.append("R1 " + after[0])
    return out


_MENTION = T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("value", T.StringType()), T.StructField("fits", T.IntegerType()), T.StructField("patterns", T.ArrayType(T.StringType()))])
_SCAN = T.StructType([T.StructField("text_key", T.StringType()), T.StructField("base", T.StringType()), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("mentions", T.ArrayType(_MENTION))])


def text_key(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def write_spans(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each document: the base entities, and all mentions with their patterns (kind -1: a candidate)."""
    fed = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    @worker("pii")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mention = pa.struct([("s", pa.int32()), ("e", pa.int32()), ("kind", pa.int32()), ("value", pa.string()), ("fits", pa.int32()), ("patterns", pa.list_(pa.string()))])
        for batch in batches:
            keys, bases, counts, mentions = [], [], [[] for _ in KINDS], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                known = base_spans(text)
                keys.append(text_key(text))
                bases.append(write_spans(known))
                tally = Counter(k for _, _, k in known)
                for k, col in enumerate(counts):
                    col.append(tally[k])
                seen = [*known, *((s, e, -1) for s, e in candidates(text, known))]
                mentions.append([{"s": s, "e": e, "kind": k, "value": text[s:e].lower(), "fits": fits(text[s:e]), "patterns": contexts(text, s, e)} for s, e, k in seen])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), pa.array(bases, pa.string()), *(pa.array(c, pa.int64()) for c in counts), pa.array(mentions, pa.list_(mention))], names=["id", *_SCAN.fieldNames()])

    return fed.mapInArrow(run, T.StructType([T.StructField("id", fed.schema["id"].dataType), *_SCAN]))


_SALT = {"L1": 1, "R1": 2, "G": 3, "N": 4, "K": 5, "L2": 6}


def _crc(words) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64)


def _slots(kind: str, a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    x = (a + np.uint64(_SALT[kind] << 33)) * np.uint64(0x9E3779B97F4A7C15)
    if b is not None:
        x = (x ^ (x >> np.uint64(31))) + b * np.uint64(0x165667B19E3779F9)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - 22)).astype(np.int64)


def _slot(pattern: str) -> int:
    kind, _, words = pattern.partition(" ")
    return int(_slots(kind, *(_crc([w]) for w in words.split(" ")))[0])


def tally_patterns(text: str, table_: np.ndarray, tally: Counter) -> None:
    """Add the occurrences of patterns with a bit in the table, at every word of a text that could be a mention."""
    words = text.lower().split()
    h = _crc(words)
    for i, w in enumerate(words):
        if ":" in w or "=" in w:
            for m in re.finditer("[:=]", w):
                name = w[: m.start()].strip(_EDGE)
                if name and m.end() < len(w) and table_[_slot("K " + name)]:
                    tally["K " + name] += 1
    if len(words) < 2:
        return
    names = h.copy()
    odd = [i for i, w in enumerate(words) if not w.isalnum()]
    bare = {i: words[i].strip(_EDGE) for i in odd}
    names[odd] = _crc(bare.values())
    for i in np.flatnonzero(table_[_slots("L1", h[:-1])]).tolist():
        tally["L1 " + words[i]] += 1
    for i in np.flatnonzero(table_[_slots("N", names[:-1])]).tolist():
        if name := bare.get(i, words[i]):
            tally["N " + name] += 1
    for i in (np.flatnonzero(table_[_slots("R1", h[1:])]) + 1).tolist():
        tally["R1 " + words[i]] += 1
    for i in np.flatnonzero(table_[_slots("G", h[:-2])]).tolist():
        tally["G " + words[i]] += 1
    for i in np.flatnonzero(table_[_slots("L2", h[:-2], h[1:-1])]).tolist():
        tally[f"L2 {words[i]} {words[i + 1]}"] += 1


def occurrences(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """How often each pattern of ``wanted`` (column pattern) holds any word at all, over the whole corpus."""

    @worker("pii")
    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_slot(p) for p in batch.column(0).to_pylist()], pa.int64())], names=["slot"])

    # at most BITMAP_BITS / 64 rows of one word each, however many patterns there are
    words = wanted.select("pattern").mapInArrow(slots, "slot long").groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    bitmap = np.zeros(BITMAP_BITS >> 6, np.uint64)
    for r in words.collect():
        bitmap[r["word"]] = r["bits"] & 0xFFFFFFFFFFFFFFFF
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    @worker("pii")
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little").view(bool)
        tally: Counter = Counter()

        def flush():
            yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], names=["pattern", "n"])
            tally.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                tally_patterns(text, table_, tally)
                if len(tally) > 100_000:
                    yield from flush()
        yield from flush()

    texts = docs.select(F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    return texts.mapInArrow(count, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).join(wanted.select("pattern"), "pattern", "left_semi")


def score_graph(edges: DataFrame, totals: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Scores of patterns and of candidates, per kind, after ``rounds`` of mutual scoring.

    edges: pattern, value, fits, kind (-1: a candidate), n. totals: pattern, n. Both results have a column for
    each kind; patterns below the support or the confidence give nothing to their candidates.
    """
    zero = F.lit(0.0)
    seeds = edges.where("kind >= 0").groupBy("value").agg(*[F.max((F.col("kind") == k).cast("double")).alias(x) for k, x in enumerate(KINDS)])
    candidates_ = edges.where("kind < 0").select("pattern", "value", "fits").distinct()
    scores = seeds
    patterns = found = None
    for turn in range(rounds):
        score = lambda x: F.coalesce(x, zero)
        open_ = lambda k, x: (F.col("kind") < 0) & (F.col("fits").bitwiseAND(1 << k) != 0) & (score(x) < min_confidence)
        sums = [
            y
            for k, x in enumerate(KINDS)
            for y in (
                F.sum(F.col("n") * score(x)).alias(x),
                F.sum(F.when(score(x) >= min_confidence, 1).otherwise(0)).alias(f"{x}_support"),
                F.sum(F.when(open_(k, x), F.col("n")).otherwise(0)).alias(f"{x}_open"),
            )
        ]
        held = edges.join(scores, "value", "left").groupBy("pattern").agg(*sums).join(totals.withColumnRenamed("n", "total"), "pattern")
        share = lambda x: (F.col(x) + 0.5) / (F.greatest("total", x) - 0.5 * F.col(f"{x}_open") + 1)
        fresh = held.select("pattern", *[F.when((F.col(f"{x}_support") >= min_support) & (share(x) >= min_confidence), F.least(share(x), F.lit(1.0))).otherwise(zero).alias(x) for x in KINDS]).where(" + ".join(KINDS) + " > 0")
        patterns = cut(fresh, f"pii-patterns-{turn}")
        # a candidate's score: the noisy or of the patterns that hold it, of the kinds that its shape allows
        best = [F.when(F.first("fits").bitwiseAND(1 << k) != 0, 1 - F.exp(F.sum(F.log(F.greatest(1 - F.col(x), F.lit(1e-9)))))).otherwise(zero).alias(x) for k, x in enumerate(KINDS)]
        found = candidates_.join(patterns, "pattern").groupBy("value").agg(*best)
        scores = seeds.unionByName(found).groupBy("value").agg(*[F.max(x).alias(x) for x in KINDS])
    return patterns, found


def discover(mentions: DataFrame, docs: DataFrame, text_col: str, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """Spans that the method adds: text_key, s, e, kind; one kind for each, the best by score, then order of ``KINDS``.

    mentions: text_key and the fields of a mention.
    """
    edges = mentions.select("value", "fits", "kind", F.explode("patterns").alias("pattern")).groupBy("pattern", "value", "fits", "kind").agg(F.count("*").alias("n"))
    edges = cut(edges, "pii-edges")
    # only patterns that could reach the support at any round: enough distinct values in all, seeds or not, as candidates
    # that a round finds support the patterns of the next
    wanted = edges.groupBy("pattern").agg(F.countDistinct("value").alias("values")).where(f"values >= {min_support}")
    wanted = cut(wanted, "pii-wanted")
    totals = cut(occurrences(docs, text_col, wanted), "pii-totals")
    patterns, found = score_graph(edges.join(wanted.select("pattern"), "pattern", "left_semi"), totals, rounds, min_support, min_confidence)
    best = F.array_max(F.array(*[F.struct(F.col(x).alias("score"), F.lit(-k).alias("rank")) for k, x in enumerate(KINDS)]))
    fit = found.select("value", best.alias("best")).where(F.col("best.score") >= min_confidence).select("value", (-F.col("best.rank")).alias("kind"))
    added = mentions.where("kind < 0").select("text_key", "s", "e", "value").join(fit, "value").select("text_key", "s", "e", "kind").distinct()
    return cut(added, "pii-added")


def mentions_of(scanned: DataFrame) -> DataFrame:
    return scanned.select("text_key", F.explode("mentions").alias("m")).select("text_key", "m.*")


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = 3, **how) -> DataFrame:
    """How well discovery finds what it isn't told: for each kind the seeds hidden (a value in ``one_in``, as candidates), how many spans came back, and with another kind."""
    scanned = cut(scan(docs, id_col, text_col), "pii-scan")
    told = mentions_of(scanned).withColumn("was", F.col("kind")).withColumn("kind", F.when((F.col("kind") >= 0) & (F.pmod(F.xxhash64("value"), F.lit(one_in)) == 0), -1).otherwise(F.col("kind")))
    got = discover(told.drop("was"), docs, text_col, **how).withColumnRenamed("kind", "got")
    hidden = told.where("kind < 0 and was >= 0").select("text_key", "s", "e", "was").distinct()
    rows = hidden.join(got, ["text_key", "s", "e"], "left").groupBy("was")
    return rows.agg(F.count("*").alias("hidden"), F.count(F.when(F.col("got") == F.col("was"), 1)).alias("found"), F.count(F.when(F.col("got") != F.col("was"), 1)).alias("mistaken"))


def _join_added(rows: DataFrame, added: DataFrame, key: str, out: str = "added") -> DataFrame:
    """``rows`` with the added spans of their text, null where there are none."""
    lists = added.groupBy(F.col("text_key").alias(key)).agg(F.sort_array(F.collect_list(F.struct("s", "e", "kind"))).alias(out))
    if added.count() <= BROADCAST_ROWS:
        lists = F.broadcast(lists)
    return rows.join(lists, key, "left")


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row for each row of ``docs``: id, counts of base entities, base_sha256, spans (base and added), n_added, n_spans."""
    scanned = cut(scan(docs, id_col, text_col), "pii-scan")
    added = discover(mentions_of(scanned), docs, text_col, **how)
    kind = F.array(*map(F.lit, KINDS))
    parts = F.transform("added", lambda a: F.struct(a["s"].alias("s"), a["kind"].alias("kind"), F.concat_ws(":", F.element_at(kind, a["kind"] + 1), a["s"], a["e"]).alias("t")))
    base = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("s"), (F.array_position(kind, F.split(x, ":")[0]) - 1).cast("int").alias("kind"), x.alias("t")))
    both = F.array_sort(F.concat(base, F.coalesce(parts, F.array().cast("array<struct<s:int,kind:int,t:string>>"))))
    return _join_added(scanned.drop("mentions"), added, "text_key").select(
        F.col("id").alias(id_col), *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), F.array_join(F.transform(both, lambda x: x["t"]), ",").alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"), F.size(both).cast("long").alias("n_spans")
    )


def redact_text(text: str, added) -> str:
    """Every span, base or added, replaced by its kind; of overlapping spans the union takes the first one's kind."""
    spans = sorted([*base_spans(text), *((a["s"], a["e"], a["kind"]) for a in added or ())])
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", **how) -> DataFrame:
    """``docs`` with every identifier replaced by <EMAIL>, <IP>, <CARD> or <PHONE>; the same columns, the length brought up to date."""
    scanned = cut(scan(docs, id_col, text_col).where(F.size("mentions") > 0).select("text_key", "mentions"), "pii-scan")
    added = discover(mentions_of(scanned), docs, text_col, **how)
    names = docs.columns
    key = free_name("text_key", names)
    at = names.index(text_col)
    list_name = free_name("added", [*names, key])
    counts = chars_col in names if chars_col else False

    if added.count() == 0:
        rows = docs.withColumn(list_name, F.lit(None).cast("array<struct<s:int,e:int,kind:int>>"))
    else:
        keyed = docs.withColumn(key, F.pandas_udf(lambda s: s.fillna("").map(text_key), "string")(F.col(text_col).cast("string")))
        rows = _join_added(keyed, added, key, list_name).select(*names, list_name)

    @worker("pii")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()
            new = [None if t is None else redact_text(t, a) for t, a in zip(texts, lists)]
            cols = list(batch.columns[: len(names)])
            cols[at] = pa.array(new, cols[at].type)
            if counts:
                n = names.index(chars_col)
                cols[n] = pa.array([old if t == was else len(t) for old, t, was in zip(cols[n].to_pylist(), new, texts)], cols[n].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(run, docs.schema)


def op1_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op1_pii_bootstrap": op1_pii_bootstrap}
