"""Phrases of two and three words that hold together, by best-first growth with admissible bounds.

Everything is counted within a language. The words and pairs of words of the corpus are counted first; the pairs are the
nodes of the search. A phrase that grows from the pair (u, v) occurs at most f(u v) times, and what follows u occurs at least
as often as the phrase, so its score is at most f(u v) / f(u): counts of prefixes bound all that can grow from a node, the
node's own score included. Nodes are expanded best bound first: a pass over the corpus counts the phrases of three words
that begin or end with a pair of the frontier, which tells the scores of those that grow from it and which pairs a longer
phrase swallows. The search is settled for a language when the score at the last wanted rank of what survives is not below the
bound of any node that is left; nodes with a bound equal to it are expanded too, so ties are whole.

A pass tells frontier pairs by a bit table of fixed size. A pair that is taken for one of the frontier by mistake only has
more phrases counted, all of them in full, so no result depends on the table. The number of passes does not grow with the data:
a first guess of the last wanted score (``SLACK`` times the rank, among pairs), a second pass down to the score that the first
one found, and guesses eight times as deep where too few phrases survived.

Ranks are never taken over all candidates of a language in one task: scores are whole numbers up to SCALE, so that
a count by score gives the score at a rank, and what reaches it is ranked in parts first.

Odd input: a null text is empty, a null language is ``und``; repeated rows count each; a piece without a word has no phrase;
texts are taken in slices between pieces, a piece is whole however long. Equal scores are ranked by count and then by
phrase. Languages with too few phrases give all they have. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from artiscope.llm._scratch import cut, drop, table
from artiscope.llm._worker import worker

#: Scores are millionths.
SCALE = 1_000_000
#: The first guess of the last wanted score is the score at so many times that rank among pairs.
SLACK = 2
#: Bytes of text that are counted at a time.
SLICE = 8 << 20
#: Bits of the table that tells pairs of the frontier; one of 2 ** BITS bits is sent to all tasks.
BITS = 25

FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
COUNTS = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])
COUNTS_SQL = "lang string, k int, phrase string, f long"


def _slices(texts: list[bytes]) -> Iterator[bytes]:
    """Folded texts, in slices of about SLICE bytes that end between pieces (``\\n``)."""
    held, size = [], 0
    for text in texts:
        text, at = text.translate(FOLD), 0
        while len(text) - at > SLICE:
            end = text.rfind(b"\n", at, at + SLICE)
            end = text.find(b"\n", at + SLICE) if end <= at else end
            if end < 0:
                break
            yield text[at:end]
            at = end + 1
        held.append(text[at:])
        size += len(held[-1])
        if size >= SLICE:
            yield b"\n".join(held)
            held, size = [], 0
    if size:
        yield b"\n".join(held)


def _coded(folded: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Words as numbers from 1, pieces set apart by 0; and the words by number."""
    ids: dict[bytes, int] = defaultdict(count().__next__)
    ids[b"\n"]
    tokens = [w for w in folded.replace(b"\n", b" \n ").split(b" ") if w]
    return np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens)), list(ids)


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Slices of each language's texts, from batches of (lang, text); what is held is bounded by a slice a language of a batch."""
    for batch in batches:
        texts: dict[str, list[bytes]] = defaultdict(list)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            texts[lang].append(text)
        for lang, own in texts.items():
            for part in _slices(own):
                yield lang, part


def _pairs(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of adjacent words, and where both are of one piece."""
    return ids[:-1] * n + ids[1:], (ids[:-1] > 0) & (ids[1:] > 0)


def _emit(lang: str, k: int, phrases: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
    n = len(phrases)
    return pa.record_batch([pa.array([lang] * n, pa.string()), pa.array(np.full(n, k, np.int32)), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts.astype(np.int64))], schema=COUNTS)


@worker("collocations")
def count_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (k = 1) and pairs (k = 2) by slice, and of all words (k = 0)."""
    for lang, part in _by_lang(batches):
        ids, words = _coded(part)
        n, single = len(words), np.bincount(ids, minlength=len(words))[1:]
        if not single.sum():
            continue
        yield _emit(lang, 0, [b""], np.array([single.sum()]))
        yield _emit(lang, 1, words[1:], single)
        codes, ok = _pairs(ids, n)
        pair, times = np.unique(codes[ok], return_counts=True)
        yield _emit(lang, 2, [words[c // n] + b" " + words[c % n] for c in pair.tolist()], times)


def slot(lang: str, phrases: list[bytes]) -> np.ndarray:
    """Places of phrases in a bit table; as ``slot_of`` gives them."""
    head = lang.encode() + b"\n"
    return np.fromiter((xxhash.xxh64_intdigest(head + p, 42) for p in phrases), np.uint64, len(phrases)) >> np.uint64(64 - BITS)


def slot_of(lang: str, phrase: str) -> F.Column:
    return F.shiftrightunsigned(F.xxhash64(F.concat_ws("\n", lang, phrase)), 64 - BITS)


def bit_table(pairs: DataFrame) -> np.ndarray:
    """Bits of the pairs (lang, phrase): 2 ** BITS at most, whatever the number of pairs."""
    place = slot_of("lang", "phrase")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    rows = pairs.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _has(table_: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (table_[(places >> np.uint64(6)).astype(np.int64)] >> (places & np.uint64(63))) & np.uint64(1) == 1


def count_grown(frontier, frequent):
    """A function over batches that counts phrases of three words with a pair of ``frontier`` at either end; both pairs are among ``frequent`` (broadcast bit tables)."""

    @worker("collocations")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, part in _by_lang(batches):
            ids, words = _coded(part)
            if len(ids) < 3:
                continue
            n = len(words)
            codes, ok = _pairs(ids, n)
            pair, at = np.unique(np.where(ok, codes, -1), return_inverse=True)
            text = [words[c // n] + b" " + words[c % n] if c >= 0 else b"" for c in pair.tolist()]
            places = slot(lang, text)
            often, wanted = _has(frequent.value, places) & (pair >= 0), _has(frontier.value, places)
            here = often[at[:-1]] & often[at[1:]] & (wanted[at[:-1]] | wanted[at[1:]])
            triple, times = np.unique(at[:-1][here] * n + ids[2:][here], return_counts=True)
            if len(triple):
                yield _emit(lang, 3, [text[c // n] + b" " + words[c % n] for c in triple.tolist()], times)

    return run


@F.pandas_udf(T.LongType())
def score(a: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
    """floor(SCALE * a * a / (left * right)), exactly."""
    return pd.Series([SCALE * x * x // (y * z) for x, y, z in zip(a.tolist(), left.tolist(), right.tolist(), strict=True)], dtype="int64")


def reached(scored: DataFrame, rank: int) -> DataFrame:
    """For each lang with ``rank`` rows or more, floor: the score at that rank. Counts by score, so at most SCALE + 1 rows a lang meet."""
    per = scored.groupBy("lang", "score").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0))
    return per.withColumn("upto", upto).where(F.col("upto") >= rank).groupBy("lang").agg(F.max("score").alias("floor"))


def ranked(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each lang with their rank; rows that reach the score at that rank are ranked in parts first."""
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = scored.join(reached(scored, top), "lang", "left").where("floor is null or score >= floor").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    first = near.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("floor", "part")


def _counted(texts: DataFrame, f, least: int, tag: str) -> DataFrame:
    return cut(texts.mapInArrow(f, COUNTS_SQL).groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("k") == 0)), tag)


def _word(grams: DataFrame, k: int, phrase: str, f: str) -> DataFrame:
    return grams.where(F.col("k") == k).select("lang", F.col("phrase").alias(phrase), F.col("f").alias(f))


def nodes_of(grams: DataFrame) -> DataFrame:
    """Pairs with their counts, score and bound: no phrase that begins with the pair, itself included, has a higher score."""
    pair = _word(grams, 2, "phrase", "a").withColumn("w1", F.substring_index("phrase", " ", 1)).withColumn("w2", F.substring_index("phrase", " ", -1))
    both = pair.join(_word(grams, 1, "w1", "l"), ["lang", "w1"]).join(_word(grams, 1, "w2", "r"), ["lang", "w2"])
    return both.select("lang", "phrase", "a", "l", "r", score("a", "l", "r").alias("score"), score("a", "l", "a").alias("bound"))


def grown_of(triples: DataFrame, grams: DataFrame) -> DataFrame:
    """Counted phrases of three words with the counts at their lowest-scoring cut (the first of equal ones) and score."""
    words = F.split("phrase", " ")
    three = triples.select("lang", "phrase", F.col("f").alias("a"), words[0].alias("w1"), words[2].alias("w3"), F.concat_ws(" ", words[0], words[1]).alias("p12"), F.concat_ws(" ", words[1], words[2]).alias("p23"))
    for k, phrase, f in ((1, "w1", "f1"), (1, "w3", "f3"), (2, "p12", "f12"), (2, "p23", "f23")):
        three = three.join(_word(grams, k, phrase, f), ["lang", phrase])
    cuts = three.withColumn("s1", score("a", "f1", "f23")).withColumn("s2", score("a", "f12", "f3"))
    early = F.col("s1") <= F.col("s2")
    return cuts.select("lang", "phrase", "a", F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"), "p12", "p23")


def survivors(nodes: DataFrame, grown: DataFrame) -> DataFrame:
    """Expanded pairs that no longer phrase swallows, and the longer phrases. A pair is swallowed by a phrase with half of its count or more."""
    within = grown.select("lang", F.explode(F.array("p12", "p23")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = nodes.join(within, ["lang", "phrase"], "left").where("longest is null or longest < a - longest")
    cols = ["lang", "phrase", "a", "l", "r", "score"]
    return kept.select(*cols).unionByName(grown.select(*cols))


def mine(docs: DataFrame, top: int = 2000, least: int = 10, slack: int = SLACK, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases that occur ``least`` times or more."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grams = _counted(texts, count_short, least, "phrases-short")
    nodes = cut(nodes_of(grams), "phrases-nodes")
    frequent = spark.sparkContext.broadcast(bit_table(nodes))
    # down_to: each lang's nodes with that bound or a higher one are expanded; from: those were before. Null: all
    langs = nodes.select("lang").distinct()
    rank, grown = slack * top, None
    aims = cut(langs.join(reached(nodes, rank), "lang", "left").select("lang", F.lit(SCALE + 1).cast("long").alias("from"), F.col("floor").alias("down_to")), "phrases-aims")
    while True:
        reach = nodes.join(aims, "lang").where("bound >= coalesce(down_to, 0)")
        frontier = spark.sparkContext.broadcast(bit_table(reach.where("bound < from")))
        new = _counted(texts, count_grown(frontier, frequent), least, "phrases-grown")
        scored = grown_of(new, grams)
        grown, old = cut(scored if grown is None else scored.unionByName(grown).dropDuplicates(["lang", "phrase"]), "phrases-known"), grown
        frontier.unpersist()
        found = cut(survivors(reach.drop("from", "down_to", "bound"), grown), "phrases-found")
        now = cut(aims.join(reached(found, top), "lang", "left").where("down_to > 0").where("floor is null or floor < down_to"), "phrases-open")
        drop(new, *([old] if old is not None else []))
        if now.isEmpty():
            break
        rank *= 8
        deeper = reached(nodes, rank).withColumnRenamed("floor", "guess")
        step = now.join(deeper, "lang", "left").select("lang", F.coalesce("floor", F.when(F.col("guess").isNotNull(), F.least("guess", F.col("down_to") - 1))).alias("next"))
        aims = cut(aims.join(step.withColumn("open", F.lit(True)), "lang", "left").select("lang", F.when(F.col("open"), F.col("down_to")).otherwise(F.lit(0)).alias("from"), F.when(F.col("open"), F.col("next")).otherwise(F.col("down_to")).alias("down_to")), "phrases-aims")
        drop(found)
    n = grams.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked(found, top).join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {"op12_collocations": op12_collocations}
ORACLE_SQL = {
    "op12_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS ks(k))),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM g GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, w, f AS a FROM f WHERE k >= 2 AND f >= 10),
parts AS (
  SELECT c.lang, c.k, c.phrase, c.a, v.cut, array_to_string(c.w[1:v.cut], ' ') AS head, array_to_string(c.w[v.cut + 1:], ' ') AS tail
  FROM cand c, (VALUES (1), (2)) AS v(cut) WHERE v.cut < c.k),
cuts AS (
  SELECT p.lang, p.k, p.phrase, p.a, p.cut, l.f AS l, r.f AS r, (1000000::HUGEINT * p.a * p.a) // (l.f::HUGEINT * r.f) AS score
  FROM parts p JOIN f l ON l.lang = p.lang AND l.phrase = p.head JOIN f r ON r.lang = p.lang AND r.phrase = p.tail),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
swallowed AS (
  SELECT DISTINCT s.lang, s.phrase FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS part, a FROM cand WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM cand WHERE k = 3) t
  JOIN cand s ON s.lang = t.lang AND s.phrase = t.part AND s.k = 2 WHERE 100 * t.a >= 50 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM best ANTI JOIN swallowed USING (lang, phrase) JOIN total USING (lang)
QUALIFY rank <= 2000"""
}
