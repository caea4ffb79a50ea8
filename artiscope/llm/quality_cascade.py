"""Quality rules as a short-circuit cascade.

Every rule is an independent test that may reject a document. A bounded sample gives each rule's
mean cost and rejection rate; rules then run in the order of rejections per unit of cost, and a
document leaves the cascade at its first rejection, so dear rules see few documents. The order
changes the cost and which rule is named, never the verdict.

Results for odd input: very long texts are judged whole; rules tied in rejections per cost go by cost, then
name; a null id changes nothing. A null text is an empty text (no words; rejected for its length). Repeated
rows and repeated ids are judged row by row. Extra columns pass through; an input column with the
name of an output column is replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import time
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from artiscope.llm._scratch import free_name, table
from artiscope.llm._worker import worker

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Documents on which costs and rejection rates are measured, at most.
SAMPLE_ROWS = 2000


class Document:
    """One text with features that are computed once, when a rule first asks for them."""

    __slots__ = ("text", "raw", "words", "_lines", "_repeat")

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = self.text.encode("utf-8", "surrogatepass")
        self.words = self.raw.split()  # splits at exactly \x20 and \x09-\x0D
        self._lines = self._repeat = None

    @property
    def n_words(self) -> int:
        return len(self.words)

    @property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\x0b\x0c\r"))

    @property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @property
    def lines(self) -> list[bytes]:
        if self._lines is None:
            self._lines = [x for x in self.raw.split(b"\n") if x.strip()]
        return self._lines

    @property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @property
    def n_repeat_words(self) -> int:
        if self._repeat is None:
            self._repeat = repeat_words(self.words, WINDOW)
        return self._repeat


_MIX = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(64)], dtype=np.uint64)


def repeat_words(words: list[bytes], width: int) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key += (ids[k : k + n] ^ (ids[k : k + n] >> np.uint64(29))) * _MIX[k]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(key, twice))
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Document], bool]


def _too_short(d: Document) -> bool:
    return d.n_words < 20


def _repeats(d: Document) -> bool:
    return 100 * d.n_repeat_words > 30 * d.n_words


def _symbols(d: Document) -> bool:
    return 10 * d.n_symbols > d.n_words


def _word_length(d: Document) -> bool:
    return not 2 * d.n_words <= d.word_chars <= 20 * d.n_words


_ASCII = bytes(range(128))


def _shouting(d: Document) -> bool:
    """More than twice as many capital as small letters, by Unicode's categories Lu and Ll."""
    codes = np.frombuffer(d.raw, np.uint8)
    upper, lower = int(((codes >= 65) & (codes <= 90)).sum()), int(((codes >= 97) & (codes <= 122)).sum())
    for c, n in Counter(d.raw.translate(None, _ASCII).decode("utf-8", "surrogatepass")).items():
        kind = unicodedata.category(c)
        upper, lower = upper + n * (kind == "Lu"), lower + n * (kind == "Ll")
    return upper > 2 * lower


def _exclaims(d: Document) -> bool:
    return 5 * d.raw.count(b"!!") > d.n_words


def _stutter(d: Document) -> bool:
    return 5 * sum(map(bytes.__eq__, d.words, d.words[1:])) > d.n_words


def _dup_lines(d: Document) -> bool:
    return len(d.lines) >= 4 and 2 * d.n_dup_lines > len(d.lines)


def _digits(d: Document) -> bool:
    return 5 * (len(d.raw) - len(d.raw.translate(None, b"0123456789"))) > 2 * len(d.raw)


#: The two base rules come with the contract of the query; the verdict of the others is the method's own.
BASE_RULES = (Rule("too_short", _too_short), Rule("repeats", _repeats))
RULES = (
    Rule("symbols", _symbols),
    Rule("word_length", _word_length),
    Rule("shouting", _shouting),
    Rule("exclaims", _exclaims),
    Rule("stutter", _stutter),
    Rule("dup_lines", _dup_lines),
    Rule("digits", _digits),
)


@dataclass(frozen=True)
class Estimate:
    rule: str
    cost_ns: float
    rejection: float


def estimate(docs: DataFrame, text_col: str = "text", rules=BASE_RULES + RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[Estimate]:
    """Mean cost and rejection rate of each rule on at most ``sample_rows`` documents."""
    texts = docs.select(F.col(text_col).alias("text"))
    total = texts.count()
    if total > sample_rows:
        texts = texts.sample(False, min(1.0, 1.3 * sample_rows / total), seed).limit(sample_rows)

    @worker("quality")
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, hits, seen = [0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen += 1
                for k, rule in enumerate(rules):
                    doc = Document(text)  # afresh: each rule pays for its own features
                    began = time.perf_counter_ns()
                    hits[k] += bool(rule.rejects(doc))
                    spent[k] += time.perf_counter_ns() - began
        yield pa.RecordBatch.from_pydict({"rule": list(range(len(rules))), "seen": [seen] * len(rules), "hits": hits, "ns": spent}, schema=pa.schema([(c, pa.int64()) for c in ("rule", "seen", "hits", "ns")]))

    got = {r["rule"]: r for r in texts.mapInArrow(measure, "rule long, seen long, hits long, ns long").groupBy("rule").agg(F.sum("seen").alias("seen"), F.sum("hits").alias("hits"), F.sum("ns").alias("ns")).collect()}
    out = []
    for k, rule in enumerate(rules):
        r = got.get(k)
        seen = max(1, r["seen"]) if r else 1
        out.append(Estimate(rule.name, (r["ns"] if r else 0) / seen, (r["hits"] if r else 0) / seen))
    return out


def order_rules(rules, estimates: list[Estimate]):
    """Rules by rejections per cost, highest first; ties by name."""
    by = {e.rule: e for e in estimates}
    return tuple(sorted(rules, key=lambda r: (-by[r.name].rejection / max(by[r.name].cost_ns, 1.0), by[r.name].cost_ns, r.name)))


def first_rejection(doc: Document, ordered) -> str | None:
    for rule in ordered:
        if rule.rejects(doc):
            return rule.name
    return None


_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def annotate(docs: DataFrame, text_col: str = "text", rules=RULES, ordered=None) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and rejected_by.

    rejected_by names the base rule or the first rule of the cascade that rejected (null if kept); it
    depends on the measured order. Everything else doesn't.
    """
    ordered = ordered or order_rules(rules, estimate(docs, text_col, rules))
    new = T.StructType([T.StructField(c, T.LongType()) for c in _STATS] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("rejected_by", T.StringType())])
    own = {f.name.lower() for f in new}
    rest = [c for c in docs.columns if c.lower() not in own]
    text_in = free_name("__text", rest)
    fed = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`").cast("string").alias(text_in))

    @worker("quality")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {f.name: [] for f in new}
            for text in batch.column(len(rest)).to_pylist():
                d = Document(text)
                for c in _STATS:
                    cols[c].append(getattr(d, c))
                base = next((r.name for r in BASE_RULES if r.rejects(d)), None)
                why = base or first_rejection(d, ordered)
                cols["base_failed"].append(base is not None)
                cols["kept"].append(why is None)
                cols["rejected_by"].append(why)
            kinds = [pa.int64()] * len(_STATS) + [pa.bool_(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays(list(batch.columns[: len(rest)]) + [pa.array(cols[f.name], k) for f, k in zip(new, kinds)], names=[*rest, *new.fieldNames()])

    return fed.mapInArrow(run, T.StructType([docs.schema[c] for c in rest] + list(new)))


def keep(docs: DataFrame, text_col: str = "text", rules=BASE_RULES + RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with exactly its columns; base rules join the cascade."""
    ordered = order_rules(rules, estimate(docs, text_col, rules))
    at = docs.columns.index(text_col)

    @worker("quality")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = [first_rejection(Document(t), ordered) is None for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pc.filter(c, pa.array(mask, pa.bool_())) for c in batch.columns], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op4_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return annotate(docs).select("doc_id", *_STATS, "base_failed", "kept")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
e AS (
  SELECT *, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines,
         list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i:i+7], ' ')) AS g
  FROM d),
win AS (SELECT doc_id, unnest(g) AS s, generate_subscripts(g, 1) AS i FROM e),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS p FROM rep, range(0, 8) t(k)) GROUP BY doc_id),
f AS (
  SELECT e.*, coalesce(cov.n, 0) AS n_repeat_words,
         n_words < 20 OR 100 * coalesce(cov.n, 0) > 30 * n_words AS base_failed
  FROM e LEFT JOIN cov USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed
         OR 10 * n_symbols > n_words
         OR word_chars < 2 * n_words OR word_chars > 20 * n_words
         OR length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) > 2 * length(regexp_replace(text, '[^\p{Ll}]', '', 'g'))
         OR 5 * ((length(text) - length(replace(text, '!!', ''))) // 2) > n_words
         OR 5 * coalesce(list_sum(list_transform(range(1, len(w)), lambda i: CASE WHEN w[i] = w[i + 1] THEN 1 ELSE 0 END)), 0) > n_words
         OR (len(l) >= 4 AND 2 * n_dup_lines > len(l))
         OR 5 * (strlen(text) - strlen(regexp_replace(text, '[0-9]', '', 'g'))) > 2 * strlen(text)) AS kept
FROM f
"""

QUERIES = {"op4_quality_cascade": op4_quality_cascade}
ORACLE_SQL = {"op4_quality_cascade": ORACLE}
