import numpy as np
import pytest
from pyspark.sql import functions as F
from test_decontaminate import brute as brute_leaks
from test_jaccard_groups import brute as brute_components
from test_packing import valid
from test_pii import cue_corpus
from tokenizers import Tokenizer

import corpus_pipeline
from artiscope.llm import packing, pii, quality_cascade


def brute_stages(docs, items):
    """The documents (id to text) after each stage but the last."""
    out = []
    rules = quality_cascade.BASE_RULES + quality_cascade.RULES
    docs = {i: t for i, t in docs.items() if not any(r.rejects(quality_cascade.Document(t)) for r in rules)}
    out.append(docs)
    docs = {i: docs[i] for i, _, c in brute_components(list(docs.items()), 5, 80, 100) if i == c}
    out.append(docs)
    leaks = {d for d, _ in brute_leaks(docs, items)}
    docs = {i: t for i, t in docs.items() if i not in leaks}
    out.append(docs)
    docs = {i: pii.redact_text(t, None) for i, t in docs.items()}
    out.append(docs)
    return out


def test_every_stage_against_brute_force(spark, sf_dir, tmp_path):
    read = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = brute_stages({r.doc_id: r.text for r in read.collect()}, items)
    docs = read
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        assert out.columns == read.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        assert len(rows) == len(want[k]) and {r.doc_id: r.text for r in rows} == want[k], name
        assert all(r.n_chars == len(r.text) for r in rows)
    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    got, least = valid(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect(), want[-1], tokenizer, packing.CAPACITY)
    assert got <= least + 1


def test_run_equals_its_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(brute_stages(docs, items)[-1])
    assert np.all([r.length <= packing.CAPACITY for r in rows])


ODD = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, "word " * 60_000, "en", "hot", 300_000),
    (None, "no id but quite a few different words in a line that the rules of quality keep as they are fine here", "en", "hot", 1),
    (4, "twice the very same row with more than twenty words that differ from each other so that nothing rejects it at all here", "en", "hot", 2),
    (4, "twice the very same row with more than twenty words that differ from each other so that nothing rejects it at all here", "en", "hot", 2),
]


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_rows(spark, sf_dir, number):
    name, stage = corpus_pipeline.STAGES[number]
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", F.lit("k").alias("text_key"), F.lit(1).alias("added"), F.lit(2).alias("node"), F.lit(3).alias("length"))
    for rows in (docs, docs.limit(0)):
        out = stage(spark, rows, sf_dir)
        got = out.collect()
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        if not rows.take(1):
            assert not got
            continue
        ids = [r.doc_id for r in got]
        want = {0: [None, 4, 4], 1: [None, 1, 2, 3, 4], 2: [None, 1, 2, 3, 4, 4], 3: [None, 1, 2, 3, 4, 4]}.get(number)
        if want:
            assert sorted(ids, key=lambda x: x or -1) == want, name
        else:
            assert set(ids) == {None, 1, 2, 3, 4} and all(r.length <= packing.CAPACITY for r in got)


def test_private_data_stage_redacts_what_it_discovers(spark, sf_dir):
    rows, want = cue_corpus()
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.private_data(spark, docs, sf_dir).collect()}
    texts = dict(rows)
    redacted = [k for k, (kind, s, e) in want.items() if f"<{kind.upper()}>" in got[k].text and texts[k][s:e] not in got[k].text]
    assert len(redacted) >= 0.9 * len(want) and all(len(r.text) == r.n_chars for r in got.values())
