import random
import re

import public_tokenizers
import pytest

from artiscope.llm import token_count as tc


def greedy(word, begin, more):
    at, n = 0, 0
    while at < len(word):
        for e in range(len(word), at, -1):
            if word[at:e] in (more if at else begin):
                break
        else:
            return -1
        at, n = e, n + 1
    return n


def brute(text, begin, more):
    words = re.findall(r"\w|[^\w\s]", text)
    words = []
    run = ""
    for c in text or "":
        if c.isalnum() or c == "_":
            run += c
            continue
        if run:
            words.append(run)
        run = ""
        if not c.isspace():
            words.append(c)
    if run:
        words.append(run)
    counts = [greedy(w, begin, more) for w in words]
    return len(words), sum(1 if c < 0 else c for c in counts), sum(c < 0 for c in counts)


def test_random_vocabularies_against_greedy_matching():
    rng = random.Random(3)
    for _ in range(60):
        piece = lambda: "".join(rng.choice("abc一") for _ in range(rng.randint(1, 4)))
        begin, more = {piece() for _ in range(12)}, {piece() for _ in range(8)}
        auto = tc.Automaton(begin, more)
        auto.dense()
        words = ["".join(rng.choice("abcd一" if rng.random() < 0.3 else "abc") for _ in range(rng.randint(1, 12))) for _ in range(200)]
        want = [greedy(w, begin, more) for w in words]
        assert [auto.count(w) for w in words] == want
        assert auto.block(" ".join(words))[1].tolist() == want


@pytest.fixture(scope="module")
def pieces():
    return tc.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def test_documents_against_greedy_matching(spark, sf_dir, pieces):
    begin, more = map(set, pieces)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in tc.op3_token_count(spark, sf_dir).collect():
        assert (r.n_words, r.n_tokens, r.n_unknown) == brute(texts[r.doc_id], begin, more)


def test_odd_rows(spark, pieces):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "naïve café, 中文! _x9 \U0001f600"), (4, "a"), (None, "x" * 30_000 + " y")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id, r.n_words, r.n_tokens, r.n_unknown) for r in tc.count_tokens(docs, *pieces).collect()), key=repr)
    begin, more = map(set, pieces)
    want = sorted(((i, *brute(t or "", begin, more)) for i, t in rows if i is not None), key=repr)
    assert [g for g in got if g[0] is not None] == want
    assert next(g for g in got if g[0] is None)[1] == 2
    assert tc.count_tokens(docs.limit(0), *pieces).count() == 0


def test_pieces_longer_than_a_byte_counts():
    begin, more = ["a" * 300 + "b"], ["a"]
    auto = tc.Automaton(sorted([*begin, *more]), more)
    auto.dense()
    for word in ("a" * 300, "a" * 299 + "c", "a" * 300 + "b", "a" * 900):
        want = -1 if "c" in word else 1 if word.endswith("b") else len(word)
        assert auto.count(word) == want and auto.block(word)[1].tolist() == [want]


def test_long_texts_are_counted_in_parts(spark, monkeypatch):
    texts = ["ab  cd " * 50, None, "", "x" * 100 + " ab", "\n \u3000ab\u3000" * 9]
    want = [t for _, t in sorted((k, "".join(p for o, ps in [*tc.blocks(texts, 16)] for i, p in zip(o, ps) if i == k)) for k in range(len(texts)))]
    assert want == [t or "" for t in texts]
    auto = tc.Automaton(["ab", "cd", "x"], ["b", "d", "x"])
    auto.dense()
    for t in filter(None, texts):
        parts = [auto.block("\n".join(p))[1].tolist() for _, p in tc.blocks([t], 16)]
        assert sum(parts, []) == auto.block(t)[1].tolist()
