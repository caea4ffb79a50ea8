import random

from artiscope.llm import quality_cascade as qc


def brute_repeat(words, w=8):
    seen, hit = {}, set()
    for i in range(len(words) - w + 1):
        seen.setdefault(tuple(words[i : i + w]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {i + k for i in at for k in range(w)}
    return len(hit)


def test_repeat_words_against_brute_force():
    rng = random.Random(5)
    for n in (0, 1, 8, 9, 30, 200):
        for spread in (1, 2, 40):
            words = [b"w%d" % rng.randrange(spread) for _ in range(n)]
            assert qc.repeat_words(words, 8) == brute_repeat(words)


def test_verdict_does_not_depend_on_the_order(spark):
    good = "the quick brown fox jumps over a lazy dog and then goes home to sleep for one more night in peace okay"
    rows = [(1, good), (2, None), (3, ""), (4, "short"), (5, " ".join(["Ment"] * 30)), (6, good.upper()), (7, " | ".join(good.split())), (1, good), (8, "é" + good + " " + "x" * 60_000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, kept string")
    a = qc.annotate(docs, ordered=qc.RULES).collect()
    b = qc.annotate(docs, ordered=qc.RULES[::-1]).collect()
    verdict = lambda out: sorted((r.doc_id, r.kept, r.n_words) for r in out)
    assert verdict(a) == verdict(b)
    assert [x[:2] for x in verdict(a)] == [(1, True), (1, True), (2, False), (3, False), (4, False), (5, False), (6, False), (7, False), (8, False)]
    kept = qc.keep(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1]


def test_rules_are_ordered_by_rejection_per_cost(spark):
    est = [qc.Estimate("a", 10, 0.1), qc.Estimate("b", 100, 0.5), qc.Estimate("c", 1, 0.0)]
    rules = [qc.Rule(n, lambda d: False) for n in "abc"]
    assert [r.name for r in qc.order_rules(rules, est)] == ["a", "b", "c"]
    docs = spark.createDataFrame([(1, "x")] * 50, "doc_id long, text string")
    got = {e.rule: e for e in qc.estimate(docs)}
    assert got["too_short"].rejection == 1 and got["symbols"].rejection == 0 and all(e.cost_ns > 0 for e in got.values())


def test_empty_table(spark):
    assert qc.annotate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cases_are_counted_one_way(spark):
    """The same verdict as the SQL, whatever characters change their length with their case."""
    import duckdb

    bold = "\U0001d400"  # a capital without a small form
    texts = [" ".join([bold * 3] * 26), " ".join([bold * 3] * 26) + " ß", " ".join(["ĸĸĸĸAA"] * 26), " ".join(["ĸĸĸĸAA"] * 26) + " ß", " ".join(["ǅa"] * 26), " ".join(["ÀÉ"] * 26), " ".join(["Straße İx"] * 26), " ".join(["日本"] * 26)]
    texts = [" ".join(f"{w}{'abcdefghijklmnopqrstuvwxyz'[k % 26]}" for k, w in enumerate(t.split())) for t in texts] + [t.replace("A", "B") for t in texts]
    rows = list(enumerate(texts))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = con.sql(qc.ORACLE).select(*cols).fetchall()
    got = qc.annotate(spark.createDataFrame(rows, "doc_id long, text string")).select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(want) and {r[-1] for r in want} == {True, False}
