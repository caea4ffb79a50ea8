import hashlib
import random

import pytest

from artiscope.llm import block_naming as bn


def lowered(text):
    return (text or "").encode().lower()  # bytes: A-Z only


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    least = float("-inf")
    best = {k: max(v, key=lambda i: least if i is None else i) for k, v in groups.items()}
    return sorted(((i, best[lowered(t)], len(groups[lowered(t)]), hashlib.sha256(lowered(t)).hexdigest()) for i, t in rows), key=repr)


def texts(size):
    rng = random.Random(3)
    pool = ["", None, "a", "A", "ab", "é", "É", "Straße", "STRASSE", "İx", "ix", "x" * 7, "x" * 8, "x" * 9, "X" * 9, "long " * 40, "LONG " * 40, "long " * 39 + "lonG.", "日本" * 30, *(["wide " * 3000, "wide " * 2999 + "wIde.", "wide " * 2999 + "wIde,"] if size > 100 else [])]
    pool += ["".join(rng.choice("aAb") for _ in range(rng.randrange(30))) for _ in range(60)]
    rows = [(k, rng.choice(pool)) for k in range(300)] + [(k + 300, t) for k, t in enumerate(pool)]
    return rows + [(None, "a"), (None, "only null ids"), (5, rows[5][1])]


@pytest.mark.parametrize(("size", "bits"), [(4, 64), (4096, 64), (8, 2)])
def test_equal_texts_and_no_others(spark, size, bits):
    rows = texts(size)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, name string, row int")
    got = bn.duplicates(docs, size=size, bits=bits).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows)
    assert sum(r.kept for r in got) == len({lowered(t) for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_names_are_of_one_block_each(spark):
    docs = spark.createDataFrame([(k, "%03d" % (k % 40) + "tail" * (k % 3)) for k in range(120)], "doc_id long, text string")
    out = bn.identities(docs, size=3).collect()
    by = {}
    for r in out:
        by.setdefault((r.n_blocks, r.name), set()).add(bytes(r.sha))
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({bytes(r.sha) for r in out})


def test_hot_text_and_empty_table(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('Same ', 40), concat('t', id)) as text")
    got = bn.duplicates(docs, size=16)
    assert got.where("group_size = 1000 and keep_id = 2997").count() == 1000 and got.where("kept").count() == 2001
    assert bn.duplicates(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = bn.duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
