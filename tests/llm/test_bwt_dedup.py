import hashlib
import random

import pytest

from artiscope.llm import bwt_dedup as bd


def brute(rows, length=bd.LENGTH):
    seen = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    got = bd.remove(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, u string")).collect()
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str)


@pytest.mark.parametrize("seed,group", [(1, 4096), (2, 2)])
def test_random_texts_against_brute_force(spark, monkeypatch, seed, group):
    monkeypatch.setattr(bd, "GROUP", group)
    monkeypatch.setattr(bd, "REFINE", 2000)
    monkeypatch.setattr(bd, "BLOCK", 5000)
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice("abcdefghij é\n") for _ in range(n))
    shared = [say(rng.randint(150, 900)) for _ in range(6)]
    rows = []
    for k in range(90):
        t = say(rng.randint(0, 500))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            piece = s[a : a + rng.randint(100, 700)]
            if piece and rng.random() < 0.4:
                c = rng.randrange(len(piece))
                piece = piece[:c] + "#" + piece[c + 1 :]
            t += piece + say(rng.randint(0, 30))
        rows.append((k, t))
    assert run(spark, rows) == brute(rows)


def test_periodic_and_overlapping_strings(spark):
    rows = [(1, "a" * 199), (2, "a" * 200), (3, "b" * 201), (4, "ab" * 150), (5, "xyz" * 67 + "q"), (6, "c" * 200), (7, "q" + "d" * 199 + "c" * 199)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    t = "".join(random.Random(5).choice("klmnop") for _ in range(450))
    rows = [(1, None), (2, ""), (3, t), (3, t), (4, t[7:300]), (None, "é" * 150), (5, "é" * 150), (6, t[:199])]
    assert run(spark, rows) == brute(rows)
    assert bd.remove(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_parts_of_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(bd, "LONG_TEXT", 700)
    rng = random.Random(6)
    t = "".join(rng.choice("klmnop") for _ in range(5000))
    rows = [(1, t), (2, t[1500:2900] + "!" + t[100:350]), (3, t[4000:4210])]
    assert run(spark, rows) == brute(rows)


def test_whole_small_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in bd.op2_bwt_byte_dedup(spark, sf_dir).collect()), key=str)
    assert got == brute(rows) and any(r[2] for r in got)
