import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from artiscope.llm import pii

SCHEMA = "doc_id long, text string"
PLAIN = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def brute(text):
    out = []
    for k, rx in enumerate(PLAIN):
        for m in rx.finditer(text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = (
                True,
                all(int(p) <= 255 for p in m[0].split(".")) if k == 1 else True,
                14 <= len(digits) <= 19 and pii.luhn(digits),
                10 <= len(digits) <= 15,
            )[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


ODD = [
    None,
    "",
    "a@b@c.com x.y@z.co.uk. +12345678901@mail.com",
    "1.2.3.4.5.6.7.8 256.1.1.1 0010.0.0.255 99999999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 +1 (052) 555-0934 é+44 20 7946 0958",
    "@@@@ a@ @b.c 1-2-3 +1 +() 5",
    "x" * 50_000 + "@mail.com " + "7" * 30_000,
]


@pytest.mark.parametrize("text", ODD)
def test_base_spans_equal_the_plain_expressions(text):
    assert pii.write_spans(pii.base_spans(text or "")) == brute(text)


def test_every_document_of_the_small_table(spark, sf_dir):
    rows = pii.op1_pii_bootstrap(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
        assert r.n_email == sum(x.startswith("email") for x in base.split(","))


def cue_rows():
    seeds = [(k, f"Please ring the office hotline: +1 (4{k}2) 555-0{k}34 during the day.") for k in range(10, 16)]
    hidden = [(50, "Please ring the office hotline: (452) 555-0934 during the day."), (51, "The serial 555 0934 12 stays as the part number.")]
    return seeds + hidden


def test_patterns_of_seeds_discover_an_unseen_phone(spark):
    docs = spark.createDataFrame(cue_rows(), SCHEMA)
    got = {r.doc_id: r for r in pii.extract(docs).collect()}
    text = cue_rows()[-2][1]
    s = text.index("(452)")
    assert got[50].spans == f"phone:{s}:{s + len('(452) 555-0934')}" and got[50].n_added == 1 and got[50].n_phone == 0
    assert got[51].spans == "" and got[51].n_added == 0
    assert all(got[k].n_phone == 1 for k in range(10, 16))


def test_discovered_phones_induce_patterns_of_their_own(spark):
    local = [f"(4{k}2) 555-09{k}" for k in range(20, 24)]
    rows = cue_rows()[:6]
    rows += [(100 + k, f"Please ring the office hotline: {x} during the day.") for k, x in enumerate(local)]
    rows += [(200 + k, f"Their night porter answers {x} until dawn.") for k, x in enumerate(local)]
    rows += [(300, "Their night porter answers (777) 321-4567 until dawn."), (301, "The serial 555 0934 12 stays as the part number.")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in pii.extract(docs).collect()}
    for k, text in rows[6:-1]:
        s = text.index("(")
        assert got[k].spans == f"phone:{s}:{s + 14 if k == 300 else s + len(local[k % 100])}", k
    assert got[301].spans == ""
    assert all("<PHONE>" in r.text for r in pii.redact(docs, chars_col=None).collect() if r.doc_id != 301)


def test_redaction_keeps_columns_and_rows(spark):
    rows = [(*r, "en", len(r[1])) for r in cue_rows()] + [(60, None, "en", None), (50, cue_rows()[-2][1], "fr", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, added string, n_chars long")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(rows)
    assert sum(r[1] == "Please ring the office hotline: <PHONE> during the day." for r in got) == 8
    assert all(r[3] == len(r[1]) for r in got if r[1] and "PHONE" in r[1])
    assert (60, None, "en", None) in got


def test_empty_and_repeated_rows(spark):
    assert pii.extract(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, "a@b.co"), (1, "a@b.co"), (1, None), (None, "x")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.spans) for r in pii.extract(docs).collect())
    assert got == [(-1, ""), (1, ""), (1, "email:0:6"), (1, "email:0:6")]
    assert pii.redact(docs.withColumn("text_key", F.lit("k"))).columns == ["doc_id", "text", "text_key"]


def cue_corpus(n=240, seed=9):
    """Letters with every kind behind cues of its own, hidden ones in a form that no expression takes, and numbers that are none."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    filler = ["the garden was quiet", "rain fell on the old road", "nobody came by after noon", "we counted seven boats"]
    rows, want = [], {}
    for k in range(n):
        kind = k % 3
        hide = k % 5 == 0
        if kind == 0:
            value = f"({rng.randint(200, 999)}) {digits(3)}-{digits(4)}" if hide else f"+1 ({rng.randint(200, 999)}) {digits(3)}-{digits(4)}"
            text = rng.choice([f"Tel: {value} until five.", f"Please ring tel. {value} today."])
        elif kind == 1:
            value = f"user{digits(3)} (at) mail{k % 7} (dot) org" if hide else f"user{digits(3)}@mail{k % 7}.org"
            text = f"Write to {value} for the rest."
        else:
            value = f"10.{rng.randint(1, 99)}.x{digits(2)}.{rng.randint(1, 99)}".replace("x", "1") if not hide else f"fe80:{digits(4)}:{digits(4)}:1"
            text = f"Seen from host {value} last night."
        text = f"{rng.choice(filler)} {text} {rng.choice(filler)} part no. {digits(8)} stays"
        rows.append((k, text))
        if hide:
            want[k] = (("phone", "email", "ip")[kind], text.index(value), text.index(value) + len(value))
    return rows, want


def plain_scores(rows, rounds=3, support=3, least=0.6):
    """The same graph in plain Python: patterns and candidates by kind."""
    edges, totals = Counter(), Counter()
    for _, text in rows:
        known = pii.base_spans(text)
        for s, e, k in [*known, *((s, e, -1) for s, e in pii.candidates(text, known))]:
            for p in pii.contexts(text, s, e):
                edges[p, text[s:e].lower(), k] += 1
        ws = text.lower().split()
        bare = [w.strip(pii._EDGE) for w in ws]
        for i, w in enumerate(ws):
            last = len(ws) - 1
            for hit, p in ((i < last, "L1 " + w), (i < last and bare[i], "N " + bare[i]), (i > 0, "R1 " + w), (i < last - 1, "G " + w), (i < last - 1, f"L2 {w} {ws[min(i + 1, last)]}")):
                totals[p] += bool(hit)
            for m in re.finditer("[:=]", w):
                totals["K " + w[: m.start()].strip(pii._EDGE)] += m.end() < len(w)
    values = defaultdict(set)
    for p, v, _ in edges:
        values[p].add(v)
    scores = defaultdict(lambda: [0.0] * 4)
    for _, v, k in edges:
        if k >= 0:
            scores[v][k] = 1.0
    seeds = {v: list(x) for v, x in scores.items()}
    for _ in range(rounds):
        patterns = {}
        for p in values:
            if len(values[p]) < support:
                continue
            row = [0.0] * 4
            for k in range(4):
                mine = [(v, kind, n) for (q, v, kind), n in edges.items() if q == p]
                held = sum(n * scores[v][k] for v, _, n in mine if v in scores)
                number = sum(1 for v, _, n in mine if v in scores and scores[v][k] >= least)
                unknown = sum(n for v, kind, n in mine if kind < 0 and pii.fits(v) >> k & 1 and not (v in scores and scores[v][k] >= least))
                share = (held + 0.5) / (max(totals[p], held) - 0.5 * unknown + 1)
                if number >= support and share >= least:
                    row[k] = min(share, 1.0)
            if any(row):
                patterns[p] = row
        found = {}
        for v in {v for _, v, k in edges if k < 0}:
            ps = [patterns[p] for p, w, k in edges if w == v and k < 0 and p in patterns]
            if ps:
                found[v] = [(1 - math.prod(1 - x[k] for x in ps)) if pii.fits(v) >> k & 1 else 0.0 for k in range(4)]
        scores = defaultdict(lambda: [0.0] * 4, {v: list(x) for v, x in seeds.items()})
        for v, x in found.items():
            scores[v] = [max(a, b) for a, b in zip(scores[v], x)]
    return patterns, found


def test_discovery_equals_the_graph_in_plain_python(spark):
    rows, want = cue_corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in pii.extract(docs).collect()}
    _, found = plain_scores(rows)
    for k, text in rows:
        known = pii.base_spans(text)
        spans = [(s, e, kind) for s, e, kind in known]
        for s, e in pii.candidates(text, known):
            x = found.get(text[s:e].lower(), [0.0] * 4)
            if max(x) >= 0.6 - 1e-12:
                spans.append((s, e, x.index(max(x))))
        assert got[k].spans == pii.write_spans(sorted(spans, key=lambda a: (a[0], a[2]))), k
        assert got[k].n_spans == len(spans)
    # what was hidden is found, what is no identifier is left alone
    hits = sum(f"{kind}:{s}:{e}" in got[k].spans for k, (kind, s, e) in want.items())
    added = sum(r.n_added for r in got.values())
    assert hits >= 0.9 * len(want) and hits >= 0.95 * added > 0


def test_masked_seeds_come_back(spark):
    rows, _ = cue_corpus(400, 12)
    for r in pii.masked(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r.hidden > 10 and r.found >= 0.9 * r.hidden and not r.mistaken


def test_contexts_are_whole_words():
    long = "w" * 5000
    text = f"one {long} two: (a@b.co), {long}s next"
    assert pii.contexts(text, text.index("a@"), text.index("a@") + 6) == ["L1 two:", "N two", f"L2 {long} two:", f"G {long}", f"R1 {long}s"]
    assert pii.contexts("see mail:a@b.co", 9, 15) == ["K mail"]
    assert pii.contexts("xa@b.co", 1, 7) == [] and pii.contexts("a@b.co", 0, 6) == []


def test_long_runs_are_read_once():
    """A million characters without a break, of every sort that an expression could start over in: seconds, not hours."""
    import time

    n = 1_000_000
    texts = ["7" * n, "1." * (n // 2), "12345.678." * (n // 10), "a" * n + " (at) b (dot) c", "a" * n + "(at)", "(at) " * (n // 5), "x@" * (n // 2), "+1" * (n // 2), "+1" + " " * n, "@" + "a." * (n // 2), "mail=a@b.cc;" * (n // 12), "1.2.3.4," * (n // 8), "-" * n + "5", "((" * (n // 2) + "10.0.0.1"]
    for text in texts:
        began = time.process_time()
        known = pii.base_spans(text)
        for s, e in [(s, e) for s, e, _ in known] + pii.candidates(text, known):
            pii.contexts(text, s, e)
        assert time.process_time() - began < 20, text[:20]


def test_expressions_find_what_the_contract_says():
    import random
    import re

    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    spoken = re.compile(r"[A-Za-z0-9._%+-]+\s*[\[(]at[\])]\s*[A-Za-z0-9-]+(?:\s*[\[(]dot[\])]\s*[A-Za-z0-9-]+)+", re.I)
    rng = random.Random(11)
    for _ in range(20_000):
        text = "".join(rng.choice(["1", "23", "4.5", ".", "a", " ", "(at)", "[dot]", "x-y", "(", "é", "(dot) c", "6.7.8"]) for _ in range(rng.randrange(18)))
        assert [m.span() for m in pii._IP.finditer(text)] == [m.span() for m in ip.finditer(text)]
        assert list(pii._disguised(text)) == [m.span() for m in spoken.finditer(text)]
