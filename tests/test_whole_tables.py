"""Queries that must cover whole tables, against plain Python."""

import re

from artiscope import catalog


def case(x):
    return bool(re.fullmatch("[^A-Z]*[a-z][^A-Z]*|[^a-z]*[A-Z][^a-z]*|([^A-Za-z]*[A-Z][a-z]*)+[^A-Za-z]*|[0-9]+", x))


def test_plausible_domains_judges_every_word(spark, sf_dir):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    words = {w for t in texts for w in re.findall("[A-Za-z0-9]+", t)}
    assert len(words) > len({w for t in texts for w in re.findall("[A-Za-z0-9]+", t)[:20]})
    want = {f"{w}.com": len(w) >= 3 and 2 * sum(c.isdigit() for c in w) <= len(w) and case(w) for w in words}
    rows = catalog.queries()["plausible_domains"](spark, sf_dir).collect()
    assert len(rows) == len(want) and {r["name"]: r.plausible for r in rows} == want


def test_settings_of_files_reads_every_event(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id").collect()
    want = [(f"e{r.event_id}.ini", "app.user", str(r.user_id)) for r in events]
    want += [(f"e{r.event_id}.ini", "app.debug", "no" if r.user_id % 2 else "true") for r in events]
    rows = catalog.queries()["settings_of_files"](spark, sf_dir).select("file_path", "key", "value").collect()
    assert any(r.event_id % 10 for r in events) and sorted(map(tuple, rows)) == sorted(want)
