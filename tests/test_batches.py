"""What goes between Spark and Python at a time, and how small tables of many files are dealt out."""

import pyarrow as pa
import pytest

from artiscope import catalog
from artiscope.binary import electron, strings
from artiscope.plans import specimens
from artiscope.sources import batches


def test_batches_are_bounded_by_rows_and_bytes():
    rows = [(f"p{k}", b"x" * (1 << 20)) for k in range(10)]
    out = list(batches.record_batches(iter(rows), (pa.string(), pa.binary()), ["path", "content"], lambda r: len(r[1])))
    assert [b.num_rows for b in out] == [4, 4, 2]
    out = list(batches.record_batches(((k,) for k in range(2500)), (pa.int64(),), ["k"]))
    assert [b.num_rows for b in out] == [1000, 1000, 500]
    assert list(batches.file_rows(iter(out)))[::999] == [(0,), (999,), (1998,)]


def test_queries_send_small_batches(spark, sf_dir):
    keys = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], "10000")
        spark.conf.set(keys[1], str(256 << 20))
        for name in ("pe_imports", "archive_members", "archive_levels", "authenticode_digests"):
            catalog.queries()[name](spark, sf_dir)
            assert [int(spark.conf.get(k)) for k in keys] == [batches.BATCH_ROWS, batches.BATCH_BYTES], name
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["pe_mitigations", "source_rules", "class_rules", "settings_of_files"])
def test_small_tables_are_dealt_out(spark, sf_dir, name):
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan


def test_a_source_is_taken_apart_once(monkeypatch):
    seen, made = [], electron.Source.__init__
    monkeypatch.setattr(electron.Source, "__init__", lambda self, text: (seen.append(1), made(self, text))[1])
    text = "new BrowserWindow({ webPreferences: { sandbox: !1, webSecurity: !0, nodeIntegration: !!0 } });\n" + "x = 1;\n" * 1000 + "w.loadURL('x')"
    found, kept = electron.source_report(text)
    assert len(seen) == 1
    assert [r for r, *_ in found] == ["electron-sandbox-off", "electron-navigation-unrestricted"] and kept == ["webSecurity on"]
    assert (electron.source_findings(text), electron.controls(text)) == (found, kept)


def test_strings_are_those_of_the_patterns():
    for data in (b"", b"abcde\0abcdef\x01ghijkl", b"a\0b\0c\0d\0e\0f\0" * 2 + b"xa\0b\0c\0d\0e\0", b"\xffabcdefg\0h\0i\0j\0k\0l\0", specimens.image(0, ("kernel32.dll",))):
        plain = [("ascii", m.start(), m[0].decode()) for m in strings._ASCII.finditer(data)]
        assert strings.strings(data) == plain + [("utf-16", m.start(), m[0].decode("utf-16-le")) for m in strings._WIDE.finditer(data)]
