"""Configuration documents: flattening to dotted keys, and the keys and values that matter."""

from __future__ import annotations

import configparser
import json
import plistlib
import sqlite3
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from artiscope.functions import constants as C
from artiscope.functions.findings import findings

SETTINGS = "file_path string, format string, key string, value string, type string"


def _leaves(document: str | None) -> Iterator[tuple[str, str | None, str]]:
    """key, value and type of the leaves of a JSON text; none of a text that isn't JSON."""
    try:
        root = json.loads(document or "", parse_float=lambda x: float(x) if "e" in x.lower() else Decimal(x))
    except (ValueError, RecursionError):
        return
    for key, v in _flat(root):
        if v is None:
            yield key, None, "VOID"
        elif isinstance(v, bool):
            yield key, "true" if v else "false", "BOOLEAN"
        elif isinstance(v, int):
            yield key, str(v), "BIGINT"
        elif isinstance(v, Decimal):
            yield key, format(v.normalize(), "f"), "DECIMAL"
        else:
            yield key, str(v), "DOUBLE" if isinstance(v, float) else "STRING"


def flatten_json(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Leaves of JSON documents as (keep..., key, value, type): one walk of each document, however deep."""
    fed = df.select(*keep, F.col(column).cast("string").alias("__doc"))
    out = T.StructType([*(fed.schema[k] for k in keep), *(T.StructField(c, T.StringType()) for c in ("key", "value", "type"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *leaf) for i, doc in enumerate(batch.column(len(keep)).to_pylist()) for leaf in _leaves(doc)]
            of, *cols = zip(*rows) if rows else ((),) * 4
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keep))), *(pa.array(c, pa.string()) for c in cols)], names=out.fieldNames())

    return fed.mapInArrow(run, out)


def classify_key(key: Column) -> Column:
    """Classes of a key by the words it holds, in the order of the table."""
    low = F.lower(key)
    hit = [F.when(low.rlike("|".join(words)), F.lit(tag)) for tag, words in C.CONFIG_CLASSES.items()]
    return F.filter(F.array(*hit), lambda t: t.isNotNull())


def is_interesting(key: Column, value: Column, kind: Column) -> Column:
    """A key of a class with a value that isn't empty; booleans always count."""
    return (F.size(classify_key(key)) > 0) & ((F.upper(kind) == "BOOLEAN") | (F.trim(value) != ""))


def is_risky(key: Column, value: Column, kind: Column) -> Column:
    """A setting to report: debug on, verification off, or a secret with a real value."""
    low, v = F.lower(key), F.lower(F.trim(value))
    last = F.element_at(F.split(low, r"[.@]"), -1)
    on, off = v.isin("true", "1", "yes", "on"), v.isin("false", "0", "no", "off", "none")
    debug = last.rlike("^(debug|trace|verbose|dev_mode)$") & on
    verify = last.rlike("(ssl|tls|cert|verify)") & last.rlike("verif|check|valid") & off
    holder = v.rlike(r"^(\$\{.*\}|\$[a-z_]+|%.*%|<.*>|\{\{.*\}\}|changeme|change_me|example|placeholder|none|null|true|false|xxx+|\*+|[0-9]{1,5})$")
    policy = last.rlike("(length|lifetime|expir|timeout|policy|enabled|required|min|max|count|url|file|path|hint|type|name)")
    secret = last.rlike("(password|passwd|pwd|secret|token|api_?key)") & ~policy & ~holder & (F.length(v) >= 6)
    return debug | verify | secret


def _flat(value: Any, prefix: str = "") -> Iterator[tuple[str, Any]]:
    stack = [(prefix, value)]
    while stack:
        key, v = stack.pop()
        if isinstance(v, dict):
            stack += [(f"{key}.{k}" if key else str(k), x) for k, x in reversed(list(v.items()))]
        elif isinstance(v, list):
            stack += [(f"{key}[{i}]", x) for i, x in reversed(list(enumerate(v)))]
        else:
            yield key, v


def _xml(text: str) -> dict[str, str]:
    import xml.etree.ElementTree as ET

    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        raise ValueError("document types aren't read")
    out: dict[str, str] = {}
    stack = [(ET.fromstring(text), "")]
    while stack:
        node, prefix = stack.pop()
        name = f"{prefix}.{node.tag}" if prefix else node.tag
        out.update((f"{name}@{k}", v) for k, v in node.attrib.items())
        if node.text and node.text.strip():
            out[name] = node.text.strip()
        stack += [(child, name) for child in reversed(list(node))]
    return out


def parse(name: str, content: bytes) -> tuple[str, Any] | None:
    """Format and data of a configuration file; None if it is of no known format or broken."""
    ext = "." + name.lower().rsplit(".", 1)[-1] if "." in name else ""
    text = lambda: content.decode("utf-8", "ignore")
    try:
        if ext == ".json":
            return "JSON", json.loads(text())
        if ext in (".yaml", ".yml"):
            import yaml

            return "YAML", yaml.safe_load(text()) or {}
        if ext in (".xml", ".config", ".manifest"):
            return "XML", _xml(text())
        if ext in (".ini", ".conf", ".cfg", ".properties", ".env"):
            parser = configparser.ConfigParser(interpolation=None, strict=False)
            parser.read_string(("[default]\n" if ext in (".env", ".properties") else "") + text())
            return "INI", {s: dict(parser[s]) for s in parser.sections()}
        if ext == ".toml":
            import tomllib

            return "TOML", tomllib.loads(text())
        if ext == ".plist":
            return "plist", plistlib.loads(content)
        if ext in (".sqlite", ".sqlite3", ".db"):
            con = sqlite3.connect(":memory:")
            try:
                con.deserialize(content)
                return "SQLite", {"tables": [r[0] for r in con.execute("select name from sqlite_master where type = 'table'")]}
            finally:
                con.close()
    except Exception:
        return None
    return None


def settings(files: DataFrame) -> DataFrame:
    """All settings of configuration files (path, content), one row each; broken files give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = parse(path.replace("\\", "/").rsplit("/", 1)[-1], content or b"")
                for key, value in _flat(got[1]) if got else ():
                    kind = "BOOLEAN" if isinstance(value, bool) else "NULL" if value is None else type(value).__name__.upper()
                    shown = None if value is None else str(value).lower() if isinstance(value, bool) else str(value)
                    for col, x in zip(cols, (path, got[0], key, shown, kind)):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["file_path", "format", "key", "value", "type"])

    return files.select("path", "content").mapInArrow(run, SETTINGS)


def setting_findings(rows: DataFrame) -> DataFrame:
    """Findings of risky settings; rows: file_path, key, value, type."""
    risky = rows.where(is_interesting(F.col("key"), F.col("value"), F.col("type")) & is_risky(F.col("key"), F.col("value"), F.col("type")))
    c = F.col
    return findings(risky, module="secrets", rule_id="config-intelligence-setting", title=F.concat(F.lit("Configuration setting: "), c("key")), severity="Medium", file_path=c("file_path"), evidence=F.concat_ws(" = ", "key", "value"), tags=classify_key(c("key")), confidence="Medium", poc=F.concat(F.lit("grep -nF -- '"), c("key"), F.lit("' \""), c("file_path"), F.lit('"')), extra=F.to_json(F.struct(F.struct("key", "value").alias("config"))))
