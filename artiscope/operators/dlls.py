"""Imports of libraries that aren't there: anti-joins against known names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from artiscope.functions.findings import findings

# --- fixed values: API sets and other names that are no files ---
IGNORED_PREFIXES, IGNORED_SUFFIXES = ("api-ms-win-", "ext-ms-"), (".cpl", ".drv")
SAFE_LOADING_APIS = ("setdlldirectorya", "setdlldirectoryw", "setdefaultdlldirectories", "adddlldirectory", "loadlibraryexa", "loadlibraryexw")
LOAD_LIBRARY_APIS = ("loadlibrarya", "loadlibraryw", "loadlibraryexa", "loadlibraryexw")


#: Parts that what belongs to one source is dealt out to.
SALTS = 16


def unknown_imports(imports: DataFrame, known: DataFrame, shipped: DataFrame) -> DataFrame:
    """imports (path, dll) without those in ``known`` (name; a trailing * stands for any rest), in ``shipped`` (name), or ignored by name."""
    low = imports.withColumn("dll", F.lower("dll"))
    for p in IGNORED_PREFIXES:
        low = low.where(~F.col("dll").startswith(p))
    for s in IGNORED_SUFFIXES:
        low = low.where(~F.col("dll").endswith(s))
    names = known.select(F.lower("name").alias("name")).distinct()
    exact = names.where(~F.col("name").endswith("*")).withColumnRenamed("name", "dll")
    starts = names.where(F.col("name").endswith("*")).select(F.regexp_replace("name", r"\*$", "").alias("start"))
    # the prefix list is a rule pack's, a few dozen rows
    left = low.join(exact, "dll", "left_anti").join(F.broadcast(starts), low["dll"].startswith(F.col("start")), "left_anti")
    return left.join(shipped.select(F.lower("name").alias("dll")).distinct(), "dll", "left_anti").select("path", "dll").distinct()


def phantom_findings(imports: DataFrame, known: DataFrame, shipped: DataFrame) -> DataFrame:
    rows = unknown_imports(imports, known, shipped)
    return findings(rows, module="dll_hijack", rule_id="phantom-dll-import", title=F.concat(F.lit("Unbundled DLL import: "), F.col("dll")), severity="Info", file_path=F.col("path"), evidence=F.concat(F.lit("Imports '"), F.col("dll"), F.lit("'")), tags=["dll"], confidence="Low")


def search_order_findings(binaries: DataFrame) -> DataFrame:
    """binaries: path, functions (array, lower case), is_dll. Loads libraries at run time without any call that restricts the search."""
    has = lambda names: F.arrays_overlap("functions", F.array(*map(F.lit, names)))
    rows = binaries.where(has(LOAD_LIBRARY_APIS) & ~has(SAFE_LOADING_APIS))
    used = F.array_join(F.array_intersect("functions", F.array(*map(F.lit, LOAD_LIBRARY_APIS))), ", ")
    return findings(rows, module="dll_hijack", rule_id="dll-search-order-exposure", title="DLL search order exposure", severity=F.when(F.col("is_dll"), "Low").otherwise("Medium"), file_path=F.col("path"), evidence=used, tags=["dll"], confidence="Medium")


def dependency_graph(edges: DataFrame, limit: int = 20) -> DataFrame:
    """edges (src, dst) to one row a source: number of targets, the first ``limit`` by name.

    A source can have any number of targets: they are dealt out by a salt, and each part keeps its first ``limit``.
    """
    part = W.partitionBy("src", F.pmod(F.xxhash64("dst"), F.lit(SALTS)))
    dealt = edges.select("src", "dst").distinct().select("*", F.row_number().over(part.orderBy("dst")).alias("n"), F.count("*").over(part).alias("all")).where(F.col("n") <= limit)
    return dealt.groupBy("src").agg(F.sum(F.when(F.col("n") == 1, F.col("all"))).alias("n_targets"), F.array_join(F.slice(F.sort_array(F.collect_list("dst")), 1, limit), ",").alias("targets"))


def publisher_conflicts(files: DataFrame) -> DataFrame:
    """files (root, publisher, path): roots with more than one publisher, anchored at the smallest group's first path."""
    groups = files.where("publisher is not null").groupBy("root", "publisher").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))
    return groups.groupBy("root").agg(F.count("*").alias("n_publishers"), F.min_by("first_path", F.struct("n", "publisher")).alias("anchor"), F.array_join(F.sort_array(F.collect_list("publisher")), ",").alias("publishers")).where("n_publishers > 1")


def publisher_findings(files: DataFrame) -> DataFrame:
    """Roots whose signed files have several publishers; files: root, publisher, path."""
    rows = publisher_conflicts(files)
    return findings(rows, module="signature", rule_id="mismatched-publisher", title="Several publishers", severity="Medium", file_path=F.col("anchor"), evidence=F.col("publishers"), tags=["signature"], confidence="Medium")


def application_roots(files: DataFrame) -> DataFrame:
    """Folders of applications: a package.json with a text main, not among the dependencies; files: path, content."""
    path = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    rows = files.where(path.rlike("(^|/)package\\.json$") & ~path.contains("/node_modules/")).select(F.regexp_replace(path, "/?package\\.json$", "").alias("root"), F.get_json_object(F.col("content").cast("string"), "$.main").alias("main"))
    return rows.where("main is not null and main not like '{%' and main not like '[%'")
