"""A scan of a file tree: modules, archive pass, findings, inventory, summary."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artiscope.functions.findings import findings
from artiscope.functions.paths import default_poc, localize_poc, relative, scrub
from artiscope.operators import binaries, bundles, config, dlls, grouping, indicators, platforms, plugins, reputation, rules, services
from artiscope.operators.system_dlls import known
from artiscope.sources import archives as AS
from artiscope.sources import files as FS
from artiscope.sources.batches import small_batches
from artiscope.sources.scratch import Scratch

MODULES = ("secrets", "dll_hijack", "signature", "re_exposure", "linux", "macos")
COMMANDS = {
    "aslr-disabled": 'dumpbin /headers "{path}" | findstr /i "Dynamic base"',
    "dep-disabled": 'dumpbin /headers "{path}" | findstr /i "NX compatible"',
    "cfg-disabled": 'dumpbin /headers "{path}" | findstr /i "Guard"',
    "binary-dependency-graph": 'dumpbin /dependents "{path}"',
    "missing-signature-timestamp": 'signtool verify /pa /v "{path}"',
    "unsigned-binary": 'signtool verify /pa /v "{path}"',
}


@dataclass
class Scan:
    """Frames of a scan. Files are parsed and archives unpacked when it is made, once, into written tables; findings are computed when first used."""

    findings: DataFrame
    inventory: DataFrame
    notes: DataFrame
    kept: DataFrame
    scratch: Scratch

    def close(self) -> None:
        """Let go of findings and of what they are computed from; its frames can't be used after that."""
        self.kept.unpersist()
        self.scratch.close()

    def executions(self) -> DataFrame:
        """Findings, and files with any, of each module: given ones, and ones out of archives."""
        inner = F.coalesce(F.array_contains("tags", "extracted-content"), F.lit(False))
        n = lambda cond: F.countDistinct(F.when(cond, F.lower("file_path")))
        return self.kept.groupBy("module").agg(F.count("*").alias("n_findings"), F.countDistinct(F.lower("file_path")).alias("n_files"), n(~inner).alias("n_input_files"), n(inner).alias("n_extracted_files"))

    def totals(self) -> DataFrame:
        """Issues and findings without the inventory."""
        return self.issues().agg(F.count("*").alias("finding_groups"), F.coalesce(F.sum("affected_count"), F.lit(0)).alias("finding_instances"))

    def issues(self) -> DataFrame:
        return grouping.issue_counts(self.findings)

    def summary(self) -> DataFrame:
        return grouping.severity_summary(self.issues())


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _registry(found: DataFrame) -> DataFrame:
    """source and text of registry exports, in either of their encodings."""
    wide = F.expr("decode(substring(content, 3), 'UTF-16LE')")
    narrow = F.expr("replace(make_valid_utf8(cast(content as string)), '\\uFFFD', '')")
    rows = found.where(FS.extension(F.col("path")) == ".reg")
    return rows.select(F.col("path").alias("source"), F.when(F.hex(F.substring("content", 1, 2)) == "FFFE", wide).otherwise(narrow).alias("text"))


def _secrets(found: DataFrame, texts: DataFrame, how: Options) -> list[DataFrame]:
    kind, text = FS.binary_kind(), F.col("text")
    raw = found.where(kind.isNotNull() | FS.extension(F.col("path")).isin(*FS.DB_EXTENSIONS))
    strings = binaries.binary_strings(raw).select(F.col("path").alias("file_path"), "text")
    hits = [rules.line_hits(text, rules=how.rules), indicators.address_hits(text)]
    if how.entropy:
        hits.append(indicators.entropy_hits(rules.without_certificates(text)))
    settings = config.setting_findings(config.settings(found.where(kind.isNull())))
    return [indicators.text_findings(texts, hits), rules.scan_keys(texts), rules.scan(strings, how.rules), settings, bundles.token_findings(texts, how.as_of)]


def _libraries(spark: SparkSession, found: DataFrame, hits: DataFrame, modes: DataFrame | None, how: Options) -> list[DataFrame]:
    imports = binaries.imports_of(found.where(FS.binary_kind() == "pe"))
    shipped = found.select(FS.name_of(F.col("path")).alias("name"))
    if how.beside is not None:  # a single file: the libraries of its own folder
        shipped = shipped.unionByName(how.beside.select(FS.name_of(F.col("path")).alias("name")))
    per_file = imports.groupBy("path", "is_dll").agg(F.array_distinct(F.flatten(F.collect_list("functions"))).alias("functions"))
    parts = [dlls.phantom_findings(imports, known(spark), shipped), dlls.search_order_findings(per_file)]
    if how.beside is None:
        parts.append(services.unquoted_findings(services.from_registry(_registry(found))))
    if how.listings is not None:
        parts.append(services.unquoted_findings(services.from_listing(how.listings)))
    if modes is not None:
        parts.append(platforms.writable_directories(modes, found.where(FS.binary_kind() == "pe")))
    return parts


#: Hits that tell other rules something and are no findings.
FACTS = ("signed-by", "signature-digest-not-verified", "electron-hardening-summary", "linked-libraries")


def _certificates_of(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """Certificates belong to linux, or to macos where that module runs alone."""
    if "macos" not in wanted or "linux" in wanted:
        return rows
    ours = F.col("rule_id").startswith("linux-certificate-")
    tags = F.transform("tags", lambda t: F.when(t == "linux", "macos").otherwise(t))
    return rows.withColumn("module", F.when(ours, "macos").otherwise(F.col("module"))).withColumn("tags", F.when(ours, tags).otherwise(F.col("tags"))).withColumn("rule_id", F.when(ours, F.regexp_replace("rule_id", "^linux", "macos")).otherwise(F.col("rule_id")))


def _of_binaries(hits: DataFrame, wanted: list[str], single: bool) -> list[DataFrame]:
    """Findings of binaries, with what is said once instead of for each file."""
    rows = binaries.hit_findings(_certificates_of(hits, wanted)).where(F.col("module").isin(*wanted))
    folder = F.regexp_replace("file_path", r"[/\\\\][^/\\\\]*$", "")
    signed = rows.where("rule_id = 'signed-by'").select(folder.alias("root"), F.col("evidence").alias("publisher"), F.col("file_path").alias("path"))
    unverified = grouping.roll_up(rows, "signature-digest-not-verified")
    note = F.concat(F.col("n_files").cast("string"), F.lit(" files: "), F.array_join("files", ", "))
    once = findings(unverified, module=F.col("module"), rule_id=F.col("rule_id"), title="Signature digests not verified", severity="Info", file_path=F.col("files")[0], evidence=note, tags=["signature", "gap"], confidence="High")
    apps = grouping.hardening_summary(rows)
    kept = findings(apps, module="re_exposure", rule_id="electron-hardening-summary", title="Hardening controls", severity="Info", file_path=F.col("app"), evidence=F.col("controls"), tags=["inventory", "electron"], confidence="High")
    channel = F.col("rule_id").contains("-update-mechanism-analysis-")
    out = [rows.where(~F.col("rule_id").isin(*FACTS) & ~channel)]
    if "signature" in wanted:
        out += [once] if single else [once, dlls.publisher_findings(signed)]
    return [*out, kept] if "re_exposure" in wanted else out


def _platform(found: DataFrame, texts: DataFrame, hits: DataFrame, modes: DataFrame | None, module: str, single: bool) -> list[DataFrame]:
    """Findings of one platform's files, and what follows from the binaries' hits."""
    own = hits.where(F.col("module") == module)
    channels = binaries.hit_findings(own.where(F.col("rule_id").contains("-update-mechanism-analysis-"))).unionByName(platforms.channel_findings(texts, module))
    plists = platforms.plist_findings(found) if module == "macos" else None
    if plists is not None:
        feed = F.col("rule_id").contains("-update-mechanism-analysis-")
        channels = channels.unionByName(plists.where(feed))
    urls = own.where(F.col("rule_id").endswith("embedded-url(s)")).select("file_path", F.explode("items").alias("url"))
    parts = [platforms.once_per_url(channels), platforms.network_artifacts(urls, module)]
    headers = own.where(F.col("rule_id").endswith("header-summary"))
    if single:
        scope = headers.select("file_path").distinct()
        note = F.lit("folder-level checks of packages, startup, certificates and permissions are left out")
        parts.append(findings(scope, module=module, rule_id=f"{module}-application-discovery-single-file-scope", title="[Application Discovery] Single File Scope", severity="Info", file_path=F.col("file_path"), evidence=note, tags=[module, "application-discovery"], confidence="Medium"))
        return parts
    parts.append(platforms.inventory_findings(own.where("rule_id = 'linked-libraries'"), found.select("path"), headers, module))
    if module == "linux":
        parts += [platforms.linux_text_findings(texts), platforms.package_findings(found)]
    else:
        parts.append(plists.where(~feed))
    if modes is not None:
        parts.append(platforms.permission_findings(modes, module))
    return parts


def _dispatch(spark: SparkSession, found: DataFrame, hits: DataFrame, modes: DataFrame | None, how: Options) -> tuple[list[DataFrame], list[DataFrame]]:
    """Findings of the modules over files (path, content) and their hits, those that copies fold in, and those that don't."""
    folded: list[DataFrame] = []
    listed: list[DataFrame] = []
    single = how.beside is not None
    texts = FS.as_text(found.where(FS.binary_kind().isNull() & (FS.file_class(F.col("path")) == "text")))
    owner = secrets_owner(how.modules)
    if owner == "secrets":
        folded += _secrets(found, texts, how)
    elif owner:
        listed += [platforms.own_secrets(x, owner) for x in _secrets(found, texts, how)]
    if "dll_hijack" in how.modules:
        folded += _libraries(spark, found, hits, modes, how)
    wanted = [m for m in ("signature", "re_exposure", "linux", "macos") if m in how.modules]
    if wanted:
        platform = F.col("module").isin("linux", "macos")
        for x in _of_binaries(hits, wanted, single):
            folded.append(x.where(~platform))
            listed.append(x.where(platform))
        for module in ("linux", "macos"):
            if module in how.modules:
                listed += _platform(found, texts, hits, modes, module, single)
    for name, scan_file in how.plugins.items():
        listed.append(plugins.run(found, scan_file, name))
    if how.verdicts is not None:
        kinds = found.where(FS.binary_kind().isNotNull())
        listed.append(reputation.reputation_findings(kinds.select("path", F.sha2("content", 256).alias("sha256"), F.col("path").alias("seq")), how.verdicts, how.max_lookups))
    return folded, listed


def secrets_owner(modules) -> str | None:
    """Which module reports secrets, so that each is reported once: their own, else linux, else macos."""
    return next((m for m in ("secrets", "linux", "macos") if m in modules), None)


@dataclass
class Options:
    """What a scan looks for. plugins: detectors by module name. verdicts: a table of hashes (reputation), all of which are looked up unless
    max_lookups says otherwise. listings: service listings (source, text). beside: the files of a single file's folder (path)."""

    as_of: datetime
    modules: tuple = ("secrets",)
    entropy: bool = True
    rules: tuple = rules.DEFAULT_RULES
    plugins: dict = field(default_factory=dict)
    verdicts: DataFrame | None = None
    max_lookups: int | None = None
    listings: DataFrame | None = None
    beside: DataFrame | None = None


def run_scan(
    spark: SparkSession,
    folder: str,
    modules=("secrets",),
    as_of: datetime | None = None,
    extract_archives: bool = True,
    entropy: bool = True,
    include_inventory: bool = True,
    single_file: bool = False,
    rule_folder: str | None = None,
    **options,
) -> Scan:
    """Scan the files below ``folder``, then, in the same way, what its archives hold.

    single_file: ``folder`` is one file; findings of whole folders are left out, libraries beside the file count as shipped.
    rule_folder: rule packs in YAML that take the place of the default rules. as_of: the moment that certificates
    are judged at, by default now. options: further fields of ``Options``. Findings are kept when first computed, so
    issues, inventory and summary don't scan again; ``Scan.close`` lets them go.
    """
    unknown = set(modules) - set(MODULES)
    if unknown:
        raise ValueError(f"unknown modules: {sorted(unknown)}")
    small_batches(spark)
    how = Options(as_of or datetime.now(timezone.utc), tuple(modules), entropy, tuple(rules.load_rules(rule_folder)) if rule_folder else rules.DEFAULT_RULES, **options)
    root = os.path.dirname(folder) if single_file else folder
    found = FS.read_files(spark, folder).select("path", "content")
    if single_file:
        how = replace(how, beside=FS.names_beside(spark, folder))
    modes = FS.read_modes(spark, folder) if {"linux", "macos", "dll_hijack"} & set(modules) and not single_file else None
    parsed = bool(set(modules) & {"signature", "re_exposure", "linux", "macos"})
    none = spark.createDataFrame([], binaries.HITS)
    # every file is parsed once; all modules, notes and roll-ups read its hits
    scratch = Scratch(spark)
    hits = scratch.written(binaries.binary_hits(found, how.as_of)) if parsed else none
    folded, listed = _dispatch(spark, found, hits, modes, how)
    notes = binaries.hit_notes(hits)
    if extract_archives:
        members, more_notes = AS.expand(found, mounted=os.path.isdir(root), keep=scratch.written)
        notes = notes.unionByName(more_notes)
        inner: tuple[list, list] = ([], [])
        if not members.isEmpty():
            members = members.select("path", "content")
            inner_hits = scratch.written(binaries.binary_hits(members, how.as_of)) if parsed else none
            inner = _dispatch(spark, members, inner_hits, None, replace(how, listings=None))
            notes = notes.unionByName(binaries.hit_notes(inner_hits))
        origin = F.to_json(F.struct(F.regexp_replace("file_path", " > [^>]*$", "").alias("extracted_from")))
        for parts, more in zip((folded, listed), inner):
            for x in more:
                tags = F.array_append(F.coalesce("tags", F.array().cast("array<string>")), F.lit("extracted-content"))
                parts.append(x.withColumn("tags", tags).withColumn("extra", F.coalesce("extra", origin)))
    parts = ([grouping.first_by_fingerprint(_union(folded))] if folded else []) + listed
    if not parts:
        raise ValueError("nothing to scan for")
    out = _union(parts)
    path = F.col("file_path")
    steps = localize_poc(default_poc(F.col("rule_id"), path, F.col("evidence"), F.col("poc"), COMMANDS), path, path)
    out = out.withColumn("poc", steps).withColumn("file_path", relative(path, root))
    notes = notes.withColumn("note", scrub(F.col("note"), root)).withColumn("path", relative(F.col("path"), root))
    if not include_inventory:
        # only these modules know findings that are a mere list
        out = out.where(~(F.col("module").isin("linux", "macos") & F.coalesce(F.array_contains("tags", "inventory"), F.lit(False))))
    out = out.persist(StorageLevel.MEMORY_AND_DISK)
    counted, inventory = grouping.split_inventory(out)
    return Scan(counted, inventory, notes, out, scratch)
