"""Findings of Linux and macOS application files: units, schedules, metadata, permissions, network artifacts."""

from __future__ import annotations

import plistlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from artiscope.functions import text as X
from artiscope.functions.findings import fingerprint, findings
from artiscope.operators.binaries import CHANNEL_CHECKS, CHANNEL_URL_WORDS, CHANNEL_WORDS, PROTECTION_WORDS, RISKY_ENTITLEMENTS, channel_hit
from artiscope.sources.files import extension, name_of

#: Candidate files whose modes are looked at, in the order of their paths.
PERMISSION_FILES = 500
# --- fixed values: folders and kinds of files whose modes matter, kinds of settings, kinds of files that name an update channel ---
MODE_FOLDERS = {"linux": ("config", "cache", "logs", "log", "data", "bin"), "macos": ("resources", "contents", "logs", "log", "cache", "caches", "macos")}
MODE_ENDS = {"linux": (".conf", ".cfg", ".log", ".json"), "macos": (".plist", ".log", ".json", ".conf")}
CONFIG_ENDS = {"linux": (".conf", ".cfg", ".ini", ".yaml", ".yml", ".json", ".toml", ".env"), "macos": (".plist", ".json", ".yaml", ".yml", ".conf", ".ini")}
CHANNEL_ENDS = {"linux": (".conf", ".cfg", ".ini", ".json", ".yaml", ".yml", ".desktop"), "macos": (".plist", ".conf", ".json")}


def _rule(module: str, category: str, check: str) -> str:
    return f"{module}-{category}-{check}".lower().replace(" ", "-")


def _of(rows: DataFrame, module: str, category: str, check: str, severity, evidence: Column, line: Column | None = None, tags=(), shown: int = 300) -> DataFrame:
    kinds = [module, category.lower().replace(" ", "-"), *tags]
    extra = F.to_json(F.struct(F.lit(category).alias("category"), F.lit(module).alias("platform")))
    return findings(rows, module=module, rule_id=_rule(module, category, check), title=f"[{category}] {check}", severity=severity, file_path=F.col("file_path"), evidence=F.left(evidence, F.lit(shown)), line_number=line, tags=kinds, confidence="Medium", extra=extra)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _parent(path: Column) -> Column:
    return F.lower(F.element_at(F.split(F.concat(F.lit("/"), F.replace(path, F.lit("\\"), F.lit("/"))), "/"), -2))


def _any_of(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def linux_text_findings(texts: DataFrame) -> DataFrame:
    """Startup units and schedules; texts: file_path, text."""
    path, line, n = F.col("file_path"), F.col("line"), F.col("line_number")
    unit = texts.where(path.endswith(".service"))
    lines = unit.select("file_path", F.posexplode(F.split("text", r"\r?\n")).alias("i", "line")).withColumn("line_number", (F.col("i") + 1).cast("int"))
    command = F.trim(F.regexp_replace(line, "^[^=]*=", ""))
    target = F.regexp_replace(F.element_at(F.split(command, r"\s+"), 1), "^[-+!@]+", "")
    temp = target.rlike("^/(tmp|var/tmp|dev/shm)/")
    reasons = F.array_compact(F.array(F.when(temp, "writable temp path"), F.when(target.rlike(r"\.(sh|py|pl|rb)$"), "script interpreter target"), F.when(command.rlike(r"[$`]|%h"), "variable/specifier expansion")))
    execs = lines.where(line.rlike(r"(?i)^\s*exec(start|stop|reload)=") & (command != "") & (F.size(reasons) > 0))
    shown = F.concat(F.regexp_extract(line, "^[^=]*=", 0), command, F.lit(" ("), F.array_join(reasons, ", "), F.lit(")"))
    user = F.regexp_extract("text", r"(?m)^\s*User\s*=\s*(\S+)", 1)
    cron = texts.where(path.rlike(r"(^|/)(crontab|cron\.d)$|(^|/)cron/") & (F.trim("text") != ""))
    return _union([
        _of(unit, "linux", "Startup", "Systemd Unit File", "Info", F.col("text"), None, ["inventory"]),
        _of(execs, "linux", "Startup", "Unsafe Service Exec Path", F.when(temp, "Medium").otherwise("Low"), shown, n, ["systemd"]),
        _of(unit.where(user.isin("", "root")), "linux", "Startup", "Service Runs as Root", "Low", F.when(user == "", "no User= directive").otherwise("User=root")),
        _of(cron, "linux", "Startup", "Cron Job Shipped With Application", "Info", F.col("text"), None, ["inventory"]),
    ])


def channel_findings(texts: DataFrame, module: str) -> DataFrame:
    """URLs of update channels in settings; texts: file_path, text. An information property list names its feed itself, see ``plist_findings``."""
    low, url = F.lower("text"), F.col("url")
    rows = texts.where(extension(F.col("file_path")).isin(*CHANNEL_ENDS[module]) & ~name_of(F.col("file_path")).isin("Info.plist") & _any_of(low, CHANNEL_WORDS[module]))
    urls = rows.select("file_path", _any_of(low, PROTECTION_WORDS[module]).alias("kept"), F.explode(X.urls(F.col("text"), 50)).alias("url"))
    urls = urls.where(_any_of(F.lower("url"), CHANNEL_URL_WORDS[module]))
    plain, secure = CHANNEL_CHECKS[module]
    sure = F.when(F.col("kept"), "Info").otherwise("Low")
    http = url.startswith("http://")
    return _of(urls.where(http), module, "Update Mechanism Analysis", plain, "High", url, shown=2000).unionByName(_of(urls.where(~http), module, "Update Mechanism Analysis", secure, sure, url, shown=2000))


def once_per_url(found: DataFrame) -> DataFrame:
    """Findings of update channels, one for each URL: the first by path."""
    return found.groupBy("module", "evidence").agg(F.min_by(F.struct(*found.columns), F.struct("file_path", "rule_id", "severity_rank")).alias("f")).select("f.*")


def package_findings(files: DataFrame) -> DataFrame:
    """Launchers and package descriptions by the name of the file; files: path, content. A file is of one kind, the first that fits."""
    plain = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    name, folders = F.substring_index(plain, "/", -1), F.split(plain, "/")
    described = F.lower(plain).rlike("(^|/)flatpak/|(^|/)metainfo/[^/]*$")
    kind = (
        F.when(name.endswith(".desktop"), "Desktop Entry Metadata")
        .when((name == "control") & F.array_contains(folders, "DEBIAN"), "Debian Package Metadata")
        .when(name.rlike(r".\.spec$"), "RPM Spec Metadata")
        .when(F.lower(name).endswith(".appimage"), "AppImage Package Detected")
        .when(name.isin("metadata", "metadata.json") & described, "Flatpak Metadata Detected")
        .when((name == "snap.yaml") | name.rlike(r".\.snap(\.|$)"), "Snap Metadata Detected")
    )
    # an AppImage or a snap may be large: only the head of the content is decoded
    head = F.replace(F.make_valid_utf8(F.substring("content", 1, 4000).cast("string")), F.lit("�"), F.lit(""))
    rows = files.select(F.col("path").alias("file_path"), kind.alias("check"), head.alias("head")).where("check is not null")
    field = lambda key, other: F.coalesce(F.nullif(F.trim(F.regexp_extract("head", rf"(?m)^[ \t]*{key}[ \t]*=([^\r\n]*)", 1)), F.lit("")), F.lit(other))
    launcher = F.concat(F.lit("Name="), field("Name", "?"), F.lit(", Exec="), field("Exec", "?"), F.lit(", Version="), field("Version", "unspecified"))
    check = F.col("check")
    evidence = F.when(check.startswith("Desktop"), launcher).when(check.startswith("AppImage"), F.col("file_path")).when(check.rlike("^(Flatpak|Snap)"), F.left("head", F.lit(500))).otherwise(F.left("head", F.lit(300)))
    rule = F.concat(F.lit("linux-application-discovery-"), F.lower(F.replace(check, F.lit(" "), F.lit("-"))))
    own = F.when(check.rlike("^(AppImage|Flatpak|Snap)"), F.lower(F.substring_index(check, " ", 1)))
    tags = F.array_compact(F.array(F.lit("linux"), F.lit("inventory"), own))
    return findings(rows, module="linux", rule_id=rule, title=F.concat(F.lit("[Application Discovery] "), check), severity="Info", file_path=F.col("file_path"), evidence=evidence, tags=tags, confidence="Medium")


def permission_findings(modes: DataFrame, module: str = "linux", limit: int = PERMISSION_FILES) -> DataFrame:
    """World-writable files among the first ``limit`` candidates by path, and (linux) set-id files up to the last of these; modes: path, mode, is_symlink."""
    path = F.col("path")
    files = modes.where(~F.col("is_symlink"))
    candidates = files.where(_parent(path).isin(*MODE_FOLDERS[module]) | extension(path).isin(*MODE_ENDS[module]))
    # a sort with a limit keeps the first rows of each partition, so no task sees them all
    first = candidates.orderBy("path").limit(limit)
    world = _of(first.where(F.col("mode").bitwiseAND(2) != 0).withColumnRenamed("path", "file_path"), module, "File Permission Analysis", "World-Writable File", "Medium", F.lit("mode bits include o+w"), None, ["permissions"])
    if module != "linux":
        return world
    last = first.agg(F.when(F.count("*") == limit, F.max("path")).alias("last"))
    special = files.where(F.col("mode").bitwiseAND(0o6000) != 0).join(F.broadcast(last)).where("last is null or path <= last").withColumnRenamed("path", "file_path")
    shown = F.concat(F.lit("mode=0o"), F.conv(F.col("mode").cast("string"), 10, 8))
    return world.unionByName(_of(special, module, "File Permission Analysis", "SUID/SGID File Detected", "High", shown, None, ["permissions", "privilege"]))


def writable_directories(modes: DataFrame, binaries: DataFrame) -> DataFrame:
    """One finding for each folder with a group- or world-writable binary in it: the first by path."""
    rows = modes.join(binaries.select("path").distinct(), "path", "left_semi").where(F.col("mode").bitwiseAND(0o022) != 0)
    folder = F.regexp_replace("path", r"[/\\][^/\\]*$", "")
    first = rows.groupBy(folder.alias("folder")).agg(F.min("path").alias("file_path"))
    return findings(first, module="dll_hijack", rule_id="writable-binary-directory", title="Writable binary directory", severity="High", file_path=F.col("file_path"), evidence=F.col("folder"), tags=["permissions", "dll"], confidence="Medium")


def network_artifacts(urls: DataFrame, module: str = "linux") -> DataFrame:
    """Distinct URLs of binaries that lead to an internal host; urls: file_path, url."""
    once = urls.where(X.is_internal_host(X.host_of(F.col("url")))).groupBy("url").agg(F.min("file_path").alias("file_path"))
    return _of(once, module, "Network Artifact Discovery", "Internal/Development Endpoint Referenced", "Low", F.col("url"), None, ["network"], 2000)


def config_counts(files: DataFrame) -> DataFrame:
    """Number of configuration files by extension; files: path."""
    return files.groupBy(extension(F.col("path")).alias("extension")).agg(F.count("*").alias("n")).where(F.col("extension").isin(".json", ".xml", ".yaml", ".yml", ".ini", ".conf", ".cfg", ".toml", ".plist", ".properties", ".env", ".config"))


def first_names(names: DataFrame, limit: int) -> DataFrame:
    """module and the first ``limit`` distinct names (module, name) by name; parts of a module are cut to that length first."""
    part = F.pmod(F.xxhash64("name"), F.lit(64))
    near = names.distinct().withColumn("__n", F.row_number().over(W.partitionBy("module", part).orderBy("name"))).where(F.col("__n") <= limit)
    rank = F.row_number().over(W.partitionBy("module").orderBy("name"))
    return near.withColumn("__n", rank).where(F.col("__n") <= limit).groupBy("module").agg(F.sort_array(F.collect_list("name")).alias("libraries"))


def libraries(linked: DataFrame, limit: int = 30) -> DataFrame:
    """The distinct libraries of all binaries (module, items), the first ``limit`` by name."""
    return first_names(linked.select("module", F.explode("items").alias("name")), limit)


def inventory_findings(linked: DataFrame, paths: DataFrame, headers: DataFrame, module: str) -> DataFrame:
    """What an application brings along, once: libraries, versioned ones, frameworks, settings, binaries.

    linked: module, items; paths: path of all files; headers: one row for each binary of the platform.
    """
    category = "Third-Party Library Enumeration"
    names = linked.where(F.col("module") == module).select("module", F.explode("items").alias("name"))
    versioned, title = (r"\.so(\.[0-9]+)+$", "Versioned Library Inventory") if module == "linux" else (r"\.(dylib|framework)(/Versions/[A-Z])?", "Library Inventory for CVE Review")
    lists = [(first_names(names, 30), category, "Linked Shared Libraries" if module == "linux" else "Linked Dynamic Libraries"), (first_names(names.where(F.col("name").rlike(versioned)), 50), category, title)]
    if module == "macos":
        framework = F.regexp_extract("path", r"([^/]+\.framework)(/|$)", 1).alias("name")
        lists.append((first_names(paths.select(F.lit(module).alias("module"), framework).where("name <> ''"), 30), category, "Embedded Frameworks"))
    parts = [_of(rows.withColumn("file_path", F.lit("")), module, c, check, "Info", F.array_join("libraries", ", "), None, ["inventory", "sbom"], 100_000) for rows, c, check in lists]
    counted = ((paths.where(extension(F.col("path")).isin(*CONFIG_ENDS[module])), "Configuration Analysis", "Configuration Files Inventoried"), (headers, "Application Discovery", "ELF Executables Discovered" if module == "linux" else "Mach-O Binaries Discovered"))
    for rows, c, check in counted:
        total = rows.agg(F.count("*").alias("n"), F.lit("").alias("file_path")).where("n > 0")
        parts.append(_of(total, module, c, check, "Info", F.concat(F.col("n").cast("string"), F.lit(" file(s) found")), None, ["inventory"]))
    return _union(parts)


def own_secrets(found: DataFrame, module: str) -> DataFrame:
    """Findings of secrets as the platform's own: their category by the kind of file."""
    ext = extension(F.col("file_path"))
    category = F.when(ext == ".log", "Log Analysis").when(ext.isin(".sqlite", ".sqlite3", ".db"), "Local Database Analysis").otherwise("Sensitive Data Discovery")
    tags = F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit(module), F.lower(F.replace(category, F.lit(" "), F.lit("-")))))
    out = found.withColumn("title", F.concat(F.lit("["), category, F.lit("] "), "title")).withColumn("tags", tags).withColumn("module", F.lit(module))
    return out.withColumn("extra", F.coalesce("extra", F.to_json(F.struct(category.alias("category"), F.lit(module).alias("platform"))))).withColumn("fingerprint", fingerprint())


def plist_findings(files: DataFrame) -> DataFrame:
    """Information property lists, entitlements and launch agents; files: path, content."""

    def about(data: dict) -> Iterator[tuple]:
        category = "Application Discovery"
        shown = ", ".join(f"{k}={data.get(k, '?')}" for k in ("CFBundleIdentifier", "CFBundleShortVersionString", "CFBundleExecutable"))
        yield category, "Info.plist Bundle Metadata", "Info", shown, "inventory"
        ats = data.get("NSAppTransportSecurity")
        if isinstance(ats, dict) and ats.get("NSAllowsArbitraryLoads"):
            yield category, "App Transport Security Disabled", "High", "NSAllowsArbitraryLoads = true", "transport"
        for kind in data.get("CFBundleURLTypes") or []:
            for scheme in kind.get("CFBundleURLSchemes", []) if isinstance(kind, dict) else []:
                yield category, "Custom URL Scheme Registered", "Medium" if str(scheme).lower() in ("http", "https", "file") else "Low", str(scheme), "url-scheme"
        if data.get("LSFileQuarantineEnabled") is False:
            yield category, "File Quarantine Disabled", "Medium", "LSFileQuarantineEnabled = false", "quarantine"
        for url in re.findall(r"https?://[^\s\"'<>]{4,300}", str(data.get("SUFeedURL") or "")):
            h = channel_hit("macos", url, "SUPublicEDKey" in data)
            yield "Update Mechanism Analysis", h.title.split("] ", 1)[1], h.severity, url, "auto-update"

    def hits(path: str, content: bytes) -> Iterator[tuple]:
        data = plistlib.loads(content)
        if not isinstance(data, dict):
            return
        parts = re.split(r"[/\\]| > ", path)
        if parts[-1] == "Info.plist":
            yield from about(data)
        if parts[-1].endswith(".entitlements"):
            for key, check in RISKY_ENTITLEMENTS.items():
                if data.get(key):
                    yield "Binary Analysis", check, "Medium", key, "entitlements"
        folders = {p.lower() for p in parts[:-1]}
        if folders & {"launchagents", "launchdaemons"}:
            kind = "LaunchDaemon" if "launchdaemons" in folders else "LaunchAgent"
            yield "Startup", f"{kind} Discovered", "Info", f"Label={data.get('Label', '?')}, RunAtLoad={data.get('RunAtLoad', False)}", "inventory"
            if kind == "LaunchDaemon" and data.get("UserName", "root") in ("", "root"):
                yield "Startup", "LaunchDaemon Runs as Root", "Low", f"UserName={data['UserName']}" if data.get("UserName") else "no UserName", "startup"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(path, *h) for h in hits(path, content or b"")]
                except Exception:
                    continue  # not a property list
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(6)], names=["file_path", "category", "check", "sev", "evidence", "tag"])

    ext = extension(F.col("path"))
    rows = files.where(ext.isin(".plist", ".entitlements")).select("path", "content").mapInArrow(run, "file_path string, category string, check string, sev string, evidence string, tag string")
    slug = F.lower(F.replace("category", F.lit(" "), F.lit("-")))
    rule = F.lower(F.replace(F.concat_ws("-", F.lit("macos"), "category", "check"), F.lit(" "), F.lit("-")))
    tags = F.array_distinct(F.array(F.lit("macos"), slug, F.col("tag")))
    return findings(rows, module="macos", rule_id=rule, title=F.concat(F.lit("["), F.col("category"), F.lit("] "), F.col("check")), severity=F.col("sev"), file_path=F.col("file_path"), evidence=F.left("evidence", F.lit(2000)), tags=tags, confidence="Medium")
