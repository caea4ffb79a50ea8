"""Queries over the driver's tables, one for each operator, each with its SQL where SQL can say it."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from artiscope.functions import constants as C
from artiscope.functions import paths
from artiscope.functions import text as X
from artiscope.operators import binaries, bundles, config, dlls, grouping, indicators, platforms, reputation, rules, services
from artiscope.plans import specimens
from artiscope.plans import sql as S
from artiscope.sources import archives as AS
from artiscope.sources import files as FS
from artiscope.sources.tables import conversation_files, document_files, read, spread
from artiscope.sources.scratch import Scratch
from artiscope.streaming import incremental
from artiscope.streaming.cache import FindingCache, cached_scan

#: Queries judge certificates as of this moment.
AS_OF = datetime(2025, 1, 1, tzinfo=timezone.utc)

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- indicators ---


@query("extract_ipv4", S.IPV4)
def extract_ipv4(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where(F.col("text").rlike(r"[0-9]\.[0-9]")).select("doc_id", F.posexplode(X.first_distinct(X.ipv4s(F.col("text")), 15)).alias("pos", "ip"))


@query("ip_class", S.IP_CLASS)
def ip_class(spark: SparkSession, d: str) -> DataFrame:
    return extract_ipv4(spark, d).groupBy(X.is_private_ip(F.col("ip")).alias("private")).agg(F.count("*").alias("n"), F.countDistinct("ip").alias("n_ips"))


@query("version_context", S.VERSION_CONTEXT)
def version_context(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of documents to which values of version attributes were added, among them ones that stand elsewhere too and ones that begin alike."""
    a = F.concat(F.lit("6."), (F.col("doc_id") % 3).cast("string"), F.lit(".0."), (F.length("text") % 7).cast("string"))
    b = F.concat(F.lit("5.1.2."), (F.length("text") % 40).cast("string"))
    text = F.concat_ws("", "text", F.lit(' <a version="'), a, F.lit('"/> on '), b, F.lit(" FileVersion : "), b, F.lit("0 and ProductVersion="), b, F.when(F.length("text") % 2 == 0, F.concat(F.lit(" then "), a)).otherwise(""), F.lit(" end"))
    return read(spark, d, "documents").select("doc_id", F.posexplode(X.addresses(text)).alias("pos", "ip"))


@query("extract_email", S.EMAIL)
def extract_email(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where(F.col("text").contains("@")).select("doc_id", F.posexplode(X.emails(F.col("text"))).alias("pos", "email"))


@query("extract_api", S.API)
def extract_api(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages").select("page_id", F.concat_ws(" ", F.regexp_replace("url", "/(en|fr|de|es)/", "/v1/$1/"), F.lit("/api/list")).alias("text"))
    return pages.select("page_id", F.posexplode(X.api_endpoints(F.col("text"))).alias("pos", "endpoint"))


@query("extract_urls", S.URLS)
def extract_urls(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("text"))
    return pages.select("page_id", F.posexplode(X.urls(F.col("text"))).alias("pos", "url"))


@query("host_denylist", S.HOSTS)
def host_denylist(spark: SparkSession, d: str) -> DataFrame:
    """Hosts of the pages without those at or below a denied domain: an anti-join on every suffix of the host."""
    denied = spark.createDataFrame([(x,) for x in ("theres.example.com", "example.net", *C.BOILERPLATE_DOMAINS)], "domain string")
    hosts = read(spark, d, "pages").groupBy(X.host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    labels = F.split("host", r"\.")
    suffixes = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("domain"))
    return hosts.join(suffixes.join(F.broadcast(denied), "domain", "left_semi").select("host").distinct(), "host", "left_anti")


@query("internal_hosts", S.INTERNAL_HOSTS)
def internal_hosts(spark: SparkSession, d: str) -> DataFrame:
    host = F.concat(F.element_at(F.array(*map(F.lit, ("api.dev.", "latest.", "localhost.", "10.0.0.1#", "qa."))), (F.col("page_id") % 5 + 1).cast("int")), X.host_of(F.col("url")))
    host = F.split(host, "#")[0]
    return read(spark, d, "pages").select("page_id", host.alias("host")).select("page_id", "host", X.is_internal_host(F.col("host")).alias("internal"))


@query("plausible_domains", S.PLAUSIBLE)
def plausible_domains(spark: SparkSession, d: str) -> DataFrame:
    words = read(spark, d, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z0-9]+)"), F.lit(1)))).alias("w")).distinct()
    names = words.select(F.concat("w", F.lit(".com")).alias("name"))
    return names.select("name", X.is_plausible_domain(F.col("name")).alias("plausible"))


@query("entropy_candidates", S.ENTROPY_CANDIDATES)
def entropy_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").where(F.col("text").rlike(r"[A-Za-z0-9+/_\-=]{20}")).select("doc_id", F.posexplode(X.entropy_candidates(F.col("text"))).alias("pos", "candidate"))
    return rows.select("doc_id", "pos", "candidate", X.is_token_shaped(F.col("candidate")).alias("token_shaped"))


@query("high_entropy", S.HIGH_ENTROPY)
def high_entropy(spark: SparkSession, d: str) -> DataFrame:
    texts = document_files(spark, d).unionByName(conversation_files(spark, d)).where(F.col("text").rlike(r"[A-Za-z0-9+/_\-=]{20}"))
    rows = texts.select("file_path", F.posexplode(X.entropy_candidates(F.col("text"))).alias("pos", "candidate"))
    c = F.col("candidate")
    return rows.select("file_path", "pos", "candidate", F.round(X.entropy(c), 4).alias("entropy"), X.is_secret_token(c).alias("flagged"))


# --- rules and findings ---


def document_findings(spark: SparkSession, d: str) -> DataFrame:
    texts = document_files(spark, d)
    return indicators.text_findings(texts, [rules.line_hits(F.col("text")), indicators.address_hits(F.col("text")), indicators.email_hits(F.col("text")), indicators.entropy_hits(F.col("text"))])


_SHOWN = ("module", "rule_id", "severity", "file_path", "evidence", "line_number", "column_number", "fingerprint")


@query("rule_scan", S.RULE_SCAN)
def rule_scan(spark: SparkSession, d: str) -> DataFrame:
    return rules.scan(document_files(spark, d)).unionByName(rules.scan(conversation_files(spark, d))).select(*_SHOWN)


@query("document_findings", S.with_findings("SELECT module, rule_id, severity, file_path, evidence, coalesce(line_number, 0) AS line_number, coalesce(column_number, 0) AS column_number, fingerprint FROM f"))
def findings_of_documents(spark: SparkSession, d: str) -> DataFrame:
    return document_findings(spark, d).select(*_SHOWN).fillna(0, ["line_number", "column_number"])


@query("fingerprint_dedup", S.with_findings("SELECT module, fingerprint, min(file_path) AS file_path, count(*) AS copies FROM (SELECT * FROM f UNION ALL SELECT * FROM f) GROUP BY ALL", "SELECT module, fingerprint, file_path, CAST(1 AS BIGINT) AS n FROM r"))
def fingerprint_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = document_findings(spark, d)
    return grouping.first_by_fingerprint(rows.unionByName(rows)).select("module", "fingerprint", "file_path", F.lit(1).cast("long").alias("n"))


@query("finding_groups", S.GROUPS)
def finding_groups(spark: SparkSession, d: str) -> DataFrame:
    """Issues with their first occurrence, number of occurrences and a checksum over all locations."""
    issues = grouping.group_issues(document_findings(spark, d))
    return issues.select("module", "rule_id", "issue_title", "severity", "affected_count", "file_path", "evidence", "locations_sum")


def document_issues(spark: SparkSession, d: str) -> DataFrame:
    return grouping.issue_counts(document_findings(spark, d))


@query("severity_summary", S.SUMMARY)
def severity_summary(spark: SparkSession, d: str) -> DataFrame:
    return grouping.severity_summary(document_issues(spark, d)).select("severity", "unique_issues", "instances")


@query("risk_distribution", S.with_issues("SELECT severity, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM i WHERE severity <> 'Info'), 4) AS percent FROM i WHERE severity <> 'Info' GROUP BY severity"))
def risk_distribution(spark: SparkSession, d: str) -> DataFrame:
    return grouping.risk_distribution(document_issues(spark, d))


@query("area_counts", S.with_issues("SELECT module, count(*) AS n FROM i WHERE severity <> 'Info' GROUP BY module"))
def area_counts(spark: SparkSession, d: str) -> DataFrame:
    return grouping.areas(document_issues(spark, d))


@query("highest_severity", S.with_issues("SELECT max_by(severity, severity_rank) AS highest FROM i"))
def highest_severity(spark: SparkSession, d: str) -> DataFrame:
    return grouping.highest_severity(document_issues(spark, d))


@query("report_rank", S.RANK)
def report_rank(spark: SparkSession, d: str) -> DataFrame:
    return grouping.ranked(document_issues(spark, d)).select("report_id", "rule_id", "issue_title", "severity", "affected_count")


@query("top_priority", S.TOP)
def top_priority(spark: SparkSession, d: str) -> DataFrame:
    return grouping.top_priority(document_issues(spark, d)).select("report_id", "rule_id", "severity", "affected_count")


@query("inventory_split", S.INVENTORY)
def inventory_split(spark: SparkSession, d: str) -> DataFrame:
    from artiscope.functions.findings import is_inventory

    rows = document_findings(spark, d).unionByName(indicators.url_findings(read(spark, d, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("file_path"), F.col("url").alias("text"))))
    return rows.groupBy(is_inventory().alias("inventory"), "rule_id").agg(F.count("*").alias("n"))


@query("files_scanned", S.with_findings("SELECT count(DISTINCT lower(file_path)) AS files, count(DISTINCT CASE WHEN CAST(string_split(file_path, '/')[2] AS BIGINT) % 3 = 0 THEN lower(file_path) END) AS extracted, count(DISTINCT lower(file_path)) - count(DISTINCT CASE WHEN CAST(string_split(file_path, '/')[2] AS BIGINT) % 3 = 0 THEN lower(file_path) END) AS input FROM f"))
def files_scanned(spark: SparkSession, d: str) -> DataFrame:
    inside = F.split("file_path", "/")[1].cast("long") % 3 == 0
    rows = document_findings(spark, d).withColumn("extra", F.when(inside, F.to_json(F.struct(F.lit("a.zip").alias("extracted_from")))))
    return grouping.files_scanned(rows)


@query("ui_filter", S.UI_FILTER)
def ui_filter(spark: SparkSession, d: str) -> DataFrame:
    return grouping.ui_filter(document_findings(spark, d), confidence="Medium", text="src1").select("rule_id", "severity", "affected_count")


@query("tag_labels", S.TAGS)
def tag_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select("event_type", (F.col("event_id") % 7).alias("k")).distinct()
    tags = F.filter(F.array(F.when(F.col("k") % 2 == 0, "credential"), F.when(F.col("k") % 3 == 0, "jwt"), F.when(F.col("k") == 5, "database"), F.lit("nothing"), F.when(F.col("k") > 2, "tls")), lambda x: x.isNotNull())
    return rows.select("event_type", "k", F.array_join(grouping.labels(tags, grouping.CWE_BY_TAG), "|").alias("cwe"), F.array_join(grouping.labels(tags, grouping.MITRE_BY_TAG), "|").alias("mitre"))


@query("exact_duplicate_text", "SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicate_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


# --- configuration ---


@query("config_flatten", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, 'nested.user[0]' AS key, CAST(user_id AS VARCHAR) FROM events UNION ALL SELECT event_id, 'nested.debug' AS key, CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END FROM events")
def config_flatten(spark: SparkSession, d: str) -> DataFrame:
    return config.flatten_json(_event_documents(spark, d), "doc", ["event_id"]).select("event_id", "key", "value")


def _event_documents(spark: SparkSession, d: str) -> DataFrame:
    """props with a nested part: {"k": .., "nested": {"user": [id], "debug": bool}}."""
    nested = F.to_json(F.struct(F.array("user_id").alias("user"), (F.col("user_id") % 2 == 0).alias("debug")))
    return read(spark, d, "events").select("event_id", F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "nested": '), nested, F.lit("}")).alias("doc"))


@query("config_interesting", "SELECT CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END AS value, 'nested.debug' AS key, 'debug-setting' AS classes, count(*) AS n FROM events GROUP BY ALL")
def config_interesting(spark: SparkSession, d: str) -> DataFrame:
    rows = config.flatten_json(_event_documents(spark, d), "doc", ["event_id"])
    kept = rows.where(config.is_interesting(F.col("key"), F.col("value"), F.col("type")))
    return kept.groupBy("key", "value", F.array_join(config.classify_key(F.col("key")), ",").alias("classes")).agg(F.count("*").alias("n"))


# --- services and libraries ---


@query("carry_forward", "SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS last_error FROM events")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return read(spark, d, "events").select("event_id", F.coalesce(F.last(F.when(F.col("event_type") == "error", F.col("event_id")), ignorenulls=True).over(w), F.lit(-1)).alias("last_error"))


@query("service_listing", S.SERVICE_LISTING)
def service_listing(spark: SparkSession, d: str) -> DataFrame:
    """Listings made of customers: names and paths on lines of their own, one listing a market segment and nation."""
    c = read(spark, d, "customer")
    quote = F.when(F.col("c_custkey") % 3 == 0, '"').otherwise("")
    lines = F.concat(F.lit("SERVICE_NAME: "), F.regexp_replace("c_name", "#", "_"), F.lit("\nBINARY_PATH_NAME : "), quote, F.lit("C:\\Program Files\\"), F.col("c_mktsegment"), F.lit(" App\\svc"), F.col("c_custkey").cast("string"), F.lit(".exe"), quote, F.lit(" -k x"))
    texts = c.groupBy(F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("source")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", lines.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    found = services.from_listing(texts)
    path = F.col("image_path")
    return found.select("source", "name", services.is_unquoted(path).alias("unquoted"), F.when(services.is_unquoted(path), F.array_join(services.candidates(path), "|")).otherwise("").alias("candidates"))


@query("phantom_anti_join", S.PHANTOM)
def phantom_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Imports are line items, known names the parts of even size, shipped names those of one brand."""
    imports = read(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("path"), F.concat(F.lit("Lib"), F.col("l_partkey").cast("string"), F.lit(".DLL")).alias("dll"))
    parts = read(spark, d, "part")
    name = F.concat(F.lit("lib"), F.col("p_partkey").cast("string"), F.lit(".dll")).alias("name")
    known = parts.where("p_size % 2 = 0").select(name).unionByName(spark.createDataFrame([("lib1*",), ("lib2*",)], "name string"))
    return dlls.unknown_imports(imports, known, parts.where("p_brand = 'Brand#13'").select(name))


@query("dependency_graph", "SELECT src, count(*) AS n_targets, array_to_string(list_sort(list(dst))[1:20], ',') AS targets FROM (SELECT DISTINCT l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem) GROUP BY src")
def dependency_graph(spark: SparkSession, d: str) -> DataFrame:
    return dlls.dependency_graph(read(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")))


@query("publisher_consistency", S.PUBLISHERS)
def publisher_consistency(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("root"), F.col("c_mktsegment").alias("publisher"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"))
    return dlls.publisher_conflicts(files)


# --- reputation and incremental ---


@query("severity_from_ratio", S.RATIO)
def severity_from_ratio(spark: SparkSession, d: str) -> DataFrame:
    per = read(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("malicious"), F.count_if(F.col("event_type") == "view").alias("suspicious"), F.count("*").alias("engines"))
    per = per.withColumn("malicious", F.when(F.col("user_id") % 4 == 0, 0).otherwise(F.col("malicious") % 7))
    return per.select("user_id", "malicious", "suspicious", "engines", F.coalesce(reputation.severity_of(F.col("malicious"), F.col("suspicious"), F.col("engines")), F.lit("none")).alias("severity"))


@query("verdict_join", S.VERDICTS)
def verdict_join(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("seq"))
    verdicts = read(spark, d, "documents").where("doc_id % 5 = 0").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.max(F.col("doc_id") % 9).alias("malicious")).select("sha256", "malicious", F.lit(0).cast("long").alias("suspicious"), F.lit(60).cast("long").alias("engines"), F.array(F.lit("a"), F.lit("b")).alias("vendors"))
    out = reputation.reputation_findings(docs, verdicts, max_lookups=None, include_clean=True)
    return out.groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


@query("incremental_work_list", "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE doc_id % 4 <> 0 OR doc_id % 3 = 0")
def incremental_work_list(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    cache = files.where("doc_id % 4 = 0").withColumn("sha256", F.when(F.col("doc_id") % 3 == 0, F.lit("old")).otherwise(F.col("sha256")))
    return incremental.work_list(files, cache, "doc_id")


@query("incremental_rescan", S.with_findings("SELECT fingerprint, count(*) AS n FROM f GROUP BY fingerprint"))
def incremental_rescan(spark: SparkSession, d: str) -> DataFrame:
    """A rescan of which half comes from the cache gives the findings of a full scan."""
    texts = document_files(spark, d).withColumn("sha256", F.sha2("text", 256)).withColumnRenamed("file_path", "path")
    half = texts.where(F.crc32(F.col("path").cast("binary")) % 2 == 0)

    def scan(files: DataFrame) -> DataFrame:
        rows = files.withColumnRenamed("path", "file_path")
        return rules.scan(rows).unionByName(indicators.address_findings(rows)).unionByName(indicators.email_findings(rows)).unionByName(indicators.entropy_findings(rows)).withColumn("path", F.col("file_path"))

    cached = scan(half).join(half.select("path", "sha256"), "path")
    return incremental.rescan(texts, cached, half, scan).groupBy("fingerprint").agg(F.count("*").alias("n"))


# --- files: made from rows of the tables ---


@query("file_classes", S.FILE_CLASSES)
def file_classes(spark: SparkSession, d: str) -> DataFrame:
    ends = F.array(*map(F.lit, S.FILE_ENDS))
    folder = F.when(F.col("p_partkey") % 11 == 0, "/a/.git/").when(F.col("p_partkey") % 13 == 0, "/node_modules/x/").otherwise("/a/b/")
    named = read(spark, d, "part").select(F.concat(folder, F.lit("f"), F.col("p_partkey").cast("string"), F.element_at(ends, (F.col("p_partkey") % len(S.FILE_ENDS) + 1).cast("int"))).alias("path"))
    return named.select("path", FS.file_class(F.col("path")).alias("kind"), FS.in_skipped_dir(F.col("path")).alias("skipped"))


@query("binary_kinds", "SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'elf' WHEN 1 THEN 'macho' WHEN 2 THEN 'macho' WHEN 3 THEN 'class' WHEN 4 THEN 'pe' ELSE 'none' END AS kind FROM supplier")
def binary_kinds(spark: SparkSession, d: str) -> DataFrame:
    heads = F.array(*[F.unhex(F.lit(h)) for h in ("7F454C4602", "CFFAEDFE07", "CAFEBABE00000002", "CAFEBABE0000003D", "4D5A" + "00" * 58 + "40000000" + "50450000", "4D5A" + "00" * 58 + "00000000")])
    made_ = read(spark, d, "supplier").select("s_suppkey", F.element_at(heads, (F.col("s_suppkey") % 6 + 1).cast("int")).alias("content"))
    return made_.select("s_suppkey", F.coalesce(FS.binary_kind(), F.lit("none")).alias("kind"))


@query("binary_strings", "SELECT doc_id, len(x) AS n_strings, coalesce(list_sum(list_transform(x, lambda s: length(s))), 0)::BIGINT AS n_chars FROM (SELECT doc_id, regexp_extract_all(text, '[ -~]{6,}') AS x FROM documents) WHERE len(x) > 0")
def binary_strings(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    rows = binaries.binary_strings(files).where("encoding = 'ascii'")
    return rows.groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.count("*").alias("n_strings"), F.sum(F.length("text")).alias("n_chars"))


@query("pe_mitigations", S.MITIGATIONS)
def pe_mitigations(spark: SparkSession, d: str) -> DataFrame:
    """Images made of parts: their size gives the mitigation flags, odd keys are 32-bit."""
    flags = (F.col("p_size") * 1301 + F.col("p_partkey") * 97) % 32768
    rows = spread(read(spark, d, "part").select("p_partkey", "p_size")).select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".exe")).alias("path"), flags.cast("int").alias("flags"), (F.col("p_partkey") % 2 == 0).alias("wide"))
    found = binaries.scan_binaries(specimens.made(rows, lambda flags, wide: specimens.image(flags, ("kernel32.dll",), wide)), AS_OF)
    return found.where(F.col("rule_id").isin("aslr-disabled", "aslr-high-entropy-va-disabled", "dep-disabled", "cfg-disabled", "safeseh-disabled")).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


@query("pe_imports", "SELECT DISTINCT 's' || l_suppkey || '.exe' AS path, 'lib' || l_partkey % 40 || '.dll' AS dll FROM lineitem WHERE l_partkey % 40 >= 5")
def pe_imports(spark: SparkSession, d: str) -> DataFrame:
    """Images that import what a supplier supplies, parsed, without the known libraries."""
    rows = read(spark, d, "lineitem").groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit(".exe")).alias("path")).agg(F.sort_array(F.collect_set(F.concat(F.lit("LIB"), (F.col("l_partkey") % 40).cast("string"), F.lit(".dll")))).alias("libs"))
    imports = binaries.imports_of(specimens.made(rows, lambda libs: specimens.image(0, tuple(libs))))
    known = spark.createDataFrame([(f"lib{k}.dll",) for k in range(5)], "name string")
    return dlls.unknown_imports(imports, known, known.limit(0))


@query("class_rules", S.CLASS_RULES)
def class_rules(spark: SparkSession, d: str) -> DataFrame:
    """Class files made of documents: a cipher and a digest by source and language, a connection with the document's number."""
    names = F.array(*map(F.lit, S.CIPHERS))
    rows = spread(read(spark, d, "documents").select("doc_id", "lang")).select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".class")).alias("path"), F.element_at(names, (F.col("doc_id") % len(S.CIPHERS) + 1).cast("int")).alias("cipher"), F.upper("lang").alias("lang"), F.concat(F.when(F.col("doc_id") % 4 == 0, "jdbc:db://h/?pwd=").otherwise("jdbc:db://h/?user="), F.col("doc_id").cast("string")).alias("url"))

    def build(cipher: str, lang: str, url: str) -> bytes:
        return specimens.java_class((("javax/crypto/Cipher", "getInstance"), ("java/security/MessageDigest", "getInstance")), (cipher, "MD5" if lang == "EN" else "SHA-256", url))

    found = binaries.scan_binaries(specimens.made(rows, build), AS_OF)
    return found.groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


@query("assembly_rules", S.ASSEMBLY_RULES)
def assembly_rules(spark: SparkSession, d: str) -> DataFrame:
    """Assemblies made of line items: a supplier's parts choose the types that it refers to."""
    kinds = F.array(*map(F.lit, S.ASSEMBLY_TYPES))
    rows = read(spark, d, "lineitem").groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit(".dll")).alias("path")).agg(F.sort_array(F.collect_set(F.element_at(kinds, (F.col("l_partkey") % 97 % len(S.ASSEMBLY_TYPES) + 1).cast("int")))).alias("types"))
    found = binaries.scan_binaries(specimens.made(rows, lambda types: specimens.assembly(tuple((t, "Create") for t in types))), AS_OF)
    return found.where("rule_id like 'dotnet-%' and rule_id not like '%obfuscated%'").groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


@query("source_rules", S.SOURCE_RULES)
def source_rules(spark: SparkSession, d: str) -> DataFrame:
    """Application sources made of events: user and event numbers set the preferences."""
    text = F.concat(
        F.when(F.col("event_id") % 7 == 0, r"const s = 'it\'s', r = /[`'\"]/; ").otherwise("const t = `a ${ f(`b`) } 'c`; "),
        F.lit("const w = new BrowserWindow({ webPreferences: { nodeIntegration: "), F.when(F.col("user_id") % 2 == 0, "true").otherwise("!1"), F.lit(", sandbox: "), F.when(F.col("event_id") % 3 == 0, "false").otherwise("true"), F.lit(" } });\n"), F.when(F.col("event_id") % 5 == 0, "w.loadURL('x')\n").otherwise("\n"), F.when(F.col("event_id") % 11 == 0, "// don't\nw.on(`will-navigate`, f); w.setWindowOpenHandler(g);").otherwise(""),
    )
    files = spread(read(spark, d, "events").select("event_id", "user_id")).select(F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(".js")).alias("path"), text.cast("binary").alias("content"))
    found = binaries.scan_binaries(files, AS_OF).where("rule_id <> 'electron-hardening-summary'")
    return found.groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


@query("archive_members", "SELECT 'd' || doc_id || '.zip > t' || doc_id || '.txt' AS path, sha256(text) AS sha256 FROM documents WHERE length(text) > 0")
def archive_members(spark: SparkSession, d: str) -> DataFrame:
    """Archives made of documents, unpacked again."""
    rows = read(spark, d, "documents").where(F.length("text") > 0).select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".zip")).alias("path"), F.concat(F.lit("t"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("body"))
    members, _ = AS.expand(specimens.made(rows, specimens.archive), max_depth=1, max_archives=None)
    return members.select("path", F.sha2("content", 256).alias("sha256"))


@query("settings_of_files", "SELECT 'e' || event_id || '.ini' AS file_path, 'app.user' AS key, CAST(user_id AS VARCHAR) AS value FROM events UNION ALL SELECT 'e' || event_id || '.ini', 'app.debug', CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'no' END FROM events")
def settings_of_files(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("[app]\nuser = "), F.col("user_id").cast("string"), F.lit("\ndebug = "), F.when(F.col("user_id") % 2 == 0, "true").otherwise("no"), F.lit("\n"))
    files = spread(read(spark, d, "events").select("event_id", "user_id")).select(F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(".ini")).alias("path"), text.cast("binary").alias("content"))
    return config.settings(files).select("file_path", "key", "value")


@query("risky_settings", S.RISKY)
def risky_settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings made of all events: keys by type of event, values by user."""
    key = F.concat_ws(".", "event_type", F.element_at(F.array(*map(F.lit, S.RISKY_KEYS)), (F.col("event_id") % len(S.RISKY_KEYS) + 1).cast("int")))
    value = F.element_at(F.array(*map(F.lit, S.RISKY_VALUES)), (F.col("user_id") % len(S.RISKY_VALUES) + 1).cast("int"))
    rows = read(spark, d, "events").select(key.alias("key"), value.alias("value"))
    return rows.groupBy("key", "value", config.is_risky(F.col("key"), F.col("value"), F.lit("STR")).alias("risky")).agg(F.count("*").alias("n"))


@query("registry_services", S.REGISTRY)
def registry_services(spark: SparkSession, d: str) -> DataFrame:
    """Registry exports made of suppliers, as escaped text or as UTF-16 bytes, one export a nation."""
    path = F.concat(F.lit("C:\\Program Files\\Acme "), F.col("s_nationkey").cast("string"), F.lit("\\svc"), F.col("s_suppkey").cast("string"), F.lit(".exe"))
    escaped = F.concat(F.lit('"ImagePath"="'), F.replace(path, F.lit("\\"), F.lit("\\\\")), F.lit('"'))
    raw = F.hex(F.encode(F.concat(path, F.lit("\0")), "UTF-16LE"))
    hexed = F.concat(F.lit('"ImagePath"=hex(2):'), F.regexp_replace(F.regexp_replace(raw, "(..)", "$1,"), ",$", ""))
    entry = F.concat(F.lit("[HKEY_LOCAL_MACHINE\\SYSTEM\\Services\\S"), F.col("s_suppkey").cast("string"), F.lit("]\r\n"), F.when(F.col("s_suppkey") % 2 == 0, escaped).otherwise(hexed), F.lit("\r\n"))
    texts = read(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("source")).agg(F.array_join(F.sort_array(F.collect_list(entry)), "").alias("text"))
    return services.from_registry(texts).select("source", "name", "image_path")


@query("permission_bits", "SELECT p_partkey, (p_size * 37 % 4096) & 2 <> 0 AS world, (p_size * 37 % 4096) & 3072 <> 0 AS set_id FROM part ORDER BY 'm' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') LIMIT 500")
def permission_bits(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("logs/m"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    modes = read(spark, d, "part").select(name.alias("path"), (F.col("p_size") * 37 % 4096).cast("int").alias("mode"), F.lit(False).alias("is_symlink"))
    found = platforms.permission_findings(modes).groupBy("file_path").agg(F.max(F.col("rule_id").endswith("world-writable-file")).alias("world"), F.max(F.col("rule_id").endswith("suid/sgid-file-detected")).alias("set_id"))
    first = modes.orderBy("path").limit(platforms.PERMISSION_FILES)
    return first.join(found, F.col("path") == F.col("file_path"), "left").select(F.substring("path", 7, 9).cast("long").alias("p_partkey"), F.coalesce("world", F.lit(False)).alias("world"), F.coalesce("set_id", F.lit(False)).alias("set_id"))


@query("finding_paths", "SELECT page_id, 'in/' || page_id || CASE WHEN page_id % 2 = 0 THEN ' > sub/a.js' ELSE '' END AS path, 'App_' || page_id || '_' AS app FROM pages")
def finding_paths(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages").select("page_id", F.concat(F.lit("/scan/root/in/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, " > sub/a.js").otherwise("")).alias("path"), F.concat(F.lit("C:\\x\\App<"), F.col("page_id").cast("string"), F.lit(">.exe")).alias("target"))
    return p.select("page_id", paths.relative(F.col("path"), "/scan/root").alias("path"), paths.application_name(F.col("target")).alias("app"))


@query("default_pocs", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'own' WHEN doc_id % 3 = 1 THEN 'dumpbin \"d' || doc_id || '\"' ELSE 'Location: d' || doc_id || '; evidence: ' || lang END AS poc FROM documents")
def default_pocs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    docs = read(spark, d, "documents").select("doc_id", "lang", F.when(k == 0, "own").otherwise(" ").alias("poc"), F.when(k == 1, "graph").otherwise("other").alias("rule"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"))
    return docs.select("doc_id", paths.default_poc(F.col("rule"), F.col("path"), F.col("lang"), F.col("poc"), {"graph": 'dumpbin "{path}"'}).alias("poc"))


@query("vendor_texts", "SELECT user_id, array_to_string(list_transform(range(0, least(10, user_id % 14)), lambda k: 'v' || k), ', ') || CASE WHEN user_id % 14 > 10 THEN ' +' || (user_id % 14 - 10) || ' more' ELSE '' END AS vendors FROM (SELECT DISTINCT user_id FROM events)")
def vendor_texts(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("user_id") % 14).cast("int")
    users = read(spark, d, "events").select("user_id").distinct()
    listed = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat(F.lit("v"), k.cast("string")))).otherwise(F.array().cast("array<string>"))
    return users.select("user_id", reputation.vendors_text(listed).alias("vendors"))


@query("severity_names", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Info' WHEN 2 THEN 'Critical' ELSE 'Info' END AS severity, CASE event_id % 4 WHEN 0 THEN 3 WHEN 2 THEN 4 ELSE 0 END AS severity_rank FROM events")
def severity_names(spark: SparkSession, d: str) -> DataFrame:
    from artiscope.functions.findings import severity, severity_rank

    name = severity(F.element_at(F.array(F.lit(" HIGH "), F.lit("odd"), F.lit("critical"), F.lit("info")), (F.col("event_id") % 4 + 1).cast("int")))
    return read(spark, d, "events").select("event_id", name.alias("severity"), severity_rank(name).alias("severity_rank"))


@query("network_artifacts", S.NETWORK_ARTIFACTS)
def network_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Internal hosts among the URLs that stand in binaries: each page's HTML and URL, and its URL on another host, are put into one."""
    hosts = F.array(*map(F.lit, S.OTHER_HOSTS))
    other = F.replace("url", F.lit("://"), F.concat(F.lit("://"), F.element_at(hosts, (F.length("html") % len(S.OTHER_HOSTS) + 1).cast("int"))))
    rows = spread(read(spark, d, "pages").select("page_id", "url", "html")).select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".so")).alias("path"), F.concat_ws("\n", "url", other, F.substring("html", 1, 1000)).alias("text"))
    hits = binaries.binary_hits(specimens.made(rows, lambda text: specimens.elf_object((text or "").split("\n"))), AS_OF)
    urls = hits.where("rule_id = 'linux-binary-analysis-embedded-url(s)'").select("file_path", F.explode("items").alias("url"))
    return platforms.network_artifacts(urls).select("rule_id", "evidence", "file_path")


@query("embedded_indicators", S.EMBEDDED)
def embedded_indicators(spark: SparkSession, d: str) -> DataFrame:
    """The first addresses of mail in each binary that holds a document, ten at most, in their order."""
    rows = read(spark, d, "documents").where(F.length("text") > 0).select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".so")).alias("path"), "text")
    hits = binaries.binary_hits(specimens.made(rows, lambda text: specimens.elf_object(text.split("\n"))), AS_OF)
    found = hits.where("rule_id = 'linux-binary-analysis-embedded-email-address(s)'")
    return found.select("file_path", F.posexplode("items").alias("pos", "email"))


@query("authenticode_digests", S.AUTHENTICODE)
def authenticode_digests(spark: SparkSession, d: str) -> DataFrame:
    """Signed images that carry a document each. They were signed before ``token`` was put in where the document has it."""
    rows = read(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".exe")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    return binaries.signature_digests(specimens.made(rows, lambda text: specimens.signed_image(text.encode(), text.replace("token", "entry").encode())))


@query("archive_levels", S.ARCHIVE_LEVELS)
def archive_levels(spark: SparkSession, d: str) -> DataFrame:
    """What archives of four kinds hold: one for each source and language with its documents, every fifth text in an archive of its own."""
    k = F.col("doc_id")
    name = F.concat(F.lit("t"), k.cast("string"), F.lit(".txt"))
    group = F.concat_ws("-", "source", "lang", F.floor(k / 50).cast("string"))
    rows = read(spark, d, "documents").where(F.length("text") > 0).select(group.alias("group"), k.alias("doc_id"), name.alias("name"), "text")
    held = rows.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("doc_id", "name", "text"))).alias("docs"))
    kind = F.element_at(F.array(F.lit("zip"), F.lit("tar"), F.lit("tgz"), F.lit("7z")), (F.length("group") % 4 + 1).cast("int"))
    made = held.select(F.concat_ws(".", "group", kind).alias("path"), kind.alias("kind"), "docs")
    members, _ = AS.expand(specimens.made(made, specimens.nested_archive), max_depth=1, max_archives=None)
    return members.select("path", "depth", F.when(~F.col("path").endswith(".zip"), F.sha2("content", 256)).alias("sha256"))


@query("secret_bundles", S.BUNDLES)
def secret_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Secrets of documents and conversations that stand near one another; above each token a password was written."""
    added = F.concat(F.lit('password = "Hx7!'), F.length("text").cast("string"), F.lit('.Lantern"\ntoken = "'))
    files = document_files(spark, d).unionByName(conversation_files(spark, d)).withColumn("text", F.replace("text", F.lit('token = "'), added))
    found = rules.scan(files)
    return bundles.bundles(found).select("file_path", "first_line", "last_line", "n_secrets", F.array_join("rules", ",").alias("rules"), "severity_rank")


@query("decoded_tokens", S.TOKENS)
def decoded_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Claims of tokens made of documents, out of the documents' texts."""
    n = F.length("text").cast("long")
    url64 = lambda c: F.translate(F.base64(c.cast("binary")), "+/=\r\n", "-_")
    head = F.concat(F.lit('{"typ":"JWT","alg":"'), F.when(n % 3 == 0, "none").otherwise("HS256"), F.lit('"}'))
    body = F.to_json(F.struct(F.col("source").alias("iss"), F.left("text", F.lit(20)).alias("sub"), (F.lit(1_700_000_000) + n * 10_000).alias("exp")))
    token = F.concat_ws(".", url64(head), url64(body), F.when(n % 3 == 0, "").otherwise(F.left(F.sha2("text", 256), F.lit(43))))
    texts = read(spark, d, "documents").where(n > 0).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_path"), F.concat("text", F.lit("\nAuthorization: Bearer "), token, F.lit("; eyJub.eyJno.x eyJhbGci.eyJ.x")).alias("text"))
    found = bundles.token_findings(texts, AS_OF)
    claim = lambda k: F.get_json_object("extra", f"$.{k}").alias(k)
    return found.select("file_path", "severity", claim("alg"), claim("iss"), claim("sub"), claim("exp").cast("bigint").alias("exp"))


@query("finding_cache", S.CACHE)
def finding_cache(spark: SparkSession, d: str) -> DataFrame:
    """What a cache holds after three rescans of documents, of which some came, changed and went in between."""
    k, text = F.col("doc_id"), F.col("text")
    docs = read(spark, d, "documents").where(text.isNotNull()).select(F.concat_ws("/", "source", k.cast("string")).alias("path"), "text", k.alias("k"), F.length("text").alias("n"))
    with_sum = lambda df: df.withColumn("sha256", F.sha2("text", 256))
    states = [docs.where("n % 4 <> 1"), docs.where("n % 5 <> 2").withColumn("text", F.when(F.col("n") % 3 == 0, F.concat(text, F.lit(" more"))).otherwise(text))]
    scratch = Scratch(spark)
    cache = FindingCache(spark, f"{scratch.folder}/cache", buckets=16)
    scan = lambda files: rules.scan(files.select(F.col("path").alias("file_path"), "text"))
    for files in (*states, states[1]):
        cached_scan(cache, with_sum(files), scan, "secrets")
    counts = cache.findings().groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("n_findings"))
    return cache.entries().join(counts, "path", "left").select("path", "module", "sha256", F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


# --- operators of a scan's end ---


@query("roll_up", S.ROLL_UP)
def roll_up(spark: SparkSession, d: str) -> DataFrame:
    """All findings of one rule as one, with the number of files and the first twenty."""
    rows = grouping.roll_up(document_findings(spark, d), "hardcoded-ip")
    return rows.select("module", "rule_id", "severity", "n_files", F.array_join("files", ",").alias("files"))


@query("report_filter", S.REPORT_FILTER)
def report_filter(spark: SparkSession, d: str) -> DataFrame:
    issues = grouping.group_issues(document_findings(spark, d))
    kept = grouping.report_filter(issues, module="secrets", text="ADDRESS")
    return kept.select("rule_id", "severity", "affected_count", grouping.module_label(F.col("module")).alias("label"))


@query("libraries", S.LIBRARIES)
def libraries(spark: SparkSession, d: str) -> DataFrame:
    """Libraries of suppliers' binaries, the first thirty by name for each module."""
    part = F.concat(F.lit("lib"), F.lpad(F.col("l_partkey").cast("string"), 8, "0"))
    module = F.when(F.col("l_suppkey") % 2 == 0, "linux").otherwise("macos")
    linked = read(spark, d, "lineitem").groupBy(module.alias("module"), "l_suppkey").agg(F.collect_set(part).alias("items"))
    return platforms.libraries(linked).select("module", F.array_join("libraries", ",").alias("libraries"))


@query("config_counts", S.CONFIG_COUNTS)
def config_counts(spark: SparkSession, d: str) -> DataFrame:
    ends = F.array(*map(F.lit, S.FILE_ENDS))
    files = read(spark, d, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.element_at(ends, (F.col("p_partkey") % len(S.FILE_ENDS) + 1).cast("int"))).alias("path"))
    return platforms.config_counts(files)


@query("application_roots", S.APP_ROOTS)
def application_roots(spark: SparkSession, d: str) -> DataFrame:
    """Manifests made of customers: some among dependencies, some without a main file."""
    k = F.col("c_custkey")
    folder = F.concat(F.lit("/apps/"), k.cast("string"), F.when(k % 5 == 0, "/node_modules/x").otherwise(""))
    main = F.when(k % 3 == 0, '{"name": "x"}').otherwise(F.concat(F.lit('{"main": "m'), k.cast("string"), F.lit('.js"}')))
    files = read(spark, d, "customer").select(F.concat(folder, F.lit("/package.json")).alias("path"), main.cast("binary").alias("content"))
    return dlls.application_roots(files)


@query("unpack_steps", S.UNPACK_STEPS)
def unpack_steps(spark: SparkSession, d: str) -> DataFrame:
    """Commands that unpack what holds a page's file, one archive or two deep."""
    k = F.col("page_id")
    chain = F.concat(F.lit("in/a"), k.cast("string"), F.lit(".zip"), F.when(k % 2 == 0, " > b.asar").otherwise(""), F.lit(" > c.js"))
    return read(spark, d, "pages").select("page_id", F.array_join(paths.unpack_steps(chain), " && ").alias("steps"))


@query("scrubbed_notes", "SELECT conv_id, turn, 'at <target>/' || conv_id || ' via <temp>/x' AS note FROM conversations")
def scrubbed_notes(spark: SparkSession, d: str) -> DataFrame:
    note = F.concat(F.lit("at /scan/root/"), F.col("conv_id").cast("string"), F.lit(" via /tmp/run"), F.col("turn").cast("string"), F.lit("/x"))
    return read(spark, d, "conversations").select("conv_id", "turn", paths.scrub(note, "/scan/root").alias("note"))
