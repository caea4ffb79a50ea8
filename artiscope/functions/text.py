"""Indicators, hosts, addresses and entropy as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from artiscope.functions import constants as C


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def first_distinct(matches: Column, limit: int) -> Column:
    """The first ``limit`` distinct values in order of appearance."""
    return F.slice(F.array_distinct(matches), 1, limit)


def every(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches; none for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


# --- IPv4 ---


def is_ipv4(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike("^(0|[1-9][0-9]{0,2})$") & (p.cast("int") <= 255))


def is_private_ip(ip: Column) -> Column:
    starts = [ip.startswith(p) for p in (*C.INTERNAL_PREFIXES, *C.PRIVATE_IP_PREFIXES)]
    out = ip.rlike(C.PRIVATE_172_RE)
    for s in starts:
        out = out | s
    return out


def ipv4s(text: Column) -> Column:
    """Valid addresses, without the two that mean nothing; neighbours that share a separator are both found."""
    apart = F.regexp_replace(text, r"([^0-9A-Za-z_.])", "$1$1")
    found = every(apart, C.IPV4_RE, 1)
    return F.filter(found, lambda ip: is_ipv4(ip) & ~ip.isin("0.0.0.0", "255.255.255.255"))


# an address, and before it either what assigns a version or the start of the text or a separator; each match is judged by itself
_ADDRESS_RE = r"(?i)(?:(?:version|fileversion|productversion|assemblyversion|schemaversion)\s*[:=]\s*[\"']?|^|[^0-9a-z_])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9a-z_])"


def addresses(text: Column, limit: int = 15, lookback: int = 40) -> Column:
    """IPv4 indicators: addresses that stand somewhere else than in a version attribute's value, whose name and sign are within ``lookback`` characters."""
    ip = lambda m: F.regexp_extract(m, r"[0-9.]+$", 0)
    before = lambda m: F.left(m, F.length(m) - F.length(ip(m)))
    named = F.transform(every(text, _ADDRESS_RE), lambda m: F.struct(F.ltrim(ip(m), F.lit(".")).alias("ip"), F.right(before(m), F.lit(lookback)).rlike(C.VERSION_CONTEXT_RE).alias("version")))
    kept = F.filter(named, lambda m: is_ipv4(m["ip"]) & ~m["ip"].isin("0.0.0.0", "255.255.255.255") & ~m["version"])
    return first_distinct(F.transform(kept, lambda m: m["ip"]), limit)


# --- hosts and URLs ---


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def registrable(host: Column) -> Column:
    """The last two labels."""
    return F.substring_index(host, ".", -2)


def is_boilerplate(host: Column) -> Column:
    """On the list itself or below a listed domain."""
    return F.exists(_array(C.BOILERPLATE_DOMAINS), lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d)))


def urls(text: Column, limit: int = 15) -> Column:
    found = F.transform(every(text, C.URL_RE), lambda u: F.regexp_replace(u, r"[.,;)\"']+$", ""))
    return first_distinct(F.filter(found, lambda u: (host_of(u) != "") & ~is_boilerplate(host_of(u))), limit)


def is_internal_host(host: Column) -> Column:
    prefix = host.startswith(C.INTERNAL_PREFIXES[0]) | host.startswith(C.INTERNAL_PREFIXES[1]) | host.startswith(C.INTERNAL_PREFIXES[2])
    label = F.arrays_overlap(F.split(host, r"\."), _array(C.INTERNAL_LABELS))
    return (host != "") & (prefix | (is_ipv4(host) & is_private_ip(host)) | label)


def emails(text: Column, limit: int = 10) -> Column:
    return first_distinct(F.filter(every(text, C.EMAIL_RE), lambda e: ~F.lower(F.substring_index(e, "@", -1)).isin(*C.PLACEHOLDER_EMAIL_DOMAINS)), limit)


def api_endpoints(text: Column, limit: int = 10) -> Column:
    return first_distinct(every(text, C.API_RE), limit)


def is_plausible_domain(name: Column) -> Column:
    """Second-level label of three characters or more, not mostly digits, each label in one case."""
    labels = F.split(name, r"\.")
    sld = F.element_at(labels, -2)
    digits = F.length(F.regexp_replace(sld, "[^0-9]", ""))
    cased = F.forall(labels, lambda x: x.rlike("^[^A-Z]*[a-z][^A-Z]*$") | x.rlike("^[^a-z]*[A-Z][^a-z]*$") | x.rlike("^([^A-Za-z]*[A-Z][a-z]*)+[^A-Za-z]*$") | x.rlike("^[0-9]+$"))
    shouting = name.rlike("[A-Z]") & ~name.rlike("[a-z]") & ((F.length(sld) <= 3) | sld.rlike("[0-9]"))
    return (F.size(labels) >= 2) & (F.length(sld) >= 3) & (2 * digits <= F.length(sld)) & cased & ~shouting


# --- entropy ---


def entropy(s: Column) -> Column:
    """Shannon entropy in bits a character."""
    n = F.length(s)
    share = lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n
    chars = F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))
    return F.coalesce(-F.aggregate(F.transform(chars, lambda c: share(c) * F.log2(share(c))), F.lit(0.0), lambda a, x: a + x), F.lit(0.0))


def entropy_candidates(text: Column) -> Column:
    return every(text, C.ENTROPY_CANDIDATE_RE)


def is_token_shaped(s: Column) -> Column:
    """Not a run of one or two characters, digits only, a GUID, or the base64 of a known binary format."""
    bare = F.regexp_replace(s, "=+$", "")
    padded = F.rpad(bare, F.ceil(F.length(bare) / 4).cast("int") * 4, "=")
    head = F.hex(F.try_to_binary(F.substring(padded, 1, 16), F.lit("base64")))
    binary = F.coalesce(F.exists(_array(C.BINARY_MAGICS_HEX), lambda m: head.startswith(m)), F.lit(False)) & (F.length(bare) >= 8)
    few = F.size(F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))) <= 2
    return ~few & ~s.rlike("^[0-9]+$") & ~s.rlike(C.GUID_RE) & ~binary


WORDS_IN_NAME_RE = "[A-Z][a-z]{2,}|[a-z]{3,}|[A-Z]{3,}"


def is_symbol_name(s: Column) -> Column:
    """Made of words, as identifiers are: three letters of five or more lie in words of three letters or more. Linear in the length."""
    letters = F.length(F.regexp_replace(s, "[^A-Za-z]", ""))
    in_words = F.aggregate(F.regexp_extract_all(s, F.lit(WORDS_IN_NAME_RE), F.lit(0)), F.lit(0), lambda a, w: a + F.length(w))
    return (letters > 0) & (10 * in_words >= 6 * letters) & (2 * letters >= F.length(s))


def is_lookup_table(s: Column) -> Column:
    """A table of characters: most neighbours are successors, or every second character goes up by one at most."""
    n = F.length(s)
    code = lambda i: F.ascii(F.substring(s, i, F.lit(1)))
    steps = lambda gap, low, high: F.size(F.filter(F.sequence(F.lit(1), n - gap), lambda i: (code(i + gap) - code(i)).between(low, high)))
    return (n > 3) & ((2 * steps(1, 1, 2) >= n - 1) | (5 * steps(2, 0, 1) >= 4 * (n - 2)))


def is_high_entropy(s: Column) -> Column:
    fits = F.length(s).between(C.MIN_TOKEN, C.MAX_TOKEN)
    return fits & F.when(s.rlike("^[0-9a-fA-F]+$"), entropy(s) >= C.HEX_THRESHOLD).otherwise(entropy(s) >= C.B64_THRESHOLD)


def high_entropy_tokens(text: Column) -> Column:
    return F.filter(entropy_candidates(text), is_secret_token)


def is_secret_token(s: Column) -> Column:
    """Token-shaped and random, and neither an identifier nor a table of characters."""
    return is_token_shaped(s) & is_high_entropy(s) & ~is_symbol_name(s) & ~is_lookup_table(s)
