"""Paths in findings: relative, normalized, without temporary folders."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def relative(path: Column, root: str) -> Column:
    """Below ``root`` the rest of the path, else its last part; an archive chain keeps its ' > '."""
    base = root.replace("\\", "/").rstrip("/") + "/"
    first = _slashes(F.substring_index(path, " > ", 1))
    rest = F.substring(path, F.length(F.substring_index(path, " > ", 1)) + 1, F.length(path))
    below = F.substring(first, F.lit(len(base) + 1), F.length(first))
    short = F.when(F.lower(first).startswith(base.lower()), below).otherwise(F.substring_index(first, "/", -1))
    return F.concat(short, rest)


def scrub(text: Column, root: str) -> Column:
    """Diagnostics without the scan root and temporary folders."""
    out = F.regexp_replace(text, re.escape(root.rstrip("/\\")), "<target>")
    return F.regexp_replace(out, r"(/tmp|/var/tmp|[A-Za-z]:\\[^\s\"']*\\Temp)[/\\][^\s/\\\"']+", "<temp>")


def application_name(path: Column) -> Column:
    """Last part of a path without a program's extension, with characters that a file system refuses replaced."""
    last = F.substring_index(F.regexp_replace(_slashes(path), "/+$", ""), "/", -1)
    bare = F.regexp_replace(last, r"(?i)\.(exe|dll|sys|ocx|msi)$", "")
    return F.regexp_replace(bare, r'[<>:"/\\|?*]', "_")


def default_poc(rule: Column, path: Column, evidence: Column, poc: Column, commands: dict[str, str]) -> Column:
    """A finding's own steps, or the commands of its rule with the path and evidence filled in."""
    made = F.lit("Location: {path}; evidence: {evidence}")
    for name, text in commands.items():
        made = F.when(rule == name, F.lit(text)).otherwise(made)
    filled = F.replace(F.replace(made, F.lit("{path}"), path), F.lit("{evidence}"), F.coalesce(evidence, F.lit("")))
    return F.coalesce(F.when(F.trim(poc) != "", poc), filled)


# --- fixed values: how an archive is unpacked by hand ---
UNPACK = ((r"(?i)\.asar$", "npx --yes @electron/asar extract '{0}' '{1}'"), (r"(?i)\.(tar|tgz|tar\.[a-z0-9]+)$", "tar -xf '{0}' -C '{1}'"), (r".", "7z x '{0}' -o'{1}'"))


def unpack_steps(chain: Column) -> Column:
    """Commands that bring a file out of archives again; chain: archive > member > member."""
    parts = F.split(chain, " > ")

    def step(k: Column) -> Column:
        source = F.when(k == 1, F.substring_index(_slashes(F.element_at(parts, 1)), "/", -1)).otherwise(F.concat(F.lit("unpacked"), (k - 1).cast("string"), F.lit("/"), F.element_at(parts, k)))
        out = F.lit(None).cast("string")
        for pattern, command in reversed(UNPACK):
            out = F.when(source.rlike(pattern), F.lit(command)).otherwise(out)
        return F.replace(F.replace(out, F.lit("{0}"), source), F.lit("{1}"), F.concat(F.lit("unpacked"), k.cast("string")))

    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), step)).otherwise(F.array().cast("array<string>"))


def localize_poc(poc: Column, chain: Column, path: Column) -> Column:
    """A finding's steps with the scanned path replaced by what the unpack steps make, and those steps first."""
    parts = F.split(chain, " > ")
    local = F.concat(F.lit("unpacked"), (F.size(parts) - 1).cast("string"), F.lit("/"), F.element_at(parts, -1))
    before = F.array_join(unpack_steps(chain), "\n")
    return F.when(F.size(parts) > 1, F.concat(before, F.lit("\n"), F.replace(poc, path, local))).otherwise(poc)


def duration(seconds: Column) -> Column:
    """h m s, without leading zero parts."""
    s = F.floor(seconds)
    return F.when(s >= 3600, F.format_string("%dh %dm %ds", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).when(s >= 60, F.format_string("%dm %ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))
