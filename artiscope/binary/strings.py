"""Printable strings of binaries, ASCII and UTF-16."""

from __future__ import annotations

import re
from collections.abc import Iterator

MIN_CHARS = 6
_ASCII = re.compile(rb"[\x20-\x7e]{%d,}" % MIN_CHARS)
_WIDE = re.compile(rb"(?:[\x20-\x7e]\x00){%d,}" % MIN_CHARS)
#: Bytes by kind, so that a plain search finds where a run begins: printable, zero, other.
_KINDS = bytes(0 if b == 0 else 1 if 0x20 <= b <= 0x7E else 2 for b in range(256))


def _runs(pattern: re.Pattern, data: bytes, kinds: bytes, least: bytes) -> Iterator[re.Match]:
    at = kinds.find(least)
    while at >= 0:
        m = pattern.match(data, at)
        yield m
        at = kinds.find(least, m.end())


def strings(data: bytes) -> list[tuple[str, int, str]]:
    """(encoding, offset, text): ASCII runs first, then UTF-16 little-endian runs."""
    kinds = data.translate(_KINDS)
    out = [("ascii", m.start(), m[0].decode("ascii")) for m in _runs(_ASCII, data, kinds, b"\1" * MIN_CHARS)]
    return out + [("utf-16", m.start(), m[0].decode("utf-16-le")) for m in _runs(_WIDE, data, kinds, b"\1\0" * MIN_CHARS)]
