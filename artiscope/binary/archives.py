"""Archives that can be read here: ZIP, TAR, gzip, 7z and ASAR; listed first, then read member by member or block by block."""

from __future__ import annotations

import gzip
import io
import json
import lzma
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

from artiscope.binary import sevenzip

ZIP_LIKE = (".zip", ".jar", ".war", ".ear", ".apk", ".nupkg", ".vsix", ".xpi", ".msix", ".appx", ".whl")
TAR_LIKE = (".tar", ".tgz", ".tar.gz", ".tbz2", ".tar.bz2", ".txz", ".tar.xz")
#: Formats that need a tool we don't have; they are noted, not skipped in silence.
UNREADABLE = (".rar", ".cab", ".msi", ".dmg", ".iso")
OTHERS = (".7z", ".asar", ".gz", ".exe", ".dll")
INNO_MARK = b"Inno Setup Setup Data ("
NSIS_MARK = b"\xef\xbe\xad\xdeNullsoftInst"
#: Bytes of a program in which the mark of its installer is looked for.
MARK_BYTES = 16 << 20
#: What a broken archive may raise.
BROKEN = (zipfile.BadZipFile, tarfile.TarError, zlib.error, lzma.LZMAError, OSError, EOFError, ValueError, KeyError, TypeError, AttributeError, IndexError, StopIteration, struct.error, RuntimeError, NotImplementedError)


def safe_member(name: str) -> str | None:
    """A relative path without a way out; None for one that has."""
    parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".")]
    if not parts or ".." in parts or name.startswith(("/", "\\")) or ":" in parts[0]:
        return None
    return "/".join(parts)


def kind(name: str, f: BinaryIO) -> str | None:
    """What sort of archive a file is, by its name and its first bytes."""
    f.seek(0)
    head, low = f.read(512), name.lower()
    if low.endswith(".asar"):
        return "asar"
    if head[:4] in (b"PK\x03\x04", b"PK\x05\x06") or low.endswith(ZIP_LIKE):
        return "zip"
    if low.endswith(TAR_LIKE) or head[257:262] == b"ustar":
        return "tar"
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if head[:6] == sevenzip.MAGIC or low.endswith(".7z"):
        return "7z"
    if low.endswith(UNREADABLE) or head[:4] in (b"Rar!", b"MSCF"):
        return "unreadable"
    if head[:2] == b"MZ":
        f.seek(0)
        start = f.read(MARK_BYTES)
        return "inno" if INNO_MARK in start else "nsis" if NSIS_MARK in start else None
    return None


@dataclass
class Entry:
    """A member: its safe path, its size as listed, the block that it is unpacked with, its place among the format's own entries."""

    path: str
    size: int
    block: int
    key: object = None


@dataclass
class Listing:
    kind: str
    entries: list[Entry] = field(default_factory=list)
    total: int = 0  # bytes that all members, unsafe ones too, unpack to
    note: str | None = None


def _zip(f: BinaryIO, limit: int) -> Iterator[Entry]:
    with zipfile.ZipFile(f) as z:
        for k, i in enumerate(z.infolist()):
            if not i.is_dir():
                yield Entry(i.filename, i.file_size, k, k)


def _read_zip(f: BinaryIO, wanted: list[Entry]) -> Iterator[bytes]:
    with zipfile.ZipFile(f) as z:
        infos = z.infolist()
        for e in wanted:
            yield z.read(infos[e.key])


def _tar(f: BinaryIO, limit: int) -> Iterator[Entry]:
    with tarfile.open(fileobj=f) as t:
        plain, total = t.fileobj is f, 0
        for k, i in enumerate(t):
            if i.isreg():
                yield Entry(i.name, i.size, k if plain else 0, k)
                total += i.size
                if total > limit:  # a packed archive is unpacked no further than that
                    return


def _read_tar(f: BinaryIO, wanted: list[Entry]) -> Iterator[bytes]:
    left = {e.key: n for n, e in enumerate(wanted)}
    out: dict[int, bytes] = {}
    with tarfile.open(fileobj=f) as t:
        for k, i in enumerate(t):
            if k in left:
                out[left.pop(k)] = t.extractfile(i).read()
            if not left:
                break
    return iter([out[n] for n in range(len(wanted))])


def _gzip(f: BinaryIO, limit: int) -> Iterator[Entry]:
    z, size = gzip.GzipFile(fileobj=f), 0
    while size <= limit and (part := z.read(1 << 20)):
        size += len(part)
    yield Entry("", size, 0)


def _read_gzip(f: BinaryIO, wanted: list[Entry]) -> Iterator[bytes]:
    body = gzip.GzipFile(fileobj=f).read(wanted[0].size + 1)
    if len(body) > wanted[0].size:
        raise ValueError("longer than listed")
    yield body


def _7z(f: BinaryIO, limit: int) -> Iterator[Entry]:
    archive = sevenzip.parse(f)
    for name, block, at in archive.files:
        size = archive.blocks[block].files[at][0] if block is not None else 0
        yield Entry(name, size, len(archive.blocks) if block is None else block, (block, at))


def _read_7z(f: BinaryIO, wanted: list[Entry]) -> Iterator[bytes]:
    archive, now, bodies = sevenzip.parse(f), -1, []
    for e in wanted:
        block, at = e.key
        if block is None:
            yield b""
            continue
        if block != now:
            now, bodies = block, list(sevenzip.contents(f, archive.blocks[block]))
        yield bodies[at]


def _asar(f: BinaryIO, limit: int) -> Iterator[Entry]:
    """Files of an ASAR archive; names that would leave it are left out."""
    f.seek(0)
    _, header, _, size = struct.unpack("<IIII", f.read(16))
    todo, k = [("", json.loads(f.read(size)))], 0
    while todo:
        prefix, node = todo.pop()
        for name, entry in (node.get("files") or {}).items():
            if name in ("..", ".") or "/" in name or "\\" in name:
                continue
            if "files" in entry:
                todo.append((f"{prefix}{name}/", entry))
            elif "offset" in entry and not entry.get("unpacked"):
                yield Entry(f"{prefix}{name}", int(entry["size"]), k, 8 + header + int(entry["offset"]))
                k += 1


def _read_asar(f: BinaryIO, wanted: list[Entry]) -> Iterator[bytes]:
    for e in wanted:
        f.seek(e.key)
        yield f.read(e.size)


_FORMATS = {"zip": (_zip, _read_zip), "tar": (_tar, _read_tar), "gzip": (_gzip, _read_gzip), "7z": (_7z, _read_7z), "asar": (_asar, _read_asar)}


def listing(name: str, f: BinaryIO, limit: int = 1 << 62) -> Listing | None:
    """What an archive holds, without unpacking more of it than ``limit`` bytes; None for what is no archive."""
    what = kind(name, f)
    if what is None:
        return None
    out = Listing(what)
    if what not in _FORMATS:
        out.note = f"{name}: {what} archive isn't unpacked"
        return out
    try:
        f.seek(0)
        for e in _FORMATS[what][0](f, limit):
            out.total += e.size
            path = safe_member(e.path) if what != "gzip" else name.rsplit("/", 1)[-1].removesuffix(".gz") or "data"
            if path is not None:
                e.path = path
                out.entries.append(e)
    except BROKEN as e:
        out.entries, out.note = [], f"{name}: {type(e).__name__}" + (f" ({e})" if isinstance(e, sevenzip.Unsupported) else "")
    return out


def read(what: str, f: BinaryIO, wanted: list[Entry]) -> Iterator[bytes]:
    """Bodies of some of an archive's entries, in their order; a block is unpacked once."""
    f.seek(0)
    return _FORMATS[what][1](f, wanted)


def members(name: str, data: bytes, budget: int) -> tuple[list[tuple[str, bytes]], list[str]]:
    """All members of one small archive, and notes. What would exceed ``budget`` bytes isn't unpacked at all."""
    f = io.BytesIO(data)
    found = listing(name, f, budget)
    if found is None or found.note:
        return [], [found.note] if found else []
    if found.total > budget:
        return [], [f"{name}: larger than the limit when unpacked"]
    try:
        return [(e.path, body) for e, body in zip(found.entries, read(found.kind, f, found.entries), strict=True)], []
    except BROKEN as e:
        return [], [f"{name}: {type(e).__name__}"]
