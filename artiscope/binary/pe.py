"""Portable executables."""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections import Counter
from dataclasses import asdict, dataclass, field

DYNAMIC_BASE, HIGH_ENTROPY_VA, NX_COMPAT, GUARD_CF, NO_SEH = 0x40, 0x20, 0x100, 0x4000, 0x400
_MAX_HEADER = 16 << 20


def is_pe(data: bytes) -> bool:
    if data[:2] != b"MZ" or len(data) < 64:
        return False
    at = struct.unpack_from("<I", data, 60)[0]
    return 0 < at <= _MAX_HEADER and data[at : at + 4] == b"PE\0\0"


@dataclass
class Section:
    name: str
    address: int
    size: int
    offset: int
    raw_size: int
    entropy: float | None = None


@dataclass
class Image:
    is_64: bool = False
    is_dll: bool = False
    machine: int = 0
    dll_characteristics: int = 0
    imports: dict = field(default_factory=dict)  # library, lower case, to its functions, lower case
    sections: list = field(default_factory=list)
    is_dotnet: bool = False
    clr: tuple = (0, 0)
    has_signature: bool = False
    signature: tuple = (0, 0)  # file offset and size
    pdb: str | None = None
    manifest: str | None = None
    versions: list = field(default_factory=list)
    safeseh: bool | None = None

    def row(self) -> dict:
        return asdict(self)


def byte_entropy(data: bytes) -> float:
    n = len(data)
    return -sum(c / n * math.log2(c / n) for c in Counter(data).values()) if n else 0.0


class _Reader:
    def __init__(self, data: bytes, sections: list[Section]):
        self.data, self.sections = data, sections

    def at(self, address: int) -> int | None:
        for s in self.sections:
            if s.address <= address < s.address + max(s.size, s.raw_size):
                offset = address - s.address + s.offset
                return offset if offset < len(self.data) else None
        return None

    def text(self, address: int, limit: int = 512) -> str:
        at = self.at(address)
        if at is None:
            return ""
        end = self.data.find(b"\0", at, at + limit)
        return self.data[at : end if end >= 0 else at + limit].decode("latin-1")


def _thunks(r: _Reader, table: int, is_64: bool) -> list[str]:
    out: list[str] = []
    at = r.at(table)
    size, top = (8, 1 << 63) if is_64 else (4, 1 << 31)
    while at is not None and at + size <= len(r.data) and len(out) < 65536:
        value = int.from_bytes(r.data[at : at + size], "little")
        if not value:
            break
        if not value & top:
            name = r.text((value & 0x7FFFFFFF) + 2)
            if name:
                out.append(name.lower())
        at += size
    return out


def _imports(r: _Reader, address: int, step: int, name_at: int, table_at: tuple[int, ...], is_64: bool, out: dict) -> None:
    at = r.at(address) if address else None
    while at is not None and at + step <= len(r.data) and len(out) < 4096:
        fields = struct.unpack_from(f"<{step // 4}I", r.data, at)
        if not fields[name_at]:
            break
        name = r.text(fields[name_at]).lower()
        table = next((fields[k] for k in table_at if fields[k]), 0)
        if name:
            out.setdefault(name, []).extend(_thunks(r, table, is_64) if table else [])
        at += step


def _resources(r: _Reader, root: int, kind: int) -> list[bytes]:
    """Data of all resources of a type."""
    base = r.at(root) if root else None
    if base is None:
        return []

    def entries(at: int) -> list[tuple[int, int]]:
        if at + 16 > len(r.data):
            return []
        named, ids = struct.unpack_from("<HH", r.data, at + 12)
        n = min(named + ids, 4096)
        return [struct.unpack_from("<II", r.data, at + 16 + 8 * k) for k in range(n) if at + 24 + 8 * k <= len(r.data)]

    found, todo = [], [(base + (o & 0x7FFFFFFF), 1) for i, o in entries(base) if i == kind and o & 0x80000000]
    while todo and len(found) < 64:
        at, depth = todo.pop()
        for _, o in entries(at):
            if o & 0x80000000:
                if depth < 3:
                    todo.append((base + (o & 0x7FFFFFFF), depth + 1))
            elif base + o + 8 <= len(r.data):
                address, size = struct.unpack_from("<II", r.data, base + o)
                start = r.at(address)
                if start is not None:
                    found.append(r.data[start : start + min(size, 1 << 20)])
    return found


_VERSION = re.compile(r"\d+(?:[.,]\s?\d+){1,3}")


def _versions(block: bytes) -> list[str]:
    """Versions of a VERSIONINFO block: the fixed part's, and every string of the text part that is one."""
    out = []
    at = block.find(b"\xbd\x04\xef\xfe")
    if at >= 0 and at + 24 <= len(block):
        for k in (8, 16):
            high, low = struct.unpack_from("<II", block, at + k)
            out.append(f"{high >> 16}.{high & 0xFFFF}.{low >> 16}.{low & 0xFFFF}")
    for part in block.decode("utf-16-le", "ignore").split("\0"):
        m = _VERSION.fullmatch(part.strip())
        if m:
            out.append(re.sub(r",\s?", ".", m[0]))
    return list(dict.fromkeys(out))


def parse(data: bytes, section_entropy: bool = True) -> Image | None:
    try:
        return _parse(data, section_entropy)
    except (struct.error, IndexError, ValueError):
        return None


def _parse(data: bytes, section_entropy: bool) -> Image | None:
    if not is_pe(data):
        return None
    head = struct.unpack_from("<I", data, 60)[0] + 4
    machine, n_sections, _, _, _, optional_size, characteristics = struct.unpack_from("<HHIIIHH", data, head)
    opt = head + 20
    is_64 = struct.unpack_from("<H", data, opt)[0] == 0x20B
    image = Image(is_64, bool(characteristics & 0x2000), machine, struct.unpack_from("<H", data, opt + 70)[0])
    count_at = opt + (108 if is_64 else 92)
    n_dirs = min(16, struct.unpack_from("<I", data, count_at)[0])
    dirs = [struct.unpack_from("<II", data, count_at + 4 + 8 * k) for k in range(n_dirs)] + [(0, 0)] * (16 - n_dirs)
    for k in range(min(n_sections, 96)):
        at = opt + optional_size + 40 * k
        name = data[at : at + 8].rstrip(b"\0").decode("latin-1")
        size, address, raw, offset = struct.unpack_from("<IIII", data, at + 8)
        s = Section(name, address, size, offset, raw)
        if section_entropy:
            s.entropy = round(byte_entropy(data[offset : offset + raw]), 3)
        image.sections.append(s)
    r = _Reader(data, image.sections)
    _imports(r, dirs[1][0], 20, 3, (0, 4), is_64, image.imports)
    _imports(r, dirs[13][0], 32, 1, (4,), is_64, image.imports)
    image.clr = dirs[14]
    image.is_dotnet = bool(dirs[14][0]) or "mscoree.dll" in image.imports
    image.signature = dirs[4]  # an offset in the file, not an address
    image.has_signature = bool(dirs[4][0] and dirs[4][1] and dirs[4][0] + 8 <= len(data))
    at = r.at(dirs[6][0]) if dirs[6][0] else None
    for k in range(min(dirs[6][1] // 28, 64) if at is not None else 0):
        kind, size, _, raw = struct.unpack_from("<IIII", data, at + 28 * k + 12)
        if kind == 2 and data[raw : raw + 4] == b"RSDS":
            image.pdb = data[raw + 24 : raw + size].split(b"\0")[0].decode("utf-8", "ignore") or None
    manifests = _resources(r, dirs[2][0], 24)
    image.manifest = manifests[0].decode("utf-8", "ignore") if manifests else None
    image.versions = [v for block in _resources(r, dirs[2][0], 16) for v in _versions(block)]
    if not is_64:
        if image.dll_characteristics & NO_SEH or image.is_dotnet:
            image.safeseh = None
        else:
            cfg = r.at(dirs[10][0]) if dirs[10][0] else None
            image.safeseh = bool(cfg is not None and cfg + 72 <= len(data) and struct.unpack_from("<I", data, cfg)[0] >= 72 and struct.unpack_from("<I", data, cfg + 64)[0])
    return image


def pkcs7(data: bytes, image: Image) -> bytes | None:
    """The signature's PKCS#7 bytes, out of its certificate table entry."""
    at, size = image.signature
    if not image.has_signature:
        return None
    length, _, kind = struct.unpack_from("<IHH", data, at)
    return data[at + 8 : at + min(length, size)] if kind == 2 and length > 8 else None


def authenticode(data: bytes, image: Image, algorithm: str) -> str:
    """Digest of what a signature covers: the file without its checksum, the certificate table and the directory entry that names the table."""
    optional = struct.unpack_from("<I", data, 60)[0] + 24
    checksum, entry = optional + 64, optional + (112 if image.is_64 else 96) + 8 * 4
    at, size = image.signature if image.has_signature else (len(data), 0)
    out, view = hashlib.new(algorithm), memoryview(data)
    for start, end in ((0, checksum), (checksum + 4, entry), (entry + 8, at), (at + size, len(data))):
        out.update(view[start : max(start, end)])
    return out.hexdigest()
