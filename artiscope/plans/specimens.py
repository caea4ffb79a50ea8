"""Small files made from table rows, for queries about files: no driver table holds any."""

from __future__ import annotations

import hashlib
import io
import lzma
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from artiscope.sources.batches import file_rows, record_batches


def image(characteristics: int, libraries: tuple[str, ...] = (), is_64: bool = True) -> bytes:
    """A portable executable with one section that holds its import table."""
    width, size = (8, 240) if is_64 else (4, 224)
    base, raw = 0x1000, 0x400
    data, table = bytearray(), b""
    for name in libraries:
        hint = base + len(data)
        data += b"\0\0LoadLibraryA\0"
        thunk = base + len(data)
        data += hint.to_bytes(width, "little") + bytes(width)
        table += struct.pack("<IIIII", thunk, 0, 0, base + len(data), thunk)
        data += name.encode() + b"\0"
    at = base + len(data)
    data += table + bytes(20)
    optional = bytearray(size)
    struct.pack_into("<H", optional, 0, 0x20B if is_64 else 0x10B)
    struct.pack_into("<H", optional, 70, characteristics)
    struct.pack_into("<I", optional, 108 if is_64 else 92, 16)
    struct.pack_into("<II", optional, (112 if is_64 else 96) + 8, at, len(table) + 20)
    head = b"MZ" + bytes(58) + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664 if is_64 else 0x14C, 1, 0, 0, 0, size, 0x22)
    head += bytes(optional) + b".text\0\0\0" + struct.pack("<IIII", len(data), base, len(data), raw) + bytes(16)
    return head.ljust(raw, b"\0") + bytes(data)


def assembly(refs: tuple[tuple[str, str], ...], bodies: tuple[bytes, ...] = ()) -> bytes:
    """A managed image: member references (Namespace.Type, member) and methods with these bodies.

    Reference k has the token 0x0A000001 + k, method k the token 0x06000001 + k.
    """
    base, raw = 0x2000, 0x400
    heap, places = bytearray(b"\0"), {}

    def text(s: str) -> int:
        if s not in places:
            places[s] = len(heap)
            heap.extend(s.encode() + b"\0")
        return places[s]

    types = list(dict.fromkeys(t for t, _ in refs))
    half = lambda t: t.rpartition(".")[::2]
    blob = bytearray(72)  # the runtime's header comes first
    spots = []
    for code in bodies:
        spots.append(base + len(blob))
        blob += bytes([len(code) << 2 | 2]) + code
    blob += bytes(-len(blob) % 4)
    rows = {
        0: [struct.pack("<HHHHH", 0, text("m"), 0, 0, 0)],
        1: [struct.pack("<HHH", 0, text(half(t)[1]), text(half(t)[0])) for t in types],
        2: [struct.pack("<IHHHHH", 0, text("C"), 0, 0, 1, 1)],
        6: [struct.pack("<IHHHHH", at, 0, 0, text(f"m{k}"), 0, 1) for k, at in enumerate(spots)],
        10: [struct.pack("<HHH", (types.index(t) + 1) << 3 | 1, text(name), 0) for t, name in refs],
    }
    rows = {k: v for k, v in rows.items() if v}
    tables = struct.pack("<IBBBBQQ", 0, 2, 0, 0, 1, sum(1 << k for k in rows), 0) + b"".join(struct.pack("<I", len(v)) for v in rows.values()) + b"".join(b"".join(v) for v in rows.values())
    tables += bytes(-len(tables) % 4)
    streams = [(b"#~\0\0", tables), (b"#Strings\0\0\0\0", bytes(heap) + bytes(-len(heap) % 4))]
    head = b"BSJB" + struct.pack("<HHII", 1, 1, 0, 4) + b"v4\0\0" + struct.pack("<HH", 0, len(streams))
    offset = len(head) + sum(8 + len(n) for n, _ in streams)
    for name, body in streams:
        head += struct.pack("<II", offset, len(body)) + name
        offset += len(body)
    meta = head + b"".join(b for _, b in streams)
    struct.pack_into("<IHHII", blob, 0, 72, 2, 5, base + len(blob), len(meta))
    blob += meta
    optional = bytearray(240)
    struct.pack_into("<H", optional, 0, 0x20B)
    struct.pack_into("<I", optional, 108, 16)
    struct.pack_into("<II", optional, 112 + 8 * 14, base, 72)
    out = b"MZ" + bytes(58) + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664, 1, 0, 0, 0, 240, 0x22)
    out += bytes(optional) + b".text\0\0\0" + struct.pack("<IIII", len(blob), base, len(blob), raw) + bytes(16)
    return out.ljust(raw, b"\0") + bytes(blob)


def java_class(refs: tuple[tuple[str, str], ...] = (), texts: tuple[str, ...] = (), methods: tuple = ()) -> bytes:
    """A class file: method references (owner, name), string constants, and methods (name, descriptor, code or None)."""
    pool: list[bytes] = []
    known: dict[bytes, int] = {}

    def entry(raw: bytes) -> int:
        if raw not in known:
            pool.append(raw)
            known[raw] = len(pool)
        return known[raw]

    utf = lambda s: entry(b"\x01" + struct.pack(">H", len(s.encode())) + s.encode())
    kind = lambda s: entry(struct.pack(">BH", 7, utf(s)))
    this, top, code_name = kind("Sample"), kind("java/lang/Object"), utf("Code")
    for owner, name in refs:
        entry(struct.pack(">BHH", 10, kind(owner), entry(struct.pack(">BHH", 12, utf(name), utf("()V")))))
    for t in texts:
        entry(struct.pack(">BH", 8, utf(t)))
    body = b""
    for name, descriptor, code in methods:
        body += struct.pack(">HHHH", 1, utf(name), utf(descriptor), code is not None)
        if code is not None:
            attribute = struct.pack(">HHI", 1, 1, len(code)) + code + struct.pack(">HH", 0, 0)
            body += struct.pack(">HI", code_name, len(attribute)) + attribute
    head = b"\xca\xfe\xba\xbe" + struct.pack(">HHH", 0, 61, len(pool) + 1) + b"".join(pool)
    return head + struct.pack(">HHHHH", 1, this, top, 0, 0) + struct.pack(">H", len(methods)) + body + struct.pack(">H", 0)


def archive(name: str, body: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, body)
    return out.getvalue()


def tar_archive(members: list[tuple[str, bytes]], packed: bool) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz" if packed else "w") as t:
        for name, body in members:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    return out.getvalue()


def _number(n: int) -> bytes:
    """A number as 7z headers write it: leading ones of the first byte say how many bytes follow."""
    for k in range(8):
        if n < 1 << 7 * (k + 1):
            return bytes([0xFF00 >> k & 0xFF | n >> 8 * k]) + (n & (1 << 8 * k) - 1).to_bytes(k, "little")
    return b"\xff" + n.to_bytes(8, "little")


def _packed(coding: str, data: bytes) -> tuple[bytes, bytes]:
    """A coder as 7z headers write it, and what it packs."""
    if coding == "copy":
        return b"\x01\x00", data
    if coding == "lzma2":
        packer = lzma.LZMACompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 20}])
        return b"\x21\x21\x01\x10", packer.compress(data) + packer.flush()
    packer = lzma.LZMACompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 20, "lc": 3, "lp": 0, "pb": 2}])
    return b"\x23\x03\x01\x01\x05" + struct.pack("<BI", 93, 1 << 20), packer.compress(data) + packer.flush()


def seven_zip(blocks: list[list[tuple[str, bytes]]], coding: str = "lzma2", packed_header: bool = False) -> bytes:
    """A 7z archive of solid blocks."""

    def streams(parts: list[list[bytes]], at: int, crcs: bool) -> tuple[bytes, bytes]:
        coders = [_packed(coding, b"".join(p)) for p in parts]
        out = b"\x06" + _number(at) + _number(len(parts)) + b"\x09" + b"".join(_number(len(d)) for _, d in coders) + b"\0"
        out += b"\x07\x0b" + _number(len(parts)) + b"\0" + b"".join(b"\x01" + c for c, _ in coders) + b"\x0c" + b"".join(_number(sum(map(len, p))) for p in parts) + b"\0"
        if crcs:
            out += b"\x08\x0d" + b"".join(_number(len(p)) for p in parts) + b"\x09" + b"".join(_number(len(x)) for p in parts for x in p[:-1])
            out += b"\x0a\x01" + b"".join(struct.pack("<I", zlib.crc32(x)) for p in parts for x in p) + b"\0"
        return out + b"\0", b"".join(d for _, d in coders)

    names = [n for b in blocks for n, _ in b]
    text = b"\0" + b"".join(n.encode("utf-16-le") + b"\0\0" for n in names)
    main, body = streams([[x for _, x in b] for b in blocks], 0, True)
    header = b"\x01\x04" + main + b"\x05" + _number(len(names)) + b"\x11" + _number(len(text)) + text + b"\0\0"
    if packed_header:
        own, packed = streams([[header]], len(body), False)
        header, body = b"\x17" + own, body + packed
    start = struct.pack("<QQI", len(body), len(header), zlib.crc32(header))
    return b"7z\xbc\xaf\x27\x1c\0\x04" + struct.pack("<I", zlib.crc32(start)) + start + body + header


def nested_archive(kind: str, docs: list[dict]) -> bytes:
    """An archive of documents; every fifth is in an archive of its own."""
    members = []
    for d in docs:
        body = d["text"].encode()
        members.append((d["name"] + ".zip", archive(d["name"], body)) if d["doc_id"] % 5 == 0 else (d["name"], body))
    if kind in ("tar", "tgz"):
        return tar_archive(members, kind == "tgz")
    if kind == "7z":
        return seven_zip([members[k : k + 20] for k in range(0, len(members), 20)])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members:
            z.writestr(name, body)
    return out.getvalue()


def elf_object(lines: list[str]) -> bytes:
    """A shared object of 64 bits without any header but the first, and strings after it."""
    head = b"\x7fELF\x02\x01\x01" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 3, 62, 1, 0, 0, 0, 0, 64, 56, 0, 64, 0, 0)
    return head + b"\0".join(line.encode() for line in lines) + b"\0"


def tlv(tag: int, *parts: bytes) -> bytes:
    """A DER value."""
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def oid(text: str) -> bytes:
    """A DER object identifier."""
    first, second, *rest = map(int, text.split("."))
    out = b""
    for n in (40 * first + second, *rest):
        part = bytes([n & 127])
        while n := n >> 7:
            part = bytes([n & 127 | 128]) + part
        out += part
    return tlv(6, out)


def indirect_signature(digest: bytes, algorithm: str = "2.16.840.1.101.3.4.2.1", sealed: bool = True, certificates: bytes = b"") -> bytes:
    """PKCS#7 signed data of an image's digest, with one signer; its value isn't computed."""
    kind = tlv(0x30, oid(algorithm), tlv(5))
    record = tlv(0x30, oid("1.3.6.1.4.1.311.2.1.15"), tlv(0x30, tlv(3, b"\0"))) + tlv(0x30, kind, tlv(4, digest))
    name = {"1.3.14.3.2.26": "sha1"}.get(algorithm, "sha256")
    seal = hashlib.new(name, record if sealed else record + b"x").digest()
    signer = tlv(0x30, tlv(2, b"\1"), tlv(0x30, tlv(0x30), tlv(2, b"\7")), kind, tlv(0xA0, tlv(0x30, oid("1.2.840.113549.1.9.4"), tlv(0x31, tlv(4, seal)))), tlv(0x30, oid("1.2.840.113549.1.1.1"), tlv(5)), tlv(4, b"\0"))
    content = tlv(0x30, oid("1.3.6.1.4.1.311.2.1.4"), tlv(0xA0, tlv(0x30, record)))
    held = [tlv(0xA0, certificates)] if certificates else []
    return tlv(0x30, oid("1.2.840.113549.1.7.2"), tlv(0xA0, tlv(0x30, tlv(2, b"\1"), tlv(0x31, kind), content, *held, tlv(0x31, signer))))


#: The image that signed specimens extend, and where its checksum and the directory entry of its signature are.
PLAIN_IMAGE = image(0x4160, ("kernel32.dll",))
CHECKSUM, ENTRY = 64 + 24 + 64, 64 + 24 + 112 + 32


def signed_image(payload: bytes, signed: bytes | None = None, algorithm: str = "2.16.840.1.101.3.4.2.1", **how) -> bytes:
    """An image that carries ``payload``, with the signature of one that carries ``signed``."""
    full = lambda body: PLAIN_IMAGE + body + bytes(-(len(PLAIN_IMAGE) + len(body)) % 8)
    seen = full(payload if signed is None else signed)
    name = {"1.3.14.3.2.26": "sha1"}.get(algorithm, "sha256")
    raw = indirect_signature(hashlib.new(name, seen[:CHECKSUM] + seen[CHECKSUM + 4 : ENTRY] + seen[ENTRY + 8 :]).digest(), algorithm, **how)
    table = struct.pack("<IHH", 8 + len(raw), 0x200, 2) + raw
    table += bytes(-len(table) % 8)
    out = bytearray(full(payload))
    struct.pack_into("<II", out, ENTRY, len(out), len(table))
    return bytes(out) + table


def made(rows: DataFrame, build: Callable[..., bytes]) -> DataFrame:
    """path and content; rows: path, then what ``build`` takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = ((path, build(*args)) for path, *args in file_rows(batches))
        yield from record_batches(files, (pa.string(), pa.binary()), ["path", "content"], lambda r: len(r[1]))

    return rows.mapInArrow(run, "path string, content binary")
