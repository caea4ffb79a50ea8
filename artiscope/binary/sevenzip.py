"""7z archives: headers, solid blocks, and the codings that the standard library can undo."""

from __future__ import annotations

import bz2
import io
import lzma
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

MAGIC = b"7z\xbc\xaf\x27\x1c"
# --- fixed values: properties of the header, and codings ---
END, HEADER, ARCHIVE, _, MAIN, FILES, PACK, UNPACK, SUBSTREAMS, SIZE, CRC, FOLDER, CODERS_SIZE, NUM_STREAMS, EMPTY_STREAM, EMPTY_FILE, _, NAMES = range(18)
ENCODED = 0x17
COPY, LZMA, LZMA2, DEFLATE, BZIP2, DELTA, AES = b"\0", bytes.fromhex("030101"), b"\x21", bytes.fromhex("040108"), bytes.fromhex("040202"), b"\x03", bytes.fromhex("06f10701")
#: Headers larger than this are refused.
MAX_HEADER = 64 << 20


class Unsupported(ValueError):
    """A coding or layout that can't be undone here."""


class _Bytes(io.BytesIO):
    def byte(self) -> int:
        b = self.read(1)
        if not b:
            raise ValueError("header ends early")
        return b[0]

    def number(self) -> int:
        """A number whose first byte says by its leading ones how many bytes follow."""
        first, value, mask = self.byte(), 0, 0x80
        for k in range(8):
            if not first & mask:
                return value | (first & (mask - 1)) << 8 * k
            value |= self.byte() << 8 * k
            mask >>= 1
        return value

    def count(self) -> int:
        """A number of things that each take a byte of header or more."""
        n = self.number()
        if n > MAX_HEADER:
            raise ValueError("header is too large")
        return n

    def bits(self, n: int) -> list[bool]:
        raw = self.read(-(-n // 8))
        if len(raw) < -(-n // 8):
            raise ValueError("header ends early")
        return [bool(raw[k // 8] & 0x80 >> k % 8) for k in range(n)]

    def optional_bits(self, n: int) -> list[bool]:
        return [True] * n if self.byte() else self.bits(n)

    def digests(self, n: int) -> list[int | None]:
        return [struct.unpack("<I", self.read(4))[0] if d else None for d in self.optional_bits(n)]


@dataclass
class Block:
    """Files that were packed as one stream: its codings, outermost first, and where its packed bytes are."""

    coders: list[tuple[bytes, bytes]] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    simple: bool = True
    at: int = 0
    packed: int = 0
    files: list[tuple[int, int | None]] = field(default_factory=list)  # size and checksum of each
    n_packed: int = 1

    @property
    def size(self) -> int:
        return self.sizes[-1] if self.coders and self.simple else max(self.sizes, default=0)


def _block(h: _Bytes) -> tuple[Block, int]:
    """A block's codings, and its number of outputs."""
    out, n_in, n_out = Block(), 0, 0
    for _ in range(h.count()):
        flag = h.byte()
        coding = h.read(flag & 15)
        one, two = (h.count(), h.count()) if flag & 16 else (1, 1)
        out.coders.append((coding, h.read(h.count()) if flag & 32 else b""))
        out.simple &= one == two == 1
        n_in, n_out = n_in + one, n_out + two
    pairs = [(h.number(), h.number()) for _ in range(n_out - 1)]
    out.n_packed = n_in - len(pairs)
    if out.n_packed > 1:
        for _ in range(out.n_packed):
            h.number()
    # coder k reads what coder k + 1 makes, as writers order them; any other order is left alone
    out.simple &= sorted(pairs) == [(k, k + 1) for k in range(n_out - 1)] and out.n_packed == 1
    if out.simple and len(out.coders) > 1:
        out.coders.reverse()
    return out, n_out


def _streams(h: _Bytes) -> list[Block]:
    blocks: list[Block] = []
    sizes: list[int] = []
    at = 0
    while (kind := h.byte()) != END:
        if kind == PACK:
            at, n = h.number() + 32, h.count()
            while (part := h.byte()) != END:
                if part == SIZE:
                    sizes = [h.number() for _ in range(n)]
                elif part == CRC:
                    h.digests(n)
        elif kind == UNPACK:
            blocks = _blocks(h)
        elif kind == SUBSTREAMS:
            _substreams(h, blocks)
        else:
            raise ValueError("unknown property of streams")
    for b in blocks:
        own, sizes = sizes[: b.n_packed], sizes[b.n_packed :]
        b.at, b.packed = at, sum(own)
        at += b.packed
        if not b.files:
            b.files = [(b.size, None)]
    return blocks


def _blocks(h: _Bytes) -> list[Block]:
    outs: list[tuple[Block, int]] = []
    while (kind := h.byte()) != END:
        if kind == FOLDER:
            n = h.count()
            if h.byte():
                raise Unsupported("external header")
            outs = [_block(h) for _ in range(n)]
        elif kind == CODERS_SIZE:
            for b, n_out in outs:
                b.sizes = [h.number() for _ in range(n_out)]
                if b.simple:
                    b.sizes.reverse()  # sizes are written in the order of the header
        elif kind == CRC:
            for (b, _), crc in zip(outs, h.digests(len(outs))):
                b.files = [(b.size, crc)]
    return [b for b, _ in outs]


def _substreams(h: _Bytes, blocks: list[Block]) -> None:
    counts = [1] * len(blocks)
    whole = [b.files[0][1] if b.files else None for b in blocks]
    kind = h.byte()
    if kind == NUM_STREAMS:
        counts = [h.count() for _ in blocks]
        kind = h.byte()
    sizes = []
    for b, n in zip(blocks, counts):
        own = [h.number() for _ in range(n - 1)] if kind == SIZE else [0] * (n - 1)
        sizes.append(own + [b.size - sum(own)] if n else [])
    if kind == SIZE:
        kind = h.byte()
    known = [n == 1 and crc is not None for n, crc in zip(counts, whole)]
    crcs: Iterator = iter(())
    if kind == CRC:
        crcs = iter(h.digests(sum(n for n, k in zip(counts, known) if not k)))
        kind = h.byte()
    if kind != END:
        raise ValueError("unknown property of files in blocks")
    for b, own, k, crc in zip(blocks, sizes, known, whole):
        b.files = [(s, crc if k else next(crcs, None)) for s in own]


#: Settings of coders that this reader can undo.
def _undo(coding: bytes, settings: bytes, data: bytes, size: int) -> bytes:
    if coding == COPY:
        return data[:size]
    if coding == BZIP2:
        return bz2.BZ2Decompressor().decompress(data, size)
    if coding == DEFLATE:
        return zlib.decompressobj(-15).decompress(data, size)
    if coding == LZMA and len(settings) == 5:
        first, width = struct.unpack("<BI", settings)
        if first >= 225:
            raise ValueError("bad settings")
        how = {"id": lzma.FILTER_LZMA1, "dict_size": max(width, 4096), "lc": first % 9, "lp": first // 9 % 5, "pb": first // 45}
    elif coding == LZMA2 and len(settings) == 1 and settings[0] <= 40:
        width = 0xFFFFFFFF if settings[0] == 40 else (2 | settings[0] & 1) << settings[0] // 2 + 11
        how = {"id": lzma.FILTER_LZMA2, "dict_size": max(4096, width)}
    else:
        raise Unsupported("encrypted" if coding == AES else f"coding {coding.hex()}")
    # a dictionary needs no more room than what it unpacks to
    how["dict_size"] = min(how["dict_size"], max(4096, size))
    return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[how]).decompress(data, size)


def unpack(f: BinaryIO, b: Block) -> bytes:
    """The bytes of a block's files, one after another."""
    if not b.simple:
        raise Unsupported("several streams in a block")
    f.seek(b.at)
    data = f.read(b.packed)
    for (coding, settings), size in zip(b.coders, b.sizes):
        data = _undo(coding, settings, data, size)
        if len(data) != size:
            raise ValueError("block ends early")
    return data


@dataclass
class Archive:
    blocks: list[Block]
    files: list[tuple[str, int | None, int]]  # name, block (None: empty), place in the block


def _files(h: _Bytes, blocks: list[Block]) -> list[tuple[str, int | None, int]]:
    n = h.count()
    names: list[str] = []
    empty, folders = [False] * n, []
    while (kind := h.byte()) != END:
        size = h.count()
        part = _Bytes(h.read(size))
        if kind == NAMES:
            if part.byte():
                raise Unsupported("external names")
            names = part.read().decode("utf-16-le", "replace").split("\0")[:n]
        elif kind == EMPTY_STREAM:
            empty = part.bits(n)
        elif kind == EMPTY_FILE:
            folders = [not e for e in part.bits(sum(empty))]
    spots = iter([(k, i) for k, b in enumerate(blocks) for i in range(len(b.files))])
    is_folder = iter(folders or [True] * sum(empty))
    out = []
    for name, none in zip(names, empty):
        if none:
            if not next(is_folder, True):
                out.append((name, None, 0))
        else:
            out.append((name, *next(spots)))
    return out


def parse(f: BinaryIO) -> Archive:
    """Blocks and files of an archive; ValueError if it is broken or holds what isn't supported."""
    f.seek(0)
    head = f.read(32)
    if len(head) < 32 or head[:6] != MAGIC:
        raise ValueError("no 7z header")
    at, size, crc = struct.unpack("<QQI", head[12:])
    if not size:
        return Archive([], [])
    if size > MAX_HEADER:
        raise ValueError("header is too large")
    f.seek(32 + at)
    raw = f.read(size)
    if zlib.crc32(raw) != crc:
        raise ValueError("header's checksum differs")
    h = _Bytes(raw)
    kind = h.byte()
    for _ in range(4):  # a header may itself be packed
        if kind != ENCODED:
            break
        (block,) = _streams(h)
        if block.size > MAX_HEADER:
            raise ValueError("header is too large")
        h = _Bytes(unpack(f, block))
        kind = h.byte()
    if kind != HEADER:
        raise ValueError("no header of files")
    blocks: list[Block] = []
    while (kind := h.byte()) != END:
        if kind == MAIN:
            blocks = _streams(h)
        elif kind == FILES:
            return Archive(blocks, _files(h, blocks))
        elif kind == ARCHIVE:
            while h.byte() != END:
                h.read(h.count())
        else:
            raise Unsupported("additional streams")
    return Archive(blocks, [])


def contents(f: BinaryIO, b: Block) -> Iterator[bytes]:
    """The files of a block, checked against their checksums."""
    data, at = unpack(f, b), 0
    for size, crc in b.files:
        body = data[at : at + size]
        if crc is not None and zlib.crc32(body) != crc:
            raise ValueError("a file's checksum differs")
        yield body
        at += size
