"""Mach-O binaries, single and fat."""

from __future__ import annotations

import struct
from dataclasses import asdict, dataclass, field

from artiscope.binary import codesign

# --- fixed values ---
CPUS = {7: "x86", 0x01000007: "x86-64", 12: "ARM", 0x0100000C: "ARM64", 18: "PowerPC"}
_SINGLE = {b"\xfe\xed\xfa\xce": (">", False), b"\xce\xfa\xed\xfe": ("<", False), b"\xfe\xed\xfa\xcf": (">", True), b"\xcf\xfa\xed\xfe": ("<", True)}


@dataclass
class MachO:
    fat: bool
    cpus: list = field(default_factory=list)
    type: int = 0
    pie: bool = False
    dylibs: list = field(default_factory=list)
    rpaths: list = field(default_factory=list)
    signed: bool = False
    hardened: bool | None = None
    encrypted: bool = False
    signature: codesign.CodeSignature | None = None

    def row(self) -> dict:
        return asdict(self)


def is_macho(data: bytes) -> bool:
    if data[:4] in _SINGLE:
        return True
    # a Java class has the same magic as a fat binary, with its version where the number of parts is
    return data[:4] in (b"\xca\xfe\xba\xbe", b"\xbe\xba\xfe\xca") and len(data) >= 8 and 0 < struct.unpack(">I" if data[0] == 0xCA else "<I", data[4:8])[0] < 40


def parse(data: bytes) -> MachO | None:
    try:
        return _parse(data)
    except (struct.error, IndexError, ValueError):
        return None


def _parse(data: bytes) -> MachO | None:
    if not is_macho(data):
        return None
    if data[:4] in _SINGLE:
        out = MachO(False)
        _thin(data, 0, out)
        return out
    e = ">" if data[0] == 0xCA else "<"
    out = MachO(True)
    for k in range(struct.unpack_from(e + "I", data, 4)[0]):
        cpu, _, offset, _, _ = struct.unpack_from(e + "IIIII", data, 8 + 20 * k)
        if k == 0 and data[offset : offset + 4] in _SINGLE:
            _thin(data, offset, out)
        else:
            out.cpus.append(CPUS.get(cpu, str(cpu)))
    return out


def _thin(data: bytes, base: int, out: MachO) -> None:
    e, wide = _SINGLE[data[base : base + 4]]
    cpu, _, out.type, n, _, flags = struct.unpack_from(e + "IIIIII", data, base + 4)
    out.cpus.append(CPUS.get(cpu, str(cpu)))
    out.pie = bool(flags & 0x200000)
    at = base + (32 if wide else 28)
    for _ in range(min(n, 4096)):
        cmd, size = struct.unpack_from(e + "II", data, at)
        if size < 8:
            break
        kind = cmd & 0x7FFFFFFF
        if kind in (0xC, 0x18, 0x1F, 0x20) or kind == 0x1C:
            start = struct.unpack_from(e + "I", data, at + 8)[0]
            text = data[at + start : at + size].split(b"\0")[0].decode("utf-8", "ignore")
            (out.rpaths if kind == 0x1C else out.dylibs).append(text)
        elif kind == 0x1D:
            out.signed = True
            offset, length = struct.unpack_from(e + "II", data, at + 8)
            out.signature = codesign.parse(data[base:], data[base + offset : base + offset + length])
            out.hardened = out.signature.hardened if out.signature else None
        elif kind in (0x21, 0x2C):
            out.encrypted = bool(struct.unpack_from(e + "I", data, at + 16)[0])
        at += size
