"""ELF binaries: header, program and dynamic headers, symbols."""

from __future__ import annotations

import struct
from dataclasses import asdict, dataclass, field

# --- fixed values ---
MACHINES = {3: "x86", 8: "MIPS", 20: "PowerPC", 40: "ARM", 62: "x86-64", 183: "AArch64", 243: "RISC-V"}
TYPES = {1: "relocatable", 2: "executable", 3: "shared object", 4: "core"}


@dataclass
class Elf:
    bits: int
    little: bool
    type: int
    machine: str
    pie: bool
    nx: bool | None = None  # None: no stack header
    relro: str = "none"
    canary: bool | None = None
    fortify: bool | None = None
    stripped: bool | None = None
    rpath: str | None = None
    needed: list = field(default_factory=list)
    interpreter: str | None = None

    def row(self) -> dict:
        return asdict(self)


def parse(data: bytes) -> Elf | None:
    try:
        return _parse(data)
    except (struct.error, IndexError, ValueError):
        return None


def _parse(data: bytes) -> Elf | None:
    if data[:4] != b"\x7fELF" or data[4] not in (1, 2) or data[5] not in (1, 2):
        return None
    wide, e = data[4] == 2, "<" if data[5] == 1 else ">"
    kind, machine = struct.unpack_from(e + "HH", data, 16)
    if wide:
        ph, sh = struct.unpack_from(e + "QQ", data, 32)
        ph_size, ph_n, sh_size, sh_n, _ = struct.unpack_from(e + "HHHHH", data, 54)
    else:
        ph, sh = struct.unpack_from(e + "II", data, 28)
        ph_size, ph_n, sh_size, sh_n, _ = struct.unpack_from(e + "HHHHH", data, 42)
    out = Elf(64 if wide else 32, e == "<", kind, MACHINES.get(machine, str(machine)), kind == 3)
    loads, dynamic = [], None
    for k in range(min(ph_n, 512)):
        at = ph + k * ph_size
        if wide:
            p_type, flags, offset, address, _, size, _, _ = struct.unpack_from(e + "IIQQQQQQ", data, at)
        else:
            p_type, offset, address, _, size, _, flags, _ = struct.unpack_from(e + "IIIIIIII", data, at)
        if p_type == 1:
            loads.append((address, offset, size))
        elif p_type == 2:
            dynamic = (offset, size)
        elif p_type == 3:
            out.interpreter = data[offset : offset + size].split(b"\0")[0].decode("latin-1")
        elif p_type == 0x6474E551:
            out.nx = not flags & 1
        elif p_type == 0x6474E552:
            out.relro = "partial"
    where = lambda a: next((a - v + o for v, o, n in loads if v <= a < v + n), a)
    tags: dict[int, list[int]] = {}
    if dynamic:
        step, form = (16, e + "qQ") if wide else (8, e + "iI")
        for at in range(dynamic[0], min(dynamic[0] + dynamic[1], len(data) - step + 1), step):
            tag, value = struct.unpack_from(form, data, at)
            if not tag:
                break
            tags.setdefault(tag, []).append(value)
        strings = where(tags[5][0]) if 5 in tags else None
        name = lambda v: data[strings + v : strings + v + 4096].split(b"\0")[0].decode("latin-1") if strings is not None else ""
        out.needed = [name(v) for v in tags.get(1, [])]
        paths = [name(v) for v in tags.get(15, []) + tags.get(29, [])]
        out.rpath = ":".join(filter(None, paths)) or None
        now = 24 in tags or any(v & 8 for v in tags.get(30, [])) or any(v & 1 for v in tags.get(0x6FFFFFFB, []))
        if out.relro == "partial" and now:
            out.relro = "full"
        table = data[strings : strings + (tags.get(10) or [1 << 20])[0]] if strings is not None else b""
        out.canary = b"__stack_chk_fail" in table
        out.fortify = b"_chk\0" in table.replace(b"__stack_chk_fail\0", b"")
    sections = {struct.unpack_from(e + "I", data, sh + k * sh_size + 4)[0] for k in range(min(sh_n, 4096))} if sh and sh_n else set()
    out.stripped = 2 not in sections if sh_n else True
    return out
