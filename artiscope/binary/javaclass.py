"""Java class files: constant pool and method bodies."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

MAX_CLASS = 8 << 20


@dataclass
class Class:
    name: str = ""
    refs: list = field(default_factory=list)  # owner.method
    classes: list = field(default_factory=list)
    strings: list = field(default_factory=list)
    methods: list = field(default_factory=list)  # (name, descriptor, code)


def parse(data: bytes) -> Class | None:
    try:
        return _parse(data)
    except (struct.error, IndexError, ValueError, KeyError):
        return None


def _parse(data: bytes) -> Class | None:
    if data[:4] != b"\xca\xfe\xba\xbe" or len(data) > MAX_CLASS:
        return None
    at, pool, k = 10, {}, 1
    n = struct.unpack_from(">H", data, 8)[0]
    sizes = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
    while k < n:
        tag = data[at]
        if tag == 1:
            size = struct.unpack_from(">H", data, at + 1)[0]
            pool[k] = (1, data[at + 3 : at + 3 + size].decode("utf-8", "replace"))
            at += 3 + size
        else:
            pool[k] = (tag, data[at + 1 : at + 1 + sizes[tag]])
            at += 1 + sizes[tag]
        k += 2 if tag in (5, 6) else 1
    two = lambda raw: struct.unpack(">HH", raw)
    text = lambda i: pool[i][1]
    named = lambda i: text(struct.unpack(">H", pool[i][1])[0])
    out = Class()
    for tag, raw in pool.values():
        if tag == 7:
            out.classes.append(text(struct.unpack(">H", raw)[0]))
        elif tag == 8:
            out.strings.append(text(struct.unpack(">H", raw)[0]))
        elif tag in (10, 11):
            owner, what = two(raw)
            out.refs.append(f"{named(owner)}.{text(two(pool[what][1])[0])}")
    _, this, _ = struct.unpack_from(">HHH", data, at)
    out.name = named(this)
    interfaces = struct.unpack_from(">H", data, at + 6)[0]
    at += 8 + 2 * interfaces
    for is_method in (False, True):
        members = struct.unpack_from(">H", data, at)[0]
        at += 2
        for _ in range(members):
            _, name, descriptor, attributes = struct.unpack_from(">HHHH", data, at)
            at += 8
            code = None  # abstract and native methods have no body
            for _ in range(attributes):
                kind, size = struct.unpack_from(">HI", data, at)
                if is_method and text(kind) == "Code":
                    length = struct.unpack_from(">I", data, at + 10)[0]
                    code = data[at + 14 : at + 14 + length]
                at += 6 + size
            if is_method:
                out.methods.append((text(name), text(descriptor), code))
    return out


def returns_true(code: bytes) -> bool:
    """A body that does nothing but return true; no-operations (0) don't count."""
    return code.replace(b"\0", b"") == b"\x04\xac"


def is_empty_body(code: bytes) -> bool:
    return code.strip(b"\0") in (b"", b"\xb1")


def classes(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    """(label, bytes) of the classes of a class file or an archive of them; entries are bounded as they are read."""
    low = name.lower()
    if low.endswith(".class"):
        if len(data) <= MAX_CLASS:
            yield name, data
        return
    if not low.endswith((".jar", ".war", ".ear")):
        return
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if info.filename.endswith(".class") and info.file_size <= MAX_CLASS:
                    with z.open(info) as f:
                        body = f.read(MAX_CLASS + 1)
                    if len(body) <= MAX_CLASS:
                        yield f"{name} > {info.filename}", body
    except (zipfile.BadZipFile, RuntimeError, OSError, NotImplementedError, ValueError):
        return
