"""Code signatures of Mach-O images: the superblob, its code directory with page hashes and flags, and entitlements."""

from __future__ import annotations

import hashlib
import plistlib
import struct
from dataclasses import dataclass, field
from xml.parsers.expat import ExpatError

# --- fixed values: magics of blobs, kinds of hashes, the flag of the hardened runtime ---
SUPERBLOB, CODE_DIRECTORY, ENTITLEMENTS = 0xFADE0CC0, 0xFADE0C02, 0xFADE7171
HASHES = {1: ("sha1", 20), 2: ("sha256", 32), 3: ("sha256", 20), 4: ("sha384", 48)}
RUNTIME = 0x10000


@dataclass
class CodeSignature:
    identifier: str = ""
    flags: int = 0
    hashed: int = 0  # pages whose hashes could be checked
    changed: list = field(default_factory=list)  # numbers of pages that aren't what was signed
    entitlements: dict = field(default_factory=dict)
    declared: str = ""  # the entitlements as they stand there

    @property
    def hardened(self) -> bool:
        return bool(self.flags & RUNTIME)


def _text(data: bytes, at: int) -> str:
    return data[at : at + 1024].split(b"\0")[0].decode("utf-8", "replace")


def _pages(image: bytes, blob: bytes, at: int, out: CodeSignature) -> None:
    """Compare the image's pages with a code directory's slots."""
    hashes, _, _, slots, limit, width, kind, _, power = struct.unpack_from(">IIIIIBBBB", blob, at + 16)
    name, size = HASHES.get(kind, (None, 0))
    if name is None or width != size or at + hashes + slots * width > len(blob):
        return
    page = 1 << power if power else max(limit, 1)
    for k in range(min(slots, -(-limit // page))):
        found = hashlib.new(name, image[k * page : min((k + 1) * page, limit)]).digest()[:width]
        out.hashed += 1
        if found != blob[at + hashes + k * width : at + hashes + (k + 1) * width]:
            out.changed.append(k)


def parse(image: bytes, blob: bytes) -> CodeSignature | None:
    """The signature ``blob`` of ``image`` (one architecture, from its header on); None if it isn't one."""
    if len(blob) < 12 or struct.unpack_from(">I", blob, 0)[0] != SUPERBLOB:
        return None
    out, directory = CodeSignature(), None
    for k in range(min(struct.unpack_from(">I", blob, 8)[0], (len(blob) - 12) // 8)):
        _, at = struct.unpack_from(">II", blob, 12 + 8 * k)
        if at + 8 > len(blob):
            continue
        magic, length = struct.unpack_from(">II", blob, at)
        if magic == CODE_DIRECTORY and directory is None:  # the first one counts, others repeat it in other hashes
            directory = at
        elif magic == ENTITLEMENTS:
            raw = blob[at + 8 : at + length]
            out.declared = raw.decode("utf-8", "replace")
            try:
                held = plistlib.loads(raw)
                out.entitlements = held if isinstance(held, dict) else {}
            except (plistlib.InvalidFileException, ExpatError, ValueError):
                pass  # shown as it stands
    if directory is None:
        return None
    out.flags, _, name = struct.unpack_from(">III", blob, directory + 12)
    out.identifier = _text(blob, directory + name)
    _pages(image, blob, directory, out)
    return out
