"""DER: X.509 certificates and the certificates of PKCS#7 signatures."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

# --- fixed values: object identifiers ---
SIGNATURES = {
    "1.2.840.113549.1.1.4": "md5WithRSA", "1.2.840.113549.1.1.5": "sha1WithRSA", "1.2.840.113549.1.1.11": "sha256WithRSA", "1.2.840.113549.1.1.12": "sha384WithRSA", "1.2.840.113549.1.1.13": "sha512WithRSA",
    "1.2.840.113549.1.1.2": "md2WithRSA", "1.2.840.10040.4.3": "sha1WithDSA", "1.2.840.10045.4.1": "sha1WithECDSA", "1.2.840.10045.4.3.2": "sha256WithECDSA", "1.2.840.10045.4.3.3": "sha384WithECDSA", "1.3.101.112": "ed25519",
}
WEAK = ("md2WithRSA", "md5WithRSA", "sha1WithRSA", "sha1WithDSA", "sha1WithECDSA")
NAMES = {"2.5.4.3": "CN", "2.5.4.10": "O", "2.5.4.11": "OU", "2.5.4.6": "C"}
BASIC_CONSTRAINTS, EXTENDED_USAGE, CODE_SIGNING, TIME_STAMPING = "2.5.29.19", "2.5.29.37", "1.3.6.1.5.5.7.3.3", "1.3.6.1.5.5.7.3.8"
#: DER of the attributes that hold a timestamp: the older countersignature and the newer token.
TIMESTAMP_MARKS = (bytes.fromhex("06092a864886f70d010906"), bytes.fromhex("060a2b060104018237030301"))

# --- fixed values: digests, what a signature of an image covers, and the attribute that seals it ---
DIGESTS = {"1.2.840.113549.2.5": "md5", "1.3.14.3.2.26": "sha1", "2.16.840.1.101.3.4.2.1": "sha256", "2.16.840.1.101.3.4.2.2": "sha384", "2.16.840.1.101.3.4.2.3": "sha512"}
INDIRECT_DATA, MESSAGE_DIGEST = "1.3.6.1.4.1.311.2.1.4", "1.2.840.113549.1.9.4"


class _Bad(ValueError):
    pass


def _tlv(data: bytes, at: int) -> tuple[int, int, int]:
    """Tag, start and end of the value at ``at``."""
    if at + 2 > len(data):
        raise _Bad
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 0 < k <= 4:
            raise _Bad
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
    if at + n > len(data):
        raise _Bad
    return tag, at, at + n


def _children(data: bytes, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    while start < end:
        tag, a, b = _tlv(data, start)
        yield tag, a, b
        start = b


def _oid(raw: bytes) -> str:
    if not raw:
        raise _Bad
    parts, value = [], 0
    for b in raw:
        value = value << 7 | b & 0x7F
        if not b & 0x80:
            parts.append(value)
            value = 0
    first = min(parts[0] // 40, 2)
    return ".".join(map(str, [first, parts[0] - 40 * first, *parts[1:]]))


def _name(data: bytes, start: int, end: int) -> dict:
    out: dict = {}
    for _, a, b in _children(data, start, end):
        for _, c, d in _children(data, a, b):
            (_, e, f), (kind, g, h) = list(_children(data, c, d))[:2]
            key = NAMES.get(_oid(data[e:f]))
            if key and key not in out:
                out[key] = data[g:h].decode("utf-16-be" if kind == 0x1E else "utf-8", "replace")
    return out


def _time(tag: int, raw: bytes) -> datetime:
    text = raw.decode("ascii").rstrip("Z")
    if tag == 0x17:
        text = ("19" if int(text[:2]) >= 50 else "20") + text
    return datetime.strptime(text[:14].ljust(14, "0"), "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc)


@dataclass
class Certificate:
    subject: dict
    issuer: dict
    serial: str
    not_before: datetime
    not_after: datetime
    signature: str
    self_signed: bool
    is_ca: bool = False
    usages: list = field(default_factory=list)

    def row(self) -> dict:
        return asdict(self)

    @property
    def weak(self) -> bool:
        return self.signature in WEAK


def certificate(data: bytes) -> Certificate | None:
    try:
        return _certificate(data)
    except (_Bad, ValueError, IndexError, UnicodeDecodeError):
        return None


def _certificate(data: bytes) -> Certificate:
    tag, a, b = _tlv(data, 0)
    if tag != 0x30:
        raise _Bad
    (tag, c, d), (_, e, f) = list(_children(data, a, b))[:2]
    fields = list(_children(data, c, d))
    k = 1 if fields[0][0] == 0xA0 else 0
    serial, _, issuer, validity, subject = fields[k : k + 5]
    (t1, v1, w1), (t2, v2, w2) = list(_children(data, validity[1], validity[2]))[:2]
    _, g, h = next(_children(data, e, f))
    oid = _oid(data[g:h])
    out = Certificate(
        _name(data, subject[1], subject[2]), _name(data, issuer[1], issuer[2]), data[serial[1] : serial[2]].hex(), _time(t1, data[v1:w1]), _time(t2, data[v2:w2]), SIGNATURES.get(oid, oid), data[subject[1] : subject[2]] == data[issuer[1] : issuer[2]]
    )
    for tag, x, y in fields[k + 5 :]:
        if tag != 0xA3:
            continue
        _, x, y = _tlv(data, x)
        for _, p, q in _children(data, x, y):
            parts = list(_children(data, p, q))
            kind, (_, r, s) = _oid(data[parts[0][1] : parts[0][2]]), parts[-1]
            _, r, s = _tlv(data, r)
            if kind == BASIC_CONSTRAINTS:
                out.is_ca = any(t == 1 and data[u] for t, u, _ in _children(data, r, s))
            elif kind == EXTENDED_USAGE:
                out.usages = [_oid(data[u:v]) for _, u, v in _children(data, r, s)]
    return out


def signature_certificates(data: bytes) -> list[Certificate]:
    """Certificates of a PKCS#7 SignedData."""
    try:
        _, a, b = _tlv(data, 0)
        _, (tag, c, _) = list(_children(data, a, b))[:2]
        _, e, f = _tlv(data, c)
        found = []
        for tag, g, h in _children(data, e, f):
            if tag == 0xA0:
                at = g
                while at < h:
                    _, _, end = _tlv(data, at)
                    cert = certificate(data[at:end])
                    if cert:
                        found.append(cert)
                    at = end
        return found
    except (_Bad, ValueError, IndexError):
        return []


@dataclass
class SignedDigest:
    """The digest of an image that a signature records; whether the signer's own digest is that of the record (None: it has none)."""

    algorithm: str
    recorded: str
    sealed: bool | None


def signed_digest(data: bytes) -> SignedDigest | None:
    """What a PKCS#7 SignedData with indirect data says about the image that it signs."""
    try:
        return _signed_digest(data)
    except (_Bad, ValueError, IndexError, StopIteration):
        return None


def _signed_digest(data: bytes) -> SignedDigest | None:
    _, a, b = _tlv(data, 0)
    _, (_, c, _) = list(_children(data, a, b))[:2]
    _, e, f = _tlv(data, c)
    parts = list(_children(data, e, f))
    content = list(_children(data, *next((x, y) for tag, x, y in parts if tag == 0x30)))
    if _oid(data[content[0][1] : content[0][2]]) != INDIRECT_DATA:
        return None
    _, start, end = _tlv(data, content[1][1])
    _, info = list(_children(data, start, end))[:2]
    (_, g, h), (_, i, j) = list(_children(data, info[1], info[2]))[:2]
    _, k, m = next(_children(data, g, h))
    algorithm = DIGESTS.get(_oid(data[k:m]))
    if algorithm is None:
        return None
    return SignedDigest(algorithm, data[i:j].hex(), _sealed(data, parts, data[start:end]))


def _sealed(data: bytes, parts: list, record: bytes) -> bool | None:
    """Whether the first signer's message digest is that of ``record``."""
    signers = parts[-1]
    if signers[0] != 0x31 or signers[1] == signers[2]:
        return None
    fields = list(_children(data, *next(_children(data, signers[1], signers[2]))[1:]))
    _, a, b = next(_children(data, fields[2][1], fields[2][2]))
    algorithm = DIGESTS.get(_oid(data[a:b]))
    for tag, x, y in fields[3:4] if algorithm else ():
        for _, p, q in _children(data, x, y) if tag == 0xA0 else ():
            (_, r, s), (_, t, u) = list(_children(data, p, q))[:2]
            if _oid(data[r:s]) == MESSAGE_DIGEST:
                _, v, w = _tlv(data, t)
                return data[v:w] == hashlib.new(algorithm, record).digest()
    return None


def has_timestamp(data: bytes) -> bool:
    return any(m in data for m in TIMESTAMP_MARKS)


def leaf(certs: list[Certificate]) -> int | None:
    """The signer among certificates: code signing and no authority, else no authority and not for time stamps, else no authority, else not self-signed, else the first."""
    tiers = (
        lambda c: not c.is_ca and CODE_SIGNING in c.usages,
        lambda c: not c.is_ca and TIME_STAMPING not in c.usages and not c.self_signed,
        lambda c: not c.is_ca and not c.self_signed,
        lambda c: not c.self_signed,
    )
    for tier in tiers:
        for k, c in enumerate(certs):
            if tier(c):
                return k
    return 0 if certs else None


_PEM = re.compile(rb"-----BEGIN CERTIFICATE-----(.*?)-----END CERTIFICATE-----", re.S)


def file_certificates(data: bytes) -> list[Certificate]:
    """Certificates of a PEM or DER file."""
    out = []
    for m in _PEM.finditer(data):
        try:
            cert = certificate(base64.b64decode(m[1]))
        except ValueError:
            continue
        if cert:
            out.append(cert)
    if not out and data[:1] == b"\x30":
        cert = certificate(data)
        out = [cert] if cert else []
    return out
