"""ZIP packages of web archives: parse directories, find stored members, range-read records."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import BinaryIO

# Fixed values of the ZIP format.
_END, _END64, _LOCATOR64 = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_CENTRAL, _LOCAL = b"PK\x01\x02", b"PK\x03\x04"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header_at: int


def _read_at(f: BinaryIO, at: int, n: int) -> bytes:
    f.seek(at)
    data = f.read(n)
    if len(data) < n:
        raise ValueError("the package is cut short")
    return data


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """The values, those at their 32-bit maximum taken from the ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            return [next(wide) if v == _FULL32 else v for v in values]
        at += 4 + n
    return values


def members(f: BinaryIO) -> list[Member]:
    """The central directory, of plain and ZIP64 packages; reads the file's end and the directory only."""
    total = f.seek(0, 2)
    tail_at = max(0, total - 65_557)  # the end record and the longest comment
    tail = _read_at(f, tail_at, total - tail_at)
    at = tail.rfind(_END)
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20:at + 22], "little") != len(tail):
        at = tail.rfind(_END, 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    if _FULL16 == count or _FULL32 in (size, start):
        locator = _read_at(f, tail_at + at - 20, 20)
        if locator[:4] != _LOCATOR64:
            raise ValueError("no ZIP64 locator")
        end64 = _read_at(f, struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != _END64:
            raise ValueError("no ZIP64 end record")
        count, size, start = struct.unpack_from("<QQQ", end64, 32)
    directory, at, found = _read_at(f, start, size), 0, []
    for _ in range(count):
        if directory[at:at + 4] != _CENTRAL:
            raise ValueError("a broken central directory")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        stored, whole, name_n, extra_n, comment_n = struct.unpack_from("<IIHHH", directory, at + 20)
        header_at = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46:at + 46 + name_n]
        extra = directory[at + 46 + name_n:at + 46 + name_n + extra_n]
        whole, stored, header_at = _wide(extra, [whole, stored, header_at])
        found.append(Member(name.decode("utf-8", "replace"), method, stored, header_at))
        at += 46 + name_n + extra_n + comment_n
    return found


def data_at(f: BinaryIO, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    header = _read_at(f, member.header_at, 30)
    if header[:4] != _LOCAL:
        raise ValueError("a broken local header")
    name_n, extra_n = struct.unpack_from("<HH", header, 26)
    return member.header_at + 30 + name_n + extra_n


def _pieces(f: BinaryIO, member: Member, step: int = 1 << 20) -> Iterator[bytes]:
    """A member's bytes; a deflated one is inflated."""
    at, end = data_at(f, replace(member, method=0)), member.size
    if member.method not in (0, 8):
        raise ValueError(f"{member.name} is compressed by method {member.method}")
    z = zlib.decompressobj(-15) if member.method == 8 else None
    for k in range(0, end, step):
        piece = _read_at(f, at + k, min(step, end - k))
        yield z.decompress(piece) if z else piece


def _unzipped(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of gzip blocks one after another."""
    z, begun = zlib.decompressobj(31), False
    for piece in pieces:
        while piece:
            yield z.decompress(piece)
            begun = not z.eof
            piece = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)
    if begun:
        raise ValueError("an index is cut short")


def _lines(pieces: Iterator[bytes]) -> Iterator[str]:
    rest = b""
    for piece in pieces:
        *whole, rest = (rest + piece).split(b"\n")
        yield from (x.decode("utf-8") for x in whole)
    yield rest.decode("utf-8")


def index_lines(f: BinaryIO) -> Iterator[tuple[int, int, dict]]:
    """(place in the file, bytes, fields) of every record, from the package's indexes.

    Indexes are CDXJ lines, plain or in gzip blocks (.gz), stored or deflated;
    .idx, which only finds blocks by key, and lines of metadata (!) are skipped.
    """
    found = {m.name: m for m in members(f)}
    start = {name: data_at(f, m) for name, m in found.items() if name.startswith("archive/") and not name.endswith("/")}
    for name, m in found.items():
        if name.startswith("indexes/") and not name.endswith(("/", ".idx")):
            pieces = _pieces(f, m)
            for line in _lines(_unzipped(pieces) if name.endswith(".gz") else pieces):
                if line.strip() and not line.startswith("!"):
                    fields = json.loads(line[line.index("{"):])
                    yield start["archive/" + fields["filename"]] + int(fields["offset"]), int(fields["length"]), fields


def parse_record(packed: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record, compressed or not; names in lower case.

    The payload of a record that holds no HTTP message is its whole block.
    """
    raw = zlib.decompress(packed, 31) if packed[:2] == b"\x1f\x8b" else packed
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = _headers(head)
    block = rest[:int(warc["content-length"])]
    if not warc.get("content-type", "").lower().startswith("application/http"):
        return warc, {}, block
    head, _, payload = block.partition(b"\r\n\r\n")
    return warc, _headers(head), payload


def unchunked(payload: bytes) -> bytes:
    """A body without chunks; one that isn't in chunks, whatever its headers say, as it is."""
    at, pieces = 0, []
    while True:
        end = payload.find(b"\r\n", at)
        size = payload[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            return payload
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(pieces)
        if payload[at + n:at + n + 2] != b"\r\n":
            return payload
        pieces.append(payload[at:at + n])
        at += n + 2


def matches(payload: bytes, digest: str) -> bool | None:
    """Whether ``algorithm:value``, in hex or base 32, is the payload's digest; None for unknown algorithms."""
    name, _, value = digest.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return None
    own, value = hashlib.new(name, payload, usedforsecurity=False).digest(), value.strip()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def _headers(head: bytes) -> dict[str, str]:
    """The first of each name; a line that begins with a space goes on with the one before."""
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in reversed(lines))}


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def make_record(kind: str, record_id: str, uri: str, digest: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """One compressed WARC record; a revisit holds the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {uri}",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <{refers_to}>"]
    return _gzip("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


class PackageWriter:
    """Writes records one after another into a stored member, then the index and the descriptor."""

    def __init__(self, out: BinaryIO):
        self._zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self._member = self._zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self._lines: list[str] = []
        self.size = 0

    def add(self, uri: str, digest: str, record: bytes) -> None:
        self._member.write(record)
        fields = {"url": uri, "digest": f"sha256:{digest}", "offset": str(self.size), "length": str(len(record)),
                  "filename": ARCHIVE.rpartition("/")[2]}
        self._lines.append(f"{uri.replace(' ', '%20')} 19700101000000 {json.dumps(fields)}")
        self.size += len(record)

    def close(self) -> None:
        self._member.close()
        self._zip.writestr(INDEX, "".join(x + "\n" for x in self._lines))
        self._zip.writestr("datapackage.json", json.dumps({
            "profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": ARCHIVE}, {"path": INDEX}]}))
        self._zip.close()
