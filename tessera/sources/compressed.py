"""Byte streams of plain, gzip (one or many members) and block-gzip files, and the blocks of the latter.

Errors are raised: bytes after the last block are one too, unless ``permissive``.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

SUFFIX = re.compile(r"\.(gz|bgz|bgzf)$", re.IGNORECASE)
PIECE = 1 << 20
#: Bytes that are read first beyond a range's end.
FIRST = 1 << 13


def is_gzip(head: bytes) -> bool:
    return head[:2] == b"\x1f\x8b"


def block_size(head: bytes) -> int | None:
    """The size of a block-gzip block from its first bytes, None for another kind of file."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    (extra,) = struct.unpack_from("<H", head, 10)
    at, end = 12, min(12 + extra, len(head))
    while at + 4 <= end:
        kind, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and size == 2 and at + 6 <= end:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


def inflate(f: BinaryIO, permissive: bool = False) -> Iterator[bytes]:
    """The bytes of all members of a gzip stream, in pieces."""
    data, out = b"", None
    while True:
        # a member's mark may lie across two pieces
        while len(data) < (2 if out is None else 1) and (more := f.read(PIECE)):
            data += more
        if not data:
            break
        if out is None:
            if not is_gzip(data):
                if permissive or not data.strip(b"\0"):
                    return
                raise ValueError("there are bytes after the last gzip member")
            out = zlib.decompressobj(31)
        yield out.decompress(data)
        if out.eof:
            data, out = out.unused_data, None
        else:
            data = b""
    if out is not None:
        raise EOFError("the gzip stream ends within a member")


def blocks(path: str) -> list[tuple[int, int]]:
    """(offset, size) of all blocks of a block-gzip file; only heads are read."""
    out, at = [], 0
    with open(path, "rb") as f:
        while True:
            f.seek(at)
            head = f.read(64)
            if not head:
                return out
            size = block_size(head)
            if size is None:
                raise ValueError(f"{path}: no block at {at}")
            out.append((at, size))
            at += size


def stream(path: str, permissive: bool = False) -> Iterator[bytes]:
    """The (decompressed) bytes of a file in pieces; compression is told by the suffix."""
    with open(path, "rb") as f:
        if SUFFIX.search(path):
            yield from inflate(f, permissive)
            return
        while piece := f.read(PIECE):
            yield piece


def can_be_split(path: str) -> bool:
    """Whether a file can be read from its middle: plain and block-gzip files."""
    if not SUFFIX.search(path):
        return True
    with open(path, "rb") as f:
        return block_size(f.read(64)) is not None


def kind(path: str) -> str:
    """plain, blocks (block gzip) or members (any other gzip file)."""
    if not SUFFIX.search(path):
        return "plain"
    return "blocks" if can_be_split(path) else "members"


def plausible_head(head: bytes) -> bool:
    """Whether ten bytes can be the begin of a gzip member: deflate, no reserved flag, and a known system."""
    return len(head) == 10 and head[:3] == b"\x1f\x8b\x08" and head[3] < 0x20 and head[8] in (0, 2, 4) and (head[9] < 14 or head[9] == 255)


def member_stream(path: str, start: int, end: int, permissive: bool = False) -> Iterator[tuple[bytes, bool]]:
    """The decompressed bytes from the member that begins at ``start`` on, and whether their member begins before ``end``."""
    with open(path, "rb") as f:
        f.seek(start)
        begin, data, out = start, b"", None
        while True:
            while len(data) < (2 if out is None else 1) and (more := f.read(PIECE)):
                data += more
            if not data:
                break
            if out is None:
                if not is_gzip(data):
                    if permissive or not data.strip(b"\0"):
                        return
                    raise ValueError(f"{path}: there are bytes after the last gzip member")
                out, begin = zlib.decompressobj(31), f.tell() - len(data)
            yield out.decompress(data, PIECE), begin < end
            data = out.unused_data if out.eof else out.unconsumed_tail
            if out.eof:
                out = None
        if out is not None:
            raise EOFError(f"{path}: the gzip stream ends within a member")


def _first_block(f: BinaryIO, at: int) -> int | None:
    """The place of the first block at or after ``at``: a head whose size leads to another one, or to the end."""
    f.seek(0, 2)
    total = f.tell()
    while at < total:
        f.seek(at)
        data = f.read(1 << 17)
        k = data.find(b"\x1f\x8b\x08\x04")
        while k >= 0:
            size = block_size(data[k : k + 64])
            if size:
                f.seek(at + k + size)
                if at + k + size == total or block_size(f.read(64)):
                    return at + k
            k = data.find(b"\x1f\x8b\x08\x04", k + 1)
        if len(data) < 1 << 17:
            return None
        at += len(data) - 64  # a head may lie across
    return None


def marked_stream(path: str, permissive: bool = False, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, bool]]:
    """The (decompressed) bytes of a file from ``start`` on, and whether they lie before ``end`` (in the file, or their block does)."""
    if not start and end is None:
        for piece in stream(path, permissive):
            yield piece, True
        return
    with open(path, "rb") as f:
        if SUFFIX.search(path):
            at = _first_block(f, start)
            while at is not None:
                f.seek(at)
                head = f.read(64)
                if not head:
                    return
                size = block_size(head)
                if size is None:
                    if permissive:
                        return
                    raise ValueError(f"{path}: no block at {at}")
                f.seek(at)
                yield zlib.decompressobj(31).decompress(f.read(size)), end is None or at < end
                at += size
            return
        f.seek(start)
        at, beyond = start, FIRST  # of what lies beyond the end little is asked for
        while piece := f.read(PIECE if end is None else min(PIECE, end - at) if at < end else beyond):
            yield piece, end is None or at < end
            if end is not None and at >= end:
                beyond = min(PIECE, 2 * beyond)
            at += len(piece)


def marked_lines(pieces: Iterator[tuple[bytes, bool]]) -> Iterator[tuple[bytes, bool | None]]:
    """Lines without their newline, and whether that lies before the end (None: the last line has none)."""
    rest = b""
    for piece, inside in pieces:
        if b"\n" not in piece:
            rest += piece
            continue
        first, *whole, last = piece.split(b"\n")
        yield rest + first, inside
        for line in whole:
            yield line, inside
        rest = last
    if rest:
        yield rest, None


class Packer:
    """Writes bytes plain, as one gzip member, a member for each call, or in blocks that can be found."""

    BLOCK = 0xFF00

    def __init__(self, f: BinaryIO, kind: str):
        self.f, self.kind, self.held = f, kind, b""
        self.one = zlib.compressobj(6, zlib.DEFLATED, 31) if kind == "gzip" else None

    def write(self, data: bytes) -> None:
        if self.kind == "none":
            self.f.write(data)
        elif self.kind == "gzip":
            self.f.write(self.one.compress(data))
        elif self.kind == "members":
            own = zlib.compressobj(6, zlib.DEFLATED, 31)
            self.f.write(own.compress(data) + own.flush())
        else:
            data = self.held + data
            whole = len(data) - len(data) % self.BLOCK
            for at in range(0, whole, self.BLOCK):
                self._block(data[at : at + self.BLOCK])
            self.held = data[whole:]

    def _block(self, data: bytes) -> None:
        own = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = own.compress(data) + own.flush()
        head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
        self.f.write(head + body + struct.pack("<II", zlib.crc32(data), len(data)))

    def close(self) -> None:
        if self.kind == "gzip":
            self.f.write(self.one.flush())
        elif self.kind == "bgzf":
            if self.held:
                self._block(self.held)
            self._block(b"")


def lines(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Lines without their newline; the last one counts even if it has none."""
    rest = b""
    for piece in pieces:
        *whole, rest = (rest + piece).split(b"\n") if b"\n" in piece else (rest + piece,)
        yield from whole
    if rest:
        yield rest
