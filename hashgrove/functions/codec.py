"""Binary codecs of the packed object format, as small helpers inside Spark functions."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
#: Kinds of entries that are deltas, the longest copy, the largest object, the largest whole number of the wire formats.
OFS_DELTA, REF_DELTA, COPY, LARGEST, SAFE = 6, 7, 0xFFFFFF, 32 << 20, (1 << 53) - 1
#: Bytes handed to a decompressor at once.
PIECE = 1 << 16


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(raw):
            raise ValueError("truncated length")
        b = raw[at]
        n, shift, at = n | (b & 127) << shift, shift + 7, at + 1
        if n > SAFE:
            raise ValueError("length too large")
        if b < 128:
            return n, at


def build_delta(base: bytes, target: bytes) -> bytes:
    """A delta of the shared beginning and end as copies, the middle as inserts."""
    top = min(len(base), len(target))
    head = next((i for i in range(top) if base[i] != target[i]), top)
    tail = next((i for i in range(top - head) if base[-1 - i] != target[-1 - i]), top - head)
    middle = target[head : len(target) - tail]
    parts = [varint(len(base)), varint(len(target)), _copies(0, head)]
    parts += [bytes([len(middle[i : i + 127])]) + middle[i : i + 127] for i in range(0, len(middle), 127)]
    return b"".join([*parts, _copies(len(base) - tail, tail)])


def _copies(at: int, size: int) -> bytes:
    out = bytearray()
    while size:
        n = min(size, COPY)
        op, rest = 128, bytearray()
        for k in range(4):
            if byte := at >> 8 * k & 255:
                op |= 1 << k
                rest.append(byte)
        for k in range(3):
            if byte := n >> 8 * k & 255:
                op |= 16 << k
                rest.append(byte)
        out += bytes([op]) + rest
        at, size = at + n, size - n
    return bytes(out)


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """The target of a delta; sizes and bounds are checked, opcode 0 is reserved, a copy size of 0 means 65,536."""
    size, at = read_varint(delta, 0)
    want, at = read_varint(delta, at)
    if size != len(base):
        raise ValueError("base size differs")
    if want > LARGEST:
        raise ValueError("target too large")
    out = bytearray()
    while at < len(delta):
        op, at = delta[at], at + 1
        if op & 128:
            start = n = 0
            for k in range(7):
                if op >> k & 1:
                    if at >= len(delta):
                        raise ValueError("truncated copy")
                    start, n = (start | delta[at] << 8 * k, n) if k < 4 else (start, n | delta[at] << 8 * (k - 4))
                    at += 1
            n = n or 65_536
            if start + n > len(base):
                raise ValueError("copy past the base")
            out += base[start : start + n]
        elif op:
            if at + op > len(delta):
                raise ValueError("truncated insert")
            out += delta[at : at + op]
            at += op
        else:
            raise ValueError("reserved opcode")
        if len(out) > want:
            raise ValueError("target size differs")
    if len(out) != want:
        raise ValueError("target size differs")
    return bytes(out)


def tree_entries(raw: bytes) -> Iterator[tuple[str, str, str]]:
    """(mode, name, oid) of each entry, in stored order; ValueError for one without a mode, cut short, or of another mode than 5 or 6 octal digits."""
    at = 0
    while at < len(raw):
        blank = raw.find(b" ", at)
        end = raw.find(b"\0", blank + 1)
        mode = raw[at:blank].decode("utf-8", "replace")
        if blank < 0 or end < 0 or end + 21 > len(raw) or not 5 <= len(mode) <= 6 or set(mode) - set("01234567"):
            raise ValueError("malformed tree entry")
        yield mode, raw[blank + 1 : end].decode("utf-8", "replace"), raw[end + 1 : end + 21].hex()
        at = end + 21


def object_id(kind: str, raw: bytes) -> str:
    return hashlib.sha1(f"{kind} {len(raw)}\0".encode() + raw).hexdigest()


def entry_head(kind: int, size: int) -> bytes:
    """Three bits of kind and a size, four bits in the first byte, seven in each further one."""
    first, rest = kind << 4 | size & 15, size >> 4
    return bytes([first | 128]) + varint(rest) if rest else bytes([first])


def pack_entry(kind: str, raw: bytes, base: str | None = None) -> bytes:
    """An entry of a pack: a whole object, or with ``base`` the delta ``raw`` on the object of that id."""
    if base is not None:
        return entry_head(REF_DELTA, len(raw)) + bytes.fromhex(base) + zlib.compress(raw)
    return entry_head({v: k for k, v in KINDS.items()}[kind], len(raw)) + zlib.compress(raw)


def pack_head(entries: int) -> bytes:
    return b"PACK" + (2).to_bytes(4, "big") + entries.to_bytes(4, "big")


class Fault(Exception):
    """A fault of a pack; its text is one of the codes not-a-pack, unsupported-version, truncated, checksum-mismatch,
    trailing-bytes, missing-base, object-too-large, corrupt."""


def inflate(raw: memoryview, at: int, end: int, size: int) -> tuple[bytes, int]:
    """The ``size`` bytes that a zlib stream at ``at`` holds, and where it ends. Input is fed in pieces, output is bounded."""
    stream, out = zlib.decompressobj(), bytearray()
    while not stream.eof:
        if at >= end:
            raise Fault("truncated")
        piece = raw[at : min(at + PIECE, end)]
        try:
            out += stream.decompress(piece, size - len(out) + 1)
        except zlib.error:
            raise Fault("corrupt") from None
        at += len(piece) - len(stream.unconsumed_tail) - len(stream.unused_data)
        if len(out) > size:
            raise Fault("corrupt")
    if len(out) != size:
        raise Fault("corrupt")
    return bytes(out), at


def read_entry(raw: memoryview, at: int, end: int) -> tuple[int, int | None, str | None, bytes, int]:
    """(kind, base place, base id, body, end) of the entry at ``at``; places count from the start of the pack."""
    place, base_place, base_id = at, None, None

    def byte() -> int:
        nonlocal at
        if at >= end:
            raise Fault("truncated")
        at += 1
        return raw[at - 1]

    b = byte()
    kind, size, shift = b >> 4 & 7, b & 15, 4
    while b & 128:
        b = byte()
        size, shift = size | (b & 127) << shift, shift + 7
        if size > SAFE:
            raise Fault("corrupt")
    if kind not in KINDS and kind not in (OFS_DELTA, REF_DELTA):
        raise Fault("corrupt")
    if size > LARGEST:
        raise Fault("object-too-large")
    if kind == OFS_DELTA:
        b = byte()
        back = b & 127
        while b & 128:
            b = byte()
            back = (back + 1) << 7 | b & 127
            if back > SAFE:
                raise Fault("corrupt")
        base_place = place - back
        if not 12 <= base_place < place:
            raise Fault("missing-base")
    elif kind == REF_DELTA:
        if at + 20 > end:
            raise Fault("truncated")
        base_id, at = bytes(raw[at : at + 20]).hex(), at + 20
    body, at = inflate(raw, at, end, size)
    return kind, base_place, base_id, body, at


def read_entries(data: bytes) -> Iterator[tuple[int, int, int, int | None, str | None, bytes]]:
    """(pos, place, kind, base place, base id, body) of each entry; deltas are not resolved, and only one entry is held."""
    raw, end = memoryview(data), len(data) - 20
    if data[:4] != b"PACK":
        raise Fault("not-a-pack" if len(data) >= 4 else "truncated")
    if len(data) < 8:
        raise Fault("truncated")
    if int.from_bytes(data[4:8], "big") not in (2, 3):
        raise Fault("unsupported-version")
    if end < 12:
        raise Fault("truncated")
    at = 12
    for pos in range(int.from_bytes(data[8:12], "big")):
        place = at
        kind, base_place, base_id, body, at = read_entry(raw, at, end)
        yield pos, place, kind, base_place, base_id, body
    if at != end:
        raise Fault("trailing-bytes")
    if hashlib.sha1(raw[:end]).digest() != raw[end:]:
        raise Fault("checksum-mismatch")


def pkt_line(payload: Column) -> Column:
    """A framed line: four hex digits of its length, itself included, and the payload."""
    raw = payload.cast("binary")
    return F.concat(F.lpad(F.lower(F.hex(F.octet_length(raw) + 4)), 4, "0").cast("binary"), raw)


ENTRIES = "path string, pos int, place long, kind int, base_place long, base_id string, body binary, fault string"


def pack_entries(packs: DataFrame, column: str = "content") -> DataFrame:
    """(path, pos, place, kind, base_place, base_id, body, fault) of the entries of packs read as binary files.

    A pack that is at fault ends with a row of pos -1 that names the fault; its rows before that are not to be kept. A task
    holds one pack's file and one entry of it. A null pack is truncated.
    """
    names = [c.split()[0] for c in ENTRIES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw in zip(pdf.path, pdf[column]):
                held, size = [], 0
                try:
                    for row in read_entries(bytes(raw or b"")):
                        held.append((path, *row, None))
                        size += len(row[-1])
                        if size > 1 << 22:
                            yield pd.DataFrame(held, columns=names)
                            held, size = [], 0
                except Fault as fault:
                    held.append((path, -1, None, None, None, None, None, str(fault)))
                yield pd.DataFrame(held, columns=names).astype({"place": "Int64", "base_place": "Int64", "kind": "Int32"})

    return packs.select("path", column).mapInPandas(run, ENTRIES)


@F.pandas_udf(BinaryType())
def delta_of(base: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([build_delta(bytes(a), bytes(b)) for a, b in zip(base, target)])


@F.pandas_udf(BinaryType())
def patched(base: pd.Series, delta: pd.Series) -> pd.Series:
    return pd.Series([apply_delta(bytes(a), bytes(b)) for a, b in zip(base, delta)])


@F.pandas_udf(BinaryType())
def patched_or_null(base: pd.Series, delta: pd.Series) -> pd.Series:
    """The target of a delta, null where the delta does not fit its base or makes too large an object."""
    def one(a: bytes, b: bytes) -> bytes | None:
        try:
            return apply_delta(bytes(a), bytes(b))
        except ValueError:
            return None

    return pd.Series([None if a is None or b is None else one(a, b) for a, b in zip(base, delta)], dtype=object)


@F.pandas_udf(BinaryType())
def deflated(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: zlib.compress(bytes(x)), na_action="ignore")
