"""ORC tails in plain Python, by the format's public specification: only the bytes asked for are read.

Used inside tasks, so that footers of many files are read on the executors.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

CODECS = ("NONE", "ZLIB", "SNAPPY", "LZO", "LZ4", "ZSTD", "BROTLI")
KINDS = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "string", "binary", "timestamp", "array", "map", "struct", "uniontype", "decimal", "date", "varchar", "char", "timestamp with local time zone")
ROW_INDEX = 6


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def message(data: bytes) -> dict[int, list]:
    """The fields of a protocol buffer by number: integers, eight or four bytes, or bytes."""
    out: dict[int, list] = {}
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        else:
            if kind == 2:
                size, at = varint(data, at)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"unknown wire type {kind}")
            value, at = data[at : at + size], at + size
        out.setdefault(tag >> 3, []).append(value)
    return out


def integers(values: list) -> list[int]:
    """A repeated integer field, packed or not."""
    out: list[int] = []
    for v in values:
        if isinstance(v, int):
            out.append(v)
            continue
        at = 0
        while at < len(v):
            x, at = varint(v, at)
            out.append(x)
    return out


def signed(u: int) -> int:
    return (u >> 1) ^ -(u & 1)


def _lz4_block(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def more(n: int, at: int) -> tuple[int, int]:
        if n == 15:
            while True:
                n += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
        return n, at

    while at < len(data):
        token = data[at]
        n, at = more(token >> 4, at + 1)
        out += data[at : at + n]
        at += n
        if at >= len(data):
            break
        back = data[at] | data[at + 1] << 8
        n, at = more(token & 15, at + 2)
        for _ in range(n + 4):
            out.append(out[-back])
    return bytes(out)


def _lzo_block(data: bytes) -> bytes:
    """LZO1X, as the format's chunks have it: literals, and copies of four kinds by their first byte."""
    out, at = bytearray(), 0

    def more(n: int, mask: int, at: int) -> tuple[int, int]:
        """A length beyond its bits: zeros count 255 each."""
        if n:
            return n, at
        while data[at] == 0:
            n += 255
            at += 1
        return n + mask + data[at], at + 1

    def copy(back: int, n: int) -> None:
        for _ in range(n):
            out.append(out[-back])

    literal = 0  # literals right before this instruction: 0 none, 1 to 3 a few behind a copy, 4 a run
    if data[0] > 17:
        n = data[0] - 17
        out += data[1 : 1 + n]
        at, literal = 1 + n, 4 if n > 3 else n
    while True:
        t = data[at]
        at += 1
        if t >= 64:
            back, n = (t >> 2 & 7) + (data[at] << 3) + 1, (t >> 5) + 1
            at += 1
        elif t >= 32:
            n, at = more(t & 31, 31, at)
            back, n = (data[at] >> 2) + (data[at + 1] << 6) + 1, n + 2
            at += 2
        elif t >= 16:
            n, at = more(t & 7, 7, at)
            back, n = ((t & 8) << 11) + (data[at] >> 2) + (data[at + 1] << 6), n + 2
            at += 2
            if not back:
                return bytes(out)
            back += 0x4000
        elif literal == 0:
            n, at = more(t, 15, at)
            out += data[at : at + n + 3]
            at, literal = at + n + 3, 4
            continue
        elif literal == 4:
            back, n = (t >> 2) + (data[at] << 2) + 0x801, 3
            at += 1
        else:
            back, n = (t >> 2) + (data[at] << 2) + 1, 2
            at += 1
        copy(back, n)
        literal = data[at - 2] & 3
        out += data[at : at + literal]
        at += literal


def _chunk(data: bytes, codec: str, limit: int) -> bytes:
    if codec == "ZLIB":
        return zlib.decompress(data, -15)
    if codec == "ZSTD":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=limit)
    if codec == "SNAPPY":
        import pyarrow as pa

        return pa.Codec("snappy").decompress(data, varint(data, 0)[0]).to_pybytes()
    if codec == "LZ4":
        return _lz4_block(data)
    if codec == "LZO":
        return _lzo_block(data)
    raise ValueError(f"unknown codec {codec!r}")


def inflate(data: bytes, codec: str, limit: int) -> bytes:
    """A compressed stream: chunks behind three bytes of length * 2 + original."""
    if codec == "NONE":
        return data
    out, at = [], 0
    while at < len(data):
        head = int.from_bytes(data[at : at + 3], "little")
        part = data[at + 3 : at + 3 + (head >> 1)]
        out.append(part if head & 1 else _chunk(part, codec, limit))
        at += 3 + (head >> 1)
    return b"".join(out)


@dataclass
class Tail:
    codec: str
    chunk_size: int
    version: str
    n_rows: int
    content_bytes: int
    stride: int
    types: list[dict]
    stripes: list[dict]
    statistics: list[dict]
    stripe_statistics: list[list[dict]]
    user_metadata: dict[str, bytes]

    def schema(self, k: int = 0) -> str:
        t = self.types[k]
        kind, below = KINDS[t.get(1, [0])[0]], integers(t.get(2, []))
        if kind == "struct":
            names = [n.decode() for n in t.get(3, [])]
            return "struct<" + ",".join(f"{n}:{self.schema(c)}" for n, c in zip(names, below)) + ">"
        if kind in ("array", "map", "uniontype"):
            return f"{kind}<{','.join(map(self.schema, below))}>"
        if kind == "decimal":
            return f"decimal({t.get(5, [38])[0]},{t.get(6, [10])[0]})"
        return f"{kind}({t[4][0]})" if kind in ("char", "varchar") and 4 in t else kind


def read_tail(read, size: int) -> Tail:
    """read(offset, length) gives a file's bytes."""
    if size <= 3:
        raise ValueError("not an ORC file: it is too short")
    held = read(max(0, size - 16_384), min(size, 16_384))
    ps_size = held[-1]
    ps = message(held[-1 - ps_size : -1])
    if ps.get(8000, [b""])[0] != b"ORC":
        raise ValueError("not an ORC file: its postscript has no magic")
    footer_size, meta_size = ps.get(1, [0])[0], ps.get(5, [0])[0]
    codec, limit = CODECS[ps.get(2, [0])[0]], ps.get(3, [262_144])[0]
    need = 1 + ps_size + footer_size + meta_size
    if need > len(held):
        held = read(size - need, need)
    end = len(held) - 1 - ps_size
    footer = message(inflate(held[end - footer_size : end], codec, limit))
    meta = message(inflate(held[end - footer_size - meta_size : end - footer_size], codec, limit))
    stripes = [message(s) for s in footer.get(3, [])]
    return Tail(
        codec, limit if codec != "NONE" else 0, ".".join(map(str, integers(ps.get(4, [])))), footer.get(6, [0])[0], footer.get(2, [0])[0], footer.get(8, [0])[0], [message(t) for t in footer.get(4, [])],
        [dict(zip(("offset", "index_bytes", "data_bytes", "footer_bytes", "n_rows"), (s.get(k, [0])[0] for k in range(1, 6)))) for s in stripes],
        [statistics(s) for s in footer.get(7, [])], [[statistics(c) for c in message(s).get(1, [])] for s in meta.get(1, [])],
        {k.decode(): v for k, v in ((m.get(1, [b""])[0], m.get(2, [b""])[0]) for m in map(message, footer.get(5, [])))},
    )


def statistics(data: bytes) -> dict:
    """A column's statistics; values as text, as their types differ."""
    m = message(data)
    out = {"n_values": m.get(1, [0])[0], "has_null": bool(m.get(10, [0])[0]), "bytes_on_disk": m.get(11, [0])[0], "min": None, "max": None, "sum": None, "n_true": None}

    def put(number: int, decode, names=("min", "max", "sum")) -> None:
        if number in m:
            own = message(m[number][0])
            for k, name in enumerate(names, 1):
                if name and k in own:
                    out[name] = decode(own[k][0])

    put(2, lambda v: str(signed(v)))
    put(3, lambda v: repr(struct.unpack("<d", v)[0]))
    put(4, lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else str(signed(v)))
    put(6, lambda v: v.decode())
    put(7, lambda v: str(signed(v)), ("min", "max"))
    put(8, lambda v: str(signed(v)), ("sum",))
    put(9, lambda v: str(signed(v)), (None, None, "min", "max"))
    if 5 in m:
        out["n_true"] = (integers(message(m[5][0]).get(1, [])) or [None])[0]
    return out


def read_row_index(read, tail: Tail):
    """(stripe, column, stride, positions, statistics) of every row group entry."""
    for k, s in enumerate(tail.stripes):
        at = s["offset"] + s["index_bytes"] + s["data_bytes"]
        footer = message(inflate(read(at, s["footer_bytes"]), tail.codec, tail.chunk_size))
        at = s["offset"]
        for stream in map(message, footer.get(1, [])):
            kind, column, size = (stream.get(i, [0])[0] for i in (1, 2, 3))
            if kind == ROW_INDEX:
                entries = message(inflate(read(at, size), tail.codec, tail.chunk_size)).get(1, [])
                for n, entry in enumerate(map(message, entries)):
                    yield k, column, n, integers(entry.get(1, [])), statistics(entry.get(2, [b""])[0])
            at += size
