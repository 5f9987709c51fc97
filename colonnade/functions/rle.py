"""Byte-exact run-length codecs of the file format, and their use on DataFrames in blocks.

``encode_ints``/``decode_ints`` are the second version of the integer encoding with its four kinds of
runs (short repeat, direct, patched base, delta); ``encode_bytes``/``decode_bytes`` the byte one and
``encode_bools``/``decode_bools`` bits in bytes. Python integers hold any 64-bit value without overflow.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bits import ALIGNED, WIDTHS

BLOCK = 512
_MASK = (1 << 64) - 1


def closest(bits: int, widths: tuple[int, ...] = WIDTHS) -> int:
    return next(w for w in widths if w >= bits)


def zigzag(v: int) -> int:
    return ((v << 1) ^ (v >> 63)) & _MASK


def unzigzag(u: int) -> int:
    return (u >> 1) ^ -(u & 1)


def varint(u: int) -> bytes:
    out = bytearray()
    while u > 127:
        out.append(u & 127 | 128)
        u >>= 7
    out.append(u)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    u = shift = 0
    while True:
        b = data[at]
        at += 1
        u |= (b & 127) << shift
        shift += 7
        if b < 128:
            return u, at


def pack(values: list[int], width: int) -> bytes:
    """Big-endian bits, the last byte filled with zeros."""
    total = 0
    for v in values:
        total = total << width | v
    bits = width * len(values)
    size = -(-bits // 8)
    return (total << (8 * size - bits)).to_bytes(size, "big")


def unpack(data: bytes, at: int, n: int, width: int) -> tuple[list[int], int]:
    size = -(-width * n // 8)
    total = int.from_bytes(data[at : at + size], "big") >> (8 * size - width * n)
    mask = (1 << width) - 1
    return [total >> width * (n - 1 - k) & mask for k in range(n)], at + size


def _header(kind: int, width: int, n: int) -> bytes:
    code = WIDTHS.index(width) if width else 0
    return bytes([kind << 6 | code << 1 | (n - 1) >> 8, (n - 1) & 255])


def _short_repeat(v: int, n: int) -> bytes:
    size = max(1, -(-v.bit_length() // 8))
    return bytes([(size - 1) << 3 | (n - 3)]) + v.to_bytes(size, "big")


def _direct(unsigned: list[int]) -> bytes:
    width = closest(max(v.bit_length() for v in unsigned) or 1)
    return _header(1, width, len(unsigned)) + pack(unsigned, width)


def _delta(values: list[int], signed: bool) -> bytes | None:
    """For values that rise or fall throughout; None if they don't, or differ by too much."""
    deltas = [b - a for a, b in zip(values, values[1:])]
    if not deltas or not (all(d >= 0 for d in deltas) or all(d <= 0 for d in deltas)):
        return None
    if max(map(abs, deltas)) >= 1 << 63 or deltas[0] == 0 and any(deltas):
        return None
    base = varint(zigzag(values[0]) if signed else values[0]) + varint(zigzag(deltas[0]))
    if all(d == deltas[0] for d in deltas):
        return _header(3, 0, len(values)) + base
    width = closest(max(2, max(abs(d) for d in deltas[1:]).bit_length()), ALIGNED)
    return _header(3, width, len(values)) + base + pack([abs(d) for d in deltas[1:]], width)


def _patched(values: list[int]) -> bytes | None:
    """A base, low bits of the differences to it, and the high bits of the few that have more."""
    base = min(values)
    over = [v - base for v in values]
    widths = sorted(v.bit_length() for v in over)
    width = closest(max(1, widths[len(widths) - 1 - int(len(widths) * 0.05)]))
    most = closest(max(1, widths[-1]))
    if width == most or most > 56 or abs(base) >= 1 << 55:
        return None
    patch_width = closest(widths[-1] - width)
    patches, last = [], 0
    for k, v in enumerate(over):
        if v >> width:
            gap = k - last
            while gap > 255:
                patches.append((255, 0))
                gap -= 255
            patches.append((gap, v >> width))
            last = k
    gap_width = max(1, max(g for g, _ in patches).bit_length())
    if len(patches) > 31 or patch_width + gap_width > 64:
        return None
    size = -(-(abs(base).bit_length() + 1) // 8)
    raw = abs(base) | (1 << 8 * size - 1 if base < 0 else 0)
    head = _header(2, width, len(values)) + bytes([(size - 1) << 5 | WIDTHS.index(patch_width), (gap_width - 1) << 5 | len(patches)])
    entry = closest(patch_width + gap_width)
    return head + raw.to_bytes(size, "big") + pack([v & (1 << width) - 1 for v in over], width) + pack([g << patch_width | p for g, p in patches], entry)


def _literals(values: list[int], signed: bool) -> bytes:
    found = _delta(values, signed)
    if found is not None and len(values) > 2:
        return found
    unsigned = [zigzag(v) for v in values] if signed else values
    direct = _direct(unsigned)
    if len(values) > 3 and all(-(1 << 63) <= v < 1 << 63 for v in values):
        patched = _patched(values)
        if patched is not None and len(patched) < len(direct):
            return patched
    return direct


def encode_ints(values: list[int], signed: bool = True) -> bytes:
    """Runs of at most 512 values: repeats where there are three or more, else the shortest of the others."""
    out, at, n = [], 0, len(values)
    held: list[int] = []

    def flush() -> None:
        if held:
            out.append(_literals(held, signed))
            held.clear()

    while at < n:
        end = at + 1
        while end < n and values[end] == values[at] and end - at < BLOCK:
            end += 1
        run = end - at
        if run >= 3 and not (held and run < 10 and len(held) + run <= BLOCK and _monotone(held, values, at, end)):
            flush()
            v = values[at]
            out.append(_short_repeat(zigzag(v) if signed else v, run) if run <= 10 else _delta(values[at:end], signed))
        else:
            for v in values[at:end]:
                held.append(v)
                if len(held) == BLOCK:
                    flush()
        at = end
    flush()
    return b"".join(out)


def _monotone(held: list[int], values: list[int], at: int, end: int) -> bool:
    """Whether a short repeat only goes on with a rising or falling run, which then need not end."""
    both = held[-8:] + values[at : min(len(values), end + 8)]
    return len(held) > 8 and (all(a <= b for a, b in zip(both, both[1:])) or all(a >= b for a, b in zip(both, both[1:])))


def decode_ints(data: bytes, signed: bool = True) -> list[int]:
    out: list[int] = []
    at = 0
    while at < len(data):
        first = data[at]
        kind = first >> 6
        if kind == 0:
            size, n = (first >> 3 & 7) + 1, (first & 7) + 3
            v = int.from_bytes(data[at + 1 : at + 1 + size], "big")
            out += [unzigzag(v) if signed else v] * n
            at += 1 + size
            continue
        code, n = first >> 1 & 31, ((first & 1) << 8 | data[at + 1]) + 1
        at += 2
        if kind == 1:
            values, at = unpack(data, at, n, WIDTHS[code])
            out += [unzigzag(v) for v in values] if signed else values
        elif kind == 3:
            base, at = read_varint(data, at)
            base = unzigzag(base) if signed else base
            delta, at = read_varint(data, at)
            delta = unzigzag(delta)
            if code == 0:
                out += [base + k * delta for k in range(n)]
                continue
            out += [base, base + delta][:n]
            rest, at = unpack(data, at, n - 2, WIDTHS[code])
            v = base + delta
            for d in rest:
                v += d if delta >= 0 else -d
                out.append(v)
        else:
            width, size, patch_width = WIDTHS[code], (data[at] >> 5) + 1, WIDTHS[data[at] & 31]
            gap_width, n_patches = (data[at + 1] >> 5) + 1, data[at + 1] & 31
            raw = int.from_bytes(data[at + 2 : at + 2 + size], "big")
            sign = 1 << 8 * size - 1
            base = -(raw ^ sign) if raw & sign else raw
            values, at = unpack(data, at + 2 + size, n, width)
            patches, at = unpack(data, at, n_patches, closest(gap_width + patch_width))
            k = 0
            for p in patches:
                k += p >> patch_width
                values[k] |= (p & (1 << patch_width) - 1) << width
            out += [base + v for v in values]
    return out


def encode_bytes(values: bytes) -> bytes:
    """A control byte of 0 to 127 repeats the next byte 3 to 130 times; -1 to -128 counts literals."""
    out, literal, at = bytearray(), bytearray(), 0

    def flush() -> None:
        for k in range(0, len(literal), 128):
            part = literal[k : k + 128]
            out.append(256 - len(part))
            out.extend(part)
        literal.clear()

    while at < len(values):
        end = at + 1
        while end < len(values) and values[end] == values[at] and end - at < 130:
            end += 1
        if end - at >= 3:
            flush()
            out += bytes([end - at - 3, values[at]])
        else:
            literal += values[at:end]
        at = end
    flush()
    return bytes(out)


def decode_bytes(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        control = data[at]
        if control < 128:
            out += data[at + 1 : at + 2] * (control + 3)
            at += 2
        else:
            n = 256 - control
            out += data[at + 1 : at + 1 + n]
            at += 1 + n
    return bytes(out)


def encode_bools(values) -> bytes:
    return encode_bytes(np.packbits(np.asarray(list(values), bool)).tobytes())


def decode_bools(data: bytes, n: int) -> list[bool]:
    return np.unpackbits(np.frombuffer(decode_bytes(data), np.uint8))[:n].astype(bool).tolist()


def encode_column(df: DataFrame, order: str, value: str, block: int = BLOCK, signed: bool = True) -> DataFrame:
    """block_no, n, present (bits of the null bitmap, run-length coded) and data of each block of rows.

    Blocks are consecutive places divided by their size. Rows are ranged over tasks by block, sorted in each and encoded as they
    stream by; a task holds a batch and the rows of the block that goes on in the next one.
    """

    def made(b: int, order: np.ndarray, values: pa.Array) -> tuple:
        there = values.is_valid().to_numpy(zero_copy_only=False)
        return b, int(order[0]), len(order), encode_bools(there), encode_ints(values.drop_null().to_pylist(), signed)

    def run(batches):
        held = None
        for batch in chain(batches, [None]):
            rows = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if rows is None or not rows.num_rows:
                continue
            numbers, order, values = rows.column("b").to_numpy(), rows.column("o").to_numpy(), rows.column("v").combine_chunks()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(numbers)) + 1, [len(numbers)]]).tolist()
            whole = cuts if batch is None else cuts[:-1]  # the last block may go on
            out = [made(int(numbers[x]), order[x:y], values.slice(x, y - x)) for x, y in zip(whole, whole[1:])]
            held = rows.slice(whole[-1])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["block_no", "first", "n", "present", "data"])

    rows = df.select(F.expr(f"`{order}` div {block}").alias("b"), F.col(order).cast("long").alias("o"), F.col(value).cast("long").alias("v"))
    return rows.repartitionByRange("b").sortWithinPartitions("b", "o").mapInArrow(run, "block_no long, first long, n int, present binary, data binary")


def decode_column(blocks: DataFrame, order: str, value: str, signed: bool = True) -> DataFrame:
    """The rows of encode_column again, places and values."""

    def run(batches):
        for batch in batches:
            places, there, out = [], [], []
            for first, n, present, data in zip(*(batch.column(c).to_pylist() for c in ("first", "n", "present", "data"))):
                places.append(np.arange(first, first + n))
                there.append(np.array(decode_bools(present, n), bool))
                out.append(np.array(decode_ints(data, signed), np.int64))
            there = np.concatenate(there) if there else np.empty(0, bool)
            values = np.zeros(len(there), np.int64)
            values[there] = np.concatenate(out) if out else values
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(places) if places else values), pa.array(values, mask=~there)], names=["o", "v"])

    return blocks.select("first", "n", "present", "data").mapInArrow(run, "o long, v long").toDF(order, value)
