"""The file format's number encodings as column expressions (generated JVM code, no Python).

Arguments are columns of 64-bit integers unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

#: Widths that an encoded run may have, by their 5-bit code.
WIDTHS = (*range(1, 25), 26, 28, 30, 32, 40, 48, 56, 64)
ALIGNED = (1, 2, 4, 8, 16, 24, 32, 40, 48, 56, 64)
#: Seconds from 1970 to 2015-01-01 UTC, where the format's timestamps begin.
TIMESTAMP_BASE = 1_420_070_400


def _long(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("long")


def zigzag(x: Column | str) -> Column:
    """Signed to unsigned with small values small: 0, -1, 1, -2 are 0, 1, 2, 3."""
    x = _long(x)
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(u: Column | str) -> Column:
    u = _long(u)
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-u.bitwiseAND(F.lit(1).cast("long")))


def bit_width(x: Column | str) -> Column:
    """Bits of an unsigned value; 0 has none."""
    x = _long(x)
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def _least_of(x: Column, steps: tuple[int, ...], values: tuple[int, ...]) -> Column:
    out = F.lit(values[-1])
    for step, value in reversed(list(zip(steps[:-1], values[:-1]))):
        out = F.when(x <= step, value).otherwise(out)
    return out


def closest_width(bits: Column) -> Column:
    """The least width that runs can have for values of so many bits."""
    return _least_of(bits, WIDTHS, WIDTHS)


def aligned_width(bits: Column) -> Column:
    return _least_of(bits, ALIGNED, ALIGNED)


def width_code(bits: Column) -> Column:
    """The 5-bit code of the closest width; of 0 bits it is 0."""
    return _least_of(bits, WIDTHS, tuple(range(32)))


def width_of_code(code: Column) -> Column:
    return F.element_at(F.array(*(F.lit(w) for w in WIDTHS)), code + 1)


def varint_length(x: Column | str, signed: bool = False) -> Column:
    """Bytes of a value in base 128, signed ones in zigzag."""
    return F.greatest(F.lit(1), F.ceil(bit_width(zigzag(x) if signed else x) / 7).cast("int"))


def varint_hex(x: Column | str, signed: bool = False) -> Column:
    """The bytes themselves, in hexadecimal: seven bits each, low ones first, the high bit if more follow."""
    u = zigzag(x) if signed else _long(x)
    n = varint_length(x, signed)
    byte = lambda i: F.call_function("shiftrightunsigned", u, (i * 7).cast("int")).bitwiseAND(F.lit(127).cast("long")) + F.when(i < n - 1, 128).otherwise(0)
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), "")


def varint_value(h: Column | str, signed: bool = False) -> Column:
    """The value of varint_hex's bytes."""
    h = F.col(h) if isinstance(h, str) else h
    byte = lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    part = lambda i: F.call_function("shiftleft", byte(i).bitwiseAND(F.lit(127).cast("long")), (i * 7).cast("int"))
    u = F.aggregate(F.sequence(F.lit(0), (F.length(h) / 2).cast("int") - 1), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(part(i)))
    return unzigzag(u) if signed else u


def nanos_scaled(n: Column | str) -> Column:
    """Nanoseconds with trailing zeros taken off: the low three bits count them, less one."""
    n = _long(n)
    text = n.cast("string")
    zeros = F.least(F.lit(8), F.length(text) - F.length(F.rtrim(text, F.lit("0"))))
    power = F.element_at(F.array(*(F.lit(10**k).cast("long") for k in range(9))), zeros + 1)
    short = F.shiftleft(((n - n % power) / power).cast("long"), 3)
    return F.when(n == 0, F.lit(0).cast("long")).when(n % 100 != 0, F.shiftleft(n, 3)).otherwise(short.bitwiseOR((zeros - 1).cast("long")))


def nanos_plain(s: Column | str) -> Column:
    s = _long(s)
    zeros = s.bitwiseAND(F.lit(7).cast("long")).cast("int")
    power = F.element_at(F.array(*(F.lit(10 ** (k + 1) if k else 1).cast("long") for k in range(8))), zeros + 1)
    return F.shiftrightunsigned(s, 3) * power


def date_days(d: Column | str) -> Column:
    d = F.col(d) if isinstance(d, str) else d
    return F.datediff(d.cast("date"), F.lit("1970-01-01").cast("date"))


def days_date(n: Column | str) -> Column:
    return F.date_from_unix_date(F.col(n) if isinstance(n, str) else n)


def utc_micros(ts: Column | str) -> Column:
    """Microseconds since 1970: of an instant, or of a time without zone read as UTC, in any session zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    million = F.lit(1_000_000).cast("long")
    clock = date_days(ts).cast("long") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60
    parts = clock * million + (F.extract(F.lit("SECOND"), ts) * million).cast("long")
    return F.when(F.typeof(ts) == "timestamp_ntz", parts).otherwise(F.unix_micros(ts.cast("timestamp")))


def timestamp_parts(ts: Column | str) -> Column:
    """struct(secs since 2015, nanos) of a timestamp."""
    us = utc_micros(ts)
    micros = F.pmod(us, F.lit(1_000_000).cast("long"))
    return F.struct(((us - micros) / 1_000_000 - TIMESTAMP_BASE).cast("long").alias("secs"), (micros * 1000).cast("long").alias("nanos"))


def present_byte(present: Column, position: Column) -> Column:
    """An aggregate: the byte of eight rows' null bits, the first row's the highest."""
    return F.sum(F.when(present, F.call_function("shiftleft", F.lit(1), (F.lit(7) - position).cast("int")).cast("long")).otherwise(F.lit(0).cast("long")))


def chunk_header(length: Column, original: Column) -> Column:
    """The three bytes before a compressed chunk, in hexadecimal: length * 2, odd if stored as it is."""
    v = length * 2 + F.when(original, 1).otherwise(0)
    part = lambda k: F.lpad(F.hex(F.shiftright(v, 8 * k).bitwiseAND(F.lit(255))), 2, "0")
    return F.lower(F.concat(part(0), part(1), part(2)))


def dictionary(df, column: str, code: str = "code"):
    """The sorted distinct values of a column and their codes.

    Codes are given over the distinct values alone, by ranges of them, never over the rows.
    """
    from ..operators.scan import with_row_no

    return with_row_no(df.select(column).where(F.col(column).isNotNull()).distinct(), [column], code).withColumn(code, F.col(code).cast("int"))


def dictionary_encode(df, column: str, code: str = "code"):
    """df with the codes of a column's values in their sorted dictionary; null has none."""
    own = dictionary(df, column, code).withColumnRenamed(column, "__value")
    return df.join(own, F.col(column) == F.col("__value"), "left").drop("__value")


def dictionary_decode(df, words, code: str, column: str):
    """Values of codes by a dictionary of column and code."""
    own = words.select(F.col(code).alias("__code"), F.col(column))
    return df.join(own, F.col(code) == F.col("__code"), "left").drop("__code")


def runs(df, order: str, value: str, least: int = 3, part_rows: int = 1 << 20):
    """Runs of at least ``least`` equal values in order: value, first place and length.

    Places must be consecutive numbers. A row begins a run if the row before it differs; ranges of
    places are windows of their own, and runs that cross their borders are put together after.
    """
    part = F.expr(f"`{order}` div {part_rows}")
    w = Window.partitionBy(part).orderBy(order)
    begins = F.coalesce(F.lag(value).over(w) != F.col(value), F.lit(True)).cast("int")
    own = df.select(order, value, part.alias("p"), F.sum(begins).over(w).alias("g")).groupBy("p", "g", value).agg(F.min(order).alias("st"), F.count(F.lit(1)).alias("ln"))
    # Runs that touch: a chain of runs of one value, each beginning where the last one ends.
    # Only the first and last run of a part can touch another part's.
    edge = Window.partitionBy("p")
    marked = own.select("*", F.min("g").over(edge).alias("lo"), F.max("g").over(edge).alias("hi"))
    inner = marked.where((F.col("g") != F.col("lo")) & (F.col("g") != F.col("hi"))).select(value, "st", "ln")
    order_w = Window.orderBy("st")  # at most two rows a part of a million places
    outer = marked.where((F.col("g") == F.col("lo")) | (F.col("g") == F.col("hi")))
    before = F.lag(F.struct(F.col(value).alias("v"), (F.col("st") + F.col("ln")).alias("e"))).over(order_w)
    new = F.coalesce((before["v"] != F.col(value)) | (before["e"] != F.col("st")), F.lit(True)).cast("int")
    joined = outer.select(value, "st", "ln", new.alias("new"))
    joined = joined.select(value, "st", "ln", F.sum("new").over(order_w).alias("c")).groupBy("c", value).agg(F.min("st").alias("st"), F.sum("ln").alias("ln")).select(value, "st", "ln")
    return inner.unionByName(joined).where(F.col("ln") >= least)
