"""Byte-level expressions: everything here is built-in functions, evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MERSENNE61 = (1 << 61) - 1
KR_BASE = (1 << 16) - 39  # fixed value: the base of the rolling fingerprint
PREFIX_BASE = 256


def as_bytes(text: Column | str) -> Column:
    """UTF-8 bytes of a string column; a null stays null."""
    return F.encode(F.col(text) if isinstance(text, str) else text, "UTF-8")


def byte_value(one: Column) -> Column:
    """0..255 of a one-byte binary."""
    return F.conv(F.hex(one), 16, 10).cast("int")


def slices(data: Column, size: int, step: int = 1) -> Column:
    """All size-byte slices at every step-th position (none if the data is shorter)."""
    last = F.octet_length(data) - size
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda p: F.substr(data, p + 1, F.lit(size)))


def blocks(rows: DataFrame, data: str, window: int, key: str = "doc_id") -> DataFrame:
    """key, block_no, offset, bytes: tumbling windows of ``window`` bytes; the last may be short.
    Bytes are sliced inside the array function, so the whole text is not copied to each row."""
    n = F.octet_length(data)
    count = F.when(n > 0, F.ceil(n / window).cast("int")).otherwise(0)
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    cut = F.transform(numbers, lambda i: F.struct(i.alias("block_no"), (i.cast("long") * window).alias("offset"), F.substr(F.col(data), i * window + 1, F.lit(window)).alias("bytes")))
    return rows.select(key, F.explode(cut).alias("b")).select(key, "b.*")


def byte_rows(rows: DataFrame, data: str, *keys: str) -> DataFrame:
    """keys, pos (from 0), byte (0..255): one row for each byte."""
    return rows.select(*keys, F.posexplode(slices(F.col(data), 1)).alias("pos", "one")).select(*keys, F.col("pos").cast("long").alias("pos"), byte_value(F.col("one")).alias("byte"))


def mod61(value: Column) -> Column:
    return F.pmod(value, F.lit(MERSENNE61).cast("decimal(38,0)")).cast("decimal(38,0)")


def mulmod61(a: Column, b: Column) -> Column:
    """a * b mod 2**61 - 1; the product of two numbers below 2**61 fits decimal(38,0)."""
    return mod61((a.cast("decimal(19,0)") * b.cast("decimal(19,0)")).cast("decimal(38,0)"))


def fingerprint(values: Column, base: int = KR_BASE) -> Column:
    """Karp-Rabin fingerprint of an array of byte values (decimal(38,0))."""
    zero = F.lit(0).cast("decimal(38,0)")
    return F.aggregate(values, zero, lambda h, x: mod61((h.cast("decimal(19,0)") * F.lit(base).cast("decimal(18,0)") + x.cast("decimal(19,0)")).cast("decimal(38,0)")))


def printable(byte: Column) -> Column:
    """'x' for a printable character, else 0xHH."""
    return F.when(byte.between(32, 126), F.concat(F.lit("'"), F.chr(byte), F.lit("'"))).otherwise(F.concat(F.lit("0x"), F.lpad(F.hex(byte.cast("long")), 2, "0")))


def bit_width(value: Column) -> Column:
    """Bits of a non-negative integer's binary form; 0 for 0."""
    return F.when(value <= 0, 0).otherwise(F.length(F.bin(value.cast("long")))).cast("int")
