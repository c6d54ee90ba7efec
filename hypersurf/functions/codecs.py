"""Byte forms of complexes, for databases of earlier runs; stored tables rely on Parquet's own encodings.

A complex is a number whose bit i is square i.  Cubes of up to 6 dimensions are narrow: their forms have 32 bytes of room; wider
ones have as many bytes as their squares need, and 96 in the plain form.

plain: all bytes, the highest first.  fixed: one byte for each 8 squares, the highest first.
sparse: SPARSE, a mask of the non-zero bytes (bit 0 for the lowest; 4 bytes if narrow; lowest byte first), those bytes, the lowest first.
raw: RAW, then plain (narrow) or fixed (wide).
combinadic: COMBINADIC, the number k of squares, the length of the rank, the rank (highest byte first) of the k-set among all:
the sum over j of C(j-th smallest square, j).
gaps, for accepted narrow surfaces: the non-zero bytes, the lowest first, are read as one number; the distance of each of its set bits from the
one before it (of the first, its place plus 1) is a nibble, the lower half of a byte first; then the mask of the non-zero bytes, 4 bytes, the highest first.
listed, for accepted wide surfaces: the non-zero bytes, the lowest first, then their mask, the lowest byte first.
fallback: FALLBACK, then gaps (narrow) or listed (wide).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: First byte of each tagged form.
SPARSE, RAW, COMBINADIC, FALLBACK = 0xA1, 0xA2, 0xA3, 0xA4
#: Non-zero bytes up to which the adaptive form is sparse; squares up to which a cube is narrow; bytes of the plain forms.
SPARSE_MOST, NARROW, PLAIN, PLAIN_WIDE = 20, 240, 32, 96
#: Set bits that the 32 bytes of nibbles have room for.
GAPS_MOST = 64


def narrow(n2: int) -> bool:
    return n2 <= NARROW


def _room(n2: int) -> int:
    """Bytes that a presence mask speaks of."""
    return PLAIN if narrow(n2) else -(-n2 // 8)


def positions(value: int) -> list[int]:
    return [i for i in range(value.bit_length()) if value >> i & 1]


def to_fixed(value: int, n2: int) -> bytes:
    return value.to_bytes(max(1, -(-n2 // 8)), "big")


def from_fixed(data: bytes) -> int:
    return int.from_bytes(data, "big")


def to_plain(value: int, n2: int) -> bytes:
    return value.to_bytes(PLAIN if narrow(n2) else PLAIN_WIDE, "big")


def to_combinadic(value: int) -> bytes:
    at = positions(value)
    if len(at) > 255:
        raise ValueError("a combinadic form has at most 255 squares")
    rank = sum(comb(p, j) for j, p in enumerate(at, 1))
    body = rank.to_bytes(-(-rank.bit_length() // 8), "big")
    return bytes([COMBINADIC, len(at), len(body)]) + body


def from_combinadic(data: bytes) -> int:
    if len(data) < 3 or data[0] != COMBINADIC or len(data) != 3 + data[2]:
        raise ValueError("no combinadic form")
    rank, value, top = int.from_bytes(data[3:], "big"), 0, 1
    for j in range(data[1], 0, -1):
        p = max(j - 1, 0)
        while comb(p + top, j) <= rank:
            top *= 2
        low, high = p, p + top
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if comb(mid, j) <= rank else (low, mid)
        value |= 1 << low
        rank -= comb(low, j)
        top = 1
    return value


def _present(value: int, n2: int) -> tuple[bytes, int]:
    """(non-zero bytes, the lowest first; their mask)."""
    raw = value.to_bytes(_room(n2), "little")
    return bytes(b for b in raw if b), sum(1 << i for i, b in enumerate(raw) if b)


def _restore(payload: bytes, mask: int) -> int:
    at = positions(mask)
    if len(payload) != len(at):
        raise ValueError("the mask doesn't fit the bytes")
    return sum(b << 8 * i for i, b in zip(at, payload, strict=True))


def to_sparse(value: int, n2: int) -> bytes:
    payload, mask = _present(value, n2)
    return bytes([SPARSE]) + mask.to_bytes(-(-_room(n2) // 8), "little") + payload


def from_sparse(data: bytes, n2: int) -> int:
    head = 1 + -(-_room(n2) // 8)
    return _restore(data[head:], int.from_bytes(data[1:head], "little"))


def to_adaptive(value: int, n2: int) -> bytes:
    if len(_present(value, n2)[0]) <= SPARSE_MOST:
        return to_sparse(value, n2)
    return bytes([RAW]) + (to_plain(value, n2) if narrow(n2) else to_fixed(value, n2))


def to_gaps(value: int) -> bytes:
    payload, mask = _present(value, NARROW)
    at = positions(int.from_bytes(payload, "little"))
    if len(at) > GAPS_MOST:
        raise ValueError(f"the form of gaps has at most {GAPS_MOST} squares")
    nibbles = [b - a for a, b in zip([-1, *at], at, strict=False)]
    packed = sum(x << 4 * i for i, x in enumerate(nibbles))
    return packed.to_bytes(-(-len(nibbles) // 2), "little") + mask.to_bytes(4, "big")


def from_gaps(data: bytes) -> int:
    if data and data[-1] == 1 and not any(data[:-1]):
        return 1  # the first square alone, in the fixed form
    nibbles = [x for b in data[:-4] for x in (b & 15, b >> 4)]
    at, bits = -1, 0
    for x in nibbles:
        if not x:
            break
        at += x
        bits |= 1 << at
    mask = int.from_bytes(data[-4:], "big")
    return _restore(bits.to_bytes(PLAIN, "little").replace(b"\0", b""), mask)


def to_listed(value: int, n2: int) -> bytes:
    payload, mask = _present(value, n2)
    return payload + mask.to_bytes(-(-_room(n2) // 8), "little")


def from_listed(data: bytes, n2: int) -> int:
    head = -(-_room(n2) // 8)
    return _restore(data[: len(data) - head], int.from_bytes(data[len(data) - head :], "little"))


def encode_surface(value: int, n2: int) -> bytes:
    """The form of tables of accepted surfaces."""
    return to_gaps(value) if narrow(n2) else to_listed(value, n2)


def decode_surface(data: bytes, n2: int) -> int:
    return from_gaps(data) if narrow(n2) else from_listed(data, n2)


def encode_frontier(value: int, n2: int) -> bytes:
    """The form of tables of unfinished complexes."""
    return bytes([FALLBACK]) + encode_surface(value, n2) if value.bit_count() > 255 else to_combinadic(value)


def decode(data: bytes, n2: int) -> int:
    """Any tagged form, else that of accepted surfaces (for a wide cube also the fixed form, known by its length); empty bytes are no square.

    For tables of frontiers: a first byte can be a tag by chance in tables of accepted surfaces, which decode_surface reads.
    """
    if not data:
        return 0
    if data[0] == RAW and len(data) == 1 + (PLAIN if narrow(n2) else -(-n2 // 8)):
        return from_fixed(data[1:])
    if data[0] == SPARSE and len(data) >= 1 + -(-_room(n2) // 8):
        return from_sparse(data, n2)
    if data[0] == COMBINADIC:
        return from_combinadic(data)
    if data[0] == FALLBACK:
        return decode_surface(data[1:], n2)
    return from_fixed(data) if not narrow(n2) and len(data) == -(-n2 // 8) else decode_surface(data, n2)


#: Forms by name: (value, n2) to bytes.
FORMS: dict[str, Callable[[int, int], bytes]] = {
    "fixed": to_fixed, "plain": to_plain, "sparse": to_sparse, "adaptive": to_adaptive, "combinadic": lambda v, n2: to_combinadic(v), "surface": encode_surface, "frontier": encode_frontier,
}
READERS: dict[str, Callable[[bytes, int], int]] = {"fixed": lambda d, n2: from_fixed(d), "plain": lambda d, n2: from_fixed(d), "surface": decode_surface, "frontier": decode, "any": decode}


def read_or_none(data: bytes | None, n2: int, form: str) -> bytes | None:
    """The fixed form of bytes in a form; None where they are not of it."""
    try:
        return None if data is None else to_fixed(READERS[form](data, n2), n2)
    except (ValueError, OverflowError):
        return None


def encode_column(fixed: Column, n2: int, form: str) -> Column:
    """A form of a column of complexes in the fixed form, in Arrow batches."""
    to = FORMS[form]

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if x is None else to(from_fixed(x), n2) for x in s], dtype=object)

    return run(fixed)


def decode_column(data: Column, n2: int, form: str = "any") -> Column:
    """The fixed form of a column of complexes in another; bytes that are not of the form are null."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([read_or_none(x, n2, form) for x in s], dtype=object)

    return run(data)


def split_limbs(value: int, bits: int, limbs: int) -> list[int]:
    """Limbs of a wide integer, the most significant first: as a struct of longs they order as the number."""
    return [value >> bits * k & (1 << bits) - 1 for k in range(limbs - 1, -1, -1)]


def merge_limbs(limbs: list[int], bits: int) -> int:
    out = 0
    for x in limbs:
        out = out << bits | x
    return out


def limb_array(fixed: Column, n2: int) -> Column:
    """Limbs of 60 bits, the lowest first, of the fixed form (see operators/topology.py), without leaving the JVM."""
    digits = F.lpad(F.hex(fixed), 15 * -(-n2 // 60), "0")
    return F.array(*[F.conv(F.substring(digits, 15 * k + 1, 15), 16, 10).cast("long") for k in range(-(-n2 // 60) - 1, -1, -1)])


def limbs_fixed(limbs: Column, n2: int) -> Column:
    """The fixed form of an array of limbs."""
    size = -(-n2 // 60)
    digits = F.concat(*[F.lpad(F.hex(limbs[k]), 15, "0") for k in range(size - 1, -1, -1)])
    wanted = 2 * max(1, -(-n2 // 8))
    return F.unhex(F.substring(F.lpad(digits, max(wanted, 15 * size), "0"), max(wanted, 15 * size) - wanted + 1, wanted))


def spread_octal(value: Column) -> Column:
    """The binary digits of a number read as octal ones: each bit gets a lane of three."""
    return F.conv(F.bin(value), 8, 10).cast("long")


def octal_pattern(digits: Column) -> Column:
    """Digits as one number in base 8, the first one the highest."""
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, x: a * 8 + x)


def stable_order(values: Column) -> Column:
    """Places of the values of an array in ascending order; equal ones keep theirs."""
    pairs = F.transform(values, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def run_lengths(values: Column) -> Column:
    """How often each distinct value of an array occurs, in ascending order of the values."""
    return F.transform(F.array_sort(F.array_distinct(values)), lambda x: F.size(F.filter(values, lambda y: y == x)))


def fixed_column(mask: Column, n2: int) -> Column:
    """Fixed form of a BIGINT mask, without leaving the JVM."""
    return F.unhex(F.lpad(F.hex(mask), 2 * max(1, -(-n2 // 8)), "0"))


def combinadic_rank(c: DataFrame, most: int = 24) -> DataFrame:
    """cid, k and rank of the k-set of squares of complexes in long form; up to `most` squares in the cube, others raise."""
    nth = F.row_number().over(W.partitionBy("cid").orderBy("sq"))
    spark = c.sparkSession
    table = spark.createDataFrame([(p, j, comb(p, j)) for p in range(most) for j in range(1, most + 1)], "sq int, j int, c long")
    return c.withColumn("j", nth).join(F.broadcast(table), ["sq", "j"], "left").withColumn("c", F.coalesce("c", F.raise_error(F.lit(f"square outside 0 to {most - 1}")))).groupBy("cid").agg(F.count("*").cast("int").alias("k"), F.sum("c").alias("rank"))
