"""Arithmetic on wide unsigned numbers as lists of limb columns, the lowest first, without leaving the JVM (but for unranking).

A limb holds `bits` bits of a BIGINT (60 at most, so that the carry of a sum stays in it).  Numbers wrap at their width, as those of a machine do; a shift
by the width or more gives 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

BITS = 60
#: Bits of a rank's limbs: sums of up to 2^13 binomials fit a BIGINT before they are carried.
RANK_BITS = 48


def _mask(bits: int, width: int, k: int) -> Column:
    """The bits that limb k of a number of that width has."""
    return F.lit((1 << min(bits, width - bits * k)) - 1)


def carried(limbs: list[Column], width: int, bits: int = BITS) -> list[Column]:
    """Limbs that may exceed their bits, or be negative, with what is over carried to the next one."""
    out, carry = [], F.lit(0).cast("long")
    for k, x in enumerate(limbs):
        total = x + carry
        out.append(total.bitwiseAND(_mask(bits, width, k)))
        carry = F.shiftright(total, bits)
    return out


def add(a: list[Column], b: list[Column], width: int, bits: int = BITS) -> list[Column]:
    return carried([x + y for x, y in zip(a, b, strict=True)], width, bits)


def subtract(a: list[Column], b: list[Column], width: int, bits: int = BITS) -> list[Column]:
    return carried([x - y for x, y in zip(a, b, strict=True)], width, bits)


def compare(a: list[Column], b: list[Column]) -> Column:
    """-1, 0 or 1, decided by the highest limb that differs."""
    out = F.lit(0)
    for x, y in zip(a, b, strict=True):
        out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
    return out


def trailing_zeros(a: list[Column], width: int, bits: int = BITS) -> Column:
    """Place of the lowest set bit; the width for 0."""
    out = F.lit(width)
    for k, x in reversed(list(enumerate(a))):
        out = F.when(x != 0, F.bit_count(x.bitwiseAND(-x) - 1) + bits * k).otherwise(out)
    return out.cast("int")


def _moved(a: list[Column], by: Column, k: int) -> Column:
    """Limb k (0 outside) of a."""
    out = F.lit(0).cast("long")
    for i, x in enumerate(a):
        out = F.when(by == k - i, x).otherwise(out)
    return out


def shift_left(a: list[Column], by: Column, width: int, bits: int = BITS) -> list[Column]:
    limbs, rest = F.floor(by / bits).cast("int"), (by % bits).cast("int")
    out = []
    for k in range(len(a)):
        # The low limb's part that leaves its limb: shifted right by bits - rest, in two steps, so that a shift by all bits gives 0.
        high, low = _moved(a, limbs, k), _moved(a, limbs, k - 1)
        kept = high.bitwiseAND(F.call_function("shiftright", F.lit((1 << bits) - 1), rest))
        out.append(F.call_function("shiftleft", kept, rest).bitwiseOR(F.shiftright(F.call_function("shiftright", low, bits - 1 - rest), 1)).bitwiseAND(_mask(bits, width, k)))
    return out


def shift_right(a: list[Column], by: Column, bits: int = BITS) -> list[Column]:
    limbs, rest = F.floor(by / bits).cast("int"), (by % bits).cast("int")
    out = []
    for k in range(len(a)):
        low, high = _moved(a, -limbs, k), _moved(a, -limbs, k + 1)
        carry = F.call_function("shiftleft", high.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), rest) - 1), bits - rest)
        out.append(F.call_function("shiftright", low, rest).bitwiseOR(carry))
    return out


def digits(a: list[Column], bits: int = BITS) -> Column:
    """Hexadecimal text, limb by limb, the highest first; bits: a multiple of 4."""
    return F.lower(F.concat(*[F.lpad(F.hex(x), bits // 4, "0") for x in reversed(a)]))


def _limbs(value: int, count: int, bits: int) -> list[int]:
    return [value >> bits * k & (1 << bits) - 1 for k in range(count)]


def rank_limbs(n2: int) -> int:
    """Limbs of the rank of any set of n2 squares."""
    return -(-max(1, comb(n2, n2 // 2).bit_length()) // RANK_BITS)


def _binomials(spark: SparkSession, n2: int) -> DataFrame:
    """sq, j and the limbs r0, r1, ... of C(sq, j), for j from 1 to sq + 1."""
    count = rank_limbs(n2)
    rows = [(s, j, *_limbs(comb(s, j), count, RANK_BITS)) for s in range(n2) for j in range(1, s + 2)]
    return spark.createDataFrame(rows, "sq int, j int, " + ", ".join(f"r{k} long" for k in range(count)))


def combinadic_ranks(c: DataFrame, n2: int) -> DataFrame:
    """cid, k and rank limbs (r0, the lowest, r1, ...) of sets (cid, sq): the sum over j of C(j-th smallest square, j)."""
    count = rank_limbs(n2)
    known = F.expr(f"if(sq < 0 or sq >= {n2}, raise_error('square outside 0 to {n2 - 1}'), sq)")
    nth = c.select("cid", known.alias("sq")).withColumn("j", F.row_number().over(W.partitionBy("cid").orderBy("sq")))
    sums = nth.join(F.broadcast(_binomials(c.sparkSession, n2)), ["sq", "j"]).groupBy("cid").agg(F.count("*").cast("int").alias("k"), *[F.sum(f"r{i}").alias(f"r{i}") for i in range(count)])
    return sums.select("cid", "k", *[x.alias(f"r{i}") for i, x in enumerate(carried([F.col(f"r{i}") for i in range(count)], RANK_BITS * count, RANK_BITS))])


@lru_cache(maxsize=1024)
def _binomials_of(j: int, n2: int) -> tuple[np.ndarray, np.ndarray]:
    """C(s, j) for each square s below n2, as rows of limbs, the highest first, and as their keys."""
    limbs = np.array([_limbs(comb(s, j), rank_limbs(n2), RANK_BITS)[::-1] for s in range(n2)], np.int64)
    return limbs, _keys(limbs)


def _keys(limbs: np.ndarray) -> np.ndarray:
    """Rows of limbs, the highest first, as bytes in the order of the numbers."""
    return np.ascontiguousarray(limbs, ">i8").view(f"S{8 * limbs.shape[1]}").ravel()


def _unranked(k: np.ndarray, rest: np.ndarray, n2: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, square) of each square of the sets of sizes k and ranks (rows of limbs, the highest first, which are used up)."""
    rows, squares = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for j in range(k.max(initial=0), 0, -1):
        at = np.flatnonzero(k >= j)
        limbs, keys = _binomials_of(j, n2)
        s = np.searchsorted(keys, _keys(rest[at]), side="right") - 1
        left = rest[at] - limbs[s]
        for i in range(left.shape[1] - 1, 0, -1):
            owed = left[:, i] < 0
            left[:, i] += owed * (1 << RANK_BITS)
            left[:, i - 1] -= owed
        rest[at] = left
        rows.append(at)
        squares.append(s.astype(np.int32))
    return np.concatenate(rows), np.concatenate(squares)


def combinadic_squares(ranks: DataFrame, n2: int) -> DataFrame:
    """cid and sq of sets by k and rank limbs: greedily the largest square whose binomial is not over the rest, k times.

    A batch's sets are searched together, by their j-th squares from the last to the first, in Arrow batches: this is the one step that leaves the JVM.
    """
    limbs = [f"r{i}" for i in reversed(range(rank_limbs(n2)))]

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = _unranked(b.column("k").to_numpy(), np.stack([b.column(x).to_numpy() for x in limbs], 1), n2)
            yield pa.record_batch([b.column("cid").take(pa.array(rows)), pa.array(found)], ["cid", "sq"])

    schema = StructType([ranks.schema["cid"], StructField("sq", IntegerType())])
    return ranks.select("cid", "k", *limbs).mapInArrow(squares, schema)
