"""Sharding: minimax contiguous partition of atomic groups.

Groups (rows with equal texts; null counts as the empty text) are ordered by their smallest id.  The smallest shard
capacity C is found for which a greedy walk needs at most n shards, each the longest run of whole groups of at most C
bytes; the corpus is cut where that walk cuts.  No group is ever split, so `bytes` is as equal as whole groups allow.

Scale: only (id, hash, size) are shuffled, never texts.  The driver keeps a histogram of at most CELLS cells of the running size and, for
the few stretches in which a cut can fall, up to EXACT ends of groups; stretches with more are split into finer cells
first, so the result is exact at any size.  Groups are stored before they are joined back to the rows, so that adaptive execution splits the rows
of a hot group over tasks; within shards rows are numbered by (group, id) through a global range sort (by id within a hot group) and per-partition
counts.

Cases: an empty table gives no rows; fewer groups than shards leave the last shards empty; rows with null ids sort
first in their group; repeated rows are separate rows of a group; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import materialise, partitions, table, text_bytes

#: Cells of a histogram and group ends that the driver holds at most.
CELLS, EXACT = 16_384, 200_000


def _offsets(sorted_df: DataFrame, value) -> dict[int, int]:
    """Sum of `value` over all partitions before each one of a stored, range-sorted table: one number a partition."""
    sums = {r[0]: r[1] for r in sorted_df.groupBy("part").agg(F.sum(value).cast("long")).collect()}
    before, out = 0, {}
    for p in sorted(sums):
        out[p] = before
        before += sums[p]
    return out


def _ranked(df: DataFrame, *keys: str) -> DataFrame:
    """df in key order over range partitions, stored, with `part` and the row's place `at` in it."""
    out = df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    return materialise(out.withColumn("at", at).withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1)), "sorted")


def _running(df: DataFrame) -> DataFrame:
    """Adds `end`, the running size through each group, to groups (ord, size) in order of ord."""
    groups = _ranked(df, "ord")
    offsets = _offsets(groups, "size")
    parts = len(offsets)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = 0, None
        for b in batches:
            part, size = b.column("part").to_numpy(), b.column("size").to_numpy()
            ends = np.empty(len(size), np.int64)
            for p in np.unique(part):
                own = part == p
                held = held if p == of else offsets[int(p)]
                ends[own] = held + np.cumsum(size[own])
                held, of = int(ends[own][-1]), p
            yield pa.RecordBatch.from_arrays([b.column("ord"), pa.array(ends)], ["ord", "end"])

    # Files of one range can be read by several tasks, so they are brought together and sorted again by place.
    return groups.repartitionByRange(max(1, parts), "part").sortWithinPartitions("part", "at").mapInArrow(add, "ord long, end long")


def capacity_cuts(ends: DataFrame, total: int, n_shards: int) -> list[int]:
    """The running sizes after which the greedy walk of the smallest feasible capacity cuts; ends: column `end`."""
    if not total:
        return [0] * n_shards
    width = -(-total // CELLS)
    cells = _cells(ends, width)
    while True:
        low, high = _search(lambda t: _before(cells, t)[0], total, n_shards), _search(lambda t: _before(cells, t)[1], total, n_shards)
        spans = _spans(cells, high, low, n_shards)
        inside = [c for c in cells if c[2] > 2 and any(c[0] <= b and a <= c[1] for a, b in spans)]
        if not inside:
            return _walk(lambda t: _before(cells, t)[0], low, n_shards, total)
        keep = F.lit(False)
        for a, b in _merged([(c[0], c[1]) for c in inside]):
            keep = keep | F.col("end").between(a, b)
        rest = [c for c in cells if c not in set(inside)]
        if sum(c[2] for c in inside) <= EXACT:
            cells = sorted(rest + [(e, e, 1) for (e,) in ends.where(keep).collect()])
        else:
            width = max(1, sum(c[1] - c[0] for c in inside) // CELLS)
            cells = sorted(rest + _cells(ends.where(keep), width))


def _cells(ends: DataFrame, width: int) -> list[tuple[int, int, int]]:
    """(first end, last end, ends) of each stretch of `width` of the running size."""
    key = F.floor(F.col("end") / F.lit(width)).alias("cell")
    return sorted(tuple(r)[1:] for r in ends.groupBy(key).agg(F.min("end"), F.max("end"), F.count("*")).collect())


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and len(out) > 64:  # a long list of ranges makes a slow filter; a wider one is still right
            out[-1] = (out[-1][0], max(out[-1][1], b))
        elif out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _before(cells: list[tuple[int, int, int]], target: int) -> tuple[int, int]:
    """Bounds of the last end that is at most target."""
    i = bisect_right(cells, (target, float("inf"), 0)) - 1
    if i < 0:
        return 0, 0
    first, last, count = cells[i]
    if last <= target:
        return last, last
    return (first, first) if count == 2 else (first, min(target, last))


def _walk(before: Callable[[int], int], capacity: int, n_shards: int, total: int) -> list[int]:
    at, out = 0, []
    for _ in range(n_shards):
        at = total if total - at <= capacity else before(at + capacity)
        out.append(at)
    return out


def _search(before: Callable[[int], int], total: int, n_shards: int) -> int:
    low, high = -(-total // n_shards), total
    while low < high:
        mid = (low + high) // 2
        if _walk(before, mid, n_shards, total)[-1] == total:
            high = mid
        else:
            low = mid + 1
    return low


def _spans(cells: list, least: int, most: int, n_shards: int) -> list[tuple[int, int]]:
    """Where the walk of any capacity between least and most can look for its cuts."""
    a = b = 0
    out = []
    for _ in range(n_shards):
        out.append((a + least, b + most))
        a, b = _before(cells, a + least)[0], _before(cells, b + most)[1]
    return out


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard and slot (place in the shard, gapless from 0) of every row."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body"))
    rows = materialise(own.select("doc_id", F.sha2("body", 256).alias("group"), (F.octet_length("body") + 1).cast("long").alias("size"), F.crc32("body").alias("text_crc32")), "rows")
    groups = rows.groupBy("group").agg(F.coalesce(F.min("doc_id"), F.lit(-(1 << 62))).alias("first"), F.sum("size").alias("size"))
    # The group's order key must be unique: ids can repeat, so the group's hash breaks ties.
    groups = materialise(groups.select("group", F.struct("first", "group").alias("key"), "size"), "groups")
    numbered = _numbered(groups)
    ends = materialise(_running(numbered.select("ord", "size")), "ends")
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long")).first()[0]
    cuts = capacity_cuts(ends.select("end"), total, n_shards)
    ords = ends.where(F.col("end").isin(sorted(set(cuts) - {0}))).select("end", "ord").collect()
    last = {r["end"]: r["ord"] for r in ords} | {0: -1}
    bounds = [last[c] for c in cuts]
    placed = _ranked(rows.join(numbered.select("group", "ord"), "group").select("doc_id", "size", "text_crc32", "ord"), "ord", "doc_id")
    index = _place(placed)
    shard_no = sum((F.when(F.col("ord") > b, 1).otherwise(0) for b in bounds[:-1]), F.lit(0)).cast("int")
    counts = {r[0]: r[1] for r in placed.groupBy(shard_no).count().collect()}
    starts = [0, *accumulate(counts.get(k, 0) for k in range(n_shards))][:n_shards]
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("shard") + 1)
    return placed.withColumn("shard", shard_no).select("doc_id", "size", "text_crc32", "shard", (index - start).alias("slot"))


def _numbered(groups: DataFrame) -> DataFrame:
    """Groups with `ord`, their place by key from 0."""
    ranked = _ranked(groups, "key")
    return materialise(ranked.select("group", "size", _place(ranked).alias("ord")), "numbered")


def _place(ranked: DataFrame):
    """A row's place over all partitions of a table from _ranked."""
    offsets = _offsets(ranked, F.lit(1))
    if not offsets:
        return F.lit(0).cast("long")
    return F.col("at") + F.element_at(F.array(*[F.lit(offsets.get(p, 0)).cast("long") for p in range(max(offsets) + 1)]), (F.col("part") + 1).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
