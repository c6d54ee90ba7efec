"""Gapless running numbers in an order, without a sort in one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

#: Bits of a place within a partition in monotonically_increasing_id.
PLACE = 33


def running_numbers(df: DataFrame, order: list[str | Column], name: str = "id", start: int = 1) -> DataFrame:
    """df with a column of the numbers start, start + 1, ... of its rows in an order.

    Rows are dealt by ranges of the order, sorted within them and stored with their place; a count a range then gives each range's first
    number.  Only those counts, one a partition, reach the driver and are broadcast.  Rows that tie are numbered in any order, but once.
    """
    at = "_at"
    while at in df.columns or at == name:
        at = f"_{at}"
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    placed = stored(ordered, "numbered")
    part = F.shiftright(at, PLACE)
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy(part.alias("part")).count().collect())
    firsts, first = [], start
    for k, size in sizes:
        firsts.append((k, first))
        first += size
    offset = df.sparkSession.createDataFrame(firsts, f"{at}part long, {at}first long")
    number = F.col(f"{at}first") + F.col(at).bitwiseAND(F.lit((1 << PLACE) - 1))
    return placed.join(F.broadcast(offset), part == F.col(f"{at}part")).withColumn(name, number).select(*[c for c in df.columns if c != name], name)
