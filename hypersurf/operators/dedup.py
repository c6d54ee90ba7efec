"""Keep-first deduplication, insert-if-absent, pages and shards of tables of complexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of least order of each key: one hash aggregation instead of a join back of the minima."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in rest])


def insert_if_absent(new: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows of new whose key the target lacks."""
    return new.join(target.select(key), key, "left_anti")


def page(df: DataFrame, key: str, after: int, size: int) -> DataFrame:
    """The next rows by key: the filter is pushed to the scan, and order and limit are one top-k."""
    return df.where(F.col(key) > after).orderBy(key).limit(size)


def merge_shards(shards: list[DataFrame], key: str) -> DataFrame:
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    return out.orderBy(key)


def shard_of(key: str, shards: int):
    return F.pmod(F.col(key), F.lit(shards)).cast("int")
