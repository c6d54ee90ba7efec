"""Accepted complexes as a bucketed table: each once, by its label, with the least id it came with.

The table is dealt into buckets by a hash of the label and sorted in them, so looking labels up in it moves only what is looked up, never
the table.  Complexes are staged, a folder a commit, and merged by insert-if-absent: a merge that is repeated, after a lost driver or by mistake, adds nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import folder

BUCKETS = 16


class GoodStore:
    """A table (label, id) of the session's catalog; buckets are fixed when it is made."""

    def __init__(self, spark: SparkSession, table: str, buckets: int = BUCKETS, schema: str = "label long"):
        if not re.fullmatch(r"\w+(\.\w+)?", table):
            raise ValueError(f"{table!r} is no table name")
        self.spark, self.table, self.buckets = spark, table, buckets
        if not spark.catalog.tableExists(table):
            self._write(spark.createDataFrame([], f"{schema}, id long"))

    def _write(self, rows: DataFrame) -> None:
        rows.write.format("parquet").bucketBy(self.buckets, "label").sortBy("label").mode("append").saveAsTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def stage(self, goods: DataFrame) -> str:
        """Stores (label, id) as they come; the folder is merged later, once or more."""
        path = folder(self.spark, "staged")
        goods.select("label", "id").write.parquet(path)
        return path

    def absent(self, goods: DataFrame) -> DataFrame:
        """label and least id of goods whose label the table lacks; only goods are moved."""
        dealt = goods.groupBy("label").agg(F.min("id").alias("id")).repartition(self.buckets, "label")
        return dealt.join(self.read().select("label").hint("merge"), "label", "left_anti")

    def merge(self, *staged: str) -> int:
        """Adds what the table lacks of staged folders; how many rows that were."""
        before = self.read().count()
        self._write(self.absent(self.spark.read.parquet(*staged)))
        self.spark.catalog.refreshTable(self.table)
        return self.read().count() - before

    def ordered(self) -> DataFrame:
        """The table in the order of ids."""
        return self.read().orderBy("id", "label")

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.table}")
