"""Tables of a cube's cells as Parquet, made once and checked when they are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..operators import cells

VERSION = 1
TABLES: dict[str, Callable[[SparkSession, int], DataFrame]] = {
    "cells": cells.cells, "square_edges": cells.square_edges, "edge_vertices": cells.edge_vertices, "square_vertices": cells.square_vertices, "vertex_neighbors": cells.vertex_neighbors, "link_cycles": cells.link_cycles,
}


def write_cells(spark: SparkSession, n: int, path: str) -> None:
    """Writes the tables of the n-cube below path, and last what they are for; a table that is there is replaced."""
    for name, make in TABLES.items():
        make(spark, n).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(VERSION, n, *cells.sizes(n))], "version int, n int, n0 int, n1 int, n2 int").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def read_cells(spark: SparkSession, n: int, path: str) -> dict[str, DataFrame]:
    """The tables of the n-cube; made anew where they are missing, broken, or of another version or cube."""
    try:
        about = spark.read.parquet(f"{path}/about").collect()
        good = [tuple(r) for r in about] == [(VERSION, n, *cells.sizes(n))] and spark.read.parquet(f"{path}/cells").count() == 3**n
    except Exception as e:  # a broken file ends the job that reads it
        if not isinstance(e, AnalysisException):
            print(f"cells below {path} can't be read and are made anew")
        good = False
    if not good:
        write_cells(spark, n, path)
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}

