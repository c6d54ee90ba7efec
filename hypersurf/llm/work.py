"""Shared storage, Arrow batching and table access for the operators of this folder."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text bytes that a Python step looks at together; a longer text is a step of its own.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder that the cluster names in spark.checkpoint.dir; a temporary one in local mode if it names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.getCheckpointDir():
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("on a cluster spark.checkpoint.dir must name a shared folder")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hypersurf-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark, schema = df.sparkSession, df.schema
    path = work_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def columns(df: DataFrame, more: str) -> StructType:
    """Schema of a step that adds columns to those of df."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def plain_names(docs: DataFrame) -> DataFrame:
    """docs with names of columns that clash with nothing, but for text."""
    return docs.toDF(*["text" if c == "text" else f"_{k}" for k, c in enumerate(docs.columns)])


def own_names(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, by its names, of a frame made from plain_names(docs)."""
    return df.select([F.col("text" if c == "text" else f"_{k}").alias(c) for k, c in enumerate(docs.columns)])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder's URI; a bare path is local."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def publish(uri: str, name: str, write) -> str:
    """Runs write(stream) into a file of a name of its own, then moves it to its final name.

    A repeated or speculative attempt replaces the file by one with the same bytes, so readers never see half a file.
    """
    store, base = open_fs(uri)
    store.create_dir(base, recursive=True)
    draft = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        write(out)
    store.move(draft, f"{base}/{name}")
    return f"{uri}/{name}"


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES, *more: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose values in a string or binary column, and in more such columns, have at most `most` bytes together."""
    sizes = [sum(x) for x in zip(*(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_pylist() for c in (column, *more)), strict=True)]
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def release() -> None:
    """Gives freed memory of a Python worker back, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_bytes(column: str = "text"):
    """UTF-8 bytes of a text, empty for null."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))
