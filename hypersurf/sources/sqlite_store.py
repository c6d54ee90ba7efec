"""SQLite files of complexes as a Spark source and sink, one partition a file.

spark.read.format("sqlite_complexes").option("path", "a.db,b.db").option("table", "goodcplxs").load()

path: files, patterns or folders (their *.db), by commas.  With the option squares (of the cube) complexes are read in the form of
their table (form: surface, frontier, fixed or any) and come in the fixed form, null where they are not of that form; written ones go from
the fixed form to it.
"""

from __future__ import annotations

import glob
import os
import re
import sqlite3
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from ..functions import codecs

SCHEMA = "id bigint, cplx binary"


def _table(options: dict) -> str:
    name = options.get("table", "goodcplxs")
    if not re.fullmatch(r"\w+", name):
        raise ValueError(f"{name!r} is no table name")
    return name


def files(path: str) -> list[str]:
    """Database files that a path option names, in order; a file that is named and missing is an error."""
    out: list[str] = []
    for p in filter(None, path.split(",")):
        found = sorted(glob.glob(os.path.join(p, "*.db"))) if os.path.isdir(p) else sorted(glob.glob(p)) or [p]
        out += [f for f in found if f not in out]
    for f in out:
        if not os.path.exists(f):
            raise FileNotFoundError(f)
    return out


class File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.table = files(options["path"]), _table(options)
        self.n2, self.form = int(options.get("squares", 0)), options.get("form", "surface")

    def partitions(self) -> list[File]:
        return [File(p) for p in self.paths]

    def read(self, partition: File) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True) as db:
            for i, data in db.execute(f"SELECT id, cplx FROM {self.table} ORDER BY id"):
                yield i, data if not self.n2 else codecs.read_or_none(data, self.n2, self.form)


class Message(WriterCommitMessage):
    def __init__(self, draft: str):
        self.draft = draft


class Writer(DataSourceWriter):
    """Writes a file a task below the path; of a complex that a task meets several times the smallest id stays.

    Files are drafts until the whole write is committed: only then do those of an overwritten folder go, so a write that fails leaves what was there.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.table, self.overwrite = options["path"], _table(options), overwrite
        self.n2, self.form = int(options.get("squares", 0)), options.get("form", "surface")
        if os.path.isdir(self.path) and os.listdir(self.path) and not overwrite:
            raise FileExistsError(self.path)

    def write(self, rows: Iterator[Row]) -> Message:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        draft = f"{self.path}/part-{TaskContext.get().partitionId():05d}.db.{uuid.uuid4().hex}"
        with sqlite3.connect(draft) as db:
            db.execute(f"CREATE TABLE {self.table} (cplx BLOB PRIMARY KEY, id INTEGER)")
            db.executemany(f"INSERT INTO {self.table} VALUES (?, ?) ON CONFLICT DO UPDATE SET id = min(id, excluded.id)", ((self._form(bytes(r.cplx)), r.id) for r in rows))
        db.close()
        return Message(draft)

    def commit(self, messages: list[Message | None]) -> None:
        names = {m.draft: m.draft.rpartition(".")[0] for m in messages if m}
        for draft, name in names.items():
            os.replace(draft, name)
        for old in (os.listdir(self.path) if self.overwrite and os.path.isdir(self.path) else []):
            if old.endswith(".db") and f"{self.path}/{old}" not in names.values():
                os.remove(f"{self.path}/{old}")

    def abort(self, messages: list[Message | None]) -> None:
        for m in messages:
            if m and os.path.exists(m.draft):
                os.remove(m.draft)

    def _form(self, data: bytes) -> bytes:
        return codecs.FORMS[self.form](codecs.from_fixed(data), self.n2) if self.n2 else data


class SqliteComplexes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_complexes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteComplexes)


def merge(shards: DataFrame, into: DataFrame | None = None) -> DataFrame:
    """Complexes of shards (id, cplx), each once with its smallest id, that `into` lacks, in order of ids."""
    first = shards.groupBy("cplx").agg(F.min("id").alias("id")).select("id", "cplx")
    return (first if into is None else first.join(into.select("cplx"), "cplx", "left_anti").select("id", "cplx")).orderBy("id")


def split(goods: DataFrame, shards: int) -> DataFrame:
    """Complexes (id, cplx) dealt to partitions by a hash of the complex, a file each if they are written as SQLite."""
    return goods.repartitionById(shards, F.pmod(F.xxhash64("cplx"), F.lit(shards)).cast("int"))
