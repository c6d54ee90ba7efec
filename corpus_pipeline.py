"""The corpus pipeline: documents through five filters and encoders, each stage stored and read again.

Cases: toxicity keeps null and empty texts, which language rejects, as it does texts without letters; rows of one id but different texts are
judged one by one, up to decontamination, which rejects all rows of an id that leaks; of equal texts, and of equal rows, one row stays, but rows without an
id all do, as nothing tells them apart; long texts are read whole; an empty table gives no rows; all columns of the documents, whatever their
names, stay up to the last stage, which returns digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hypersurf.llm import decontaminate, language, minhash, pieces, toxicity
from hypersurf.llm.work import table, work_dir

STAGES = [
    ("toxicity", toxicity.keep_clean),
    ("language", language.keep_known),
    ("near_duplicates", minhash.keep_one),
    ("decontaminate", decontaminate.drop_contaminated),
    ("encode", pieces.encode_kept),
]

#: The first stages are trained models, which SQL can't state; tests/llm/test_queries.py holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet and read as the next stage's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
