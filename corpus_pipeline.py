"""The corpus pipeline: toxicity, line dedup, near-dedup, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; all
but the last return the columns of ``documents``. Between stages the rows are written to
the shared folder and read again, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm.common import drop_table, write_table
from tarnwork.llm.linededup import dedup_lines
from tarnwork.llm.minhash import drop_near_duplicates
from tarnwork.llm.packing import pack
from tarnwork.llm.pii import sanitise
from tarnwork.llm.toxicity import drop_toxic

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, with the length of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return _columns(drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in the last of them only."""
    return _columns(dedup_lines(docs))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays."""
    return _columns(drop_near_duplicates(docs))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are generalised or removed."""
    return _columns(sanitise(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: which piece of which document goes where in which bin."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("pii", pii),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_table(docs)  # the stage before; nothing reads it any more
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # a trained classifier and packing are not SQL; tests hold run() against brute force
