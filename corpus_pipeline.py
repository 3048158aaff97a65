"""A corpus pipeline: toxic documents go, frequent lines go, near copies go, leaked benchmark items go, and the rest is mixed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietgrid.llm import decontam, jobs, line_dedup, mixing, simhash, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the model learns from the labelled documents, all of them allowed."""
    model = toxicity.train_toxicity(docs, _table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.drop_toxic(docs, model, 0.7)


def drop_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in ten documents or more go; documents stay."""
    return line_dedup.drop_frequent_lines(docs, min_docs=10)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.drop_near_duplicates(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix_sources(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_frequent_lines),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaked),
    ("mixing", mix),
]

#: Toxicity scores and fingerprints cannot be stated in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """Removes a stage's table, which nothing reads any more."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet in the shared folder and read again; the last one's table stays.

    Ids may repeat or be null, texts may be null, empty or very long: rows of one id and different texts are
    different documents throughout.  Empty tables give empty results.  Columns beyond those of ``documents``
    pass through all stages but the last, whatever their names.
    """
    docs = _table(spark, sf_dir, "documents")
    folder = f"{jobs.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    return docs
