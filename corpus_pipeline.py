"""A corpus pipeline of five stages.

``toxicity`` drops documents that the classifier calls toxic, ``near_duplicates`` leaves one of
each component of similar documents, ``decontamination`` drops documents that hold benchmark
passages, ``secrets`` puts marks in the place of secrets other than widely copied examples, ``packing``
lays what is left into bins. Each stage takes all that the one before it kept.

All stages take null ids and texts, empty texts, repeated rows and empty tables, and look at no other columns
than those of ``documents``. A null or empty text is not toxic (unless the base rate is), has no near
duplicates, is not contaminated, holds no secrets and takes no place in a bin. Repeated rows are one
component, so one of them stays; those without words all stay.

A stage's result may read scratch copies that the stage has made, so it must be written before the next stage is
called: each stage but the first removes what the stages before it left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwarden.llm import decontaminate, jaccard_join, packing, secret_scan, toxicity
from tabwarden.llm.common import ship_package
from tabwarden.session import persisted_copy, remove_scratch, scratch_scope

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, carry=COLUMNS).where("predicted = 0").select(*COLUMNS)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return jaccard_join.one_of_each(docs.select(*COLUMNS))


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=COLUMNS)
    return decontaminate.judged(found).where("NOT contaminated").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    scanned = secret_scan.scan_secrets(docs, carry=COLUMNS)
    redacted = secret_scan.redact(scanned, verdicts=("live", "other"))
    changed = F.when(F.size("found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return redacted.withColumn("n_chars", changed).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack_documents(docs)


_left: dict[str, list[str]] = {}


def _stage(function: Callable, first: bool = False) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The function, and the removal of the scratch copies of the stages before it."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _left.pop(spark.sparkContext.applicationId, [])
        if not first:
            remove_scratch(spark, left)
        with scratch_scope() as made:
            result = function(spark, docs, sf_dir)
        _left[spark.sparkContext.applicationId] = made
        return result

    return run_stage


STAGES = [
    ("toxicity", _stage(remove_toxic, first=True)),
    ("near_duplicates", _stage(remove_near_duplicates)),
    ("decontamination", _stage(remove_contaminated)),
    ("secrets", _stage(redact_secrets)),
    ("packing", _stage(pack)),
]

#: A trained classifier decides the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        result = stage(spark, docs, sf_dir)
        with scratch_scope() as written:
            docs = persisted_copy(result, f"pipeline-{name}")
        remove_scratch(spark, before)
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
