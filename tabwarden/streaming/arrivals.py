"""Arriving CSV files, checked by the same rules as in batch.

A file source needs a fixed schema. ``arriving_rows`` takes files of one header; ``arriving_by_header`` takes
files of any header by position and names the cells by the header of their own file. Rows carry the
path of their file in ``__path`` and, when they have too few or too many fields, their text in
``__malformed``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tabwarden.functions.text import nullify
from tabwarden.model import DATASET_COLUMN, MALFORMED, PATH, Cde, Profile
from tabwarden.operators import tables
from tabwarden.operators.dictionary import primary_schema
from tabwarden.operators.row_checks import VIOLATION_COLUMNS, null_tokens_of, quoted, row_violations
from tabwarden.plans.validate import validate_rows
from tabwarden.sources.csv_text import header_lookup, read_headers, typed_columns, with_nulls

#: Column with the header of a file that no known column names describe.
FOREIGN = "__foreign"


def arriving_rows(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    files_per_batch: int | None = None,
    glob: str = "*.csv",
    *,
    multi_line: bool = False,
    any_header: bool = False,
) -> DataFrame:
    """Stream of text rows with the file that each comes from.

    A file with another header ends the query, unless ``any_header`` leaves headers to
    ``validate_then_commit``. ``multi_line`` reads line breaks inside quotes.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, MALFORMED]])
    reader = (
        spark.readStream.option("header", True)
        .option("escape", '"')
        .option("enforceSchema", any_header)
        .option("multiLine", multi_line)
        .option("maxColumns", max(20480, len(columns) + 1))
        .option("columnNameOfCorruptRecord", MALFORMED)
        .option("columnPruning", False)
        .option("pathGlobFilter", glob)
        .schema(schema)
    )
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(path).withColumn(PATH, F.col("_metadata.file_path"))


def arriving_by_header(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    width: int | None = None,
    files_per_batch: int | None = None,
    glob: str = "*.csv",
    *,
    multi_line: bool = False,
) -> DataFrame:
    """Stream of text rows of files with any header, the cells under the names of ``columns``.

    Rows are read by position, ``width`` cells each (as many as there are columns if not given). Each task
    opens a file that it reads once more for its header and looks the names up there, so layouts may come in
    any order and at any time. A column that a header lacks is null. A file whose header has another width
    or names outside ``columns`` is told in ``__foreign`` (its header), null for the others.
    """
    width = len(columns) if width is None else width
    cells = [f"__cell{i}" for i in range(width)]
    rows = arriving_rows(spark, path, cells, files_per_batch, glob, multi_line=multi_line, any_header=True)
    rows = rows.withColumn("__header", header_lookup()(F.col(PATH)))
    known = (F.size("__header") == width) & (F.size(F.array_except("__header", F.array(*map(F.lit, columns)))) == 0)
    known &= F.size(F.array_distinct("__header")) == width
    values = F.array(*cells)

    def under(name: str):
        place = F.array_position("__header", name).cast("int")
        return F.when(known & (place > 0), F.try_element_at(values, place))

    return rows.select(
        *(under(c).alias(c) for c in columns),
        F.when(known, quoted(MALFORMED)).alias(MALFORMED),
        F.when(~known, F.array_join("__header", ",")).alias(FOREIGN),
        PATH,
    )


def foreign_headers(rows: DataFrame) -> DataFrame:
    """One ``foreign_header`` violation per file, on a stream of ``arriving_by_header`` as long as it runs."""
    return (
        rows.where(F.col(FOREIGN).isNotNull())
        .select(F.col(PATH).alias("file"), F.col(FOREIGN).alias("value"))
        .dropDuplicates(["file"])
        .select(
            "file",
            F.lit(None).cast("string").alias("column"),
            F.lit("foreign_header").alias("rule"),
            "value",
            F.lit(None).cast("string").alias("detail"),
        )
    )


def arriving_violations(
    rows: DataFrame, cdes: Sequence[Cde], profile: Profile = Profile.FILE, row_keys: Sequence[str] = ()
) -> DataFrame:
    """Row rules on a stream; they keep no state. Rows of files with a foreign header are left out."""
    if FOREIGN in rows.columns:
        rows = rows.where(F.col(FOREIGN).isNull()).drop(FOREIGN)
    found = row_violations(rows, cdes, [PATH, *row_keys], profile)
    return found.select(F.col(PATH).alias("file"), *[quoted(k) for k in row_keys], *VIOLATION_COLUMNS)


def running_datasets(rows: DataFrame, profile: Profile = Profile.FILE) -> DataFrame:
    """Each dataset code once, when it is first seen. The state is the set of codes."""
    if FOREIGN in rows.columns:
        rows = rows.where(F.col(FOREIGN).isNull())
    codes = rows.select(nullify(F.col(DATASET_COLUMN), null_tokens_of(profile)).alias(DATASET_COLUMN))
    return codes.dropDuplicates([DATASET_COLUMN])


def validate_then_commit(
    rows: DataFrame,
    cdes: Sequence[Cde],
    valid_path: str,
    quarantine_path: str,
    *,
    profile: Profile = Profile.FILE,
    longitudinal: bool = False,
) -> DataStreamWriter:
    """Sink that takes a file as a whole or not at all.

    Rows of valid files go typed and padded to ``valid_path``, the violations of the others
    to ``quarantine_path``, a file with another header as ``foreign_header``. Each batch
    overwrites its own folder, so a replayed batch leaves the same files once. A file without
    rows commits nothing and breaks nothing.
    """
    target = T.StructType(primary_schema(list(cdes)).fields[1:] + [T.StructField(PATH, T.StringType())])
    columns = [c for c in rows.columns if c not in (PATH, MALFORMED)]

    def commit(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            headers = read_headers(batch.select(F.col(PATH).alias("file")).distinct())
            foreign = headers.where(F.col("columns") != F.array(*[F.lit(c) for c in columns])).select(
                "file",
                F.lit(None).cast("string").alias("column"),
                F.lit("foreign_header").alias("rule"),
                F.array_join("columns", ",").alias("value"),
                F.lit(",".join(columns)).alias("detail"),
            )
            ours = batch.join(foreign.select(F.col("file").alias(PATH)), PATH, "left_anti")
            found = validate_rows(ours, cdes, scope=(PATH,), profile=profile, longitudinal=longitudinal)
            found = found.withColumnRenamed(PATH, "file").unionByName(foreign)
            quarantine = f"{quarantine_path}/batch={batch_id}"
            found.write.mode("overwrite").parquet(quarantine)
            failed = batch.sparkSession.read.schema(found.schema).parquet(quarantine).select(F.col("file").alias(PATH)).distinct()
            good = batch.join(failed, PATH, "left_anti")
            typed = typed_columns(with_nulls(good, null_tokens_of(profile), columns), cdes)
            tables.pad_columns(typed, target).write.mode("overwrite").parquet(f"{valid_path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(commit)
