"""CSV trees: listing, header probe, scans that read every column as text."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwarden.functions.text import nullify, typed
from tabwarden.model import MALFORMED, Cde
from tabwarden.operators.row_checks import quoted
from tabwarden.sources import tree

FILE = "file"


def list_files(spark: SparkSession, root: str, file_glob: str = "*.csv") -> DataFrame:
    """Files below ``root`` as ``(file, folder, bytes)``, whatever their names; no content is read."""
    hidden_folders, hidden_files, is_file = tree.hidden_entries(spark, root, file_glob)
    path = F.col("_metadata.file_path")
    hidden = spark.createDataFrame(hidden_files, "file string, bytes bigint")
    hidden = hidden.select(FILE, folder_of(F.col(FILE)).alias("folder"), "bytes")
    if is_file:
        return hidden  # the reader would refuse it
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", file_glob)
        .load([root, *hidden_folders])
        .select(path.alias(FILE), folder_of(path).alias("folder"), F.col("length").alias("bytes"))
    )
    return listed.unionByName(hidden) if hidden_files else listed


def reader_path(spark: SparkSession, file: str) -> str:
    """What the readers take for a listed file. The listing encodes names as in URLs, the readers take
    them plain and expand patterns; of a hidden file they take the copy."""
    return tree.copy_of(spark, file) or re.sub(r"([{}\[\]*?\\])", r"\\\1", unquote(file))


def folder_of(path):
    return F.regexp_replace(path, "/[^/]*$", "")


def pair_with_dictionaries(files: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """Each file with the dictionary of its own folder; ``model_key`` is null without one."""
    homes = dictionaries.select("model_key", folder_of(F.col("model_key")).alias("folder"))
    return files.join(homes, "folder", "left")


def read_headers(files: DataFrame) -> DataFrame:
    """First record of each file as ``(file, columns)``.

    Each task opens its own files and stops after the first record, so the cost grows with
    the number of files and not with their size.
    """
    return files.select(FILE).mapInPandas(_header_probe(), "file string, columns array<string>")


def header_rows(headers: DataFrame) -> DataFrame:
    """Headers as rows ``(file, position, column)``, positions from 0."""
    return headers.select(FILE, F.posexplode("columns").alias("position", "column"))


def quoted_newline_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files in which a quoted field goes over the end of its line.

    Such a field leaves a line with an odd number of quotes, which a split-parallel text
    scan sees. Only these files need the reader that takes a file as a whole.
    """
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    path = tree.told_path(spark, F.col("_metadata.file_path"), paths)
    return (
        spark.read.text(list(paths))
        .where(quotes % 2 == 1)
        .select(path.alias(FILE))
        .distinct()
    )


def scan_text(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Sequence[str],
    *,
    multi_line: bool = False,
    flag_malformed: bool = False,
    path_column: str = FILE,
) -> DataFrame:
    """Scan files of one layout; every column is text, plus the file it comes from.

    The path stands in ``path_column``, which should be no name of the header.

    Spark matches the columns by position, so all paths must have exactly this header.
    With ``flag_malformed`` a row with too few or too many fields carries its text in
    ``__malformed``.
    """
    fields = [T.StructField(c, T.StringType()) for c in columns]
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    reader = reader.option("maxColumns", max(20480, len(fields) + 1))
    if flag_malformed:
        fields.append(T.StructField(MALFORMED, T.StringType()))
        # A pruned parse does not count the fields of a row.
        reader = reader.option("columnNameOfCorruptRecord", MALFORMED).option("columnPruning", False)
    source = [paths] if isinstance(paths, str) else list(paths)
    path = tree.told_path(spark, F.col("_metadata.file_path"), source)
    return reader.schema(T.StructType(fields)).csv(source).withColumn(path_column, path)


def scan_positions(spark: SparkSession, paths: Sequence[str], width: int, *, multi_line: bool = False) -> DataFrame:
    """Scan files whose headers have ``width`` columns as ``(file, cells)``, cells by position.

    One cell more holds the text of a row with too few or too many fields.
    """
    names = [*(f"c{i}" for i in range(width)), MALFORMED]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("maxColumns", max(20480, width + 1))
        .option("columnNameOfCorruptRecord", MALFORMED)
        .option("columnPruning", False)
        .schema(schema)
        .csv(list(paths))
        .select(tree.told_path(spark, F.col("_metadata.file_path"), paths).alias(FILE), F.array(*names).alias("cells"))
    )


def with_nulls(df: DataFrame, tokens: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Null tokens of the given columns turned into nulls."""
    names = df.columns if columns is None else columns
    return df.withColumns({n: nullify(quoted(n), tokens) for n in names})


def typed_columns(df: DataFrame, cdes: Sequence[Cde]) -> DataFrame:
    """Text columns cast to their declared types; other columns stay as they are."""
    types = {c.code: c.sql_type for c in cdes}
    return df.select(
        *[typed(quoted(n), types[n]).alias(n) if n in types else quoted(n) for n in df.columns]
    )


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    """Write the frame as CSV files with a header that ``scan_text`` reads back."""
    writer = df.write.mode(mode).option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def _first_record() -> Callable[[str], list[str]]:
    """The probe of one file as a local function, which goes to the executors by value.

    So they need no copy of this package.
    """

    def first_record(path: str) -> list[str]:
        from pyarrow import fs

        url = urlparse(path)
        if url.scheme in ("", "file"):
            store, name = fs.LocalFileSystem(), unquote(url.path)
        else:
            scheme = {"s3a": "s3", "s3n": "s3"}.get(url.scheme, url.scheme)
            store, name = fs.FileSystem.from_uri(f"{scheme}://{url.netloc}{unquote(url.path)}")
        with store.open_input_stream(name) as stream:
            text = io.TextIOWrapper(stream, encoding="utf-8-sig", newline="")
            return next((record for record in csv.reader(text) if record), [])

    return first_record


def _header_probe() -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    first_record = _first_record()

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {"file": batch["file"], "columns": [first_record(path) for path in batch["file"]]}
            )

    return probe


def header_lookup():
    """A function column: the first record of the file under a path, opened once per task and file."""
    first_record = _first_record()

    def lookup(paths: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[str]] = {}
        for batch in paths:
            for path in batch.unique():
                if path not in known:
                    known[path] = first_record(path)
            yield batch.map(known)

    lookup.__annotations__ = {"paths": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(lookup, "array<string>")
