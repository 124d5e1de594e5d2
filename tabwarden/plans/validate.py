"""Whole validations: one text frame, or a folder of dictionaries and CSV files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwarden.functions.text import nullify
from tabwarden.model import (
    DATASET_COLUMN,
    DICTIONARY_FILE,
    PATH,
    SUBJECT_COLUMN,
    VISIT_COLUMN,
    Cde,
    ErrorClass,
    Profile,
)
from tabwarden.operators import dictionary_rules, headers, keys, membership, reports
from tabwarden.operators.dictionary import compile_cdes
from tabwarden.operators.row_checks import (
    VIOLATION_COLUMNS,
    cell_violations,
    null_tokens_of,
    quoted,
    row_violations,
)
from tabwarden.session import persisted_copy
from tabwarden.sources import csv_text, tree
from tabwarden.sources.dictionaries import (
    flatten_dictionaries,
    parse_dictionaries,
    read_dictionaries,
)

# Up to so many layouts each gets a plan with its constraints compiled in; more go
# through one plan in which the constraints are data. Both give the same results.
COMPILED_LAYOUTS = 32


def validate_rows(
    df: DataFrame,
    cdes: Sequence[Cde],
    *,
    row_keys: Sequence[str] = (),
    scope: Sequence[str] = ("file",),
    profile: Profile = Profile.FILE,
    longitudinal: bool = False,
    key_columns: DataFrame | None = None,
) -> DataFrame:
    """All violations of text rows of one layout: ``(scope, row keys, column, rule, value, detail)``.

    Row rules share one narrow scan; repeated keys and dataset codes read two or three
    columns each, from ``key_columns`` if that is a cheaper scan of the same rows, and are
    counted on the map side first.
    """
    shape = [*scope, *row_keys, *VIOLATION_COLUMNS]
    found = [row_violations(df, cdes, [*scope, *row_keys], profile, longitudinal)]
    cross = _cross_row_frame(df if key_columns is None else key_columns, scope, profile)
    if longitudinal:
        found.append(keys.key_violations(cross, scope=scope))
    if DATASET_COLUMN in df.columns:
        codes = next((c.codes for c in cdes if c.code == DATASET_COLUMN), None) or ()
        datasets = membership.distinct_datasets(cross, scope)
        known = F.col(DATASET_COLUMN).isin(*codes) if codes else F.lit(False)
        unknown = datasets.where(F.col(DATASET_COLUMN).isNull() | ~known)
        found.append(membership.membership_violations(unknown, scope))
    else:
        files = df.select(*scope).distinct()
        found.append(
            files.select(
                *scope,
                F.lit(DATASET_COLUMN).alias("column"),
                F.lit("missing_dataset_column").alias("rule"),
                F.lit(None).cast("string").alias("value"),
                F.lit(None).cast("string").alias("detail"),
            )
        )
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    return merged.select(*shape)


def _cross_row_frame(df: DataFrame, scope: Sequence[str], profile: Profile) -> DataFrame:
    """Only the columns that rules across rows need, null tokens as nulls."""
    wanted = [c for c in (DATASET_COLUMN, SUBJECT_COLUMN, VISIT_COLUMN) if c in df.columns]
    tokens = null_tokens_of(profile)
    return df.select(*scope, *[nullify(quoted(c), tokens).alias(c) for c in wanted])


@dataclass(frozen=True)
class Layout:
    """Files of one model with exactly the same header."""

    model_key: str
    columns: tuple[str, ...]
    multi_line: bool
    paths: tuple[str, ...]


@dataclass
class FolderCheck:
    """Result of a folder validation, all lazy except the folder's own structure."""

    dictionaries: DataFrame
    dictionary_violations: DataFrame
    files: DataFrame
    violations: DataFrame
    models: DataFrame
    cdes: DataFrame
    layouts: list[Layout]
    compiled: dict[str, list[Cde]]
    longitudinal: set[str]
    staged: dict[Layout, DataFrame]

    def verdicts(self) -> DataFrame:
        """One row per dictionary and per CSV file.

        Files of a folder without a dictionary count as valid with a warning; files under
        a broken dictionary are not judged and fail with it.
        """
        shape = ["kind", "path", "is_valid", "first_rule", "first_column", "error_class", "n_violations"]
        dictionaries = self.dictionaries.select(
            F.lit("dictionary").alias("kind"),
            F.col("model_key").alias("path"),
            "is_valid",
            "first_rule",
            F.col("first_code").alias("first_column"),
            "error_class",
            "n_violations",
        )
        invalid = self.dictionaries.where("NOT is_valid").select("model_key").withColumn("__bad", F.lit(True))
        judged = reports.file_verdicts(self.files, self.violations).join(invalid, "model_key", "left")
        orphan, under_bad = F.col("model_key").isNull(), F.col("__bad").isNotNull()
        files = judged.select(
            F.lit("file").alias("kind"),
            F.col("file").alias("path"),
            (F.col("is_valid") & ~under_bad).alias("is_valid"),
            F.when(orphan, "no_dictionary")
            .when(under_bad, "invalid_dictionary")
            .otherwise(F.col("first_rule"))
            .alias("first_rule"),
            "first_column",
            F.when(orphan, str(ErrorClass.WARNING))
            .when(under_bad, str(ErrorClass.DATA_MODEL))
            .otherwise(F.col("error_class"))
            .alias("error_class"),
            "n_violations",
        )
        return dictionaries.select(*shape).unionByName(files.select(*shape))


def check_folder(
    spark: SparkSession,
    root: str,
    *,
    profile: Profile = Profile.FILE,
    dictionary_glob: str = DICTIONARY_FILE,
    csv_glob: str = "*.csv",
    quoted_newlines: str = "detect",
    compiled_layouts: int = COMPILED_LAYOUTS,
    stage: bool = False,
) -> FolderCheck:
    """Validate every dictionary below ``root`` and the CSV files next to it.

    Reads the dictionaries and the headers at once, since the plans depend on them; the
    CSV rows are read when a result is used. ``quoted_newlines``: "detect" looks in a
    split-parallel pass which files need the reader that takes a file as a whole,
    "never" and "always" skip that pass. ``stage`` writes the text of each layout as a
    columnar table first, for a load that reads it again and again.
    """
    models, cdes = structure(spark, root, dictionary_glob)
    files = csv_text.pair_with_dictionaries(csv_text.list_files(spark, root, csv_glob), models)
    return check_files(
        spark,
        files,
        models,
        cdes,
        profile=profile,
        quoted_newlines=quoted_newlines,
        compiled_layouts=compiled_layouts,
        stage=stage,
    )


def check_files(
    spark: SparkSession,
    listed: DataFrame,
    models: DataFrame,
    cdes: DataFrame,
    *,
    profile: Profile = Profile.FILE,
    quoted_newlines: str = "detect",
    compiled_layouts: int = COMPILED_LAYOUTS,
    stage: bool = False,
) -> FolderCheck:
    """Validate files ``(file, folder, bytes, model_key)`` against models that are read already."""
    broken = persisted_copy(dictionary_rules.dictionary_violations(models, cdes), "dictionary-violations")
    dictionaries = dictionary_rules.dictionary_verdict(models, broken)
    files = persisted_copy(
        listed.join(models.select("model_key", "longitudinal"), "model_key", "left").join(
            csv_text.read_headers(listed), "file", "left"
        ),
        "files",
    )
    judged = files.join(dictionaries.where("is_valid").select("model_key"), "model_key", "left_semi")
    header = judged.select("file", "model_key", F.posexplode("columns").alias("position", "column"))
    found = headers.header_violations(judged, header, cdes).withColumns(
        {"value": F.lit(None).cast("string"), "detail": F.lit(None).cast("string")}
    )
    bad_headers = persisted_copy(found.select("file", "model_key", *VIOLATION_COLUMNS), "header-violations")
    readable = judged.join(bad_headers.select("file"), "file", "left_anti")
    layouts = _layouts(spark, readable, quoted_newlines)
    compiled = compile_cdes(cdes.join(readable.select("model_key").distinct(), "model_key", "left_semi"))
    longitudinal = {r["model_key"] for r in models.where("longitudinal").select("model_key").collect()}
    staged = {}
    if stage:
        staged = {x: persisted_copy(scan_layout(spark, x, flag_malformed=True), "staged") for x in layouts}
    if not layouts:
        violations = bad_headers
    elif stage or len(layouts) <= compiled_layouts:
        parts = [
            _layout_violations(
                spark, x, compiled[x.model_key], x.model_key in longitudinal, profile, staged.get(x)
            )
            for x in layouts
        ]
        violations = reduce(DataFrame.unionByName, parts, bad_headers)
    else:
        violations = bad_headers.unionByName(_all_layouts(spark, layouts, readable, cdes, profile))
    return FolderCheck(
        dictionaries, broken, files.drop("columns"), violations, models, cdes, layouts, compiled, longitudinal, staged
    )


def structure(spark: SparkSession, root: str, dictionary_glob: str = DICTIONARY_FILE) -> tuple[DataFrame, DataFrame]:
    """Models and variables of all dictionaries below ``root``, written once and read back.

    The files themselves are opened once, and their texts laid together: later passes open as many files as there were tasks.
    """
    texts = read_dictionaries(spark, root, dictionary_glob).coalesce(4 * spark.sparkContext.defaultParallelism)
    parsed = parse_dictionaries(persisted_copy(texts, "dictionaries"))
    models = persisted_copy(parsed.drop("node"), "models")
    cdes = persisted_copy(flatten_dictionaries(parsed), "cdes")
    return models, cdes


def _layouts(spark: SparkSession, readable: DataFrame, quoted_newlines: str) -> list[Layout]:
    """Group the files by model and exact header; the driver holds the list of files.

    The driver holds as much for any scan: the paths and sizes of its files.
    """
    rows = readable.select("file", "model_key", "columns").orderBy("file").collect()
    paths = {row["file"] for row in rows}
    tree.copy_hidden(spark, sorted(paths))
    whole: set[str] = set()
    if quoted_newlines == "always":
        whole = paths
    elif quoted_newlines == "detect" and paths:
        whole = {r["file"] for r in csv_text.quoted_newline_files(spark, [csv_text.reader_path(spark, p) for p in sorted(paths)]).collect()}
    grouped: dict[tuple, list[str]] = {}
    for row in rows:
        key = (row["model_key"], tuple(row["columns"]), row["file"] in whole)
        grouped.setdefault(key, []).append(row["file"])
    return [Layout(*key, tuple(files)) for key, files in grouped.items()]


def scan_layout(spark: SparkSession, layout: Layout, flag_malformed: bool = False) -> DataFrame:
    return csv_text.scan_text(
        spark, [csv_text.reader_path(spark, p) for p in layout.paths], layout.columns, multi_line=layout.multi_line, flag_malformed=flag_malformed, path_column=PATH
    )


def _layout_violations(
    spark: SparkSession,
    layout: Layout,
    cdes: Sequence[Cde],
    longitudinal: bool,
    profile: Profile,
    staged: DataFrame | None = None,
) -> DataFrame:
    """Violations of one layout with its constraints compiled in."""
    flag = profile is not Profile.DATASET_ONLY
    found = validate_rows(
        staged if staged is not None else scan_layout(spark, layout, flag_malformed=flag),
        cdes,
        scope=(PATH,),
        profile=profile,
        longitudinal=longitudinal,
        key_columns=staged if staged is not None else scan_layout(spark, layout),
    )
    return found.select(F.col(PATH).alias("file"), F.lit(layout.model_key).alias("model_key"), *VIOLATION_COLUMNS)


def _all_layouts(
    spark: SparkSession, layouts: Sequence[Layout], readable: DataFrame, cdes: DataFrame, profile: Profile
) -> DataFrame:
    """Violations of any number of layouts in one plan.

    Every file is scanned by position, with a scan per width of header, so that the reader
    sees rows with too few or too many fields. What a file's cells must hold is one row per file,
    written out, so that Spark knows its size and broadcasts it or, beyond the threshold,
    shuffles both sides and splits a file that is too large for one task.
    """
    shapes: dict[tuple[int, bool], list[str]] = {}
    for layout in layouts:
        paths = shapes.setdefault((len(layout.columns), layout.multi_line), [])
        paths += [csv_text.reader_path(spark, p) for p in layout.paths]
    scans = [
        csv_text.scan_positions(spark, paths, width, multi_line=whole) for (width, whole), paths in shapes.items()
    ]
    expected = persisted_copy(_expectations(readable, cdes), "expectations")
    rows = reduce(DataFrame.unionByName, scans).join(expected, "file")
    tokens = null_tokens_of(profile)
    shape = ["file", "model_key", *VIOLATION_COLUMNS]
    cells = rows.select(
        "file", "model_key", F.explode(F.arrays_zip("cells", "expected")).alias("cell")
    ).select(
        "file",
        "model_key",
        F.col("cell.expected.column").alias("column"),
        F.col("cell.cells").alias("raw"),
        nullify(F.col("cell.cells"), tokens).alias("value"),
        "cell.expected.sql_type",
        "cell.expected.min",
        "cell.expected.max",
        "cell.expected.codes",
    )
    found = []
    if profile is not Profile.DATASET_ONLY:
        inside = cells.where("column IS NOT NULL AND value IS NOT NULL")
        found.append(cell_violations(inside, ["file", "model_key"], profile))
        found.append(
            # The cell after the last of the header is the text of a malformed row.
            cells.where("column IS NULL AND raw IS NOT NULL").select(
                "file",
                "model_key",
                F.lit(None).cast("string").alias("column"),
                F.lit("malformed_row").alias("rule"),
                F.col("raw").alias("value"),
                F.lit(None).cast("string").alias("detail"),
            )
        )
    named = rows.select(
        "file",
        "model_key",
        "longitudinal",
        "datasets",
        *[_cell_of(name, tokens).alias(name) for name in (DATASET_COLUMN, SUBJECT_COLUMN, VISIT_COLUMN)],
    )
    scope = ["file", "model_key"]
    visits = named.where("longitudinal")
    found.append(keys.key_violations(visits, scope=scope))
    for column, null_rows in ((SUBJECT_COLUMN, keys.null_subjects), (VISIT_COLUMN, keys.null_visits)):
        found.append(
            null_rows(visits).select(
                *scope,
                F.lit(column).alias("column"),
                F.lit(f"null_{column}").alias("rule"),
                F.lit(None).cast("string").alias("value"),
                F.lit(None).cast("string").alias("detail"),
            )
        )
    # The allowed codes come along with every row, so the filter needs no second join.
    strangers = named.where(
        F.col(DATASET_COLUMN).isNull()
        | ~F.coalesce(F.array_contains("datasets", F.col(DATASET_COLUMN)), F.lit(False))
    )
    found.append(membership.membership_violations(membership.distinct_datasets(strangers, scope), scope))
    return reduce(lambda a, b: a.unionByName(b), [f.select(*shape) for f in found])


def _cell_of(name: str, tokens: Sequence[str]) -> Column:
    """The cell under a header name, null when the header lacks it."""
    position = F.array_position(F.col("columns"), name)
    return nullify(F.when(position > 0, F.try_element_at("cells", position.cast("int"))), tokens)


def _expectations(readable: DataFrame, cdes: DataFrame) -> DataFrame:
    """Per file: its header, the constraints of each position, the allowed dataset codes."""
    last = cdes.groupBy("model_key", F.col("code").alias("column")).agg(
        F.max_by(
            F.struct(
                "sql_type", "min", "max", F.when(F.col("is_categorical"), F.map_keys("enumerations")).alias("codes")
            ),
            "ordinal",
        ).alias("c")
    )
    described = (
        readable.select("file", "model_key", F.posexplode("columns").alias("position", "column"))
        .join(last, ["model_key", "column"])
        .groupBy("file", "model_key")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("position", "column", "c.sql_type", "c.min", "c.max", "c.codes"))
            ).alias("expected")
        )
    )
    datasets = last.where(F.col("column") == DATASET_COLUMN).select("model_key", F.col("c.codes").alias("datasets"))
    return (
        described.join(readable.select("file", "columns", "longitudinal"), "file")
        .join(datasets, "model_key", "left")
        .select("file", "model_key", "longitudinal", "columns", "expected", "datasets")
    )
