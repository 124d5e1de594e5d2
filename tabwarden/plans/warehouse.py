"""The catalog with its primary tables on shared storage, and the jobs that change it.

Every change writes the changed catalog tables to new folders and then appends one row to
the commit table; readers see the last commit. So a job that fails before its commit has
changed nothing. One writer at a time is assumed.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace as with_fields
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tabwarden.model import (
    CDE_SCHEMA,
    DATASET_COLUMN,
    DICTIONARY_FILE,
    DISABLED,
    ENABLED,
    LONGITUDINAL_TAG,
    PATH,
    ErrorClass,
    Profile,
)
from tabwarden.operators import catalog, tables
from tabwarden.operators.dictionary import compile_cdes, dataset_codes, primary_schema
from tabwarden.operators.row_checks import null_tokens_of
from tabwarden.operators.rowids import assign_ordered_ids, number_rows, with_places
from tabwarden.plans.validate import FolderCheck, check_files, check_folder, structure
from tabwarden.session import persisted_copy
from tabwarden.sources import csv_text
from tabwarden.sources.primary import LOAD, append_load, read_primary

SCHEMAS = {
    "data_models": "data_model_id bigint, code string, version string, label string, status string, body string",
    "datasets": (
        "dataset_id bigint, data_model_id bigint, code string, label string, status string, "
        "csv_path string, variables array<string>"
    ),
    "cdes": CDE_SCHEMA,
    "model_tags": "entity_id bigint, tag string, seq bigint",
    "model_properties": "entity_id bigint, key string, value string",
    "dataset_tags": "entity_id bigint, tag string, seq bigint",
    "dataset_properties": "entity_id bigint, key string, value string",
    "loads": "load bigint, data_model_id bigint, dataset string, n_rows bigint, last_row_id bigint, live boolean",
}
#: ``stream`` and ``batch`` tell which batch of which streaming query a commit took, if any.
_COMMIT_SCHEMA = "version bigint, paths map<string,string>, stream string, batch bigint"


#: What the listing of a stream of files has; the content is never read.
_LISTING = "path string, modificationTime timestamp, length bigint, content binary"


class RequestError(Exception):
    """A request that is refused; ``rows`` has all the reasons, the message the first ones."""

    def __init__(self, error_class: ErrorClass, message: str, rows: DataFrame | None = None) -> None:
        shown = "" if rows is None else "\n" + "\n".join(str(r.asDict()) for r in rows.limit(20).collect())
        super().__init__(message + shown)
        self.error_class = error_class
        self.rows = rows


class Warehouse:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    # Storage

    def _commits(self) -> DataFrame:
        return self.spark.read.schema(_COMMIT_SCHEMA).json(f"{self.root}/_commits")

    def _current(self) -> tuple[int, dict[str, str]]:
        try:
            last = self._commits().agg(F.max_by(F.struct("version", "paths"), "version").alias("last")).first()["last"]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            last = None
        return (0, {}) if last is None else (last["version"], dict(last["paths"]))

    def is_initialised(self) -> bool:
        return set(SCHEMAS) <= set(self._current()[1])

    def initialise(self) -> None:
        """Create the catalog tables that are missing."""
        paths = self._current()[1]
        missing = {
            name: self.spark.createDataFrame([], schema) for name, schema in SCHEMAS.items() if name not in paths
        }
        if missing:
            self.commit(missing)

    def table(self, name: str) -> DataFrame:
        return self.tables([name])[name]

    def tables(self, names: Sequence[str] = tuple(SCHEMAS)) -> dict[str, DataFrame]:
        """Catalog tables of one and the same commit."""
        paths = self._current()[1]
        if not set(names) <= set(paths):
            raise RequestError(ErrorClass.USER_INPUT, "The catalog has to be initialised first.")
        return {name: self.spark.read.schema(SCHEMAS[name]).parquet(paths[name]) for name in names}

    def commit(self, frames: Mapping[str, DataFrame], taken: tuple[str, int] | None = None) -> None:
        """Write the given tables and make them current together; ``taken`` is the stream and batch they come from."""
        version, paths = self._current()
        written = {name: f"{self.root}/{name}/{version + 1}-{uuid.uuid4().hex}" for name in frames}

        def write(name: str) -> None:
            schema = SCHEMAS[name]
            wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
            shaped = frames[name].select(*[F.col(f.name).cast(f.dataType) for f in wanted])
            shaped.write.parquet(written[name])

        # The tables do not depend on each other, so their jobs run side by side.
        with ThreadPoolExecutor(len(SCHEMAS)) as pool:
            list(pool.map(write, frames))
        paths.update(written)
        row = self.spark.createDataFrame([(version + 1, paths, *(taken or (None, None)))], _COMMIT_SCHEMA)
        row.coalesce(1).write.mode("append").json(f"{self.root}/_commits")

    def _primary_path(self, data_model_id: int) -> str:
        return f"{self.root}/primary/{data_model_id}"

    # Lists and lookups

    def list_data_models(self) -> DataFrame:
        return catalog.list_data_models(self.table("data_models"), self.table("datasets"))

    def list_datasets(self) -> DataFrame:
        return catalog.list_datasets(self.table("datasets"))

    def model_id(self, code: str, version: str) -> int:
        request = self.spark.createDataFrame([(code, version)], "code string, version string")
        return self._one_id(request, self.table("data_models"), ["code", "version"], "data_model_id", "data model")

    def dataset_id(self, dataset: str, code: str, version: str) -> int:
        request = self.spark.createDataFrame(
            [(dataset, self.model_id(code, version))], "code string, data_model_id bigint"
        )
        return self._one_id(request, self.table("datasets"), ["code", "data_model_id"], "dataset_id", "dataset")

    def _one_id(self, request: DataFrame, table: DataFrame, keys: list[str], id_column: str, kind: str) -> int:
        row = catalog.resolve(request, table, keys, id_column).first()
        if row["resolution"] != "ok":
            raise RequestError(ErrorClass.DATABASE, f"The {kind} is {row['resolution']}: {row.asDict()}")
        return row[id_column]

    def is_longitudinal(self, code: str, version: str) -> bool:
        model = self.table("data_models").where(F.col("data_model_id") == self.model_id(code, version))
        return not catalog.longitudinal_models(model, self.table("model_tags")).isEmpty()

    def cdes(self, code: str, version: str) -> DataFrame:
        model = self.table("data_models").where((F.col("code") == code) & (F.col("version") == version))
        return catalog.cdes_of_models(self.table("cdes"), model)

    def primary_schema(self, code: str, version: str) -> T.StructType:
        by_model = compile_cdes(self.cdes(code, version))
        return primary_schema(next(iter(by_model.values())))

    def primary(self, code: str, version: str, datasets: Sequence[str] | None = None) -> DataFrame:
        """Rows of a model's primary table, of all or of some datasets."""
        model = self.model_id(code, version)
        schema = self.primary_schema(code, version)
        live = self.table("loads").where((F.col("data_model_id") == model) & F.col("live"))
        if live.isEmpty():
            return self.spark.createDataFrame([], schema)
        return read_primary(self.spark, self._primary_path(model), schema, live, datasets)

    # Registration and loading

    def add_data_models(self, root: str, dictionary_glob: str = DICTIONARY_FILE) -> None:
        """Check and register every dictionary below ``root``; all of them or none."""
        models, cdes = structure(self.spark, root, dictionary_glob)
        nothing = self.spark.createDataFrame([], "file string, folder string, bytes bigint, model_key string").where("false")
        checked = check_files(self.spark, nothing, models, cdes)
        self._refuse_invalid(checked)
        self.commit(self._registered(checked, self.tables()))

    def _registered(self, checked: FolderCheck, base: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """Model, variable and tag tables with the models of a checked folder added."""
        wanted = checked.models.select(
            "model_key",
            F.col("model_code").alias("code"),
            F.col("model_version").alias("version"),
            F.col("model_label").alias("label"),
            "longitudinal",
            "body",
        )
        conflicts = catalog.registration_conflicts(wanted, base["data_models"])
        if not conflicts.isEmpty():
            raise RequestError(ErrorClass.DATABASE, "Data models that exist already:", conflicts)
        first = F.coalesce(base["data_models"].agg(F.max("data_model_id")).scalar(), F.lit(0))
        numbered = assign_ordered_ids(wanted, ["code", "version"], "data_model_id", first).withColumn(
            "status", F.lit(ENABLED)
        )
        tags = numbered.where("longitudinal").select(
            F.col("data_model_id").alias("entity_id"), F.lit(LONGITUDINAL_TAG).alias("tag"), F.lit(0).alias("seq")
        )
        return {
            "data_models": base["data_models"].unionByName(numbered.select(*base["data_models"].columns)),
            "cdes": base["cdes"].unionByName(checked.cdes.select(*CDE_SCHEMA.names)),
            "model_tags": base["model_tags"].unionByName(tags),
        }

    def _refuse_invalid(self, checked: FolderCheck) -> None:
        """Stop unless every dictionary and every file is valid."""
        bad = checked.dictionary_violations
        if not bad.isEmpty():
            raise RequestError(ErrorClass.DATA_MODEL, "Invalid data models:", bad)
        found = persisted_copy(checked.violations, "violations")
        if not found.isEmpty():
            raise RequestError(ErrorClass.DATASET, "Invalid datasets:", found)

    def check_dataset(
        self, paths: str, code: str, version: str, profile: Profile = Profile.LOAD, stage: bool = False
    ) -> FolderCheck:
        """Check CSV files (one, or all below a folder) against a registered model."""
        # A file that is named is read whatever its name; a folder gives its CSV files.
        name = paths.rstrip("/").rsplit("/", 1)[-1]
        listed = csv_text.list_files(self.spark, paths, "*" if re.search(r"\.\w+$", name) else "*.csv")
        if listed.isEmpty():
            raise RequestError(ErrorClass.USER_INPUT, f"No data file found: {paths}")
        return self._check_listed(listed, code, version, profile, stage)

    def _check_listed(self, listed: DataFrame, code: str, version: str, profile: Profile, stage: bool) -> FolderCheck:
        """Check listed files ``(file, folder, bytes)`` against a registered model."""
        model = self.table("data_models").where(F.col("data_model_id") == self.model_id(code, version))
        key = F.concat_ws(":", "code", "version")
        longitudinal = self.is_longitudinal(code, version)
        models = model.select(
            key.alias("model_key"),
            F.col("code").alias("model_code"),
            F.col("version").alias("model_version"),
            F.col("label").alias("model_label"),
            F.lit(True).alias("is_json"),
            F.lit("boolean").alias("longitudinal_kind"),
            F.lit(longitudinal).alias("longitudinal"),
            "body",
        )
        cdes = self.cdes(code, version).withColumns(
            {
                "model_key": F.lit(f"{code}:{version}"),
                "missing_keys": F.lit(None).cast("array<string>"),
                "has_enumerations": F.col("enumerations").isNotNull(),
                "bad_bound": F.lit(False),
                "bad_enumeration": F.lit(False),
            }
        )
        files = listed.withColumn("model_key", F.lit(f"{code}:{version}"))
        return check_files(self.spark, files, models, cdes, profile=profile, stage=stage)

    def add_datasets(
        self, paths: str, code: str, version: str, profile: Profile = Profile.LOAD, replace: bool = False
    ) -> None:
        """Check CSV files and load them; nothing is loaded unless all of them are valid.

        Loading a dataset again appends its rows, with ``replace`` the new rows take the
        place of the old ones. The profile DATASET_ONLY, which leaves cells unchecked, registers
        the datasets and stores no rows.
        """
        checked = self.check_dataset(paths, code, version, profile, stage=True)
        self._refuse_invalid(checked)
        base = self.tables()
        self.commit(self._loaded(checked, {f"{code}:{version}": self.model_id(code, version)}, base, profile, replace))
        if replace:
            self._purge()

    def load_stream(
        self,
        path: str,
        code: str,
        version: str,
        quarantine: str,
        *,
        profile: Profile = Profile.LOAD,
        files_per_batch: int | None = None,
        glob: str = "*.csv",
    ) -> DataStreamWriter:
        """A stream that loads arriving CSV files of any header into a registered model, each file as a whole or not at all.

        The stream carries paths only; a batch is checked as ``check_dataset`` does and the files without a
        violation are loaded with one commit. Violations of the others go to ``quarantine``. The commit
        row names the query (by its checkpoint) and the batch, so a batch that Spark runs again is
        known and left out, and what a failed batch left behind is overwritten. Row ids go on from the
        last load. The caller names the checkpoint and the trigger. One writer at a time, as for all changes.
        """
        reader = self.spark.readStream.format("binaryFile").schema(_LISTING).option("pathGlobFilter", glob)
        if files_per_batch is not None:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        place = F.col("_metadata.file_path")
        arrived = reader.load(path).select(
            place.alias("file"), csv_text.folder_of(place).alias("folder"), F.col("length").alias("bytes")
        )

        def take(batch: DataFrame, batch_id: int) -> None:
            house = Warehouse(batch.sparkSession, self.root)
            query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
            if query is None:
                raise RuntimeError("A batch of an unknown streaming query can't be told from its repetition.")
            mine = (F.col("stream") == query) & (F.col("batch") >= batch_id)
            if house._commits().where(mine).isEmpty():
                house._take_batch(batch, (query, batch_id), code, version, quarantine, profile)

        return arrived.writeStream.foreachBatch(take)

    def _take_batch(
        self, batch: DataFrame, taken: tuple[str, int], code: str, version: str, quarantine: str, profile: Profile
    ) -> None:
        checked = self._check_listed(persisted_copy(batch, "arrived"), code, version, profile, stage=True)
        told = f"{quarantine}/batch={taken[1]}"
        checked.violations.write.mode("overwrite").parquet(told)
        bad = self.spark.read.schema(checked.violations.schema).parquet(told).select(F.col("file").alias(PATH)).distinct()
        good = {
            x: persisted_copy(frame.join(bad, PATH, "left_anti").select(*frame.columns), "good")
            for x, frame in checked.staged.items()
        }
        checked = with_fields(checked, staged={x: frame for x, frame in good.items() if not frame.isEmpty()})
        ids = {f"{code}:{version}": self.model_id(code, version)}
        self.commit(self._loaded(checked, ids, self.tables(), profile), taken)

    def load_folder(
        self, root: str, profile: Profile = Profile.LOAD, dictionary_glob: str = DICTIONARY_FILE
    ) -> None:
        """Replace the whole catalog by a folder of dictionaries and CSV files.

        The folder is checked as a whole before anything changes; the old content goes
        with the same commit that brings the new one.
        """
        checked = check_folder(self.spark, root, profile=profile, dictionary_glob=dictionary_glob, stage=True)
        self._refuse_invalid(checked)
        history = self.table("loads").withColumn("live", F.lit(False))
        empty = {name: self.spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}
        frames = {**empty, **self._registered(checked, empty), "loads": history}
        frames["data_models"] = persisted_copy(frames["data_models"], "data-models")
        names = checked.models.select("model_key", F.col("model_code").alias("code"), F.col("model_version").alias("version"))
        ids = {
            r["model_key"]: r["data_model_id"]
            for r in names.join(frames["data_models"], ["code", "version"]).select("model_key", "data_model_id").collect()
        }
        self.commit({**frames, **self._loaded(checked, ids, frames, profile)})
        self._purge()

    def _loaded(
        self,
        checked: FolderCheck,
        ids: Mapping[str, int],
        base: Mapping[str, DataFrame],
        profile: Profile,
        replace: bool = False,
    ) -> dict[str, DataFrame]:
        """Write the rows of a checked folder, one job per model, and the tables that list them.
        With the profile DATASET_ONLY just the tables."""
        loads = base["loads"]
        load = (loads.agg(F.max("load")).first()[0] or 0) + 1
        new_loads, carried = [], []
        for key, model in ids.items():
            staged = [(x, frame) for x, frame in checked.staged.items() if x.model_key == key]
            if not staged:
                continue
            carried += [
                frame.select(
                    F.lit(model).alias("data_model_id"),
                    F.col(DATASET_COLUMN).alias("code"),
                    F.col(PATH).alias("file"),
                    F.array(*[F.lit(c) for c in x.columns]).alias("variables"),
                )
                .groupBy("data_model_id", "code")
                .agg(F.min_by(F.struct("file", "variables"), "file").alias("source"))
                for x, frame in staged
            ]
            if profile is Profile.DATASET_ONLY:
                continue  # registers the datasets and stores no rows
            cdes = checked.compiled[key]
            target = primary_schema(cdes)
            places = [T.StructField("__file", T.StringType()), T.StructField("__index", T.LongType())]
            body = T.StructType(target.fields[1:] + places)
            typed = [
                tables.pad_columns(
                    csv_text.typed_columns(
                        csv_text.with_nulls(with_places(frame), null_tokens_of(profile), x.columns), cdes
                    ),
                    body,
                )
                for x, frame in staged
            ]
            mine = loads.where(F.col("data_model_id") == model)
            # Row ids start again with an empty table, as after a load of a whole folder.
            before = mine.where("live").agg(F.max("last_row_id")).first()[0] or 0
            rows = number_rows(reduce(DataFrame.unionByName, typed), target.fields[0].name, before)
            path = append_load(rows.select(*target.names), self._primary_path(model), load)
            counted = tables.count_by_dataset(self.spark.read.parquet(path))
            total = self.spark.read.parquet(path).count()
            new_loads.append(
                counted.select(
                    F.lit(load).alias("load"),
                    F.lit(model).alias("data_model_id"),
                    F.col(DATASET_COLUMN).cast("string").alias("dataset"),
                    F.col("n").alias("n_rows"),
                    F.lit(before + total).alias("last_row_id"),
                    F.lit(True).alias("live"),
                )
            )
        if not carried:
            return {}
        if new_loads:
            added = reduce(DataFrame.unionByName, new_loads)
        if new_loads and replace:
            again = added.select("data_model_id", "dataset").withColumn("__again", F.lit(True))
            loads = loads.join(again, ["data_model_id", "dataset"], "left").select(
                *[c for c in loads.columns if c != "live"], (F.col("live") & F.col("__again").isNull()).alias("live")
            )
        sources = (
            reduce(DataFrame.unionByName, carried)
            .groupBy("data_model_id", "code")
            .agg(F.min_by("source", "source.file").alias("source"))
        )
        pairs = self.spark.createDataFrame(list(ids.items()), "model_key string, data_model_id bigint")
        labels = dataset_codes(checked.cdes).join(pairs, "model_key").select(
            "data_model_id", F.col("dataset").alias("code"), "label"
        )
        new = tables.new_datasets(sources, base["datasets"], ["data_model_id", "code"])
        described = catalog.dataset_rows(new, labels, ["data_model_id", "code"], ENABLED).join(
            sources, ["data_model_id", "code"]
        )
        first = F.coalesce(base["datasets"].agg(F.max("dataset_id")).scalar(), F.lit(0))
        numbered = assign_ordered_ids(described, ["data_model_id", "code"], "dataset_id", first).select(
            "*", F.col("source.file").alias("csv_path"), F.col("source.variables").alias("variables")
        )
        return {
            "loads": loads.unionByName(added) if new_loads else loads,
            "datasets": base["datasets"].unionByName(numbered.select(*base["datasets"].columns)),
        }

    # Deletion

    def empty_model(self, code: str, version: str) -> None:
        """Drop all rows of a model's primary table, from the disk too; the model and its datasets stay listed."""
        gone = F.col("data_model_id") == self.model_id(code, version)
        self.commit({"loads": self.table("loads").withColumn("live", F.col("live") & ~gone)})
        self._purge()

    def delete_dataset(self, dataset: str, code: str, version: str) -> None:
        """Drop a dataset from the catalog and its rows from the disk."""
        model, identity = self.model_id(code, version), self.dataset_id(dataset, code, version)
        gone = (F.col("data_model_id") == model) & F.col("dataset").eqNullSafe(dataset)
        self.commit(
            {
                "loads": self.table("loads").withColumn("live", F.col("live") & ~gone),
                "datasets": self.table("datasets").where(F.col("dataset_id") != identity),
                "dataset_tags": self.table("dataset_tags").where(F.col("entity_id") != identity),
                "dataset_properties": self.table("dataset_properties").where(F.col("entity_id") != identity),
            }
        )
        self._purge()

    def delete_data_model(self, code: str, version: str, force: bool = False) -> None:
        """Drop a model; with ``force`` also when it has datasets, which then go with it."""
        identity = self.model_id(code, version)
        self._delete_models(self.table("data_models").where(F.col("data_model_id") == identity), force)

    def cleanup(self) -> None:
        """Drop every model with everything that belongs to it."""
        self._delete_models(self.table("data_models"), True)

    def _delete_models(self, targets: DataFrame, force: bool) -> None:
        base = self.tables()
        if not force:
            blocking = catalog.blocking_datasets(targets, base["datasets"])
            if not blocking.isEmpty():
                raise RequestError(ErrorClass.FOREIGN_KEY, "Data models that still have datasets:", blocking)
        orphans = base["datasets"].join(targets.select("data_model_id"), "data_model_id", "left_semi")
        orphan_ids = orphans.select(F.col("dataset_id").alias("data_model_id"))
        names = targets.select(F.col("code").alias("model_code"), F.col("version").alias("model_version"))
        dead = targets.select("data_model_id").withColumn("__dead", F.lit(True))
        self.commit(
            {
                "data_models": catalog.drop_models(base["data_models"], targets),
                "datasets": catalog.drop_models(base["datasets"], targets),
                "cdes": base["cdes"].join(names, ["model_code", "model_version"], "left_anti"),
                "model_tags": catalog.drop_models(base["model_tags"], targets, "entity_id"),
                "model_properties": catalog.drop_models(base["model_properties"], targets, "entity_id"),
                "dataset_tags": catalog.drop_models(base["dataset_tags"], orphan_ids, "entity_id"),
                "dataset_properties": catalog.drop_models(base["dataset_properties"], orphan_ids, "entity_id"),
                "loads": base["loads"]
                .join(dead, "data_model_id", "left")
                .withColumn("live", F.col("live") & F.col("__dead").isNull()),
            }
        )
        self._purge()

    def _purge(self) -> None:
        """Remove from the disk what the last commit does not name: rows of deleted datasets,
        models and failed loads, and superseded catalog tables.

        Runs after the commit, so a failure in between leaves files that nothing reads and that
        the next removal takes. Frames of an older commit can't be read afterwards. The driver
        lists the folders and holds the live ``(model, load, dataset)`` entries of the catalog.
        """
        for name, path in self._current()[1].items():
            current = path.rsplit("/", 1)[1]
            self._remove(f"{self.root}/{name}/{old}" for old in self._children(f"{self.root}/{name}") if old != current)
        live: dict[str, dict[str, set[str]]] = {}
        listed = self.table("loads").where("live").select("data_model_id", "load", "dataset").distinct()
        for row in listed.toLocalIterator():
            loads = live.setdefault(str(row["data_model_id"]), {})
            loads.setdefault(f"{LOAD}={row['load']}", set()).add(row["dataset"])
        for model in self._children(f"{self.root}/primary"):
            kept = live.get(model, {})
            folder = self._primary_path(int(model))
            if not kept:
                self._remove([folder])
                continue
            for load in self._children(folder):
                if load not in kept:
                    self._remove([f"{folder}/{load}"])
                    continue
                parts = [p for p in self._children(f"{folder}/{load}") if p.startswith(f"{DATASET_COLUMN}=")]
                gone = [p for p in parts if unquote(p.split("=", 1)[1]) not in kept[load]]
                self._remove(f"{folder}/{load}/{p}" for p in gone)

    def _store(self, path: str):
        """The path and its file system, as Spark's own readers see them."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _children(self, path: str) -> list[str]:
        place, store = self._store(path)
        return sorted(s.getPath().getName() for s in store.listStatus(place)) if store.exists(place) else []

    def _remove(self, paths: Iterable[str]) -> None:
        for path in paths:
            place, store = self._store(path)
            store.delete(place, True)

    # Status, tags, properties: change frames in, outcomes out

    def change_status(self, table: str, changes: DataFrame) -> DataFrame:
        """Apply ``(id, wanted, seq)`` to data_models or datasets; returns the outcomes."""
        id_column = "data_model_id" if table == "data_models" else "dataset_id"
        current = self.table(table)
        outcomes = persisted_copy(catalog.status_outcomes(current, changes, id_column), "outcomes")
        self.commit({table: catalog.apply_status(current, changes, id_column)})
        return outcomes

    def set_status(self, status: str, code: str, version: str, dataset: str | None = None) -> None:
        """Enable or disable one model or dataset; it is an error if it has that status."""
        if status not in (ENABLED, DISABLED):
            raise RequestError(ErrorClass.USER_INPUT, f"No such status: {status}")
        table, id_column, identity = self._entity(code, version, dataset)
        changes = self.spark.createDataFrame([(identity, status, 1)], f"{id_column} bigint, wanted string, seq bigint")
        current = self.table(table)
        if catalog.status_outcomes(current, changes, id_column).first()["outcome"] == "already":
            raise RequestError(ErrorClass.USER_INPUT, f"The {table[:-1]} was already {status.lower()}")
        self.commit({table: catalog.apply_status(current, changes, id_column)})

    def _entity(self, code: str, version: str, dataset: str | None) -> tuple[str, str, int]:
        if dataset is None:
            return "data_models", "data_model_id", self.model_id(code, version)
        return "datasets", "dataset_id", self.dataset_id(dataset, code, version)

    def annotations(self, kind: str) -> DataFrame:
        """Tags in order and properties as a map, one row per model or dataset."""
        table, id_column = ("data_models", "data_model_id") if kind == "model" else ("datasets", "dataset_id")
        base = self.tables([table, f"{kind}_tags", f"{kind}_properties"])
        return catalog.annotations(base[table], base[f"{kind}_tags"], base[f"{kind}_properties"], id_column)

    def overwrite_annotations(self, kind: str, wanted: DataFrame) -> None:
        """Put ``(entity_id, tags, properties)`` in the place of all that those entities have."""
        base = self.tables([f"{kind}_tags", f"{kind}_properties"])
        self.commit(
            {
                f"{kind}_tags": catalog.overwrite_tags(base[f"{kind}_tags"], wanted),
                f"{kind}_properties": catalog.overwrite_properties(base[f"{kind}_properties"], wanted),
            }
        )

    def change_tags(self, kind: str, requests: DataFrame) -> DataFrame:
        """Apply ``(entity_id, expression, remove, force, seq)`` to models or datasets.

        ``kind`` is "model" or "dataset". Requests for one tag or key take effect by ``seq``, all in one pass
        over the catalog. Returns one outcome row per entity, tag or key, and turn from adding to removing
        or back.
        """
        base = self.tables([f"{kind}_tags", f"{kind}_properties"])
        tags, properties = base[f"{kind}_tags"], base[f"{kind}_properties"]
        parsed = catalog.parse_tag_requests(requests)
        changed = persisted_copy(catalog.ordered_changes(tags, properties, parsed), "tag-changes")
        left = changed.where("operation IS NULL")
        self.commit(
            {
                f"{kind}_tags": left.where("tag").select("entity_id", F.col("name").alias("tag"), F.col("place").alias("seq")),
                f"{kind}_properties": left.where("NOT tag").select("entity_id", F.col("name").alias("key"), "value"),
            }
        )
        return catalog.change_outcomes(changed)

    def tag(
        self,
        expression: str,
        code: str,
        version: str,
        dataset: str | None = None,
        remove: bool = False,
        force: bool = False,
    ) -> None:
        """Add or remove one tag or ``key=value`` property; a request without effect is an error."""
        _, _, identity = self._entity(code, version, dataset)
        request = self.spark.createDataFrame(
            [(identity, expression, remove, force, 1)],
            "entity_id bigint, expression string, remove boolean, force boolean, seq bigint",
        )
        outcome = self.change_tags("model" if dataset is None else "dataset", request).first()["outcome"]
        if outcome in ("exists", "missing"):
            thing = "Property" if "=" in expression else "Tag"
            told = "already exists" if outcome == "exists" else "does not exist"
            raise RequestError(ErrorClass.USER_INPUT, f"{thing} {told}: {expression}")
