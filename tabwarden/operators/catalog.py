"""Catalog operators on change frames.

Tables: ``data_models(data_model_id, code, version, label, status)``,
``datasets(dataset_id, data_model_id, code, label, status, csv_path, variables)``,
``tags(entity_id, tag, seq)`` and ``properties(entity_id, key, value)``, the last two once
for models and once for datasets. Tags and properties are rows, so that an entity with
very many of them is spread like any other data.

Changes carry ``seq``, their order within the batch. They are reduced to one row per
entity and tag (or key) before they meet the catalog; ``requests`` counts what was asked
and ``rejected`` what fails as it would one by one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.functions.text import model_name, split_tag
from tabwarden.model import LONGITUDINAL_TAG
from tabwarden.operators.skew import spread_join

_ONE = "*"


def resolve(requests: DataFrame, table: DataFrame, keys: Sequence[str], id_column: str) -> DataFrame:
    """Add the id that the keys name: ``resolution`` is ok, not_found or ambiguous."""
    asked = requests.groupBy(*keys).agg(F.count(_ONE).alias("__asked"))
    known = table.groupBy(*keys).agg(F.min(id_column).alias("__id"), F.count(_ONE).alias("__known"))
    found = asked.join(known, list(keys), "left").select(
        *keys,
        "__asked",
        F.when(F.col("__known") == 1, F.col("__id")).alias(id_column),
        F.when(F.col("__known").isNull(), "not_found")
        .when(F.col("__known") > 1, "ambiguous")
        .otherwise("ok")
        .alias("resolution"),
    )
    return spread_join(requests, found, keys, "__asked", "left").drop("__asked")


def list_data_models(models: DataFrame, datasets: DataFrame) -> DataFrame:
    """Models with the number of their datasets, 0 when there are none."""
    counted = datasets.groupBy("data_model_id").agg(F.count(_ONE).alias("count"))
    return models.join(counted, "data_model_id", "left").select(
        "data_model_id",
        "code",
        "version",
        "label",
        "status",
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
        model_name(F.col("code"), F.col("version")).alias("name"),
    )


def list_datasets(datasets: DataFrame) -> DataFrame:
    return datasets.select("dataset_id", "data_model_id", "code", "label", "status")


def select_where(table: DataFrame, columns: Sequence[str], equal: Mapping[str, object]) -> DataFrame:
    """Columns of the rows that equal all given values."""
    for column, value in equal.items():
        table = table.where(F.col(column) == F.lit(value))
    return table.select(*columns)


def cdes_of_models(cdes: DataFrame, models: DataFrame) -> DataFrame:
    """Variables of the given models, in any number."""
    wanted = models.select(F.col("code").alias("model_code"), F.col("version").alias("model_version"))
    return cdes.join(wanted.distinct(), ["model_code", "model_version"], "left_semi")


def longitudinal_models(models: DataFrame, tags: DataFrame) -> DataFrame:
    """Models that carry the longitudinal tag."""
    tagged = tags.where(F.col("tag") == LONGITUDINAL_TAG).select(F.col("entity_id").alias("data_model_id"))
    return models.join(tagged, "data_model_id", "left_semi")


def status_outcomes(table: DataFrame, changes: DataFrame, id_column: str) -> DataFrame:
    """What the changes ``(id, wanted, seq)`` do: changed, already or not_found per entity.

    The last of several changes to one entity decides.
    """
    wanted = changes.groupBy(id_column).agg(
        F.max_by("wanted", "seq").alias("wanted"), F.count(_ONE).alias("requests")
    )
    current = table.select(id_column, "status")
    return wanted.join(current, id_column, "left").select(
        id_column,
        "wanted",
        "requests",
        F.when(F.col("status").isNull(), "not_found")
        .when(F.col("status") == F.col("wanted"), "already")
        .otherwise("changed")
        .alias("outcome"),
    )


def apply_status(table: DataFrame, changes: DataFrame, id_column: str) -> DataFrame:
    """The table with the wanted statuses."""
    wanted = changes.groupBy(id_column).agg(F.max_by("wanted", "seq").alias("__wanted"))
    return (
        table.join(wanted, id_column, "left")
        .withColumn("status", F.coalesce("__wanted", "status"))
        .select(*table.columns)
    )


def tag_additions(tags: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests ``(entity_id, tag, seq)``: added, or exists when the tag was there before."""
    return _tag_requests(tags, requests).select(
        "entity_id",
        "tag",
        "seq",
        "requests",
        F.when(F.col("__present"), "exists").otherwise("added").alias("outcome"),
        (F.col("requests") - F.when(F.col("__present"), 0).otherwise(1)).alias("rejected"),
    )


def tag_removals(tags: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests ``(entity_id, tag, seq)``: removed, or missing when there was no such tag."""
    return _tag_requests(tags, requests).select(
        "entity_id",
        "tag",
        "seq",
        "requests",
        F.when(F.col("__present"), "removed").otherwise("missing").alias("outcome"),
        (F.col("requests") - F.when(F.col("__present"), 1).otherwise(0)).alias("rejected"),
    )


def add_tags(tags: DataFrame, requests: DataFrame) -> DataFrame:
    """The tags with the new ones; a new tag keeps its place in the order of requests."""
    added = tag_additions(tags, requests).where("outcome = 'added'")
    return tags.unionByName(added.select("entity_id", "tag", "seq"))


def remove_tags(tags: DataFrame, requests: DataFrame) -> DataFrame:
    return tags.join(requests.select("entity_id", "tag").distinct(), ["entity_id", "tag"], "left_anti")


def property_additions(properties: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests ``(entity_id, key, value, force, seq)``: added, overwritten or exists.

    Without force an existing key stays as it is; of several requests for one key the last
    forced one counts, otherwise the first.
    """
    asked = requests.groupBy("entity_id", "key").agg(
        F.count(_ONE).alias("requests"),
        F.count_if("force").alias("__forced"),
        F.min_by("value", "seq").alias("__first"),
        F.min_by("force", "seq").alias("__first_forced"),
        F.max_by("value", F.when(F.col("force"), F.col("seq"))).alias("__last_forced"),
    )
    current = properties.select("entity_id", "key", F.col("value").alias("__old"), F.lit(True).alias("__has"))
    forced, present = F.col("__forced") > 0, F.col("__has").isNotNull()
    opening = F.when(~present & ~F.col("__first_forced"), 1).otherwise(0)
    return asked.join(current, ["entity_id", "key"], "left").select(
        "entity_id",
        "key",
        F.when(forced, F.col("__last_forced"))
        .when(present, F.col("__old"))
        .otherwise(F.col("__first"))
        .alias("value"),
        "requests",
        F.when(~present, "added").when(forced, "overwritten").otherwise("exists").alias("outcome"),
        (F.col("requests") - F.col("__forced") - opening).alias("rejected"),
    )


def property_removals(properties: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests ``(entity_id, key, value)``: removed only when key and value both match."""
    asked = requests.groupBy("entity_id", "key", "value").agg(F.count(_ONE).alias("requests"))
    current = properties.select("entity_id", "key", "value", F.lit(True).alias("__has"))
    present = F.col("__has").isNotNull()
    return asked.join(current, ["entity_id", "key", "value"], "left").select(
        "entity_id",
        "key",
        "value",
        "requests",
        F.when(present, "removed").otherwise("missing").alias("outcome"),
        (F.col("requests") - F.when(present, 1).otherwise(0)).alias("rejected"),
    )


def add_properties(properties: DataFrame, requests: DataFrame) -> DataFrame:
    """The properties after the additions."""
    changed = property_additions(properties, requests).select("entity_id", "key", "value")
    kept = properties.join(changed, ["entity_id", "key"], "left_anti")
    return kept.select("entity_id", "key", "value").unionByName(changed)


def remove_properties(properties: DataFrame, requests: DataFrame) -> DataFrame:
    gone = requests.select("entity_id", "key", "value").distinct()
    return properties.join(gone, ["entity_id", "key", "value"], "left_anti")


def parse_tag_requests(requests: DataFrame, expression: str = "expression") -> DataFrame:
    """Route ``(expression, remove, force)`` to one of four operations.

    ``key=value`` means a property, anything else a tag.
    """
    key, value = split_tag(F.col(expression))
    is_property = F.instr(F.col(expression), "=") > 0
    return requests.withColumns(
        {
            "operation": F.concat(
                F.when(F.col("remove"), "remove_").otherwise("add_"),
                F.when(is_property, "property").otherwise("tag"),
            ),
            "tag": F.when(~is_property, F.col(expression)),
            "key": F.when(is_property, key),
            "value": value,
        }
    )


_CHANGED = (
    "operation string, entity_id bigint, tag boolean, name string, value string, place bigint, run bigint, "
    "effect boolean, fresh boolean"
)


def ordered_changes(tags: DataFrame, properties: DataFrame, parsed: DataFrame) -> DataFrame:
    """Take parsed requests through the catalog in their order, all of them in one pass.

    The rows of the catalog and the requests of one tag or key of one entity meet in one task, sorted by
    ``seq`` behind what the catalog holds; of equal ``seq`` removals come first, then unforced additions,
    then smaller values. The pass carries one name's state at a time, so a name with any number of
    requests takes no memory, and sorting spills.

    Returns a row per request with ``effect`` (it changed something), ``fresh`` (there was nothing before)
    and ``run`` (how often the name's requests turned from adding to removing or back before), and a
    row without ``operation`` per tag and property that is there at the end. New tags take their place
    after those of the catalog.
    """
    last = tags.agg(F.max("seq")).first()[0] or 0
    nothing = F.lit(None)
    shape = lambda frame, tag, name, value, place: frame.select(
        "entity_id",
        F.lit(tag).alias("tag"),
        F.col(name).alias("name"),
        value.cast("string").alias("value"),
        place.cast("bigint").alias("place"),
        nothing.cast("string").alias("operation"),
        nothing.cast("boolean").alias("force"),
    )
    asked = parsed.select(
        "entity_id",
        F.col("tag").isNotNull().alias("tag"),
        F.coalesce("tag", "key").alias("name"),
        "value",
        (F.col("seq") + F.when(F.col("tag").isNotNull(), last).otherwise(0)).alias("place"),
        "operation",
        "force",
    )
    known = shape(tags, True, "tag", nothing, F.col("seq")).unionByName(
        shape(properties, False, "key", F.col("value"), nothing)
    )
    keys = ["tag", "entity_id", "name"]
    order = [F.col("operation").isNotNull(), "place", F.col("operation").startswith("add"), "force", "value"]
    together = known.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, *order)
    return together.select("operation", "entity_id", "tag", "name", "value", "place", "force").mapInArrow(
        _in_turn(), _CHANGED
    )


def _in_turn():
    def run(batches):
        import pyarrow as pa

        schema = pa.schema(
            [("operation", pa.string()), ("entity_id", pa.int64()), ("tag", pa.bool_()), ("name", pa.string())]
            + [("value", pa.string()), ("place", pa.int64()), ("run", pa.int64())]
            + [("effect", pa.bool_()), ("fresh", pa.bool_())]
        )
        name = held = None  # the name at hand and its (value, place), None for nothing
        turns, adding = 0, None

        def end():
            if held is not None:
                entity, tag, called = name
                yield None, entity, tag, called, *held, None, None, None

        for batch in batches:
            rows = []
            for operation, entity, tag, called, value, place, force in zip(
                *(column.to_pylist() for column in batch.columns), strict=True
            ):
                if (entity, tag, called) != name:
                    rows += end()
                    name, held, turns, adding = (entity, tag, called), None, 0, None
                if operation is None:
                    held = held or (value, place)
                    continue
                adds = operation.startswith("add")
                turns += adding is not None and adds != adding
                adding, fresh = adds, held is None
                if adds:
                    effect = fresh or (not tag and bool(force))
                    held = (value, place) if effect else held
                else:
                    effect = not fresh and (tag or held[0] == value)
                    held = None if effect else held
                rows.append((operation, entity, tag, called, value, place, turns, effect, fresh))
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
                )
        rows = list(end())
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(rows[0], schema, strict=True)], schema=schema
            )

    return run


def change_outcomes(changed: DataFrame) -> DataFrame:
    """What the requests of ``ordered_changes`` did, one row per entity, name and run (and per value for
    removals of properties): added, overwritten, exists, removed or missing."""
    of_value = F.when(F.col("operation") == "remove_property", F.col("value"))
    asked = changed.where("operation IS NOT NULL").groupBy("operation", "entity_id", "name", "run", of_value.alias("__value"))
    adds = F.col("operation").startswith("add")
    return asked.agg(
        F.count(_ONE).alias("requests"), F.count_if("effect").alias("__effects"), F.bool_or(F.expr("effect AND fresh")).alias("__new")
    ).select(
        "operation",
        "entity_id",
        "name",
        F.when(adds & F.col("__new"), "added")
        .when(adds & (F.col("__effects") > 0), "overwritten")
        .when(adds, "exists")
        .when(F.col("__effects") > 0, "removed")
        .otherwise("missing")
        .alias("outcome"),
        "requests",
        (F.col("requests") - F.col("__effects")).alias("rejected"),
    )


def annotations(entities: DataFrame, tags: DataFrame, properties: DataFrame, id_column: str) -> DataFrame:
    """One row per entity: its tags in order and its properties as a map, both empty by default."""
    ordered = tags.groupBy(F.col("entity_id").alias(id_column)).agg(
        F.sort_array(F.collect_list(F.struct("seq", "tag"))).getField("tag").alias("__tags")
    )
    mapped = properties.groupBy(F.col("entity_id").alias(id_column)).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("__properties")
    )
    return entities.select(id_column).join(ordered, id_column, "left").join(mapped, id_column, "left").select(
        id_column,
        F.coalesce("__tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("__properties", F.create_map().cast("map<string,string>")).alias("properties"),
    )


def overwrite_tags(tags: DataFrame, wanted: DataFrame) -> DataFrame:
    """The tags with those of the entities in ``wanted (entity_id, tags, ..)`` put in the place of
    the old ones; a tag that is named twice counts once, a null array is an empty one."""
    new = wanted.select("entity_id", F.posexplode(F.array_distinct("tags")).alias("at", "tag"))
    kept = tags.join(wanted.select("entity_id"), "entity_id", "left_anti")
    return kept.select("entity_id", "tag", "seq").unionByName(new.select("entity_id", "tag", F.col("at").cast("bigint").alias("seq")))


def overwrite_properties(properties: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same for ``wanted (entity_id, properties, ..)``, a map."""
    new = wanted.select("entity_id", F.explode("properties").alias("key", "value"))
    kept = properties.join(wanted.select("entity_id"), "entity_id", "left_anti")
    return kept.select("entity_id", "key", "value").unionByName(new)


def blocking_datasets(targets: DataFrame, datasets: DataFrame) -> DataFrame:
    """Datasets that keep the targeted models from being deleted, one row each."""
    named = datasets.select("data_model_id", F.col("code").alias("dataset"))
    return targets.select(
        "data_model_id", model_name(F.col("code"), F.col("version")).alias("name")
    ).join(named, "data_model_id")


def deletable_models(targets: DataFrame, datasets: DataFrame) -> DataFrame:
    """Targeted models without any dataset."""
    return targets.join(datasets.select("data_model_id"), "data_model_id", "left_anti")


def drop_models(table: DataFrame, targets: DataFrame, id_column: str = "data_model_id") -> DataFrame:
    """Rows of a table that do not belong to the targeted models."""
    # Not made distinct: an aggregate below the join would keep Spark from splitting a hot model.
    gone = targets.select(F.col("data_model_id").alias(id_column))
    return table.join(gone, id_column, "left_anti")


def registration_conflicts(candidates: DataFrame, models: DataFrame) -> DataFrame:
    """Candidates ``(code, version)`` that are registered already or come more than once."""
    asked = candidates.groupBy("code", "version").agg(F.count(_ONE).alias("copies"))
    known = models.select("code", "version").distinct().withColumn("__known", F.lit(True))
    return asked.join(known, ["code", "version"], "left").where(
        F.col("__known").isNotNull() | (F.col("copies") > 1)
    ).select(
        "code",
        "version",
        "copies",
        F.when(F.col("__known").isNotNull(), "registered").otherwise("repeated").alias("conflict"),
    )


def dataset_rows(new: DataFrame, labels: DataFrame, on: Sequence[str], status: str) -> DataFrame:
    """Catalog rows of new datasets; the label is the one that the dictionary gives the code."""
    return new.join(labels.select(*on, "label"), list(on), "left").withColumn("status", F.lit(status))


def _tag_requests(tags: DataFrame, requests: DataFrame) -> DataFrame:
    asked = requests.groupBy("entity_id", "tag").agg(
        F.min("seq").alias("seq"), F.count(_ONE).alias("requests")
    )
    present = tags.select("entity_id", "tag").distinct().withColumn("__has", F.lit(True))
    return asked.join(present, ["entity_id", "tag"], "left").withColumn(
        "__present", F.col("__has").isNotNull()
    )
