"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_temporary_roots: dict[str, str] = {}
_open_scopes: list[list[str]] = []


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tabwarden")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def keep_methods_compilable(spark: SparkSession) -> None:
    """Have Spark split generated code that the JVM would only interpret.

    HotSpot leaves methods of more than 8000 bytes uncompiled, and Spark's own limit for
    giving up on one large method is far above that.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir`` of the session.

    Only where the cluster names none (single-machine tests) a temporary folder is taken.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors see.")
        application = spark.sparkContext.applicationId
        if application not in _temporary_roots:
            _temporary_roots[application] = tempfile.mkdtemp(prefix="tabwarden-")
        named = _temporary_roots[application]
    return named.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    for made in _open_scopes:
        made.append(path)
    return path


@contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """The list of the scratch paths that are made inside, for ``remove_scratch`` once what needs them is written."""
    made: list[str] = []
    _open_scopes.append(made)
    try:
        yield made
    finally:
        _open_scopes[:] = [scope for scope in _open_scopes if scope is not made]


def remove_scratch(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove scratch paths from the shared folder; those that are gone already don't matter."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        place = hadoop.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def persisted_copy(df: DataFrame, label: str) -> DataFrame:
    """Write the frame to the shared folder and read it back.

    Cuts the lineage, and two later passes see the same rows in the same files, also
    after an executor is lost.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
