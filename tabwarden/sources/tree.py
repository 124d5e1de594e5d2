"""Names that Spark's file sources leave out: those that begin with ``_`` or ``.``.

A study folder may have any name, and so may its files. The cluster's own file system
client lists the tree, one pair of calls per level, and only hidden entries come to the driver's Python; below a
hidden folder Spark lists and reads as anywhere. Files hidden by their own name can't be given to a reader at all.
Each gets a copy under a plain name in the shared folder, streamed by the file system client, and what is read
from the copy is told under the name of the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from fnmatch import fnmatchcase

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tabwarden.session import scratch

_HIDDEN = "[_.]*"
_COPY = re.compile(r"(hidden-[0-9a-f]{32}/[0-9]+[.]csv)$")

# Per application: the copy of each hidden file, by the encoded path of the file.
_copies: dict[tuple[str, str], str] = {}


def is_hidden(file: str) -> bool:
    return file.rstrip("/").rsplit("/", 1)[-1].startswith(("_", "."))


def hidden_entries(spark: SparkSession, root: str, file_glob: str) -> tuple[list[str], list[tuple[str, int]], bool]:
    """Hidden folders below ``root``, hidden files of the pattern as (encoded path, bytes), and whether
    ``root`` is itself such a file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    store = hadoop.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders, files = [], []

    def told(entries) -> None:
        for entry in entries or ():
            path = entry.getPath()
            if entry.isDirectory():
                folders.append(path.toString())
            elif fnmatchcase(path.getName(), file_glob):
                # A listing writes the scheme in another way than Spark does; patterns and texts give Spark's.
                files.append((hadoop.Path(path.toString()).toUri().toString(), entry.getLen()))

    if is_hidden(root):
        told(entry for entry in store.globStatus(hadoop.Path(root)) or () if entry.isFile())
    is_file = bool(files)
    level = hadoop.FileUtil.stat2Paths(store.globStatus(hadoop.Path(root)))
    seen = {path.toString() for path in level or ()}
    is_hidden_name, same = hadoop.GlobFilter(_HIDDEN), spark.sparkContext._jvm.java.util.Objects.deepEquals
    while level is not None and len(level):
        below = hadoop.FileUtil.stat2Paths(store.listStatus(level))
        # A listed file stands for itself, so below the last folders nothing changes.
        if same(level, below):
            break
        fresh = [entry for entry in store.listStatus(level, is_hidden_name) if entry.getPath().toString() not in seen]
        seen.update(entry.getPath().toString() for entry in fresh)
        told(fresh)
        level = below
    return folders, files, is_file


def copy_hidden(spark: SparkSession, files: Iterable[str]) -> None:
    """Make the copies from which hidden files are read; those that have one keep it."""
    application = spark.sparkContext.applicationId
    missing = [f for f in files if is_hidden(f) and (application, f) not in _copies]
    if not missing:
        return
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop, folder = jvm.org.apache.hadoop.fs, scratch(spark, "hidden")
    for number, file in enumerate(missing):
        source, target = hadoop.Path(jvm.java.net.URI(file)), hadoop.Path(f"{folder}/{number}.csv")
        hadoop.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, conf)
        _copies[(application, file)] = f"{folder}/{number}.csv"


def copy_of(spark: SparkSession, file: str) -> str | None:
    return _copies.get((spark.sparkContext.applicationId, file))


def told_path(spark: SparkSession, path: Column, read: Sequence[str]) -> Column:
    """The path of a row's file, for rows read from copies the path of the hidden file itself."""
    application = spark.sparkContext.applicationId
    wanted = set(read)
    named = {_COPY.search(c)[1]: f for (a, f), c in _copies.items() if a == application and c in wanted}
    if not named:
        return path
    known = F.create_map(*[F.lit(part) for pair in named.items() for part in pair])
    return F.coalesce(F.try_element_at(known, F.regexp_extract(path, _COPY.pattern, 1)), path)
