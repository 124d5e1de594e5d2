"""Column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space of the word contracts, as a character class body.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\f\r"


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs of characters that are no white space, in order."""
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+"))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns: whatever else a table carries can clash with no name of an operator."""
    return df.select(*columns)


#: Rows of a few numbers or digests that are sent to all tasks at most.
MAX_BROADCAST_ROWS = 500_000


def counted_broadcast(df: DataFrame) -> DataFrame:
    """The frame, to be broadcast if it has at most ``MAX_BROADCAST_ROWS`` rows. It is counted,
    so it should be cheap: read from a written table."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else df


def slices(batches, max_bytes: int, column: str = "text"):
    """Cut Arrow batches so that a piece holds about ``max_bytes`` of the column, one row at least.

    Bounds what vectorised code allocates at once, whatever the batch size of the session.
    """
    import numpy as np

    for batch in batches:
        sizes = batch.column(column).cast("large_binary")
        ends = np.frombuffer(sizes.buffers()[1], dtype=np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
        at, n = 0, batch.num_rows
        while at < n:
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] + max_bytes, side="right")) - 1)
            yield batch.slice(at, upto - at)
            at = upto


#: Bytes of an Arrow batch sent to a Python worker, one row at least.
ARROW_BYTES = 4 << 20

_shipped: set[str] = set()


def ship_package(spark) -> None:
    """Make this package importable in Python workers that start elsewhere, once per application, and
    bound what one Arrow batch brings to them, as texts may be long."""
    import os
    import tempfile
    import zipfile

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    target = os.path.join(tempfile.mkdtemp(prefix="tabwarden-code-"), "tabwarden_code.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, files in os.walk(os.path.join(root, "tabwarden")):
            for file in files:
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    archive.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(target)
    _shipped.add(application)
