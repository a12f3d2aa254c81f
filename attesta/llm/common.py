"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import storage
from ..sources.names import quoted
from ..storage import discard, shared_folder

__all__ = ["discard", "shared_folder"]

#: A word is a maximal run of code points other than space, tab and the line controls.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"

#: Rows that go to a Python worker at once, at most; rows carry whole texts.
ARROW_ROWS = 250
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_shipped: set[str] = set()


_made: list[list[DataFrame]] = []


def column(name: str) -> Column:
    """A column of any name, with dots and backticks too."""
    return F.col(quoted(name))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and outlives a lost executor."""
    out = storage.written(df, name)
    for made in _made:
        made.append(out)
    return out


@contextlib.contextmanager
def intermediate() -> Iterator[list[DataFrame]]:
    """A list of all tables that written() makes in this block, for discard() once nothing reads them any more."""
    made: list[DataFrame] = []
    _made.append(made)
    try:
        yield made
    finally:
        _made.remove(made)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of queries that are over; it does so once the driver has collected its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, wherever they run, and bound the batches that they get."""
    if not 0 < int(spark.conf.get(_BATCH)) <= ARROW_ROWS:
        spark.conf.set(_BATCH, str(ARROW_ROWS))
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="attesta-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "attesta_ship.zip")
    with zipfile.ZipFile(target, "w") as z:
        for top, _, names in os.walk(os.path.join(root, "attesta")):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def freed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches; after the last one, memory that the worker no longer uses goes back to the system before the next task."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(col: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col), F.lit(""))


def pieces_for(n_rows: int, per_piece: int) -> int:
    """How many pieces of about per_piece rows n_rows make; at least one."""
    return max(1, -(-n_rows // per_piece))


#: Rows of a few numbers that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a hint to broadcast it, if it has been counted to have at most so many rows."""
    return F.broadcast(df) if df.count() <= most else df


def numbered(df: DataFrame, order: list[Column], name: str, *, group: tuple[str, ...] = (), rows_per_range: int = 50_000) -> DataFrame:
    """df, written, with the column `nth`: the place of a row, from 0, in its group by the order given.

    Rows are sorted in ranges of about equal counts; a place is the row's place in its range plus the counts of the
    ranges before. The order starts with the group's columns. Rows that the order leaves equal are spread by their
    place in the input, so many equal rows don't meet in one range; df has to come from stored tables. df must not
    have columns named nth, _mid, _tie or _range.
    """
    n = pieces_for(df.count(), rows_per_range)
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*order, F.col("_tie").asc()]
    ranged = tied.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_mid", F.monotonically_increasing_id())
    ranged = written(ranged.select(*df.columns, F.shiftright("_mid", 33).alias("_range"), F.col("_mid").bitwiseAND((1 << 33) - 1).alias("_mid")), name)
    found = ranged.groupBy(*group, "_range").agg(F.min("_mid").alias("_first"), F.count("*").alias("_rows"))
    # a row for each range of a group
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    bases = found.select(*group, "_range", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    bases = written(bases, f"{name}_ranges")
    return ranged.join(small(bases), [*group, "_range"]).select(*df.columns, (F.col("_base") + F.col("_mid")).alias("nth"))
