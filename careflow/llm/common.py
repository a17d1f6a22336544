"""What the corpus operators share: stored intermediate tables, words, and runs of sorted rows."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.sources.store import scratch_path

#: Word separators: space and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once a session, whatever their working folder."""
    context = spark.sparkContext
    if context.getLocalProperty("careflow.shipped"):
        return
    root = Path(__file__).resolve().parents[2]
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="careflow-")) / "careflow"), "zip", root, "careflow")
    context.addPyFile(archive)
    context.setLocalProperty("careflow.shipped", "yes")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the cluster's shared folder and read again, which cuts its lineage.

    The files survive the loss of executors. They are removed by ``discard``, or when the session's JVM ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove the files of a ``stored`` table that nothing reads any more: what was made of it is stored itself."""
    context = table.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        where = context._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as make it differ from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; NULL and blank texts have none."""
    plain = F.trim(F.translate(text, SPACES, " " * len(SPACES)))
    return F.when(F.length(plain) > 0, F.size(F.split(plain, " +"))).otherwise(0).cast("long")


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 with A-Z lower-cased; bytes know no other letters or spaces than ASCII."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def sorted_pieces(
    batches: Iterator[pa.RecordBatch],
    arrays: Callable[[pa.RecordBatch], dict[str, np.ndarray]],
    key: Callable[[dict[str, np.ndarray]], np.ndarray],
    size: int,
) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """Cut the sorted rows of a partition to pieces of whole runs of equal ``key``, of about ``size`` rows.

    Yields (arrays, bounds, open): run i holds the rows bounds[i]:bounds[i+1], and open[i] tells
    that rows of its key may stand elsewhere: in a neighbouring partition, or in another piece because
    the run alone is longer than ``size``.
    """
    held: dict[str, np.ndarray] | None = None
    first = True

    def piece(part: dict[str, np.ndarray], keys: np.ndarray, start_open: bool, end_open: bool):
        bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        is_open = np.zeros(len(bounds) - 1, dtype=bool)
        is_open[0] |= start_open
        is_open[-1] |= end_open
        return part, bounds, is_open

    for batch in batches:
        if not batch.num_rows:
            continue
        new = arrays(batch)
        held = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in new}
        while len(next(iter(held.values()))) > size:
            keys = key(held)
            starts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            fitting = starts[starts <= size]
            long_run = not len(fitting)
            cut = size if long_run else int(fitting[-1])
            yield piece({c: a[:cut] for c, a in held.items()}, keys[:cut], first, long_run)
            held, first = {c: a[cut:] for c, a in held.items()}, long_run
    if held is not None and len(next(iter(held.values()))):
        yield piece(held, key(held), first, True)


def merge_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (the smallest member's index of every member's set) after joining the sets of a[i] and b[i]."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
