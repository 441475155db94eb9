"""Shared helpers of the operators: bounded Arrow batches, free column names, scratch tables."""

from __future__ import annotations

import atexit
import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgate.session import run_folder

#: Bytes of one Arrow batch on its way to Python, whatever the length of the texts; one longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def quoted(name: str) -> Column:
    """Column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that the DataFrame does not use yet."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def map_batches(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """mapInArrow with batches bounded in bytes, not only in rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


#: Keys up to this number are sent to all tasks (some 100 bytes each there); more are joined by a shuffle of both sides.
BROADCAST_KEYS = 500_000


def match(docs: DataFrame, keys: DataFrame, same: Column, how: str) -> DataFrame:
    """Semi or anti join of documents with a written table of keys. Few keys leave the texts where they are."""
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys.hint("merge"), same, how)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Scratch tables of this application that are still there, with their sessions, in the order in which they were written.
_written: dict[str, SparkSession] = {}


@contextlib.contextmanager
def work(spark: SparkSession) -> Iterator[None]:
    """Scratch tables that are written inside are removed at the end: everything that reads them must have been written by then."""
    before = set(_written)
    try:
        yield
    finally:
        for path in [p for p in _written if p not in before]:
            remove(spark, path)


@atexit.register
def _remove_rest() -> None:
    """What no piece of work has removed goes with the application, as far as its session still runs."""
    for path, spark in list(_written.items()):
        with contextlib.suppress(Exception):
            remove(spark, path)


class Scratch:
    """Tables below the shared folder that end with the work they were written for, or with the application."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name, self.paths = spark, name, []

    def table(self, df: DataFrame, keep: bool = True) -> DataFrame:
        """The rows, written and read again. Lineage ends here, so a lost executor repeats nothing before it.
        keep=False: drop() may remove the table while later ones stay."""
        path = run_folder(self.spark, self.name)
        _written[path] = self.spark
        df.write.parquet(path)
        if not keep:
            self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep_last: int = 0) -> None:
        """Removes the tables that were written with keep=False, but for the last ones."""
        gone = self.paths[: len(self.paths) - keep_last]
        self.paths = self.paths[len(gone) :]
        for path in gone:
            remove(self.spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a scratch table that this library wrote."""
    _written.pop(path, None)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
