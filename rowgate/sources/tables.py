"""Tables that are replaced in isolation: versions below one folder, and a manifest that names the version of each table.

    target/data/version=<id>/table_name=<name>/part-...    written once, never changed
    target/manifest/<number>.json                          the highest number holds

A write makes a new version folder, at which no reader looks. A commit makes the named tables point to it: a new manifest is written under
another name and renamed to the next number, which must not exist; who comes second takes the newer manifest and tries again. So each
commit replaces all its tables at once, a run that ends before it changes nothing, and a DataFrame that was made before goes on reading the
rows that it began with, until `remove_old` takes them away."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import or_

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgate.functions.schema import DATE_FIELD, DEFAULT_MAPPING, FieldMapping
from rowgate.session import remove_folder
from rowgate.sources.files import States

TABLE_COLUMN = "table_name"
VERSION_COLUMN = "version"
#: Version of each table; None for a table without rows.
Manifest = dict[str, str | None]


def manifest(spark: SparkSession, target: str) -> Manifest:
    """The tables of a target and their versions. One entry for each table: as small as the list of the target's tables."""
    return States(spark, f"{target}/manifest").latest()


def commit(spark: SparkSession, target: str, changed: Manifest) -> None:
    """Makes the named tables point to their new versions, all at once."""
    States(spark, f"{target}/manifest").change(lambda held: held | changed)


def write_version(rows: DataFrame, target: str, mapping: list[FieldMapping] = DEFAULT_MAPPING) -> str:
    """Writes the rows, with their table names, as a new version, which no reader sees before a commit. What a failed write left is removed.

    The rebalance hint spreads a large table over many tasks and packs small ones into few files."""
    version = uuid.uuid4().hex
    folder = f"{target}/data/{VERSION_COLUMN}={version}"
    columns = [m.field for m in sorted(mapping, key=lambda m: m.col_order)]
    try:
        rows.select(TABLE_COLUMN, "row_num", *columns).hint("rebalance", TABLE_COLUMN).write.partitionBy(TABLE_COLUMN).parquet(folder)
    except (PySparkException, Py4JJavaError):
        remove_folder(rows.sparkSession, folder)
        raise
    return version


def read_tables(spark: SparkSession, target: str, mapping: list[FieldMapping] = DEFAULT_MAPPING, names: list[str] | None = None) -> DataFrame:
    """All tables, or the named ones, as they are at this moment."""
    return _stored(spark, target, mapping, names).drop(VERSION_COLUMN)


def _stored(spark: SparkSession, target: str, mapping: list[FieldMapping], names: list[str] | None) -> DataFrame:
    """The rows with their version. Only folders of the versions in use are listed, and a filter on table_name prunes to its partition. The
    schema is stated, so that table names that look like numbers stay text and a target without any rows can be read."""
    held: dict[str, list[str]] = {}
    for table, version in manifest(spark, target).items():
        if version and (names is None or table in names):
            held.setdefault(version, []).append(table)
    fields = [f"`{m.field}` {'date' if m.field == DATE_FIELD else 'string'}" for m in sorted(mapping, key=lambda m: m.col_order)]
    schema = f"row_num bigint, {', '.join(fields)}, {VERSION_COLUMN} string, {TABLE_COLUMN} string"
    if not held:
        return spark.createDataFrame([], schema)
    folders = [f"{target}/data/{VERSION_COLUMN}={v}" for v in held]
    stored = spark.read.schema(schema).option("basePath", f"{target}/data").parquet(*folders)
    current = reduce(or_, [(F.col(VERSION_COLUMN) == v) & F.col(TABLE_COLUMN).isin(t) for v, t in held.items()])
    return stored.where(current)


def count_from_footers(spark: SparkSession, target: str, names: list[str]) -> DataFrame:
    """(table_name, n_stored) of the named tables that have rows, from the parquet footers: the count is pushed into the scan, which reads
    no column. The settings it needs hold in a session of its own; the result has a row for each table at most."""
    rows = _footer_counts(spark, target, names).collect()
    return spark.createDataFrame(rows, f"{TABLE_COLUMN} string, n_stored bigint")


def _footer_counts(spark: SparkSession, target: str, names: list[str]) -> DataFrame:
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    # Counts are pushed down only if they are grouped by all partition columns; a table has one version.
    counted = _stored(own, target, DEFAULT_MAPPING, names).groupBy(VERSION_COLUMN, TABLE_COLUMN).agg(F.count(F.lit(1)).alias("n_stored"))
    return counted.select(TABLE_COLUMN, "n_stored")


def remove_old(spark: SparkSession, target: str) -> None:
    """Removes all manifests but the last, and the versions that only they name. Versions that no manifest names may be about to be
    committed and stay."""
    states = States(spark, f"{target}/manifest")
    numbers = states.numbers()
    old, kept = numbers[:-1], numbers[-1:]
    named = [{v for n in some for v in states.at(n).values() if v} for some in (old, kept)]
    for version in sorted(named[0] - named[1]):
        remove_folder(spark, f"{target}/data/{VERSION_COLUMN}={version}")
    for n in old:
        states.delete(f"{n}.json")
