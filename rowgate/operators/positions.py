"""Positions, ordinals and row ranges without one task per group.

A sheet, a message or an owner may hold a third of all rows, so no window here spans a whole
group. Rows are cut into position buckets of BUCKET_ROWS; a window works inside
(group, bucket), and what crosses bucket borders is settled on one small row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_ROWS = 1 << 16


def _bucket(position: Column, bucket_rows: int) -> Column:
    return F.call_function("div", position, F.lit(bucket_rows))


def number_rows(
    df: DataFrame, groups: list[str], position: str, out: str, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """1-based ordinal of each row in its group, by `position` (an integer, unique in the group)."""
    bucketed = df.withColumn("_bucket", _bucket(F.col(position), bucket_rows))
    earlier = W.partitionBy(*groups).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*groups, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*groups, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = W.partitionBy(*groups, "_bucket").orderBy(position)
    return (
        bucketed.join(offsets, [*groups, "_bucket"])
        .withColumn(out, F.col("_offset") + F.row_number().over(inside))
        .drop("_bucket", "_offset")
        .select(*df.columns, out)
    )


def row_ranges(
    df: DataFrame,
    groups: list[str],
    row: str = "row_num",
    sums: dict[str, Column] | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Maximal runs of consecutive row numbers per group: range_start, range_end, and the given
    sums over the input rows of each run. Repeated row numbers count as one."""
    sums = sums or {}
    inside = W.partitionBy(*groups, "_bucket").orderBy(row)
    runs = (
        df.where(F.col(row).isNotNull())
        .select(*groups, row, *[c.alias(name) for name, c in sums.items()])
        .withColumn("_bucket", _bucket(F.col(row), bucket_rows))
        .withColumn("_run", F.col(row) - F.dense_rank().over(inside))
        .groupBy(*groups, "_bucket", "_run")
        .agg(
            F.min(row).alias("_start"),
            F.max(row).alias("_end"),
            *[F.sum(name).alias(name) for name in sums],
        )
    )
    # Only a run that touches a bucket border can go on in the next bucket; there are at most two
    # per bucket. They meet in one window per group, all others stay with their bucket.
    first_of_bucket = F.col("_start") == F.col("_bucket") * bucket_rows
    last_of_bucket = F.col("_end") == (F.col("_bucket") + 1) * bucket_rows - 1
    chain_home = F.when(~(first_of_bucket | last_of_bucket), F.col("_bucket"))
    along = W.partitionBy(*groups, "_home").orderBy("_start")
    starts_chain = F.coalesce(F.lag("_end").over(along) + 1 < F.col("_start"), F.lit(True))
    chains = (
        runs.withColumn("_home", chain_home)
        .withColumn("_new", starts_chain.cast("int"))
        .withColumn("_chain", F.sum("_new").over(along))
    )
    return (
        chains.groupBy(*groups, "_home", "_chain")
        .agg(
            F.min("_start").alias("range_start"),
            F.max("_end").alias("range_end"),
            *[F.sum(name).alias(name) for name in sums],
        )
        .drop("_home", "_chain")
    )


def range_label(start: str = "range_start", end: str = "range_end") -> Column:
    """'140614-140615', or '140620' for a single row."""
    first, last = F.col(start).cast("string"), F.col(end).cast("string")
    return F.when(F.col(start) == F.col(end), first).otherwise(F.concat(first, F.lit("-"), last))
