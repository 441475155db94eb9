"""The load gate: a table is replaced only when its sheet has no bad row.

Everything here is one row per table. Counts are combined before the shuffle, so a sheet that
holds most of the rows costs no more than the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgate.functions.messages import JOINER, RUN_ERROR_TEXT

ABSENT = "sheet is not in the input"


def sheet_counts(verdicts: DataFrame) -> DataFrame:
    """Scanned rows and bad rows per sheet, from rows with a verdict."""
    return verdicts.groupBy("sheet_name").agg(F.count(F.lit(1)).alias("n_rows"), F.count("kind").alias("n_errors"))


def load_gate(
    selected: DataFrame,
    verdicts: DataFrame,
    inventory: DataFrame | None = None,
    table_errors: DataFrame | None = None,
    errors: DataFrame | None = None,
) -> DataFrame:
    """Outcome per selected table (`selected`: sheet_name, table_name).

    A selected sheet with no rows passes and empties its table. With an inventory of the input, a
    selected sheet that is not in it fails. `table_errors` (table_name, error) are failures of the
    table as a whole. With `errors` (one row per failing row or refused write), bad rows are counted there; a row counts once."""
    zero = F.lit(0).cast("bigint")
    counts = sheet_counts(verdicts)
    if errors is not None:
        per_row = errors.groupBy("sheet_name", "row_num").agg(F.lit(1).alias("one"))
        bad = per_row.groupBy("sheet_name").agg(F.count(F.lit(1)).alias("n_errors"))
        counts = counts.drop("n_errors").join(bad, "sheet_name", "full_outer")
    gate = selected.select("sheet_name", "table_name").join(counts, "sheet_name", "left")
    reasons: list[Column] = []
    if inventory is not None:
        present = inventory.select("sheet_name", F.lit(True).alias("_present")).distinct()
        gate = gate.join(present, "sheet_name", "left")
        reasons.append(F.when(F.col("_present").isNull(), F.lit(ABSENT)))
    if table_errors is not None:
        gate = gate.join(table_errors.select("table_name", "error"), "table_name", "left")
        reasons.append(F.col("error"))
    n_errors = F.coalesce("n_errors", zero)
    table_error = F.coalesce(*reasons, F.lit(None).cast("string")) if reasons else F.lit(None).cast("string")
    return gate.select(
        "sheet_name",
        "table_name",
        F.coalesce("n_rows", zero).alias("n_rows"),
        n_errors.alias("n_errors"),
        table_error.alias("table_error"),
        F.when((n_errors > 0) | table_error.isNotNull(), "failed").otherwise("success").alias("status"),
    )


def settled(gate: DataFrame, reconciled: DataFrame, write_errors: DataFrame | None = None) -> DataFrame:
    """The gate after the write: a table that should have been replaced, but whose write failed (table_name, error) or that holds another
    number of rows than were scanned, has failed."""
    diff = reconciled.select("table_name", "diff")
    off = F.concat(F.lit("stored rows differ from scanned rows by "), F.col("diff").cast("string"))
    joined = gate.join(diff, "table_name", "left")
    broken = F.lit(None).cast("string")
    if write_errors is not None:
        joined = joined.join(write_errors.select("table_name", F.col("error").alias("_write_error")), "table_name", "left")
        broken = F.col("_write_error")
    error = F.when(F.col("status") == "success", F.coalesce(broken, F.when(F.col("diff") != 0, off)))
    return joined.select(
        *[c for c in gate.columns if c not in ("table_error", "status")],
        F.coalesce("table_error", error).alias("table_error"),
        F.when(error.isNotNull(), "failed").otherwise(F.col("status")).alias("status"),
    )


def load_outcome(gate: DataFrame) -> DataFrame:
    """Totals of a run. `partial` means that at least one table failed, also when all did."""
    failed = F.count_if(F.col("status") == "failed")
    return gate.agg(
        F.count(F.lit(1)).alias("n_tables"),
        F.count_if(F.col("status") == "success").alias("n_loaded"),
        failed.alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("status") == "success", F.col("n_rows"))), F.lit(0)).cast("bigint").alias("rows_loaded"),
        F.coalesce(F.sum("n_errors"), F.lit(0)).cast("bigint").alias("error_rows"),
        (failed == 0).alias("success"),
        (failed > 0).alias("partial"),
    )


def run_error(gate: DataFrame) -> DataFrame:
    """The run's error line in pieces, one per failed table in the order of names: read one after the other, they give the number of
    failed tables and all their names. No piece for a run without a failure."""
    failed = failed_tables(gate).select("table_name").distinct()
    total = failed.agg(F.count(F.lit(1)).alias("n_failed"), F.min("table_name").alias("first"))
    head = F.concat(F.col("n_failed").cast("string"), F.lit(RUN_ERROR_TEXT[0]))
    text = F.when(F.col("table_name") == F.col("first"), F.concat(head, "table_name")).otherwise(F.concat(F.lit(JOINER), "table_name"))
    joined = failed.withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one")
    return joined.select("table_name", "n_failed", text.alias("text"))


def failed_tables(gate: DataFrame) -> DataFrame:
    return gate.where("status = 'failed'")


def loadable_rows(records: DataFrame, gate: DataFrame) -> DataFrame:
    """Rows of the tables that passed, with their table name. A passed sheet has no bad row."""
    passed = gate.where("status = 'success'").select("sheet_name", "table_name")
    return records.drop("kind").join(passed, "sheet_name")


def ledger_rows(gate: DataFrame, run_id: str, finished_at: str, started_at: str = "", source: str = "") -> DataFrame:
    """History of a load, one row per table, with the error text of a failed one."""
    return gate.select(
        F.lit(run_id).alias("run_id"),
        "table_name",
        "sheet_name",
        "status",
        F.when(F.col("status") == "success", F.col("n_rows")).otherwise(F.lit(0)).cast("bigint").alias("rows"),
        F.col("n_errors").alias("error_rows"),
        F.coalesce("table_error", F.lit("")).alias("error"),
        F.lit(started_at).alias("started_at"),
        F.lit(finished_at).alias("finished_at"),
        F.lit(source).alias("source"),
    )


def dedup_history(stats: DataFrame, run_id: str, mode: str, finished_at: str, started_at: str = "", source: str = "") -> DataFrame:
    """History of a de-duplication: its totals in one row."""
    total = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("total", "kept", "deleted")]
    return stats.agg(F.count(F.lit(1)).alias("n_sheets"), F.count_if("copied_only").alias("n_copied"), *total).select(
        F.lit(run_id).alias("run_id"), F.lit(mode).alias("mode"), "n_sheets", "n_copied", "total", "kept", "deleted",
        F.lit(started_at).alias("started_at"), F.lit(finished_at).alias("finished_at"), F.lit(source).alias("source"),
    )


def table_row_counts(target: DataFrame) -> DataFrame:
    return target.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_stored"))


def reconcile(gate: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows scanned against rows stored (table_name, n_stored), per loaded table; `diff` is 0 when they agree."""
    loaded = gate.where("status = 'success'").select("table_name", "n_rows")
    stored = F.coalesce("n_stored", F.lit(0).cast("bigint"))
    return loaded.join(counts, "table_name", "left").select(
        "table_name", "n_rows", stored.alias("n_stored"), (stored - F.col("n_rows")).alias("diff")
    )


def counts_agree(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two independent row counts per sheet (sheet_name, n), side by side. When they disagree, rows were
    lost or doubled, and the result must not be used."""
    zero = F.lit(0).cast("bigint")
    n_first, n_second = F.coalesce("n_first", zero), F.coalesce("n_second", zero)
    return (
        first.select("sheet_name", F.col("n").alias("n_first"))
        .join(second.select("sheet_name", F.col("n").alias("n_second")), "sheet_name", "full_outer")
        .select("sheet_name", n_first.alias("n_first"), n_second.alias("n_second"), (n_first == n_second).alias("agrees"))
    )


def rows_per_sheet(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sheet_name").agg(F.count(F.lit(1)).alias("n"))


def kept_and_deleted(kept: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows per sheet of two results that together must be the whole input."""
    both = rows_per_sheet(kept).unionByName(rows_per_sheet(deleted))
    return both.groupBy("sheet_name").agg(F.sum("n").alias("n"))
