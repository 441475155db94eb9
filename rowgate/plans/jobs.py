"""Jobs that put the operators together and write their results.

A failed job can be run again with the same input and run id: the load replaces whole tables, its reports replace those of the
same run, and so does its history in the ledger. Intermediate tables are removed when a job ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgate.functions.schema import DEFAULT_CONSTRAINTS, DEFAULT_KEY_INDEX, DEFAULT_MAPPING, Constraint, FieldMapping
from rowgate.operators import checks, dedup, gate, lookups, reports
from rowgate.operators.rows import nonblank_rows, select_sheets, sheet_inventory, to_records
from rowgate.session import remove_folder, run_folder
from rowgate.sources import ledger as ledgers
from rowgate.sources import sinks, tables

#: Write jobs of one load that run side by side.
WRITERS = 4


class RefusedRequest(ValueError):
    """The request cannot be started; nothing was changed. `rows` holds everything that speaks against it, the message its
    first names and their number."""

    def __init__(self, reason: str, rows: DataFrame | None = None) -> None:
        super().__init__(reason)
        self.rows = rows


def _refuse_if_any(rows: DataFrame, reason: str, name: str, order: str) -> None:
    found = lookups.preview(rows.select(F.col(name).alias("sheet_name"), F.col(order).alias("sheet_order")).distinct()).first()
    if found.n_total:
        raise RefusedRequest(f"{reason}: {found.preview}", rows)


@contextmanager
def _scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for intermediate tables, removed at the end."""
    folder = run_folder(spark, "job")
    try:
        yield folder
    finally:
        remove_folder(spark, folder)


@dataclass(frozen=True)
class LoadResult:
    gate: DataFrame  # one row per table, as recorded in the ledger
    reconciled: DataFrame  # scanned against stored rows
    totals: DataFrame  # one row: counts, success, partial and the run's error text


def resolve_selection(selected: DataFrame, sheet_map: DataFrame) -> DataFrame:
    """Selected sheets with their tables; refuses empty, unmapped and conflicting selections."""
    if selected.isEmpty():
        raise RefusedRequest("no sheet is selected")
    _refuse_if_any(lookups.unmapped_sheets(selected, sheet_map), "sheets without a table", "sheet_name", "sheet_order")
    conflicts = lookups.table_conflicts(selected, sheet_map).withColumn("conflict", F.concat("table_name", F.lit(" ["), "sheet_name", F.lit("]")))
    _refuse_if_any(conflicts, "several sheets want one table", "conflict", "sheet_order")
    return lookups.mapped_sheets(selected, sheet_map)


def run_load(
    rows: DataFrame,
    wanted: DataFrame,
    target: str,
    ledger: str,
    run_id: str,
    finished_at: str,
    inventory: DataFrame | None = None,
    existing: DataFrame | None = None,
    table_errors: DataFrame | None = None,
    writer_errors: DataFrame | None = None,
    constraints: list[Constraint] = DEFAULT_CONSTRAINTS,
    mapping: list[FieldMapping] = DEFAULT_MAPPING,
    report_folder: str | None = None,
    started_at: str = "",
    source: str = "",
) -> LoadResult:
    """Checks, gates and loads the wanted sheets (sheet_name, sheet_order, table_name), then counts what is stored and records the
    outcome.

    The input is read twice, and only the wanted sheets of it: once to check it (the narrow result is kept for the gate
    and the reports) and once to write the tables that pass. `inventory` names the sheets of the input, also those without a
    row; without it, sheets with rows count. `writer_errors` (address, message, team, company_name) are rows that a writer
    refused; they fail their table. A table whose write fails, or that then holds another number of rows than were scanned, is recorded as failed;
    the others are loaded. Readers of the target see a table as it was or as it is then, never in between."""
    spark, wanted = rows.sparkSession, _local(wanted)  # as many rows as the request has
    # One name per selected sheet; they are pushed to the scan.
    request = wanted.collect()
    names = [r.sheet_name for r in request]
    if not names:
        raise RefusedRequest("no sheet is selected")
    if len({r.table_name for r in request}) < len({(r.table_name, r.sheet_name) for r in request}):
        shared = wanted.groupBy("table_name").agg(F.count_distinct("sheet_name").alias("n"), F.min("sheet_order").alias("sheet_order")).where("n > 1")
        _refuse_if_any(shared, "several sheets want one table", "table_name", "sheet_order")
    if existing is not None:
        _refuse_if_any(lookups.missing_tables(wanted, existing), "missing tables", "table_name", "sheet_order")
    records = to_records(nonblank_rows(select_sheets(rows, names)), mapping)
    present = inventory if inventory is not None else sheet_inventory(select_sheets(rows, names))
    with _scratch(spark) as scratch:
        checked = sinks.write_and_read(checks.checked_rows(records, constraints, mapping), f"{scratch}/checked")
        found = checks.found_errors(checked)
        if writer_errors is not None:
            found = found.unionByName(checks.writer_errors(writer_errors.join(wanted.select("sheet_name"), "sheet_name", "left_semi")))
        errors = sinks.write_and_read(found, f"{scratch}/errors")
        # From here on there is one row per table, as many as the request names.
        decided = _local(gate.load_gate(wanted, checked.select("sheet_name", F.lit(None).cast("string").alias("kind")), present, table_errors, errors))
        broken = _write_tables(records, decided, target, mapping)
        loaded = decided.join(broken, "table_name", "left_anti")
        stored = tables.count_from_footers(spark, target, [r.table_name for r in decided.where("status = 'success'").collect()])
        reconciled = _local(gate.reconcile(loaded, stored))
        final = _local(gate.settled(decided, reconciled, broken))
        ledgers.append(gate.ledger_rows(final, run_id, finished_at, started_at, source), ledger)
        if report_folder is not None:
            _write_reports(final, errors, wanted, f"{report_folder}/run_id={run_id}")
        return LoadResult(final, reconciled, _local(gate.load_outcome(final)))


def _local(df: DataFrame) -> DataFrame:
    """A result with a row per table of the request, worked out and held by the driver."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _write_tables(records: DataFrame, decided: DataFrame, target: str, mapping: list[FieldMapping]) -> DataFrame:
    """Replaces the tables that pass and returns (table_name, error) of those whose write failed.

    All tables are written by one job, which reads the input once. If it fails, each half of the tables gets a job of its own, and so on
    until the tables that cannot be written stand alone: at most two jobs more for each halving of each of them. Every job commits its tables.
    What an earlier load replaced is removed first, so readers that began before this load keep their rows."""
    spark, passed = records.sparkSession, decided.where("status = 'success'").select("sheet_name", "table_name", "n_rows").collect()
    tables.remove_old(spark, target)
    groups, failed = [[r.table_name for r in passed if r.n_rows]], []
    sheets = {r.table_name: r.sheet_name for r in passed}

    def put(group: list[str]) -> str | None:
        try:
            # The names reach the scan, so a job of its own reads only its sheets.
            rows = gate.loadable_rows(select_sheets(records, [sheets[t] for t in group]), decided.where(F.col("table_name").isin(group)))
            version = tables.write_version(rows, target, mapping)
            tables.commit(spark, target, dict.fromkeys(group, version))
        except (PySparkException, Py4JJavaError) as e:
            return (str(e).strip() or type(e).__name__).split("\n")[0]
        return None

    emptied = [r.table_name for r in passed if not r.n_rows]
    if emptied:
        try:
            tables.commit(spark, target, dict.fromkeys(emptied))
        except (PySparkException, Py4JJavaError) as e:
            failed += [(t, str(e).split("\n")[0]) for t in emptied]
    with ThreadPoolExecutor(WRITERS) as pool:
        while groups := [g for g in groups if g]:
            outcomes = list(zip(groups, pool.map(put, groups), strict=True))
            failed += [(g[0], error) for g, error in outcomes if error and len(g) == 1]
            groups = [part for g, error in outcomes if error and len(g) > 1 for part in (g[: len(g) // 2], g[len(g) // 2 :])]
    return spark.createDataFrame(failed, "table_name string, error string")


def _write_reports(final: DataFrame, errors: DataFrame, wanted: DataFrame, folder: str) -> None:
    """Row errors, summary, detail and text report of the failed tables, each with the columns that order it."""
    def put(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
        df.orderBy(*order).write.mode("overwrite").parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    failed = gate.failed_tables(final).join(wanted.select("sheet_name", "sheet_order"), "sheet_name")
    bad = errors.join(failed.select("sheet_name"), "sheet_name", "left_semi")
    listed = put(reports.with_tableless_errors(bad, failed.withColumnRenamed("table_error", "error")), "errors", "sheet_order", "sheet_name", "row_num")
    ranges = put(reports.summary_ranges(listed), "summary_ranges", *reports.OWNER, "range_start")
    summary = put(reports.error_summary(ranges), "summary", "sheet_order", "first_row", "owner")
    put(reports.summary_items(listed, ranges), "summary_items", *reports.SUMMARY_ORDER)
    put(reports.summary_footer(summary), "footer", "n_sheets")
    put(reports.error_detail(listed), "detail", "sheet_order", "sheet_name", F.col("row_num").asc_nulls_first(), "problem", "field_pos")
    groups = put(reports.error_ranges(listed.where("row_num IS NOT NULL")), "ranges", "sheet_order", "sheet_name", "message", "range_start")
    put(reports.report_pieces(failed, groups, "load"), "report", *reports.REPORT_ORDER)


def run_dedup(
    rows: DataFrame,
    folder: str,
    mode: str = dedup.GLOBAL,
    key_index: int = DEFAULT_KEY_INDEX,
    sheets: list[str] | None = None,
    inventory: DataFrame | None = None,
    ledger: str | None = None,
    run_id: str = "",
    started_at: str = "",
    finished_at: str = "",
    source: str = "",
) -> DataFrame:
    """Writes the de-duplicated copy, the duplicate list and the statistics below `folder`, which must be
    new, and returns the statistics. They are written last, and only if the copy and the list, read
    back, make up the input again: a folder without them must not be used.

    The input is read twice: once narrow, for the list and the new row numbers, and once for the copy, where one join takes the listed rows
    out and gives the others their numbers."""
    spark = rows.sparkSession
    with _scratch(spark) as scratch:
        keyed = sinks.write_and_read(dedup.keyed_rows(rows, key_index, sheets), f"{scratch}/keyed")
        listing = sinks.write_and_read(dedup.listing_of(keyed, mode), f"{folder}/listing")
        sinks.write_duplicate_list(listing, f"{folder}/duplicates.csv")
        gone = listing.where("action = 'delete'")
        numbers = sinks.write_and_read(dedup.numbering(keyed, gone), f"{scratch}/numbers")
        copy = sinks.write_and_read(dedup.copy_rows(rows, numbers), f"{folder}/rows")
        unsure = gate.counts_agree(gate.rows_per_sheet(keyed), gate.kept_and_deleted(copy, gone)).where("NOT agrees").withColumn("n", F.lit(1))
        _refuse_if_any(unsure, "row counts disagree", "sheet_name", "n_first")
        stats = sinks.write_and_read(dedup.stats_of(copy, gone, sheets, inventory), f"{folder}/stats")
        if ledger is not None:
            ledgers.append(gate.dedup_history(stats, run_id, mode, finished_at, started_at, source), ledger)
        return stats


def run_validation(
    rows: DataFrame,
    sheets: list[str] | None = None,
    constraints: list[Constraint] = DEFAULT_CONSTRAINTS,
    mapping: list[FieldMapping] = DEFAULT_MAPPING,
    inventory: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(findings, counts per sheet); nothing is written. An empty selection is refused. With an inventory of the input, selected
    sheets without a row count, too."""
    if sheets is not None and not sheets:
        raise RefusedRequest("no sheet is selected")
    records = to_records(nonblank_rows(select_sheets(rows, sheets)), mapping)
    errors = checks.validation_errors(records, constraints)
    chosen = select_sheets(inventory, sheets) if inventory is not None else None
    return errors, checks.validation_by_sheet(records, errors, chosen)
