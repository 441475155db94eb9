"""Reports on failed rows: groups with row ranges, islands, summary per owner, detail.

A report is rows at every size: one per row range, problem or title, with the columns that put them in order. The
text of a report is its `text` column read in that order; no group is gathered for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgate.functions.messages import (
    JOINER,
    LOAD_HEAD_TEXT,
    LOAD_ROWS_INDENT,
    LOAD_TITLE_TEXT,
    PROBLEM_JOINER,
    RANGE_JOINER,
    ROWS_TEXT,
    SCANNED_TEXT,
    UNKNOWN_ERROR,
    VALIDATION_HEAD_TEXT,
    VALIDATION_ROWS_INDENT,
    VALIDATION_TITLE_TEXT,
    problem_text,
    reason_label,
)
from rowgate.functions.text import NO_OWNER, NO_VALUE, first_line, text_or
from rowgate.operators.positions import BUCKET_ROWS, range_label, row_ranges

SHOWN_LINES = 12
REPORT_ORDER = ["sheet_order", "sheet_name", "first_row", "message", "part", "position"]


def error_ranges(errors: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Errors that have a row, by sheet and message: one row per run of rows, with its number of errors."""
    sums = {"n_errors": F.lit(1).cast("bigint")}
    return row_ranges(errors, ["sheet_name", "sheet_order", "message"], sums=sums, bucket_rows=bucket_rows)


def error_groups(ranges: DataFrame) -> DataFrame:
    """One row per sheet and message of error_ranges: number of errors and first row, which orders the groups."""
    return ranges.groupBy("sheet_name", "sheet_order", "message").agg(
        F.sum("n_errors").alias("n_errors"), F.min("range_start").alias("first_row")
    )


def report_pieces(by_sheet: DataFrame, ranges: DataFrame, style: str) -> DataFrame:
    """The text report of failed sheets in pieces; style is 'load' or 'validation'.

    Read in the order of REPORT_ORDER, the pieces are the report: a head per sheet, then for each message its title
    and its row ranges. A failed table without row errors has its table_error in place of both.
    `by_sheet` has n_rows and n_errors per sheet (and table_error, for a load), `ranges` is the result of error_ranges."""
    if style not in ("load", "validation"):
        raise ValueError(f"unknown report style: {style}")

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    n_rows, n_errors = F.col("n_rows"), F.col("n_errors")
    scanned = F.when(n_rows > 0, text(SCANNED_TEXT[0], n_rows, SCANNED_TEXT[1])).otherwise("")
    if style == "load":
        head = text(LOAD_HEAD_TEXT[0], n_errors, LOAD_HEAD_TEXT[1], scanned, ":")
        title = text("\n", LOAD_TITLE_TEXT[0], F.col("message"), LOAD_TITLE_TEXT[1], n_errors, LOAD_TITLE_TEXT[2])
        indent = LOAD_ROWS_INDENT
    else:
        head = text(VALIDATION_HEAD_TEXT[0], F.col("sheet_name"), VALIDATION_HEAD_TEXT[1], n_errors, VALIDATION_HEAD_TEXT[2], scanned, ":")
        title = text("\n", VALIDATION_TITLE_TEXT[0], n_errors, VALIDATION_TITLE_TEXT[1], F.col("message"))
        indent = VALIDATION_ROWS_INDENT
    zero = F.lit(0).cast("bigint")
    failed = n_errors > 0
    if "table_error" in by_sheet.columns:
        head = F.when(n_errors > 0, head).otherwise(F.col("table_error"))
        failed = failed | F.col("table_error").isNotNull()
    heads = by_sheet.where(failed).select(
        "sheet_name", "sheet_order", zero.alias("first_row"), F.lit("").alias("message"), F.lit(0).alias("part"), zero.alias("position"), head.alias("text")
    )
    order = ["sheet_name", "sheet_order", "first_row", "message"]
    groups = error_groups(ranges)
    titles = groups.select(*order, F.lit(1).alias("part"), zero.alias("position"), title.alias("text"))
    # An inner join, so that a message with very many ranges can be split at run time.
    firsts = groups.select("sheet_name", "message", "first_row")
    before = F.when(F.col("range_start") == F.col("first_row"), f"\n{indent}").otherwise(RANGE_JOINER)
    shown = ranges.join(firsts, ["sheet_name", "message"]).select(
        *order, F.lit(2).alias("part"), F.col("range_start").alias("position"), text(before, ROWS_TEXT[0], range_label(), ROWS_TEXT[1]).alias("text")
    )
    return heads.unionByName(titles).unionByName(shown)


def error_islands(
    errors: DataFrame, reason: str | None = None, shown: int = SHOWN_LINES, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Runs of adjacent rows with validation findings, over all reasons: the row range, the number of
    findings, and fields, values and reasons as text of at most `shown` lines plus a line that says
    how many are left. With `reason`, only runs in which it occurs.

    The shown lines of a run come from its first `shown` rows, because every row of a run has at
    least one finding; so only those rows are gathered, however long the run is."""
    sheet = ["sheet_name", "sheet_order"]
    errors = errors.withColumn("_value_lines", F.length("value") - F.length(F.replace("value", F.lit("\n"), F.lit(""))) + 1)
    sums = {"n_errors": F.lit(1).cast("bigint"), "n_value_lines": F.col("_value_lines").cast("bigint")}
    if reason is not None:
        sums["n_reason"] = (F.col("reason") == reason).cast("bigint")
    islands = row_ranges(errors, sheet, sums=sums, bucket_rows=bucket_rows)
    if reason is not None:
        islands = islands.where("n_reason > 0").drop("n_reason")
    head_rows = islands.select(
        *sheet,
        "range_start",
        F.explode(F.sequence("range_start", F.least("range_end", F.col("range_start") + (shown - 1)))).alias("row_num"),
    )
    first = (
        errors.join(head_rows, [*sheet, "row_num"])
        .groupBy(*sheet, "range_start")
        .agg(F.sort_array(F.collect_list(F.struct("row_num", "check_pos", "field", "value", "reason"))).alias("_first"))
    )

    def capped(pick, n_lines: Column) -> Column:
        text = F.array_join(F.transform("_first", pick), "\n")
        head = F.array_join(F.slice(F.split(text, "\n", -1), 1, shown), "\n")
        rest = F.concat(F.lit("\n…(还有 "), (n_lines - shown).cast("string"), F.lit(" 条未显示)"))
        return F.concat(head, F.when(n_lines > shown, rest).otherwise(""))

    n = F.col("n_errors")
    return islands.join(first, [*sheet, "range_start"]).select(
        *sheet,
        "range_start",
        range_label().alias("row_text"),
        "n_errors",
        capped(lambda e: e["field"], n).alias("fields"),
        capped(lambda e: e["value"], F.col("n_value_lines")).alias("shown_values"),
        capped(lambda e: reason_label(e["reason"]), n).alias("reasons"),
    )


def with_tableless_errors(errors: DataFrame, failed_tables: DataFrame) -> DataFrame:
    """Adds one error without a row for every failed table that has no row errors; its message is the
    first line of the table's error. `failed_tables`: sheet_name, sheet_order, n_errors, error."""
    empty = F.lit(None).cast("string")
    return errors.unionByName(
        failed_tables.where("n_errors = 0").select(
            "sheet_name",
            "sheet_order",
            F.lit(None).cast("bigint").alias("row_num"),
            F.lit("db").alias("kind"),
            F.coalesce(first_line(F.col("error")), F.lit(UNKNOWN_ERROR)).alias("message"),
            F.array().cast(errors.schema["fields"].dataType).alias("fields"),
            empty.alias("team"),
            empty.alias("company_name"),
        )
    )


def _owned(errors: DataFrame) -> DataFrame:
    return errors.withColumn("owner", text_or(F.col("team"), NO_OWNER)).withColumn(
        "problem", problem_text(F.col("kind"), F.col("message"))
    )


def error_detail(errors: DataFrame) -> DataFrame:
    """One line per error and offending field; errors without fields show the company instead."""
    owned = _owned(errors)
    return owned.select(
        "sheet_name",
        "sheet_order",
        "row_num",
        F.posexplode_outer("fields").alias("field_pos", "f"),
        "company_name",
        "problem",
        "owner",
    ).select(
        "sheet_name",
        "sheet_order",
        "row_num",
        F.coalesce("field_pos", F.lit(0)).alias("field_pos"),
        F.coalesce("f.label", F.lit(NO_VALUE)).alias("label"),
        F.when(F.col("f").isNull(), text_or(F.col("company_name"), NO_VALUE)).otherwise(F.col("f.value")).alias("value"),
        "problem",
        "owner",
    )


OWNER = ["owner", "sheet_name", "sheet_order"]
SUMMARY_ORDER = [*OWNER, "part", "position", "text"]


def summary_ranges(errors: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per owner, sheet and run of failed rows. Errors without a row are runs without bounds, with their number."""
    owned = _owned(errors)
    ranges = row_ranges(owned, OWNER, bucket_rows=bucket_rows).withColumn("n_rows", F.col("range_end") - F.col("range_start") + 1)
    rowless = owned.where(F.col("row_num").isNull()).groupBy(*OWNER).agg(F.count(F.lit(1)).alias("n_rows"))
    nothing = F.lit(None).cast("bigint")
    return ranges.unionByName(rowless.select(*OWNER, nothing.alias("range_start"), nothing.alias("range_end"), "n_rows"))


def error_summary(ranges: DataFrame) -> DataFrame:
    """Per owner and sheet, from summary_ranges: distinct rows plus errors without a row, and the first row."""
    return ranges.groupBy(*OWNER).agg(F.sum("n_rows").alias("n_error_rows"), F.coalesce(F.min("range_start"), F.lit(0)).alias("first_row"))


def summary_items(errors: DataFrame, ranges: DataFrame) -> DataFrame:
    """What the summary lists for an owner and sheet, a row each: its row ranges ('rows') and its distinct problems ('problems'), at
    the position where they first occur. `text` begins with the separator but for the first of its part, so that texts read in the
    order of SUMMARY_ORDER are the cell of the summary."""
    zero = F.lit(0).cast("bigint")
    rows = ranges.where(F.col("range_start").isNotNull()).select(
        *OWNER, F.lit("rows").alias("part"), F.col("range_start").alias("position"), range_label().alias("item"), F.lit(JOINER).alias("_joiner")
    )
    problems = _owned(errors).groupBy(*OWNER, "problem").agg(F.coalesce(F.min("row_num"), zero).alias("position")).select(
        *OWNER, F.lit("problems").alias("part"), "position", F.col("problem").alias("item"), F.lit(PROBLEM_JOINER).alias("_joiner")
    )
    items = rows.unionByName(problems)
    first = items.groupBy(*OWNER, "part").agg(F.min(F.struct("position", "item")).alias("_first"))
    text = F.when(F.struct("position", "item") == F.col("_first"), F.col("item")).otherwise(F.concat("_joiner", "item"))
    return items.join(first, [*OWNER, "part"]).select(*OWNER, "part", "position", "item", text.alias("text"))


def summary_footer(summary: DataFrame) -> DataFrame:
    """Distinct sheets and the sum of the counts of the summary."""
    return summary.agg(
        F.count_distinct("sheet_name").alias("n_sheets"),
        F.coalesce(F.sum("n_error_rows"), F.lit(0)).cast("bigint").alias("n_error_rows"),
    )
