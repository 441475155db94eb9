"""From raw sheet rows to records: pruning, blank rows, selection, projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgate.functions.dates import parse_date
from rowgate.functions.schema import ADDRESS, CELLS, DATE_FIELD, DEFAULT_KEY_INDEX, DEFAULT_MAPPING, FieldMapping
from rowgate.functions.text import is_blank_if_rare, starts_visible

RAW_DATE = "collected_at_raw"
NUMERIC_DATE = "c0_is_numeric"


def prune_cells(rows: DataFrame) -> DataFrame:
    """Address and the first eleven cells (plus the numeric-date flag if the source has one)."""
    extra = [NUMERIC_DATE] if NUMERIC_DATE in rows.columns else []
    return rows.select(*ADDRESS, *CELLS, *extra)


def nonblank_rows(rows: DataFrame) -> DataFrame:
    """Rows with something in at least one of the eleven cells. Row numbers stay as they are.

    Nearly every row is settled by the first character of its name; only the others are looked at whole."""
    usual, whole = F.col(CELLS[DEFAULT_KEY_INDEX - 1]), F.concat_ws("", *CELLS)
    return prune_cells(rows).where(starts_visible(usual) | ~is_blank_if_rare(whole))


def select_sheets(rows: DataFrame, sheet_names: list[str] | None) -> DataFrame:
    """Rows of the named sheets; the list reaches the scan as a pushed filter. None selects all."""
    return rows if sheet_names is None else rows.where(F.col("sheet_name").isin(list(sheet_names)))


def sheet_inventory(rows: DataFrame) -> DataFrame:
    """Sheets of the input with their order."""
    return rows.select("sheet_name", "sheet_order").distinct()


def numeric_date(rows: DataFrame) -> Column:
    return F.coalesce(F.col(NUMERIC_DATE), F.lit(False)) if NUMERIC_DATE in rows.columns else F.lit(False)


def to_records(rows: DataFrame, mapping: list[FieldMapping] = DEFAULT_MAPPING) -> DataFrame:
    """Named fields by position. Missing text is '', a blank or unreadable date is NULL; the raw
    date text stays beside the parsed one."""

    def cell(m: FieldMapping) -> Column:
        name = f"c{m.cell_index}"
        return F.col(name) if name in rows.columns else F.lit(None).cast("string")

    columns = list(ADDRESS)
    for m in sorted(mapping, key=lambda m: m.col_order):
        if m.field == DATE_FIELD:
            is_number = numeric_date(rows)
            columns.append(F.when(~is_number, parse_date(cell(m))).alias(m.field))
            columns.append(cell(m).alias(RAW_DATE))
            columns.append(is_number.alias("date_is_numeric"))
        else:
            columns.append(F.coalesce(cell(m), F.lit("")).alias(m.field))
    return rows.select(*columns)
