"""Keep-earliest de-duplication.

A row takes part when its key is not blank and its date parses; of the rows with one key the
earliest date stays, and on equal dates the first row in sheet order and row order. All other
rows stay untouched.

Scope 'sheet' compares inside a sheet, 'global' over all selected sheets. One key may hold any
share of the rows: keepers use a ranking that is cut to one row per key before the shuffle, and
the listing works on (key, date) groups, which are combined before the shuffle, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowgate.functions.dates import parse_date
from rowgate.functions.schema import ADDRESS, DEFAULT_KEY_INDEX, MAX_KEY_INDEX
from rowgate.functions.text import dedup_key
from rowgate.operators.positions import number_rows
from rowgate.operators.rows import numeric_date, select_sheets

SHEET = "sheet"
GLOBAL = "global"

# A row's place in the input. The sheet name stands beside its order, because sheets may share an order or have none;
# a row's identity is (sheet_name, row_num).
POSITION = ["sheet_order", "sheet_name", "row_num"]


def _position() -> Column:
    return F.struct(*POSITION)


def _scope(mode: str) -> list[str]:
    if mode not in (SHEET, GLOBAL):
        raise ValueError(f"unknown dedup mode: {mode}")
    return ["sheet_name", "dedup_key"] if mode == SHEET else ["dedup_key"]


def _key_cell(rows: DataFrame, key_index: int) -> Column:
    if not 1 <= key_index <= MAX_KEY_INDEX:
        raise ValueError(f"the key is one of cells 1 to {MAX_KEY_INDEX}")
    name = f"c{key_index - 1}"
    return F.col(name) if name in rows.columns else F.lit(None).cast("string")


def with_key(rows: DataFrame, key_index: int = DEFAULT_KEY_INDEX, sheets: list[str] | None = None) -> DataFrame:
    """Adds dedup_key, dedup_date and eligible. Sheets that are not selected have no eligible rows."""
    selected = F.lit(True) if sheets is None else F.col("sheet_name").isin(list(sheets))
    return (
        rows.withColumn("dedup_key", dedup_key(_key_cell(rows, key_index)))
        .withColumn("dedup_date", F.when(~numeric_date(rows), parse_date(F.col("c0"))))
        .withColumn("eligible", selected & (F.col("dedup_key") != "") & F.col("dedup_date").isNotNull())
    )


def kept_rows(
    rows: DataFrame,
    mode: str = GLOBAL,
    key_index: int = DEFAULT_KEY_INDEX,
    sheets: list[str] | None = None,
) -> DataFrame:
    """Rows that stay, with all their columns: keepers, ineligible rows and unselected sheets.

    Sheets that are not selected leave the scan by a pushed filter and are passed by without a shuffle. The others are read once, their key and date
    are worked out once, and they are ranked; the ranking is cut to one row per key before the shuffle. A row that does not take part is a
    group of its own, told by its address. The hash comes first because rows are sorted by the partition columns: names share long beginnings,
    hashes do not."""
    keyed = with_key(select_sheets(rows, sheets), key_index)
    scope, address, taking = _scope(mode), ["sheet_name", "row_num"], F.col("eligible")
    of = F.when(taking, F.xxhash64(*scope)).otherwise(F.xxhash64(*address))
    group = [of, *[F.when(taking, F.col(c)) for c in scope], *[F.when(~taking, F.col(c)) for c in address]]
    earliest = W.partitionBy(*group).orderBy("dedup_date", *POSITION)
    best = keyed.withColumn("_rank", F.row_number().over(earliest)).where("_rank = 1").select(*rows.columns)
    return best if sheets is None else rows.where(~F.col("sheet_name").isin(list(sheets))).unionByName(best)


def keyed_rows(
    rows: DataFrame, key_index: int = DEFAULT_KEY_INDEX, sheets: list[str] | None = None
) -> DataFrame:
    """Every row, narrow: its address, whether it takes part, its key, date and both cells as they are written. The
    listing, the keepers and the statistics can all be made from it."""
    keyed = with_key(rows, key_index, sheets)
    return keyed.select(*ADDRESS, "eligible", "dedup_key", "dedup_date", _key_cell(rows, key_index).alias("raw_key"), F.col("c0").alias("raw_time"))


def _dated_keys(keyed: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """(eligible rows with their position, first position and count per key and date)."""
    eligible = keyed.where("eligible").withColumn("pos", _position())
    first = eligible.groupBy(*_scope(mode), "dedup_date").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n"))
    return eligible, first


def keepers(
    rows: DataFrame, mode: str = GLOBAL, key_index: int = DEFAULT_KEY_INDEX, sheets: list[str] | None = None
) -> DataFrame:
    """One narrow row per key: the address of its keeper, its date and the number of rows."""
    return keepers_of(keyed_rows(rows, key_index, sheets), mode)


def keepers_of(keyed: DataFrame, mode: str = GLOBAL) -> DataFrame:
    """keepers, from the result of keyed_rows."""
    _, first = _dated_keys(keyed, mode)
    return (
        first.groupBy(*_scope(mode))
        .agg(F.min("dedup_date").alias("keep_date"), F.min_by("first_pos", "dedup_date").alias("_pos"), F.sum("n").alias("n_rows"))
        .select(*_scope(mode), "keep_date", *[F.col(f"_pos.{c}").alias(f"keep_{c}") for c in POSITION], "n_rows")
    )


def duplicate_list(
    rows: DataFrame, mode: str = GLOBAL, key_index: int = DEFAULT_KEY_INDEX, sheets: list[str] | None = None
) -> DataFrame:
    """Keeper and losers of every key that lost rows, with the columns that order the list (LIST_ORDER).

    Groups come in the order in which their key first occurs; inside a group the keeper comes first,
    then the losers in the order in which a reader going down the sheets drops them. A row is the
    current best when its date is below all dates before it in its key; it is dropped when
    the next best arrives, any other row is dropped at its own position. Whether a row was a best can
    be told from the first position of each (key, date), a table with one row per distinct date of a key.
    """
    return listing_of(keyed_rows(rows, key_index, sheets), mode)


LIST_ORDER = [*[f"group_{c}" for c in POSITION], "action_pos", *[f"lost_{c}" for c in POSITION]]


def listing_of(keyed: DataFrame, mode: str = GLOBAL) -> DataFrame:
    """duplicate_list, from the result of keyed_rows."""
    scope = _scope(mode)
    eligible, first = _dated_keys(keyed, mode)
    going_down = W.partitionBy(*scope).orderBy("first_pos")
    before = going_down.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*scope)
    was_best = F.coalesce(F.col("dedup_date") < F.min("dedup_date").over(before), F.lit(True))
    # Position of the next best: the nearest later first position that was a best itself.
    going_up = W.partitionBy(*scope).orderBy(F.col("first_pos").desc()).rowsBetween(W.unboundedPreceding, -1)
    dates = (
        first.withColumn("was_best", was_best)
        .withColumn("group_pos", F.min("first_pos").over(whole))
        .withColumn("group_rows", F.sum("n").over(whole))
        .withColumn("next_best", F.min(F.when(F.col("was_best"), F.col("first_pos"))).over(going_up))
        .where("group_rows > 1")
        .drop("n", "group_rows")
    )
    best = F.col("was_best") & (F.col("pos") == F.col("first_pos"))
    keeps = best & F.col("next_best").isNull()
    lost = F.when(best & ~keeps, F.col("next_best")).otherwise(F.col("pos"))
    return (
        eligible.join(dates, [*scope, "dedup_date"])
        .select(*ADDRESS, "raw_key", "raw_time", "dedup_key", "group_pos", keeps.alias("_keeps"), lost.alias("_lost"))
        .select(
            F.when(F.col("_keeps"), "keep").otherwise("delete").alias("action"),
            *ADDRESS,
            "raw_key",
            "raw_time",
            "dedup_key",
            *[F.col(f"group_pos.{c}").alias(f"group_{c}") for c in POSITION],
            F.when(F.col("_keeps"), 0).otherwise(1).alias("action_pos"),
            *[F.col(f"_lost.{c}").alias(f"lost_{c}") for c in POSITION],
        )
    )


def losers(
    rows: DataFrame, mode: str = GLOBAL, key_index: int = DEFAULT_KEY_INDEX, sheets: list[str] | None = None
) -> DataFrame:
    """Addresses of the rows that go."""
    return duplicate_list(rows, mode, key_index, sheets).where("action = 'delete'").select(*ADDRESS)


def remove_rows(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose address is not in `gone`; joined on the address, which is unique, so no key is hot."""
    return rows.join(gone.select("sheet_name", "row_num"), ["sheet_name", "row_num"], "left_anti").select(*rows.columns)


def dedup_stats(
    rows: DataFrame,
    mode: str = GLOBAL,
    key_index: int = DEFAULT_KEY_INDEX,
    sheets: list[str] | None = None,
    inventory: DataFrame | None = None,
) -> DataFrame:
    """Per sheet: total, kept, deleted, copied_only. Blank rows count. Sheets of the inventory that
    have no rows appear with zeros."""
    keyed = keyed_rows(rows, key_index, sheets)
    totals = keyed.groupBy("sheet_name").agg(
        F.min("sheet_order").alias("sheet_order"), F.count(F.lit(1)).alias("total"), F.count_if("eligible").alias("n_eligible")
    )
    kept = keepers_of(keyed, mode).groupBy(F.col("keep_sheet_name").alias("sheet_name")).agg(F.count(F.lit(1)).alias("n_keepers"))
    zero = F.lit(0).cast("bigint")
    counts = totals.join(kept, "sheet_name", "left")
    deleted = F.coalesce("n_eligible", zero) - F.coalesce("n_keepers", zero)
    return _stats(counts.select("sheet_name", "sheet_order", "total", deleted.alias("deleted")), sheets, inventory)


def stats_of(kept: DataFrame, deleted: DataFrame, sheets: list[str] | None = None, inventory: DataFrame | None = None) -> DataFrame:
    """The same statistics from what was written: rows that were kept and rows that were deleted, with their address."""
    one = F.lit(1).cast("bigint")
    both = kept.select("sheet_name", "sheet_order", F.lit(0).cast("bigint").alias("d")).unionByName(deleted.select("sheet_name", "sheet_order", one.alias("d")))
    counts = both.groupBy("sheet_name").agg(F.min("sheet_order").alias("sheet_order"), F.count(F.lit(1)).alias("total"), F.sum("d").alias("deleted"))
    return _stats(counts, sheets, inventory)


def _stats(counts: DataFrame, sheets: list[str] | None, inventory: DataFrame | None) -> DataFrame:
    if inventory is not None:
        counts = inventory.select("sheet_name", "sheet_order").join(counts.drop("sheet_order"), "sheet_name", "left")
    zero = F.lit(0).cast("bigint")
    total, deleted = F.coalesce("total", zero), F.coalesce("deleted", zero)
    copied = F.lit(False) if sheets is None else ~F.col("sheet_name").isin(list(sheets))
    return counts.select(
        "sheet_name", "sheet_order", total.alias("total"), (total - deleted).alias("kept"), deleted.alias("deleted"), copied.alias("copied_only")
    )


def renumber(kept: DataFrame, **bucket) -> DataFrame:
    """Compact row numbers after deletion: 2, 3, ... per sheet (the header is row 1)."""
    return number_rows(kept, ["sheet_name"], "row_num", "_ordinal", **bucket).withColumn(
        "new_row_num", F.col("_ordinal") + 1
    ).drop("_ordinal")


def numbering(keyed: DataFrame, gone: DataFrame, **bucket) -> DataFrame:
    """New row numbers of the rows that stay: sheet_name, old_row_num, row_num. Made from addresses only, so no cell is moved for it."""
    left = remove_rows(keyed.select("sheet_name", "row_num"), gone)
    return renumber(left, **bucket).select("sheet_name", F.col("row_num").alias("old_row_num"), F.col("new_row_num").alias("row_num"))


def copy_rows(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """The rows that stay, with old_row_num and their new row_num. One join on the address, which is unique, takes the other rows out and gives
    the numbers, so the cells are shuffled once."""
    cells = rows.withColumnRenamed("row_num", "old_row_num")
    return cells.join(numbers, ["sheet_name", "old_row_num"]).select(*cells.columns, "row_num")
