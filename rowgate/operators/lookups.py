"""Lookups on the sheet map, the ledger and requests.

These tables have one row per sheet or run. They carry no broadcast hint: Spark broadcasts a side
only when its measured size is below spark.sql.autoBroadcastJoinThreshold and otherwise shuffles,
splitting skewed partitions at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgate.functions.text import contains_keyword, count_literal, replace_literal


def sheet_tables(sheet_map: DataFrame) -> DataFrame:
    """One table per sheet name; of several entries the one with the highest (sheet_order, id) counts."""
    latest = F.struct("sheet_order", "id") if "id" in sheet_map.columns else F.col("sheet_order")
    return sheet_map.groupBy("sheet_name").agg(F.max_by("table_name", latest).alias("table_name"))


def mapped_sheets(selected: DataFrame, sheet_map: DataFrame) -> DataFrame:
    """Selected sheets with their table; unmapped ones are left out."""
    return selected.join(sheet_tables(sheet_map).where("table_name <> ''"), "sheet_name")


def unmapped_sheets(selected: DataFrame, sheet_map: DataFrame) -> DataFrame:
    """Selected sheets without an entry or with an empty table name. Any such sheet refuses the request."""
    known = sheet_tables(sheet_map).where("table_name <> ''")
    return selected.join(known, "sheet_name", "left_anti")


def table_conflicts(selected: DataFrame, sheet_map: DataFrame) -> DataFrame:
    """Every (table, sheet) of a table that several selected sheets want, in sheet order."""
    wanted = mapped_sheets(selected, sheet_map)
    shared = wanted.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_sheets")).where("n_sheets > 1")
    return wanted.join(shared, "table_name").select("table_name", "n_sheets", "sheet_name", "sheet_order")


#: The latest entry of each table and its last success. States of parts of a history, put together, give the state of the whole.
STATE = "table_name string, last_finished_at string, last_run_id string, last_status string, last_success_at string"


def entries_as_state(entries: DataFrame) -> DataFrame:
    """Ledger entries in the shape of STATE."""
    success = F.when(F.col("status") == "success", F.col("finished_at"))
    return entries.select(
        "table_name", F.col("finished_at").alias("last_finished_at"), F.col("run_id").alias("last_run_id"),
        F.col("status").alias("last_status"), success.alias("last_success_at"),
    )


def latest_state(states: DataFrame) -> DataFrame:
    """One state per table from any number of them."""
    last = F.struct("last_finished_at", "last_run_id", "last_status")
    merged = states.groupBy("table_name").agg(F.max(last).alias("last"), F.max("last_success_at").alias("last_success_at"))
    return merged.select("table_name", "last.*", "last_success_at")


def ledger_state(ledger: DataFrame) -> DataFrame:
    """Current state per table from all entries: status of the last attempt, time of the last success. A state that was folded before is taken
    as it is."""
    if "last_status" in ledger.columns:
        return ledger
    return latest_state(entries_as_state(ledger)).select("table_name", "last_status", "last_success_at")


def sheet_states(inventory: DataFrame, sheet_map: DataFrame, ledger: DataFrame) -> DataFrame:
    """Input sheets with their last load time ('' if none) and failed flag."""
    state = sheet_tables(sheet_map).join(ledger_state(ledger), "table_name")
    return inventory.join(state, "sheet_name", "left").select(
        "sheet_name",
        "sheet_order",
        F.coalesce("last_success_at", F.lit("")).alias("last_load_time"),
        F.coalesce(F.col("last_status") == "failed", F.lit(False)).alias("failed"),
    )


def retry_sheets(inventory: DataFrame, sheet_map: DataFrame, ledger: DataFrame) -> DataFrame:
    """Sheets whose last load failed and that are in the new input."""
    failed = ledger_state(ledger).where("last_status = 'failed'")
    names = sheet_tables(sheet_map).join(failed, "table_name", "left_semi")
    return inventory.join(names, "sheet_name", "left_semi")


def preview(names: DataFrame, order: str = "sheet_order", shown: int = 8) -> DataFrame:
    """The first names in order, and how many there are in all."""
    total = names.agg(F.count(F.lit(1)).alias("n_total"))
    first = names.orderBy(order).limit(shown)
    pieces = F.sort_array(F.collect_list(F.struct(order, "sheet_name")))
    joined = first.agg(F.array_join(F.transform(pieces, lambda p: p["sheet_name"]), "、").alias("names"))
    more = F.when(F.col("n_total") > shown, F.concat(F.lit(" 等 "), F.col("n_total").cast("string"), F.lit(" 个"))).otherwise("")
    return (
        total.withColumn("_one", F.lit(1))
        .join(joined.withColumn("_one", F.lit(1)), "_one")
        .select("n_total", F.concat("names", more).alias("preview"))
    )


def missing_tables(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Wanted tables that do not exist; `wanted` carries the request order."""
    return wanted.join(existing.select("table_name"), "table_name", "left_anti")


def keyword_filter(entries: DataFrame, keyword: str, trim_keyword: bool = False) -> DataFrame:
    return entries.where(contains_keyword(F.col("sheet_name"), keyword, trim_keyword))


def keyword_replace(entries: DataFrame, find: str, replacement: str) -> DataFrame:
    """Literal replacement in sheet and table name. Entries are chosen by sheet name without regard to
    case, the text is replaced with regard to case. `n_replaced` counts the places."""
    if not find:
        raise ValueError("nothing to find")
    chosen = contains_keyword(F.col("sheet_name"), find)
    old = {c: F.col(c) for c in ("sheet_name", "table_name")}
    count = count_literal(old["sheet_name"], find) + count_literal(old["table_name"], find)
    return entries.withColumns(
        {
            "n_replaced": F.when(chosen, count).otherwise(F.lit(0).cast("bigint")),
            **{f"new_{c}": F.when(chosen, replace_literal(v, find, replacement)).otherwise(v) for c, v in old.items()},
        }
    )
