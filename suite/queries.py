"""The registered queries: each a Spark callable, most with the same result in DuckDB SQL.

All of them run over the whole of the driver's tables. Results are flat: dates as text, counts as
bigint.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowgate.functions import messages, text
from rowgate.functions.dates import normalize_date_text, parse_date
from rowgate.functions.schema import ADDRESS, CELLS, DEFAULT_MAPPING
from rowgate.operators import checks, dedup, gate, lookups, reports, rows
from rowgate.operators.positions import row_ranges
from rowgate.plans import jobs
from rowgate.session import run_folder, staged
from rowgate.sources import ledger, readers, sinks, tables
from suite import fixture as fx
from suite.fixture import FIELDS, RAW, RECORDS, VERDICT, raw_rows, sql_blank, sql_strip, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DAY = "yyyy-MM-dd"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _day(c: str) -> F.Column:
    return F.date_format(c, DAY)


# ---- inputs that several queries share ----


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.to_records(rows.nonblank_rows(raw_rows(spark, sf_dir)))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.with_verdict(_records(spark, sf_dir))


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheets of the fixture, straight from the orders."""
    return (
        table(spark, sf_dir, "orders")
        .select(F.col("o_orderpriority").alias("sheet_name"))
        .distinct()
        .withColumn("sheet_order", F.substring("sheet_name", 1, 1).cast("int"))
    )


def _sheet_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sheets(spark, sf_dir).withColumn("table_name", F.concat(F.lit("t_00"), F.col("sheet_order").cast("string")))


def _load_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load errors as a written table, because the reports read them several times."""
    return staged(checks.load_errors(_records(spark, sf_dir)), "load-errors")


def _validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(checks.validation_errors(_records(spark, sf_dir)), "findings")


SHEETS_SQL = "sheets AS (SELECT DISTINCT o_orderpriority AS sheet_name, CAST(substr(o_orderpriority, 1, 1) AS INT) AS sheet_order, 't_00' || substr(o_orderpriority, 1, 1) AS table_name FROM orders)"

# ---- rows and records ----


@query(f"WITH {RECORDS} SELECT sheet_name, sheet_order, row_num, {', '.join(CELLS)} FROM nonblank")
def rows_nonblank(spark, sf_dir):
    return rows.nonblank_rows(raw_rows(spark, sf_dir))


@query(f"WITH {SHEETS_SQL} SELECT sheet_name, sheet_order FROM sheets")
def sheet_inventory(spark, sf_dir):
    return rows.sheet_inventory(raw_rows(spark, sf_dir))


@query(f"WITH {RECORDS} SELECT sheet_name, count(*) AS n_rows FROM nonblank GROUP BY sheet_name")
def sheet_row_counts(spark, sf_dir):
    return gate.rows_per_sheet(rows.nonblank_rows(raw_rows(spark, sf_dir))).withColumnRenamed("n", "n_rows")


@query(f"WITH {RECORDS} SELECT sheet_name, sheet_order, row_num, c0 FROM nonblank WHERE sheet_name IN ('2-HIGH', '5-LOW')")
def selected_rows(spark, sf_dir):
    selected = rows.select_sheets(raw_rows(spark, sf_dir), ["5-LOW", "2-HIGH", "no such sheet"])
    return rows.nonblank_rows(selected).select(*ADDRESS, "c0")


@query(f"WITH {RECORDS} SELECT sheet_name, sheet_order, row_num, strftime(collected_at, '%Y-%m-%d') AS collected_at, c0 AS collected_at_raw, {', '.join(FIELDS)} FROM rec")
def records_projected(spark, sf_dir):
    return _records(spark, sf_dir).select(*ADDRESS, _day("collected_at").alias("collected_at"), "collected_at_raw", *FIELDS)


@query(f"WITH {RAW} SELECT sheet_name, row_num, CASE WHEN c0 IS NOT NULL THEN norm END AS date_text, strftime(dt, '%Y-%m-%d') AS parsed FROM dated")
def date_texts(spark, sf_dir):
    c0 = F.col("c0")
    return raw_rows(spark, sf_dir).select(
        "sheet_name", "row_num", normalize_date_text(c0).alias("date_text"), F.date_format(parse_date(c0), DAY).alias("parsed")
    )


@query(f"WITH {RAW} SELECT sheet_name, row_num, key AS dedup_key, coalesce({sql_strip('c3')}, '') AS stripped FROM dated")
def dedup_keys(spark, sf_dir):
    c3 = F.col("c3")
    return raw_rows(spark, sf_dir).select(
        "sheet_name", "row_num", text.dedup_key(c3).alias("dedup_key"), text.clean_text(c3).alias("stripped")
    )


def _display_sql(c: str) -> str:
    return f"CASE WHEN {sql_blank(c)} THEN '（空）' WHEN length({c}) > 60 THEN substr({c}, 1, 60) || '…' ELSE {c} END"


def _short_sql(c: str) -> str:
    return f"coalesce(CASE WHEN length({c}) > 60 THEN substr({c}, 1, 60) || '…' ELSE {c} END, '')"


@query(
    f"""SELECT doc_id, {_display_sql('text')} AS shown, {_short_sql('text')} AS short, length(text) AS n_chars,
    {sql_strip("coalesce(list_filter(regexp_split_to_array(text, '\\r\\n|[\\x{0a}-\\x{0d}\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}]'), lambda x: NOT " + sql_blank('x') + ")[1], '')")} AS first_line
    FROM documents"""
)
def cell_texts(spark, sf_dir):
    """Shown values, lengths and first lines over whole texts."""
    c = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.display_value(c).alias("shown"),
        text.short_value(c).alias("short"),
        F.length(c).cast("bigint").alias("n_chars"),
        text.clean_text(text.first_line(c)).alias("first_line"),
    )


# ---- checks ----

_MESSAGE_SQL = f"""CASE kind
  WHEN 'null' THEN '字段 [' || concat_ws(', ', CASE WHEN {sql_blank('company_name')} THEN 'company_name' END, CASE WHEN {sql_blank('industry')} THEN 'industry' END) || '] 不能为空 (NOT NULL 约束)'
  WHEN 'date' THEN '字段 [collected_at] 第 ' || row_num || ' 行 值 ''' || {_display_sql('c0')} || ''' 不是有效日期（应形如 2024-01-31）'
  WHEN 'length' THEN concat_ws('、', {', '.join(f"CASE WHEN length({f}) > {n} THEN '字段 [{f}] 值长度 ' || length({f}) || ' 超过限制 {n}' END" for f, n in fx.LIMITS.items())}) END"""
ERRORS = f"""{VERDICT},
err AS (SELECT sheet_name, sheet_order, row_num, ok, kind, {_MESSAGE_SQL} AS message, team, company_name, industry, c0, {', '.join(f for f in FIELDS if f not in ('team', 'company_name', 'industry'))}
        FROM verdict WHERE kind IS NOT NULL)"""


@query(f"WITH {VERDICT} SELECT sheet_name, sheet_order, row_num, coalesce(kind, 'clean') AS kind FROM verdict")
def load_verdict(spark, sf_dir):
    return _verdicts(spark, sf_dir).select(*ADDRESS, F.coalesce("kind", F.lit("clean")).alias("kind"))


@query(f"WITH {ERRORS} SELECT sheet_name, sheet_order, row_num, kind, message FROM err")
def load_error_messages(spark, sf_dir):
    return checks.load_errors(_records(spark, sf_dir)).select(*ADDRESS, "kind", "message")


@query(f"WITH {VERDICT} SELECT sheet_name, sheet_order, row_num, strftime(collected_at, '%Y-%m-%d') AS collected_at, {', '.join(FIELDS)} FROM verdict WHERE kind IS NULL")
def clean_rows(spark, sf_dir):
    return checks.clean_rows(_records(spark, sf_dir)).select(*ADDRESS, _day("collected_at").alias("collected_at"), *FIELDS)


_VALIDATION_PARTS = [
    f"SELECT sheet_name, sheet_order, row_num, 0 AS check_pos, 'collected_at' AS field, {_short_sql('c0')} AS value, 'DATE' AS reason, '字段 [collected_at] 无法解析为日期' AS message FROM rec WHERE collected_at IS NULL AND NOT {sql_blank('c0')}"
]
_pos = 1
for _f in FIELDS:
    if _f in ("company_name", "industry"):
        _VALIDATION_PARTS.append(
            f"SELECT sheet_name, sheet_order, row_num, {_pos}, '{_f}', {_short_sql(_f)}, 'NOT NULL', '字段 [{_f}] 不能为空 (NOT NULL 约束)' FROM rec WHERE {sql_blank(_f)}"
        )
        _pos += 1
    if _f in fx.LIMITS:
        _also = f" AND NOT {sql_blank(_f)}" if _f in ("company_name", "industry") else ""
        _VALIDATION_PARTS.append(
            f"SELECT sheet_name, sheet_order, row_num, {_pos}, '{_f}', {_short_sql(_f)}, 'LENGTH', '字段 [{_f}] 值长度 ' || length({_f}) || ' 超过限制 {fx.LIMITS[_f]}' FROM rec WHERE length({_f}) > {fx.LIMITS[_f]}{_also}"
        )
        _pos += 1
VALIDATION = f"{RECORDS}, val AS ({' UNION ALL '.join(_VALIDATION_PARTS)})"


@query(f"WITH {VALIDATION} SELECT * FROM val")
def validate_all(spark, sf_dir):
    return jobs.run_validation(raw_rows(spark, sf_dir))[0]


@query(
    f"""WITH {VALIDATION} SELECT sheet_name, sheet_order, n_rows, coalesce(n_errors, 0) AS n_errors, coalesce(n_error_rows, 0) AS n_error_rows
    FROM (SELECT sheet_name, sheet_order, count(*) AS n_rows FROM rec GROUP BY ALL) r
    LEFT JOIN (SELECT sheet_name, count(*) AS n_errors, count(DISTINCT row_num) AS n_error_rows FROM val GROUP BY ALL) v USING (sheet_name)"""
)
def validate_by_sheet(spark, sf_dir):
    return jobs.run_validation(raw_rows(spark, sf_dir))[1]


@query(
    f"""WITH {VALIDATION} SELECT (SELECT count(DISTINCT sheet_name) FROM rec) AS total_sheets, (SELECT count(*) FROM rec) AS total_rows,
    (SELECT count(*) FROM val) AS total_errors, (SELECT count(*) FROM val) = 0 AS valid"""
)
def validate_totals(spark, sf_dir):
    return checks.validation_totals(jobs.run_validation(raw_rows(spark, sf_dir))[1])


def _numeric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture with numbers in some date cells, as a spreadsheet gives them for general cells."""
    number = F.expr("d IS NOT NULL AND ok % 71 = 5")
    raw = raw_rows(spark, sf_dir, keep=("ok", "d"))
    return raw.withColumn("c0_is_numeric", number).withColumn("c0", F.when(number, F.expr("CAST(35000 + ok % 9000 AS STRING)")).otherwise(F.col("c0")))


@query(
    f"""WITH {VERDICT}, num AS (SELECT *, ok % 71 = 5 AS is_num, CASE WHEN ok % 71 = 5 THEN CAST(35000 + ok % 9000 AS STRING) ELSE c0 END AS cell FROM dated),
    filled AS (SELECT * FROM num WHERE is_num OR {fx._FILLED})
    SELECT sheet_name, row_num, is_num,
      CASE WHEN {sql_blank('c3')} OR {sql_blank('c5')} THEN 'null' WHEN is_num OR (dt IS NULL AND NOT {sql_blank('cell')}) THEN 'date'
           WHEN length(c9) > 200 THEN 'length' ELSE 'clean' END AS kind,
      NOT is_num AND dt IS NULL AND NOT {sql_blank('cell')} AS validation_refuses_date FROM filled"""
)
def numeric_date_checks(spark, sf_dir):
    """Numbers in the date cell: refused by the load, let through by the validation."""
    records = rows.to_records(rows.nonblank_rows(_numeric_rows(spark, sf_dir)))
    found = checks.validation_errors(records).where("reason = 'DATE'").select("sheet_name", "row_num", F.lit(True).alias("refused"))
    verdicts = checks.with_verdict(records).join(found, ["sheet_name", "row_num"], "left")
    return verdicts.select(
        "sheet_name",
        "row_num",
        F.col("date_is_numeric").alias("is_num"),
        F.coalesce("kind", F.lit("clean")).alias("kind"),
        F.coalesce("refused", F.lit(False)).alias("validation_refuses_date"),
    )


@query(
    f"""WITH {VERDICT}, num AS (SELECT *, ok % 71 = 5 AS is_num, CASE WHEN ok % 71 = 5 THEN CAST(35000 + ok % 9000 AS STRING) ELSE c0 END AS cell FROM dated)
    SELECT sheet_name, row_num, '字段 [collected_at] 第 ' || row_num || ' 行 值 ''' || {_display_sql('cell')} || ''' 不是有效日期（应形如 2024-01-31）'
      || CASE WHEN is_num THEN '（日期列应为文本格式，请勿使用数值/常规格式）' ELSE '' END AS message
    FROM num WHERE NOT {sql_blank('c3')} AND NOT {sql_blank('c5')} AND (is_num OR (dt IS NULL AND NOT {sql_blank('cell')}))"""
)
def numeric_date_messages(spark, sf_dir):
    """Messages of refused dates; numbers get a hint."""
    records = rows.to_records(rows.nonblank_rows(_numeric_rows(spark, sf_dir)))
    return checks.load_errors(records).where("kind = 'date'").select("sheet_name", "row_num", "message")


#: A mapping without the date, the team and the required category.
_REDUCED = [m for m in DEFAULT_MAPPING if m.field not in ("collected_at", "team", "industry")]


@query(f"WITH {RECORDS} SELECT sheet_name, row_num, CASE WHEN {sql_blank('company_name')} THEN 'company_name, industry' ELSE 'industry' END AS missing, 'null' AS kind FROM rec")
def load_verdict_reduced(spark, sf_dir):
    """A field that the mapping lacks is missing in every row: the required one fails all of them."""
    errors = checks.load_errors(rows.to_records(rows.nonblank_rows(raw_rows(spark, sf_dir)), _REDUCED), mapping=_REDUCED)
    return errors.select("sheet_name", "row_num", F.regexp_extract("message", r"\[(.*?)\]", 1).alias("missing"), "kind")


@query(
    f"""WITH {VALIDATION} SELECT sheet_name, row_num, field, reason FROM val WHERE field NOT IN ('collected_at', 'team', 'industry')
    UNION ALL SELECT sheet_name, row_num, 'industry', 'NOT NULL' FROM rec"""
)
def validate_all_reduced(spark, sf_dir):
    return jobs.run_validation(raw_rows(spark, sf_dir), mapping=_REDUCED)[0].select("sheet_name", "row_num", "field", "reason")


@query(
    f"""WITH {VALIDATION} SELECT CAST(2 AS BIGINT) AS total_sheets, (SELECT count(*) FROM rec WHERE sheet_name = '2-HIGH') AS total_rows,
    (SELECT count(*) FROM val WHERE sheet_name = '2-HIGH') AS total_errors, (SELECT count(*) FROM val WHERE sheet_name = '2-HIGH') = 0 AS valid"""
)
def validate_selected_totals(spark, sf_dir):
    """Totals over two selected sheets, one of which has no row."""
    given = raw_rows(spark, sf_dir).where("sheet_name <> '5-LOW'")
    found = jobs.run_validation(given, sheets=["2-HIGH", "5-LOW"], inventory=_sheets(spark, sf_dir))
    return checks.validation_totals(found[1])


# ---- gate and load ----

GATE = f"""{VERDICT}, {SHEETS_SQL},
wanted AS (SELECT sheet_name, table_name FROM sheets UNION ALL SELECT 'absent of ' || sheet_name, 'x' || table_name FROM sheets WHERE sheet_order = 1),
gate AS (SELECT w.sheet_name, w.table_name, coalesce(n_rows, 0) AS n_rows, coalesce(n_errors, 0) AS n_errors,
  CASE WHEN s.sheet_name IS NULL THEN 'sheet is not in the input' END AS table_error,
  CASE WHEN coalesce(n_errors, 0) > 0 OR s.sheet_name IS NULL THEN 'failed' ELSE 'success' END AS status
  FROM wanted w LEFT JOIN sheets s ON w.sheet_name = s.sheet_name
  LEFT JOIN (SELECT sheet_name, count(*) AS n_rows, count(kind) AS n_errors FROM verdict GROUP BY ALL) v ON w.sheet_name = v.sheet_name)"""


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sheets, and one that is not in the input."""
    sheets = _sheet_map(spark, sf_dir)
    absent = sheets.where("sheet_order = 1").select(
        F.concat(F.lit("absent of "), "sheet_name").alias("sheet_name"), F.concat(F.lit("x"), "table_name").alias("table_name")
    )
    wanted = sheets.select("sheet_name", "table_name").unionByName(absent)
    return gate.load_gate(wanted, _verdicts(spark, sf_dir), _sheets(spark, sf_dir))


@query(f"WITH {GATE} SELECT * FROM gate")
def load_gate(spark, sf_dir):
    return _gate(spark, sf_dir)


@query(f"WITH {GATE} SELECT sheet_name, table_name, n_rows, n_errors, table_error FROM gate WHERE status = 'failed'")
def failed_tables(spark, sf_dir):
    return gate.failed_tables(_gate(spark, sf_dir)).drop("status")


@query(
    f"""WITH {GATE} SELECT count(*) AS n_tables, count(*) FILTER (status = 'success') AS n_loaded, count(*) FILTER (status = 'failed') AS n_failed,
    CAST(sum(n_rows) FILTER (status = 'success') AS BIGINT) AS rows_loaded, CAST(sum(n_errors) AS BIGINT) AS error_rows,
    count(*) FILTER (status = 'failed') = 0 AS success, count(*) FILTER (status = 'failed') > 0 AS partial FROM gate"""
)
def load_outcome(spark, sf_dir):
    return gate.load_outcome(_gate(spark, sf_dir))


@query(
    f"""WITH {GATE} SELECT 'run-1' AS run_id, table_name, sheet_name, status, CASE WHEN status = 'success' THEN n_rows ELSE 0 END AS "rows",
    n_errors AS error_rows, coalesce(table_error, '') AS error, '2024-01-31 10:00:00' AS started_at, '2024-01-31 10:30:00' AS finished_at, 'week 5' AS source FROM gate"""
)
def load_history(spark, sf_dir):
    return gate.ledger_rows(_gate(spark, sf_dir), "run-1", "2024-01-31 10:30:00", "2024-01-31 10:00:00", "week 5")


@query(
    f"""WITH {GATE}, f AS (SELECT table_name, count(*) OVER () AS n_failed, row_number() OVER (ORDER BY table_name) AS i FROM gate WHERE status = 'failed')
    SELECT table_name, n_failed, CASE WHEN i = 1 THEN n_failed || ' 张表导入失败：' ELSE '、' END || table_name AS text FROM f"""
)
def load_run_error(spark, sf_dir):
    return gate.run_error(_gate(spark, sf_dir))


@query(
    f"""WITH {GATE} SELECT table_name, n_rows, n_rows AS n_stored, CAST(0 AS BIGINT) AS diff FROM gate WHERE status = 'success'"""
)
def load_recount(spark, sf_dir):
    """A whole load into a new folder: what was scanned against what the target then holds."""
    folder = run_folder(spark, "load")
    result = jobs.run_load(
        raw_rows(spark, sf_dir), _sheet_map(spark, sf_dir), f"{folder}/target", f"{folder}/ledger", "run-1", "2024-01-31 10:30:00"
    )
    return result.reconciled


@query(f"WITH {VERDICT} SELECT sheet_name, sheet_order, row_num, 't' || sheet_order AS table_name, strftime(collected_at, '%Y-%m-%d') AS collected_at, {', '.join(FIELDS)} FROM verdict WHERE sheet_name IN ('3-MEDIUM', '5-LOW')")
def load_selected(spark, sf_dir):
    """A load of three sheets of five, one of which has bad rows: what the target then holds."""
    folder = run_folder(spark, "load")
    chosen = _sheet_map(spark, sf_dir).where("sheet_name IN ('3-MEDIUM', '5-LOW', '2-HIGH')").withColumn("table_name", F.concat(F.lit("t"), "sheet_order"))
    jobs.run_load(raw_rows(spark, sf_dir), chosen, f"{folder}/target", f"{folder}/ledger", "run-1", "now", report_folder=f"{folder}/reports")
    stored = tables.read_tables(spark, f"{folder}/target").join(chosen, "table_name")
    return stored.select(*ADDRESS, "table_name", _day("collected_at").alias("collected_at"), *FIELDS)


@query(
    f"""WITH {VERDICT}, {SHEETS_SQL}, n AS (SELECT sheet_name, count(*) AS n FROM verdict GROUP BY ALL)
    SELECT sheet_name, sheet_order, CASE sheet_order WHEN 3 THEN '表1' ELSE 'x<y %20/' || sheet_order END AS table_name,
      CASE WHEN sheet_order = 3 THEN n ELSE 0 END AS n_stored FROM sheets LEFT JOIN n USING (sheet_name) WHERE sheet_order IN (3, 5)"""
)
def load_empties_tables(spark, sf_dir):
    """Two loads into tables with odd names; the second time one sheet has no row left, and its table must be empty."""
    folder = run_folder(spark, "load")
    chosen = _sheets(spark, sf_dir).where("sheet_order IN (3, 5)").withColumn(
        "table_name", F.when(F.col("sheet_order") == 3, "表1").otherwise(F.concat(F.lit("x<y %20/"), "sheet_order"))
    )
    raw = raw_rows(spark, sf_dir)
    for run, given in (("run-1", raw), ("run-2", raw.where("sheet_name <> '5-LOW'"))):
        jobs.run_load(given, chosen, f"{folder}/target", f"{folder}/ledger", run, run, inventory=_sheets(spark, sf_dir))
    stored = gate.table_row_counts(tables.read_tables(spark, f"{folder}/target"))
    return chosen.join(stored, "table_name", "left").withColumn("n_stored", F.coalesce("n_stored", F.lit(0).cast("bigint")))


@query(
    f"""WITH {VERDICT}, {SHEETS_SQL},
    old AS (SELECT sheet_name, count(*) AS n FROM verdict WHERE kind IS NULL AND d < '1998-01-01' GROUP BY ALL),
    new AS (SELECT sheet_name, count(*) AS n, count(kind) AS n_errors FROM verdict GROUP BY ALL)
    SELECT table_name, CASE WHEN sheet_name = '5-LOW' THEN 0 WHEN n_errors > 0 THEN old.n ELSE new.n END AS n_stored
    FROM sheets JOIN new USING (sheet_name) LEFT JOIN old USING (sheet_name)"""
)
def load_twice(spark, sf_dir):
    """Two loads into one target. After the second, failed tables still hold the rows of the first, clean
    tables hold the new rows, and the sheet that is present without rows has emptied its table."""
    folder, sheets = run_folder(spark, "load"), _sheet_map(spark, sf_dir)
    raw = raw_rows(spark, sf_dir, keep=("d",))
    good = checks.clean_rows(rows.to_records(rows.nonblank_rows(raw))).select("sheet_name", "row_num")
    first = raw.where("d < '1998-01-01'").join(good, ["sheet_name", "row_num"], "left_semi")
    second = raw.where("sheet_name <> '5-LOW'")
    for run, given in (("run-1", first), ("run-2", second)):
        jobs.run_load(given, sheets, f"{folder}/target", f"{folder}/ledger", run, run, inventory=_sheets(spark, sf_dir))
    stored = gate.table_row_counts(tables.read_tables(spark, f"{folder}/target"))
    return sheets.select("table_name").join(stored, "table_name", "left").select(
        "table_name", F.coalesce("n_stored", F.lit(0).cast("bigint")).alias("n_stored")
    )


_MOMENT_SQL = "SELECT '{}' AS moment, table_name, count(*) AS n, CAST(sum(row_num) AS BIGINT) AS row_sum FROM good WHERE {} GROUP BY ALL"


@query(
    f"""WITH {VERDICT}, good AS (SELECT *, 't_00' || sheet_order AS table_name FROM verdict WHERE kind IS NULL AND sheet_name IN ('3-MEDIUM', '5-LOW'))
    """
    + " UNION ALL ".join(
        _MOMENT_SQL.format(moment, which)
        for moment, which in (("loaded", "d < '1998-01-01'"), ("written", "d < '1998-01-01'"), ("kept by a reader", "d < '1998-01-01'"), ("committed", "true"), ("broken off", "true"))
    )
)
def load_isolated(spark, sf_dir):
    """What a reader sees of two tables: after a load, between the write and the commit of the next one (at both times, and of a table that was
    opened before the commit, the old rows), after the commit, and after a run that was broken off before it."""
    folder, seen = run_folder(spark, "load"), []
    target, chosen = f"{folder}/target", _sheet_map(spark, sf_dir).where("sheet_name IN ('3-MEDIUM', '5-LOW')")
    raw = raw_rows(spark, sf_dir, keep=("d",))

    def look(moment: str, stored: DataFrame) -> None:
        counts = stored.groupBy("table_name").agg(F.count(F.lit(1)).alias("n"), F.sum("row_num").alias("row_sum"))
        seen.append(staged(counts.select(F.lit(moment).alias("moment"), "table_name", "n", "row_sum"), "seen"))

    jobs.run_load(raw.where("d < '1998-01-01'"), chosen, target, f"{folder}/ledger", "run-1", "now")
    look("loaded", tables.read_tables(spark, target))
    opened = tables.read_tables(spark, target)
    passed = gate.load_gate(chosen, _verdicts(spark, sf_dir))
    version = tables.write_version(gate.loadable_rows(_records(spark, sf_dir), passed), target)
    look("written", tables.read_tables(spark, target))
    tables.commit(spark, target, {r.table_name: version for r in passed.collect()})
    look("kept by a reader", opened)
    look("committed", tables.read_tables(spark, target))
    tables.write_version(gate.loadable_rows(_records(spark, sf_dir).where("row_num < 50"), passed), target)
    look("broken off", tables.read_tables(spark, target))
    return reduce(DataFrame.unionAll, seen)


@query(
    f"""WITH {GATE}, old AS (SELECT 't_00' || sheet_order AS table_name, count(*) AS n FROM verdict WHERE kind IS NULL AND d < '1998-01-01' GROUP BY ALL)
    SELECT gate.table_name, CASE WHEN sheet_name = '3-MEDIUM' THEN 'failed' ELSE status END AS status, sheet_name = '3-MEDIUM' AS write_failed,
      CASE WHEN sheet_name = '5-LOW' THEN n_rows ELSE old.n END AS n_stored,
      CAST(1 AS BIGINT) AS n_loaded, (SELECT n_rows FROM gate WHERE sheet_name = '5-LOW') AS rows_loaded
    FROM gate LEFT JOIN old USING (table_name) WHERE n_errors = 0 AND table_error IS NULL OR gate.table_name IN ('t_001', 't_002', 't_004')"""
)
def load_one_write_fails(spark, sf_dir):
    """The second of two loads has a row that cannot be written, which only the write finds out: its table is recorded as failed and keeps its
    rows, the other clean table is replaced."""
    folder, sheets = run_folder(spark, "load"), _sheet_map(spark, sf_dir)
    raw = raw_rows(spark, sf_dir, keep=("d",))
    good = checks.clean_rows(rows.to_records(rows.nonblank_rows(raw))).select("sheet_name", "row_num")
    first = raw.where("d < '1998-01-01'").join(good, ["sheet_name", "row_num"], "left_semi")
    broken = (F.col("sheet_name") == "3-MEDIUM") & F.col("c3").startswith("C")
    second = raw.withColumn("c10", F.when(broken, F.raise_error("this row cannot be written").cast("string")).otherwise(F.col("c10")))
    jobs.run_load(first, sheets, f"{folder}/target", f"{folder}/ledger", "run-1", "a")
    done = jobs.run_load(second, sheets, f"{folder}/target", f"{folder}/ledger", "run-2", "b")
    stored = gate.table_row_counts(tables.read_tables(spark, f"{folder}/target"))
    totals = done.totals.first()
    told = F.coalesce(F.contains("table_error", F.lit("this row cannot be written")), F.lit(False))
    return done.gate.join(stored, "table_name", "left").select(
        "table_name", "status", told.alias("write_failed"), "n_stored", F.lit(totals.n_loaded).alias("n_loaded"), F.lit(totals.rows_loaded).alias("rows_loaded")
    )


_REFUSED = "SELECT '{}' AS request, '{}' AS reason, {} AS name, CAST(0 AS BIGINT) AS tables_after"


@query(
    " UNION ALL ".join(
        _REFUSED.format(*x)
        for x in (
            ("nothing selected", "no sheet is selected", "NULL"),
            ("a table is missing", "missing tables: t_003", "'t_003'"),
            ("one table for all", "several sheets want one table: same", "'same'"),
        )
    )
    + " FROM (SELECT count(*) FROM orders)"
)
def load_refusals(spark, sf_dir):
    """Requests that must not start: what is said, what speaks against them, and the number of tables that the target then has."""
    target, sheets, out = f"{run_folder(spark, 'load')}/target", _sheet_map(spark, sf_dir), []
    requests = {
        "nothing selected": (sheets.where("sheet_order > 9"), None),
        "a table is missing": (sheets, sheets.where("sheet_order <> 3").select("table_name")),
        "one table for all": (sheets.withColumn("table_name", F.lit("same")), None),
    }
    for name, (wanted, existing) in requests.items():
        try:
            jobs.run_load(raw_rows(spark, sf_dir), wanted, target, f"{target}-ledger", "run-1", "now", existing=existing)
        except jobs.RefusedRequest as e:
            against = e.rows.select("table_name") if e.rows is not None else spark.createDataFrame([(None,)], "table_name string")
            after = F.lit(len(tables.manifest(spark, target))).cast("bigint")
            out.append(against.select(F.lit(name).alias("request"), F.lit(str(e)).alias("reason"), F.col("table_name").alias("name"), after.alias("tables_after")))
    return reduce(DataFrame.unionAll, out)


@query(f"WITH {SHEETS_SQL} SELECT sheet_name, sheet_order, true AS second_refused FROM sheets")
def outputs_kept(spark, sf_dir):
    """A result that is written twice to one place: the second time is refused, and the first result stays."""
    path, first, refused = run_folder(spark, "kept"), _sheets(spark, sf_dir), False
    sinks.write_new(first, path)
    try:
        sinks.write_new(first.where("sheet_order > 3"), path)
    except AnalysisException as e:
        refused = "PATH_ALREADY_EXISTS" in str(e)
    return spark.read.parquet(path).withColumn("second_refused", F.lit(refused))


# ---- written order ----


def _written_order(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a result with the place at which they stand in its files, from 1: rows of the files before, and the row's place in its own."""
    stored = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    files = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    offsets = stored.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).select("_file", F.coalesce(F.sum("_n").over(files), F.lit(0)).alias("_before"))
    return stored.join(offsets, "_file").withColumn("place", F.col("_before") + F.col("_at") + 1).drop("_file", "_at", "_before")


def _load_reports(spark: SparkSession, sf_dir: str) -> str:
    folder = run_folder(spark, "load")
    jobs.run_load(raw_rows(spark, sf_dir), _sheet_map(spark, sf_dir), f"{folder}/target", f"{folder}/ledger", "run-1", "now", report_folder=f"{folder}/reports")
    return f"{folder}/reports/run_id=run-1"


@query(f"WITH {SHEETS_SQL} SELECT row_number() OVER (ORDER BY sheet_order, sheet_name) AS place, sheet_name, sheet_order FROM sheets")
def sheets_in_order(spark, sf_dir):
    """The inventory as it is written, in the order of the sheets."""
    path = run_folder(spark, "inventory")
    sinks.write_new(rows.sheet_inventory(raw_rows(spark, sf_dir)).orderBy("sheet_order", "sheet_name"), path)
    return _written_order(spark, path)


@query(f"WITH {ERRORS} SELECT row_number() OVER (ORDER BY sheet_order, row_num) AS place, sheet_name, row_num, kind, message FROM err")
def errors_in_order(spark, sf_dir):
    """The error list that a load writes, in the order of sheets and rows."""
    return _written_order(spark, f"{_load_reports(spark, sf_dir)}/errors").select("place", "sheet_name", "row_num", "kind", "message")


# ---- error reports ----


def _islands_sql(source: str, groups: str, extra: str = "") -> str:
    """Runs of consecutive row numbers of `source` per group."""
    return f"""(SELECT {groups}, min(row_num) AS a, max(row_num) AS b{extra} FROM (
      SELECT *, row_num - dense_rank() OVER (PARTITION BY {groups} ORDER BY row_num) AS isl FROM {source}) GROUP BY {groups}, isl)"""


_RANGE = "CASE WHEN a = b THEN CAST(a AS STRING) ELSE a || '-' || b END"


_G = "sheet_name, sheet_order, message"


@query(f"WITH {ERRORS}, isl AS {_islands_sql('err', 'sheet_name, kind', ', count(*) AS n_errors')} SELECT sheet_name, kind, a AS range_start, b AS range_end, n_errors FROM isl")
def error_ranges(spark, sf_dir):
    return row_ranges(_load_errors(spark, sf_dir), ["sheet_name", "kind"], sums={"n_errors": F.lit(1).cast("bigint")})


@query(f"WITH {ERRORS} SELECT {_G}, count(*) AS n_errors, min(row_num) AS first_row FROM err GROUP BY ALL")
def error_groups(spark, sf_dir):
    return reports.error_groups(reports.error_ranges(_load_errors(spark, sf_dir)))


def _report_sql(source: str, counts: str, head: str, title: str, indent: str) -> str:
    """A head for each failed sheet, a title for each message, and its row ranges, each with what is written before it."""
    return f"""SELECT sheet_name, sheet_order, CAST(0 AS BIGINT) AS first_row, '' AS message, 0 AS part, CAST(0 AS BIGINT) AS position, {head} AS text FROM ({counts}) WHERE n_errors > 0
      UNION ALL SELECT sheet_name, sheet_order, min(row_num), message, 1, 0, {title} FROM {source} GROUP BY {_G}
      UNION ALL SELECT sheet_name, sheet_order, first_row, message, 2, a,
        CASE WHEN a = first_row THEN chr(10) || '{indent}' ELSE ', ' END || '第 ' || {_RANGE} || ' 行'
        FROM (SELECT *, min(a) OVER (PARTITION BY {_G}) AS first_row FROM {_islands_sql(source, _G)})"""


@query(
    f"""WITH {ERRORS} """
    + _report_sql(
        "err",
        "SELECT sheet_name, sheet_order, count(*) AS n_rows, count(kind) AS n_errors FROM verdict GROUP BY ALL",
        "'共 ' || n_errors || ' 行数据存在错误，已扫描整个 Sheet 共 ' || n_rows || ' 行:'",
        "chr(10) || '  · ' || message || '：' || count(*) || ' 行'",
        "    出错行: ",
    )
)
def load_report(spark, sf_dir):
    counts = _verdicts(spark, sf_dir).groupBy("sheet_name", "sheet_order").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("kind").alias("n_errors")
    )
    return reports.report_pieces(counts, reports.error_ranges(_load_errors(spark, sf_dir)), "load")


@query(
    f"""WITH {VALIDATION} """
    + _report_sql(
        "val",
        "SELECT r.sheet_name, r.sheet_order, n_rows, n_errors FROM (SELECT sheet_name, sheet_order, count(*) AS n_rows FROM rec GROUP BY ALL) r JOIN (SELECT sheet_name, count(*) AS n_errors FROM val GROUP BY ALL) v ON r.sheet_name = v.sheet_name",
        "'验证完成，Sheet [' || sheet_name || '] 共 ' || n_errors || ' 行数据存在错误，已扫描整个 Sheet 共 ' || n_rows || ' 行:'",
        "chr(10) || chr(10) || '■ 错误类型（' || count(*) || ' 行）: ' || message",
        "  出错行: ",
    )
)
def validation_report(spark, sf_dir):
    errors = _validation(spark, sf_dir)
    by_sheet = checks.validation_by_sheet(_records(spark, sf_dir), errors)
    return reports.report_pieces(by_sheet, reports.error_ranges(errors), "validation")


def _islands_query(reason: str, source: str = VALIDATION) -> str:
    def capped(item: str, lines: str) -> str:
        joined = f"string_agg({item}, chr(10) ORDER BY row_num, check_pos)"
        return f"""CASE WHEN {lines} <= 12 THEN {joined} ELSE array_to_string(str_split({joined}, chr(10))[1:12], chr(10)) || chr(10) || '…(还有 ' || ({lines} - 12) || ' 条未显示)' END"""

    label = "CASE reason WHEN 'NOT NULL' THEN '空值(必填)' WHEN 'LENGTH' THEN '超长' WHEN 'DATE' THEN '日期非法' ELSE reason END"
    value_lines = "CAST(sum(length(value) - length(replace(value, chr(10), '')) + 1) AS BIGINT)"
    having = f" HAVING count(*) FILTER (reason = '{reason}') > 0" if reason else ""
    return f"""WITH {source}, isl AS (SELECT *, row_num - dense_rank() OVER (PARTITION BY sheet_name ORDER BY row_num) AS g FROM val)
    SELECT sheet_name, sheet_order, min(row_num) AS range_start,
      CASE WHEN min(row_num) = max(row_num) THEN CAST(min(row_num) AS STRING) ELSE min(row_num) || '-' || max(row_num) END AS row_text,
      count(*) AS n_errors, {capped('field', 'count(*)')} AS fields, {capped('value', value_lines)} AS shown_values, {capped(label, 'count(*)')} AS reasons
    FROM isl GROUP BY sheet_name, sheet_order, g{having}"""


@query(_islands_query(""))
def error_islands(spark, sf_dir):
    return reports.error_islands(_validation(spark, sf_dir))


@query(_islands_query("LENGTH"))
def error_islands_by_reason(spark, sf_dir):
    return reports.error_islands(_validation(spark, sf_dir), "LENGTH")


# Rows 100 to 140 and 150 to 162 of every sheet without a category: longer runs than are shown, and one just above.
_LONG = VALIDATION.replace(
    "nonblank AS (SELECT * FROM dated WHERE",
    "gaps AS (SELECT * REPLACE (CASE WHEN row_num BETWEEN 100 AND 140 OR row_num BETWEEN 150 AND 162 THEN NULL ELSE c5 END AS c5) FROM dated),\nnonblank AS (SELECT * FROM gaps WHERE",
)


@query(_islands_query("", _LONG))
def error_islands_long(spark, sf_dir):
    """Runs with more findings than a report shows."""
    gap = F.col("row_num").between(100, 140) | F.col("row_num").between(150, 162)
    raw = raw_rows(spark, sf_dir).withColumn("c5", F.when(~gap, F.col("c5")))
    return reports.error_islands(staged(jobs.run_validation(raw)[0], "findings"))


# Writer errors in rows that passed the checks, and a table that failed as a whole.
# Parts of writer errors and what is shown for them: fixed values, stated here on their own.
_LONG_VALUE = "数据过长：某个字段的值超出了数据库列的长度限制。请检查超长文本字段。"
_SHOWN = {
    "im002": "未安装数据库驱动：这台电脑缺少 SQL Server ODBC 驱动（需 64 位，ODBC Driver 17 或 18）。请到微软官网下载安装后再点一次「测试连接」——与网络、账号密码无关。",
    "22018": "数据格式错误：某个「日期/数字」字段里包含了非法字符（例如本该填日期的列被填成了人名或文字）。请先运行「验证数据」定位具体行。",
    "invalid character value for cast specification": "数据类型转换失败：字段值与目标列类型不匹配（常见于日期/数字列被填了文字）。请先运行「验证数据」定位具体行。",
    "string or binary data would be truncated": _LONG_VALUE,
    "right truncation": _LONG_VALUE,
    "将截断": _LONG_VALUE,
    "cannot insert the value null into column": "必填字段为空：有列被写入了 NULL，但该列不允许为空。请先运行「验证数据」检查空值。",
    "hy000": "数据库驱动错误：请确认 SQL Server ODBC 驱动已正确安装且连接参数正确。",
    "hy104": "数据库参数错误，请检查连接配置。",
    "08s01": "网络连接中断，请确认数据库服务器可达后重试。",
    "hy010": "连接状态异常（函数序列错误），请关闭后重新连接再试。",
    "ssl provider": "加密握手失败：数据库服务器证书不被信任。请改装 ODBC Driver 17 后重试，或联系数智组。",
}
_WRITER_MESSAGES = [*_SHOWN, "Deadlock on page", "  "]


def _writer_message(key: str) -> str:
    whens = " ".join(f"WHEN {i} THEN concat('[{m.upper()}] ', '{m} at ', CAST({key} AS STRING), chr(10), 'second line')" for i, m in enumerate(_WRITER_MESSAGES[:-1]))
    return f"CASE {key} % {len(_WRITER_MESSAGES)} {whens} ELSE '  ' END"


def _all_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = rows.to_records(rows.nonblank_rows(raw_rows(spark, sf_dir)))
    refused = checks.clean_rows(records).where("sheet_name <> '5-LOW' AND row_num % 131 = 5")
    writer = checks.writer_errors(refused.withColumn("message", F.expr(_writer_message("row_num"))))
    found = staged(checks.load_errors(records).unionByName(writer), "load-errors")
    counts = found.groupBy("sheet_name").agg(F.count(F.lit(1)).alias("n_errors"))
    failed = _sheets(spark, sf_dir).join(counts, "sheet_name", "left").withColumn("n_errors", F.coalesce("n_errors", F.lit(0)))
    failed = failed.withColumn("error", F.when(F.col("sheet_name") == "5-LOW", F.lit(" \n table is locked\nsecond")))
    return reports.with_tableless_errors(found, failed)


_LABELS = {"team": "B列 负责人 / 小组", "source": "C列 来源", "company_name": "D列 企业名称", "link": "E列 官网", "industry": "F列 一级分类",
           "sub_category_2": "G列 二级分类", "sub_category_3": "H列 三级分类", "org_type": "I列 单位类型", "status": "J列 环节"}
_HUMAN = "CASE " + " ".join(f"WHEN contains(lower(message), '{k}') THEN '{t}'" for k, t in _SHOWN.items()) + " ELSE message END"
_FIRST = f"coalesce(list_filter(str_split(({_HUMAN}), chr(10)), lambda x: NOT {sql_blank('x')})[1], '未知错误')"
_PROBLEM = f"""CASE kind WHEN 'null' THEN '必填字段为空，请补填' WHEN 'date' THEN '日期格式无法识别（应形如 2024-01-31）' WHEN 'length' THEN '字段值超长，请缩短后重试'
  ELSE substr({sql_strip(_FIRST)}, 1, 60) END"""
ALL_ERRORS = f"""{ERRORS}, {SHEETS_SQL},
writer AS (SELECT sheet_name, sheet_order, row_num, 'db' AS kind, {_writer_message('row_num')} AS message, team, company_name
  FROM verdict WHERE kind IS NULL AND sheet_name <> '5-LOW' AND row_num % 131 = 5),
some_errors AS (SELECT sheet_name, sheet_order, row_num, kind, message, team, company_name FROM err UNION ALL SELECT * FROM writer),
all_errors AS (SELECT * FROM some_errors UNION ALL SELECT sheet_name, sheet_order, NULL, 'db', CASE WHEN sheet_name = '5-LOW' THEN ' table is locked' ELSE '未知错误' END, NULL, NULL
  FROM sheets WHERE sheet_name NOT IN (SELECT sheet_name FROM some_errors)),
owned AS (SELECT *, coalesce(nullif({sql_strip('team')}, ''), '（未填负责人）') AS owner, {_PROBLEM} AS problem FROM all_errors)"""
_FIELD_ROWS = [
    f"SELECT sheet_name, sheet_order, row_num, 'company_name' AS f, company_name AS v FROM err WHERE kind = 'null' AND {sql_blank('company_name')}",
    f"SELECT sheet_name, sheet_order, row_num, 'industry', industry FROM err WHERE kind = 'null' AND {sql_blank('industry')}",
    "SELECT sheet_name, sheet_order, row_num, 'collected_at', c0 FROM err WHERE kind = 'date'",
    *[f"SELECT sheet_name, sheet_order, row_num, '{f}', {f} FROM err WHERE kind = 'length' AND length({f}) > {n}" for f, n in fx.LIMITS.items()],
]
_FIELD_LABEL = "CASE f " + " ".join(f"WHEN '{f}' THEN '{label}'" for f, label in {"collected_at": "A列 日期", **_LABELS}.items()) + " END"


@query(
    f"""WITH {ALL_ERRORS}, hit AS ({' UNION ALL '.join(_FIELD_ROWS)})
    SELECT o.sheet_name, o.sheet_order, o.row_num, coalesce({_FIELD_LABEL}, '—') AS label,
      CASE WHEN f IS NULL THEN coalesce(nullif({sql_strip('o.company_name')}, ''), '—') ELSE {_display_sql('v')} END AS value, problem, owner
    FROM owned o LEFT JOIN hit h ON o.sheet_name = h.sheet_name AND o.row_num = h.row_num AND o.kind <> 'db'"""
)
def error_detail(spark, sf_dir):
    return reports.error_detail(_all_errors(spark, sf_dir)).drop("field_pos")


_O = "owner, sheet_name, sheet_order"
_COUNTS_SQL = f"(SELECT {_O}, count(DISTINCT row_num) + count(*) FILTER (row_num IS NULL) AS n_error_rows, coalesce(min(row_num), 0) AS first_row FROM owned GROUP BY {_O})"


@query(f"WITH {ALL_ERRORS} SELECT * FROM {_COUNTS_SQL}")
def error_summary(spark, sf_dir):
    return reports.error_summary(reports.summary_ranges(_all_errors(spark, sf_dir)))


@query(
    f"""WITH {ALL_ERRORS}, item AS (
      SELECT {_O}, 'rows' AS part, a AS position, {_RANGE} AS item, '、' AS j FROM {_islands_sql('(SELECT * FROM owned WHERE row_num IS NOT NULL)', _O)}
      UNION ALL SELECT {_O}, 'problems', coalesce(min(row_num), 0), problem, '；' FROM owned GROUP BY {_O}, problem)
    SELECT {_O}, part, position, item, CASE WHEN row_number() OVER (PARTITION BY {_O}, part ORDER BY position, item) = 1 THEN item ELSE j || item END AS text FROM item"""
)
def error_summary_items(spark, sf_dir):
    errors = _all_errors(spark, sf_dir)
    return reports.summary_items(errors, reports.summary_ranges(errors))


@query(f"WITH {ALL_ERRORS} SELECT count(DISTINCT sheet_name) AS n_sheets, CAST(sum(n_error_rows) AS BIGINT) AS n_error_rows FROM {_COUNTS_SQL}")
def error_summary_footer(spark, sf_dir):
    return reports.summary_footer(reports.error_summary(reports.summary_ranges(_all_errors(spark, sf_dir))))


@query(f"WITH m AS (SELECT o_orderkey, 'db' AS kind, {_writer_message('o_orderkey')} AS message FROM orders) SELECT o_orderkey, {_HUMAN} AS shown, {_PROBLEM} AS problem FROM m")
def humanized_messages(spark, sf_dir):
    found = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_writer_message("o_orderkey")).alias("message"))
    m = F.col("message")
    return found.select("o_orderkey", messages.humanize(m).alias("shown"), messages.problem_text(F.lit("db"), m).alias("problem"))


# ---- lookups ----


def _suppliers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as selected sheets; their nation is the table, empty or absent for some."""
    s = table(spark, sf_dir, "supplier")
    selected = s.select(F.col("s_name").alias("sheet_name"), F.col("s_suppkey").alias("sheet_order"))
    entries = s.where("s_suppkey % 10 <> 7").selectExpr(
        "s_name AS sheet_name", "s_suppkey AS sheet_order", "CASE WHEN s_suppkey % 10 = 3 THEN '' ELSE concat('nation_', s_nationkey) END AS table_name"
    )
    return selected, entries


_MAPPED = "mapped AS (SELECT s_name AS sheet_name, s_suppkey AS sheet_order, 'nation_' || s_nationkey AS table_name FROM supplier WHERE s_suppkey % 10 NOT IN (3, 7))"


@query("SELECT p_name AS sheet_name, arg_max(p_brand, p_partkey) AS table_name FROM part GROUP BY p_name")
def sheet_tables(spark, sf_dir):
    """Many entries per sheet name; the one with the highest order counts."""
    entries = table(spark, sf_dir, "part").selectExpr("p_name AS sheet_name", "p_partkey AS sheet_order", "p_brand AS table_name")
    return lookups.sheet_tables(entries)


@query(f"WITH {_MAPPED} SELECT sheet_name, sheet_order, table_name FROM mapped")
def mapped_sheets(spark, sf_dir):
    return lookups.mapped_sheets(*_suppliers(spark, sf_dir))


@query("SELECT s_name AS sheet_name, s_suppkey AS sheet_order FROM supplier WHERE s_suppkey % 10 IN (3, 7)")
def unmapped_sheets(spark, sf_dir):
    return lookups.unmapped_sheets(*_suppliers(spark, sf_dir))


@query(f"WITH {_MAPPED} SELECT table_name, n_sheets, sheet_name, sheet_order FROM (SELECT *, count(*) OVER (PARTITION BY table_name) AS n_sheets FROM mapped) WHERE n_sheets > 1")
def sheet_table_conflicts(spark, sf_dir):
    return lookups.table_conflicts(*_suppliers(spark, sf_dir))


@query("SELECT 'nation_' || n_nationkey AS table_name, n_nationkey AS request_order FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0)")
def missing_tables(spark, sf_dir):
    wanted = table(spark, sf_dir, "nation").selectExpr("concat('nation_', n_nationkey) AS table_name", "n_nationkey AS request_order")
    existing = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").selectExpr("concat('nation_', s_nationkey) AS table_name").distinct()
    return lookups.missing_tables(wanted, existing)


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per month of the order date: a sheet failed in the months in which one of its rows is bad."""
    months = raw_rows(spark, sf_dir, keep=("d",)).select("sheet_name", "sheet_order", "row_num", F.substring("d", 1, 7).alias("d"))
    verdicts = _verdicts(spark, sf_dir).select("sheet_name", "row_num", "kind").join(months, ["sheet_name", "row_num"])
    return verdicts.groupBy("d", "sheet_name", "sheet_order").agg(F.count("kind").alias("bad")).select(
        F.col("d").alias("run_id"),
        F.concat(F.lit("t_00"), F.col("sheet_order").cast("string")).alias("table_name"),
        "sheet_name",
        F.when(F.col("bad") > 0, "failed").otherwise("success").alias("status"),
        F.concat("d", F.lit("-28 12:00:00")).alias("finished_at"),
    )


LEDGER = f"""{VERDICT}, {SHEETS_SQL},
ledger AS (SELECT d[1:7] AS run_id, 't_00' || sheet_order AS table_name, CASE WHEN count(kind) > 0 THEN 'failed' ELSE 'success' END AS status, d[1:7] || '-28 12:00:00' AS finished_at FROM verdict GROUP BY d[1:7], sheet_order),
state AS (SELECT table_name, arg_max(status, finished_at) AS last_status, max(finished_at) FILTER (status = 'success') AS last_success_at FROM ledger GROUP BY table_name)"""


@query(f"WITH {LEDGER} SELECT * FROM state")
def ledger_state(spark, sf_dir):
    return lookups.ledger_state(_ledger(spark, sf_dir))


@query(
    f"""WITH {LEDGER} SELECT w.moment, s.table_name, s.last_status, s.last_success_at FROM
    (VALUES ('appended'), ('folded'), ('appended behind the snapshot'), ('a wrong run'), ('the run repeated'), ('folded again')) AS w(moment),
    LATERAL (SELECT table_name, CASE WHEN w.moment = 'a wrong run' THEN 'failed' ELSE arg_max(status, finished_at) END AS last_status,
        max(finished_at) FILTER (status = 'success' AND (w.moment <> 'a wrong run' OR run_id < '1999-01')) AS last_success_at
      FROM ledger WHERE w.moment NOT IN ('appended', 'folded') OR run_id < '1999-01' GROUP BY table_name) AS s"""
)
def ledger_folded(spark, sf_dir):
    """The state of each table from the ledger's files: before and after a fold, with runs behind the snapshot, after runs were repeated
    wrongly, repeated rightly, and folded again."""
    path, seen, entries = run_folder(spark, "ledger"), [], staged(_ledger(spark, sf_dir), "entries")
    late = F.col("run_id") >= "1999-01"

    def look(moment: str) -> None:
        seen.append(staged(ledger.state(spark, path).select(F.lit(moment).alias("moment"), "*"), "seen"))

    ledger.append(entries.where(~late), path, fold_after=1 << 30)
    look("appended")
    ledger.fold(spark, path)
    look("folded")
    ledger.append(entries.where(late), path, fold_after=1)  # folds, too
    look("appended behind the snapshot")
    ledger.append(entries.where(late).withColumn("status", F.lit("failed")), path, fold_after=1 << 30)
    look("a wrong run")
    ledger.append(entries.where(late), path, fold_after=1 << 30)
    look("the run repeated")
    ledger.fold(spark, path)
    look("folded again")
    return reduce(DataFrame.unionAll, seen)


@query(f"WITH {LEDGER} SELECT sheet_name, sheet_order, coalesce(last_success_at, '') AS last_load_time, coalesce(last_status = 'failed', false) AS failed FROM sheets LEFT JOIN state USING (table_name)")
def sheet_states(spark, sf_dir):
    return lookups.sheet_states(_sheets(spark, sf_dir), _sheet_map(spark, sf_dir), _ledger(spark, sf_dir))


# The new input holds only the sheets that have orders of the current year.
_PRESENT = "present AS (SELECT DISTINCT sheet_name FROM base WHERE d >= '2001-01-01' AND sheet_name <> '1-URGENT')"


@query(f"WITH {LEDGER}, {_PRESENT} SELECT sheet_name, sheet_order FROM sheets JOIN state USING (table_name) WHERE last_status = 'failed' AND sheet_name IN (SELECT sheet_name FROM present)")
def retry_set(spark, sf_dir):
    new_input = table(spark, sf_dir, "orders").where("o_orderdate >= '2001-01-01' AND o_orderpriority <> '1-URGENT'").select(
        F.col("o_orderpriority").alias("sheet_name"), F.substring("o_orderpriority", 1, 1).cast("int").alias("sheet_order")
    )
    return lookups.retry_sheets(rows.sheet_inventory(new_input), _sheet_map(spark, sf_dir), _ledger(spark, sf_dir))


@query("SELECT count(*) AS n_total, (SELECT string_agg(s_name, '、' ORDER BY s_suppkey) FROM (SELECT * FROM supplier ORDER BY s_suppkey LIMIT 8)) || CASE WHEN count(*) > 8 THEN ' 等 ' || count(*) || ' 个' ELSE '' END AS preview FROM supplier")
def retry_preview(spark, sf_dir):
    return lookups.preview(_suppliers(spark, sf_dir)[0])


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "concat(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END, ' ', p_type) AS sheet_name", "concat(p_name, '-', p_brand) AS table_name"
    )


_ENTRIES = "entries AS (SELECT p_partkey AS id, concat(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END, ' ', p_type) AS sheet_name, concat(p_name, '-', p_brand) AS table_name FROM part)"


@query(f"WITH {_ENTRIES} SELECT * FROM entries WHERE contains(lower(sheet_name), 'ri')")
def keyword_filter(spark, sf_dir):
    return lookups.keyword_filter(_entries(spark, sf_dir), " Ri ", trim_keyword=True)


def _count(c: str) -> str:
    return f"CAST((length({c}) - length(replace({c}, 'ri', ''))) / 2 AS BIGINT)"


@query(
    f"""WITH {_ENTRIES}, c AS (SELECT *, contains(lower(sheet_name), 'ri') AS hit FROM entries)
    SELECT id, sheet_name, table_name, CASE WHEN hit THEN {_count('sheet_name')} + {_count('table_name')} ELSE 0 END AS n_replaced,
      CASE WHEN hit THEN replace(sheet_name, 'ri', '.*') ELSE sheet_name END AS new_sheet_name,
      CASE WHEN hit THEN replace(table_name, 'ri', '.*') ELSE table_name END AS new_table_name FROM c"""
)
def keyword_replace(spark, sf_dir):
    return lookups.keyword_replace(_entries(spark, sf_dir), "ri", ".*")


@query(
    f"""WITH {_ENTRIES} SELECT count(*) AS n_entries, CAST(sum({_count('sheet_name')} + {_count('table_name')}) AS BIGINT) AS n_replaced
    FROM entries WHERE contains(lower(sheet_name), 'ri')"""
)
def keyword_replace_count(spark, sf_dir):
    chosen = lookups.keyword_replace(lookups.keyword_filter(_entries(spark, sf_dir), "ri"), "ri", ".*")
    return chosen.agg(F.count(F.lit(1)).alias("n_entries"), F.sum("n_replaced").alias("n_replaced"))


# ---- de-duplication ----


def _ranked(scope: str, key: str = "key", selected: str = "true") -> str:
    cell = "c3" if key == "key" else "c4"
    return f"""{RAW},
    keyed AS (SELECT *, {key} AS k, {cell} AS raw_key, ({selected}) AND {key} <> '' AND dt IS NOT NULL AS eligible FROM dated),
    elig AS (SELECT *, row_number() OVER (PARTITION BY {scope} ORDER BY dt, sheet_order, row_num) AS rn,
                    row_number() OVER (PARTITION BY {scope} ORDER BY sheet_order, row_num) AS pos_in_key,
                    min(dt) OVER (PARTITION BY {scope} ORDER BY sheet_order, row_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
             FROM keyed WHERE eligible)"""


def _kept_sql(scope: str, key: str = "key", selected: str = "true") -> str:
    columns = f"sheet_name, sheet_order, row_num, {', '.join(CELLS)}"
    return f"WITH {_ranked(scope, key, selected)} SELECT {columns} FROM keyed WHERE NOT eligible UNION ALL SELECT {columns} FROM elig WHERE rn = 1"


def _list_sql(scope: str, columns: str | None = None) -> str:
    """Row by row: when a row is a new best, when it is dropped, and where its group starts."""
    columns = columns or """CASE WHEN rn = 1 THEN 'keep' ELSE 'delete' END AS action, sheet_name, sheet_order, row_num, raw_key, c0 AS raw_time,
      g.o AS group_sheet_order, g.s AS group_sheet_name, g.r AS group_row_num, CASE WHEN rn = 1 THEN 0 ELSE 1 END AS action_pos,
      l.o AS lost_sheet_order, l.s AS lost_sheet_name, l.r AS lost_row_num"""
    return f"""WITH {_ranked(scope)},
    marked AS (SELECT *, {{'o': sheet_order, 's': sheet_name, 'r': row_num}} AS pos, before IS NULL OR dt < before AS best FROM elig),
    dropped AS (SELECT *, min(CASE WHEN best THEN pos END) OVER (PARTITION BY {scope} ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_best,
                       min(pos) OVER (PARTITION BY {scope}) AS g, count(*) OVER (PARTITION BY {scope}) AS n FROM marked),
    placed AS (SELECT *, CASE WHEN rn > 1 AND best THEN next_best ELSE pos END AS l FROM dropped WHERE n > 1)
    SELECT {columns} FROM placed"""


@query(_kept_sql("k"))
def dedup_global_kept(spark, sf_dir):
    return dedup.kept_rows(raw_rows(spark, sf_dir))


@query(_kept_sql("sheet_name, k"))
def dedup_sheet_kept(spark, sf_dir):
    return dedup.kept_rows(raw_rows(spark, sf_dir), dedup.SHEET)


@query(_kept_sql("k", selected="sheet_name IN ('2-HIGH', '4-NOT SPECIFIED')"))
def dedup_selected_kept(spark, sf_dir):
    """Two selected sheets; the others pass through."""
    return dedup.kept_rows(raw_rows(spark, sf_dir), sheets=["4-NOT SPECIFIED", "2-HIGH"])


@query(_kept_sql("k", key=f"coalesce({sql_strip('c4')}, '')"))
def dedup_by_link(spark, sf_dir):
    """Another key column: E, the link."""
    return dedup.kept_rows(raw_rows(spark, sf_dir), key_index=5)


@query(_list_sql("k"))
def dedup_global_losers(spark, sf_dir):
    return dedup.duplicate_list(raw_rows(spark, sf_dir)).drop("dedup_key")


@query(_list_sql("sheet_name, k"))
def dedup_sheet_losers(spark, sf_dir):
    return dedup.duplicate_list(raw_rows(spark, sf_dir), dedup.SHEET).drop("dedup_key")


@query(f"WITH {_ranked('k')} SELECT k AS dedup_key, strftime(min(dt), '%Y-%m-%d') AS keep_date, min(sheet_order) FILTER (rn = 1) AS keep_sheet_order, min(sheet_name) FILTER (rn = 1) AS keep_sheet_name, min(row_num) FILTER (rn = 1) AS keep_row_num, count(*) AS n_rows FROM elig GROUP BY k")
def dedup_keepers(spark, sf_dir):
    return dedup.keepers(raw_rows(spark, sf_dir)).withColumn("keep_date", _day("keep_date"))


def _stats_sql(scope: str, selected: str = "true") -> str:
    return f"""WITH {_ranked(scope, selected=selected)}, gone AS (SELECT sheet_name, count(*) AS n FROM elig WHERE rn > 1 GROUP BY ALL)
    SELECT sheet_name, sheet_order, count(*) AS total, count(*) - coalesce(max(n), 0) AS kept, coalesce(max(n), 0) AS deleted, NOT ({selected}) AS copied_only
    FROM keyed LEFT JOIN gone USING (sheet_name) GROUP BY sheet_name, sheet_order"""


@query(_stats_sql("sheet_name, k"))
def dedup_sheet_stats(spark, sf_dir):
    return dedup.dedup_stats(raw_rows(spark, sf_dir), dedup.SHEET)


@query(_stats_sql("k", "sheet_name IN ('2-HIGH', '4-NOT SPECIFIED')"))
def dedup_selected_stats(spark, sf_dir):
    return dedup.dedup_stats(raw_rows(spark, sf_dir), sheets=["4-NOT SPECIFIED", "2-HIGH"])


@query(
    f"""WITH {_ranked('k')}, kept AS (SELECT sheet_name, row_num FROM keyed WHERE NOT eligible UNION ALL SELECT sheet_name, row_num FROM elig WHERE rn = 1)
    SELECT sheet_name, row_num, 1 + row_number() OVER (PARTITION BY sheet_name ORDER BY row_num) AS new_row_num FROM kept"""
)
def dedup_renumber(spark, sf_dir):
    kept = staged(dedup.kept_rows(raw_rows(spark, sf_dir).select(*ADDRESS, "c0", "c3")).select(*ADDRESS), "kept")
    return dedup.renumber(kept).select("sheet_name", "row_num", "new_row_num")


# Two sheets that share an order, and one whose order is beyond 16 bits.
_SHARED = "CASE WHEN sheet_order <= 2 THEN 7 WHEN sheet_order = 5 THEN 70000 ELSE sheet_order END"


def _shared_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_rows(spark, sf_dir).withColumn("sheet_order", F.expr(_SHARED))


def _shared_sql(sql: str) -> str:
    """The query over rows with the changed order; equal orders follow by name."""
    changed = sql.replace("FROM dated)", f"FROM (SELECT * REPLACE ({_SHARED} AS sheet_order) FROM dated))", 1)
    return changed.replace("sheet_order, row_num)", "sheet_order, sheet_name, row_num)").replace("sheet_order, row_num ROWS", "sheet_order, sheet_name, row_num ROWS")


@query(_shared_sql(_kept_sql("k")))
def dedup_shared_order(spark, sf_dir):
    return dedup.kept_rows(_shared_order(spark, sf_dir))


@query(_shared_sql(_list_sql("k")))
def dedup_shared_order_losers(spark, sf_dir):
    return dedup.duplicate_list(_shared_order(spark, sf_dir)).drop("dedup_key")


@query(_shared_sql(_stats_sql("k")))
def dedup_shared_order_stats(spark, sf_dir):
    return dedup.dedup_stats(_shared_order(spark, sf_dir))


_CELL_12 = _ranked("k", "'L' || ok % 400")


@query(f"WITH {_CELL_12} SELECT sheet_name, row_num FROM keyed WHERE NOT eligible UNION ALL SELECT sheet_name, row_num FROM elig WHERE rn = 1")
def dedup_by_cell_12(spark, sf_dir):
    """The key in the twelfth cell, which belongs to no record."""
    raw = raw_rows(spark, sf_dir, keep=("ok",)).withColumn("c11", F.expr("concat('Ｌ', ok % 400)"))
    return dedup.kept_rows(raw, key_index=12).select("sheet_name", "row_num")


@query(
    f"""WITH {_ranked('k')}, s AS (SELECT count(*) AS kept FROM (SELECT 1 FROM keyed WHERE NOT eligible UNION ALL SELECT 1 FROM elig WHERE rn = 1))
    SELECT 'run-1' AS run_id, 'global' AS mode, (SELECT count(DISTINCT sheet_name) FROM keyed) AS n_sheets, CAST(0 AS BIGINT) AS n_copied, (SELECT count(*) FROM keyed) AS total,
      kept, (SELECT count(*) FROM keyed) - kept AS deleted, 'a' AS started_at, 'b' AS finished_at, 'c' AS source FROM s"""
)
def dedup_history(spark, sf_dir):
    """A whole de-duplication job: what its history then says."""
    folder = run_folder(spark, "dedup")
    jobs.run_dedup(raw_rows(spark, sf_dir), f"{folder}/out", ledger=f"{folder}/ledger", run_id="run-1", started_at="a", finished_at="b", source="c")
    return ledger.history(spark, f"{folder}/ledger")


@query(
    f"""WITH {_ranked('k')}, kept AS (SELECT * FROM keyed WHERE NOT eligible UNION ALL SELECT * EXCLUDE (rn, pos_in_key, before) FROM elig WHERE rn = 1)
    SELECT sheet_name, sheet_order, row_num AS old_row_num, 1 + row_number() OVER (PARTITION BY sheet_name ORDER BY row_num) AS row_num, {', '.join(CELLS)} FROM kept"""
)
def dedup_copy(spark, sf_dir):
    """The copy that a whole job writes: all cells, the old row numbers and the new ones."""
    folder = run_folder(spark, "dedup")
    jobs.run_dedup(raw_rows(spark, sf_dir), f"{folder}/out")
    return spark.read.parquet(f"{folder}/out/rows").select("sheet_name", "sheet_order", "old_row_num", "row_num", *CELLS)


@query(f"WITH {_ranked('k')} SELECT sheet_name, row_num FROM keyed WHERE NOT eligible UNION ALL SELECT sheet_name, row_num FROM elig WHERE rn = 1")
def dedup_remove_rows(spark, sf_dir):
    """The same survivors by taking the losers out."""
    raw = raw_rows(spark, sf_dir)
    return dedup.remove_rows(raw, dedup.losers(raw)).select("sheet_name", "row_num")


@query(f"WITH {RAW} SELECT sheet_name, count(*) AS n_first, count(*) AS n_second, true AS agrees FROM raw GROUP BY sheet_name")
def dedup_counts_agree(spark, sf_dir):
    """Rows read against rows kept plus rows deleted."""
    raw = raw_rows(spark, sf_dir)
    return gate.counts_agree(gate.rows_per_sheet(raw), gate.kept_and_deleted(dedup.kept_rows(raw), dedup.losers(raw)))


_LISTED = "g.o, g.s, g.r, CASE WHEN rn = 1 THEN 0 ELSE 1 END, l.o, l.s, l.r"


@query(_list_sql("k", f"1 + row_number() OVER (ORDER BY {_LISTED}) AS line, CASE WHEN rn = 1 THEN '保留' ELSE '删除' END AS action, sheet_name, row_num, raw_key, c0 AS raw_time"))
def dedup_list_csv(spark, sf_dir):
    """The duplicate list, written as one CSV file and read again, with the line at which each entry stands."""
    path = f"{run_folder(spark, 'duplicates')}.csv"
    sinks.write_duplicate_list(dedup.duplicate_list(raw_rows(spark, sf_dir)), path)
    listed = readers.csv_sheets(spark, path)
    return listed.select(
        F.col("row_num").alias("line"), F.col("c0").alias("action"), F.col("c1").alias("sheet_name"), F.col("c2").cast("bigint").alias("row_num"),
        F.col("c3").alias("raw_key"), F.col("c4").alias("raw_time"),
    )


# ---- files ----


def _sheet_files(spark: SparkSession, sf_dir: str, file_format: str) -> str:
    """The fixture as a folder of files, one per sheet and named after it, with its rows in order and a header."""
    parts = run_folder(spark, "parts")
    named = raw_rows(spark, sf_dir).withColumn("name", F.concat(F.lit("表 "), "sheet_name"))
    writer = named.repartition("name").sortWithinPartitions("name", "row_num").select("name", *CELLS).write.partitionBy("name")
    writer = writer.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.format(file_format).save(parts)
    return _one_file_each(spark, parts, file_format)


def _one_file_each(spark: SparkSession, parts: str, file_format: str) -> str:
    """A folder with the one file of each partition folder below `parts`, named after it."""
    files = run_folder(spark, "sheets")
    target, fs = _hadoop(spark, files)
    fs.mkdirs(target)
    written = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(parts)
    for row in written.select("path").collect():  # one file per sheet
        source, _ = _hadoop(spark, row.path)
        name = source.getParent().getName().split("=", 1)[1]
        fs.rename(source, spark._jvm.org.apache.hadoop.fs.Path(target, f"{name}.{file_format}"))
    return files


def _hadoop(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


_FILE_SQL = f"WITH {RAW} SELECT '表 ' || sheet_name AS sheet_name, sheet_order, row_num, c1, c3, c4, nullif(c8, '') AS c8 FROM raw"


@query(_FILE_SQL)
def parquet_sheets_read(spark, sf_dir):
    """The fixture written as a file per sheet and read back: names, order and row numbers come from the files."""
    return readers.parquet_sheets(spark, _sheet_files(spark, sf_dir, "parquet")).select(*ADDRESS, "c1", "c3", "c4", "c8")


#: A line that opens a cell and does not close it, behind this row of this sheet.
_BROKEN_LINE, _BROKEN_AT = 'five pipes,"never closed', ("2-HIGH", 40)


@query(
    f"""WITH {RAW} SELECT '表 ' || sheet_name AS sheet_name, CASE WHEN sheet_name = '{_BROKEN_AT[0]}' AND row_num > {_BROKEN_AT[1]} THEN row_num + 1 ELSE row_num END AS row_num,
      CASE WHEN ok % 5 = 0 THEN c1 || chr(10) || '"' || ok || '", next' ELSE c1 END AS c1, c3, CAST(NULL AS VARCHAR) AS problem FROM raw
    UNION ALL SELECT '表 {_BROKEN_AT[0]}', {_BROKEN_AT[1] + 1}, NULL, NULL, '{_BROKEN_LINE}'"""
)
def csv_broken_line(spark, sf_dir):
    """The fixture as CSV files with cells of several lines and one broken line in the midst of a sheet: all other rows with their cells and
    numbers, and the broken line as a row of its own."""
    parts = run_folder(spark, "parts")
    lined = raw_rows(spark, sf_dir, keep=("ok",)).withColumn("c1", F.when(F.col("ok") % 5 == 0, F.concat("c1", F.lit('\n"'), "ok", F.lit('", next'))).otherwise(F.col("c1")))
    text = F.to_csv(F.struct(*CELLS), {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    name = F.concat(F.lit("表 "), "sheet_name")
    lines = lined.select(name.alias("name"), F.col("row_num").cast("double").alias("at"), text.alias("line"))
    broken = spark.createDataFrame([(f"表 {_BROKEN_AT[0]}", _BROKEN_AT[1] + 0.5, _BROKEN_LINE)], lines.schema)
    heads = lines.select("name", F.lit(1.0).alias("at"), F.lit(",".join(CELLS)).alias("line")).distinct()
    whole = lines.unionAll(broken).unionAll(heads).repartition("name").sortWithinPartitions("name", "at")
    whole.select("name", "line").write.partitionBy("name").text(parts)
    path = _one_file_each(spark, parts, "csv")
    read, problems = readers.csv_sheets_and_problems(spark, path)
    read, problems = read.select("sheet_name", "row_num", "c1", "c3"), problems.select("sheet_name", "row_num", F.col("line").alias("problem"))
    joined = read.join(problems, ["sheet_name", "row_num"], "left")
    return joined.select("sheet_name", "row_num", *[F.when(F.col("problem").isNull(), F.col(c)).alias(c) for c in ("c1", "c3")], "problem")


@query(_FILE_SQL)
def csv_sheets_read(spark, sf_dir):
    return readers.csv_sheets(spark, _sheet_files(spark, sf_dir, "csv")).select(*ADDRESS, "c1", "c3", "c4", "c8")


@query(f"WITH {SHEETS_SQL} SELECT '表 ' || sheet_name AS sheet_name, CASE sheet_order WHEN 4 THEN 1 WHEN 2 THEN 2 WHEN 1 THEN 3 WHEN 3 THEN 4 ELSE 5 END AS sheet_order FROM sheets")
def file_inventory(spark, sf_dir):
    """Listed sheets first, the others by name."""
    return readers.file_sheets(spark, _sheet_files(spark, sf_dir, "parquet"), ["表 4-NOT SPECIFIED", "表 none", "表 2-HIGH"])


# Run by bench.py.
HEADLINE = [
    "rows_nonblank",
    "records_projected",
    "load_verdict",
    "load_gate",
    "validate_all",
    "error_groups",
    "error_islands",
    "error_summary",
    "dedup_global_kept",
    "dedup_sheet_kept",
    "dedup_global_losers",
    "dedup_sheet_stats",
    "dedup_renumber",
    "load_recount",
]
