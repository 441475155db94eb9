"""Sheet rows derived from the driver's tables, in Spark and as DuckDB CTEs.

The five order priorities are the sheets and each order is a row: company names in three
spellings, dates in seven, blank rows, and bad values in three of the five sheets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgate.functions.schema import ADDRESS, CELLS
from rowgate.operators.positions import number_rows
from rowgate.session import staged

# Cell expressions that both engines understand; {d} is the order date as yyyy-MM-dd.
_CELL_SQL = """
  CASE WHEN blank THEN '' WHEN ok % 17 = 0 THEN NULL WHEN ok % 17 = 1 THEN '  '
       WHEN ok % 17 = 2 THEN concat(d, ' 10:30')      WHEN ok % 17 = 3 THEN replace(d, '-', '/')
       WHEN ok % 17 = 4 THEN replace(d, '-', '.')     WHEN ok % 17 = 5 THEN concat('  ', d, '-08:05:09 ')
       WHEN ok % 17 = 6 THEN translate(d, '0123456789-', '０１２３４５６７８９－')
       WHEN dirty AND ok % 61 = 0 THEN 'n/a'          WHEN dirty AND ok % 67 = 0 THEN '2024-02-30'
       ELSE d END AS c0,
  CASE WHEN blank OR ok % 13 = 0 THEN NULL ELSE concat('team', CAST(ck % 7 AS STRING)) END AS c1,
  CASE WHEN blank THEN NULL ELSE concat('src', CAST(ok % 19 AS STRING)) END AS c2,
  CASE WHEN blank THEN '　' WHEN dirty AND ok % 97 = 0 THEN NULL WHEN dirty AND ok % 101 = 0 THEN '　 '
       WHEN ok % 3 = 0 THEN concat(' ', c_name, '　')
       WHEN ok % 3 = 1 THEN translate(c_name, '0123456789#C', '０１２３４５６７８９＃Ｃ')
       ELSE c_name END AS c3,
  CASE WHEN blank THEN NULL ELSE concat('https://', CAST(ck AS STRING), '.example') END AS c4,
  CASE WHEN blank OR (dirty AND ok % 89 = 0) THEN '' ELSE seg END AS c5,
  CAST(NULL AS STRING) AS c6, '' AS c7,
  CASE WHEN blank THEN NULL ELSE st END AS c8,
  CASE WHEN blank THEN NULL WHEN dirty AND ok % 211 = 0 THEN repeat('x', 201) ELSE 'open' END AS c9,
  CAST(NULL AS STRING) AS c10
"""
_BASE_SQL = """
  o_orderkey AS ok, o_custkey AS ck, c_name, c_mktsegment AS seg, o_orderstatus AS st,
  o_orderpriority AS sheet_name,
  CAST(substr(o_orderpriority, 1, 1) AS INT) AS sheet_order,
  o_orderpriority NOT IN ('3-MEDIUM', '5-LOW') AS dirty,
  o_orderkey % 53 = 7 AS blank
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheet rows with their order key (ok) and date (d); row numbers start at 2, by order key."""
    orders = number_rows(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderkey", "_n")
    base = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        *_split_columns(_BASE_SQL), "_n + 1 AS row_num", "date_format(o_orderdate, 'yyyy-MM-dd') AS d"
    )
    return base.selectExpr("sheet_name", "sheet_order", "row_num", *_split_columns(_CELL_SQL), "ok", "d")


_STAGED: dict[tuple[str, str], DataFrame] = {}


def raw_rows(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The sheet rows as a row table, the form in which the library gets its input. It is derived from the
    driver's tables once per application. `keep` leaves further columns in."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STAGED:
        _STAGED[key] = staged(derive_rows(spark, sf_dir), "sheet-rows")
    return _STAGED[key].select(*ADDRESS, *CELLS, *keep)


def _split_columns(sql: str) -> list[str]:
    """Splits a select list at commas outside brackets and quotes."""
    out, depth, quoted, start = [], 0, False, 0
    for i, ch in enumerate(sql):
        if ch == "'":
            quoted = not quoted
        elif not quoted and ch == "(":
            depth += 1
        elif not quoted and ch == ")":
            depth -= 1
        elif not quoted and depth == 0 and ch == ",":
            out.append(sql[start:i].strip())
            start = i + 1
    return [*out, sql[start:].strip()]


# ---- the same in DuckDB ----

# Folding and white space are stated here on their own, not taken from the library.
FROM = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
TO = ("".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " ").replace("'", "''")
BLANK_CLASS = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(c: str) -> str:
    return rf"regexp_replace({c}, '^{BLANK_CLASS}+|{BLANK_CLASS}+$', '', 'g')"


def sql_blank(c: str) -> str:
    return f"(coalesce({sql_strip(c)}, '') = '')"


def sql_key(c: str) -> str:
    translated = f"translate(coalesce({c}, ''), '{FROM}', '{TO}')"
    return sql_strip(translated)


_NORM = f"regexp_replace(translate(c0, '{FROM}', '{TO}'), '{BLANK_CLASS}', ' ', 'g')"
RAW = f"""base AS (
  SELECT {_BASE_SQL}, CAST(1 + row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS BIGINT) AS row_num,
         strftime(o_orderdate, '%Y-%m-%d') AS d
  FROM orders JOIN customer ON o_custkey = c_custkey),
raw AS (SELECT sheet_name, sheet_order, row_num, ok, d, dirty, {_CELL_SQL} FROM base),
words AS (SELECT *, trim({_NORM}) AS t FROM raw),
parts AS (SELECT *, translate(split_part(t, ' ', 1), '/.', '--') AS p1,
                 translate(replace(substr(t, length(split_part(t, ' ', 1)) + 1), ' ', ''), '.', ':') AS p2 FROM words),
normal AS (SELECT *, CASE WHEN p2 = '' THEN p1 ELSE p1 || ' ' || p2 END AS norm FROM parts),
dated AS (SELECT *, CASE WHEN substr(norm, 1, 4) <> '0000' AND regexp_matches(norm,
   '^\\d{{4}}-(1[0-2]|0[1-9]|[1-9])-(3[01]|[12]\\d|0[1-9]|[1-9])([ -](2[0-3]|[01]\\d|\\d):([0-5]\\d|\\d)(:([0-5]\\d|\\d))?)?$')
   THEN try_cast(regexp_extract(norm, '^(\\d+)-(\\d+)-(\\d+)', 1) || '-' || lpad(regexp_extract(norm, '^(\\d+)-(\\d+)-(\\d+)', 2), 2, '0')
     || '-' || lpad(regexp_extract(norm, '^(\\d+)-(\\d+)-(\\d+)', 3), 2, '0') AS DATE) END AS dt,
   {sql_key('c3')} AS key FROM normal)"""
_FILLED = " OR ".join(f"NOT {sql_blank(c)}" for c in CELLS)
FIELDS = ["team", "source", "company_name", "link", "industry", "sub_category_2", "sub_category_3", "org_type", "status", "system_reply"]
RECORDS = f"""{RAW},
nonblank AS (SELECT * FROM dated WHERE {_FILLED}),
rec AS (SELECT sheet_name, sheet_order, row_num, ok, d, c0, dt AS collected_at,
        {", ".join(f"coalesce(c{i + 1}, '') AS {f}" for i, f in enumerate(FIELDS))} FROM nonblank)"""
LIMITS = {"team": 50, "source": 200, "company_name": 500, "link": 1000, "industry": 100, "sub_category_2": 100,
          "sub_category_3": 100, "org_type": 100, "status": 200}
_TOO_LONG = " OR ".join(f"length({f}) > {n}" for f, n in LIMITS.items())
VERDICT = f"""{RECORDS},
verdict AS (SELECT *, CASE WHEN {sql_blank('company_name')} OR {sql_blank('industry')} THEN 'null'
  WHEN collected_at IS NULL AND NOT {sql_blank('c0')} THEN 'date' WHEN {_TOO_LONG} THEN 'length' END AS kind FROM rec)"""
