"""Sheet rows from files: one file per sheet, or row tables that carry their address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowgate.functions.schema import ADDRESS, CELLS, MAX_KEY_INDEX
from rowgate.operators.positions import BUCKET_ROWS
from rowgate.session import staged

_ALL_CELLS = [f"c{i}" for i in range(MAX_KEY_INDEX)]
_CSV_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in _ALL_CELLS])


def row_table(spark: SparkSession, path: str, file_format: str = "parquet", check: bool = True) -> DataFrame:
    """Rows that already carry sheet_name, sheet_order and row_num; cells that the table lacks are missing in every row.

    With `check`, a table whose addresses (sheet_name, row_num) are NULL or repeated is refused, which reads the addresses once."""
    df = spark.read.format(file_format).load(path)
    missing = [c for c in ADDRESS if c not in df.columns]
    if missing:
        raise ValueError(f"row table lacks columns: {', '.join(missing)}")
    lacking = {c: F.lit(None).cast("string") for c in CELLS if c not in df.columns}
    df = df.withColumn("row_num", F.col("row_num").cast("bigint")).withColumns(lacking)
    if check:
        repeated = df.groupBy("sheet_name", "row_num").agg(F.count(F.lit(1)).alias("n"))
        if not repeated.where("n > 1 OR sheet_name IS NULL OR row_num IS NULL").isEmpty():
            raise ValueError("row table has missing or repeated addresses")
    return df


def _sheet_of(file_path: str) -> F.Column:
    """Sheet name: the file name without its extension, percent-decoded."""
    name = F.substring_index(F.col(file_path), "/", -1)
    return F.url_decode(F.replace(F.regexp_replace(name, r"\.[^.]*\z", ""), F.lit("+"), F.lit("%2B")))


def file_sheets(spark: SparkSession, path: str, order: list[str] | None = None) -> DataFrame:
    """Inventory of a folder with one file per sheet: sheet_name and sheet_order, also of sheets without a row. Files are listed,
    not read. Listed sheets come first, in their order, then the others by name; a listed sheet without a file is not in the input."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("_file"))
    names = files.select(_sheet_of("_file").alias("sheet_name")).distinct()
    if order is None:
        listed = F.lit(None).cast("int")
    else:
        listed = F.array_position(F.array(*[F.lit(n) for n in order]).cast("array<string>"), F.col("sheet_name"))
        listed = F.when(listed > 0, listed)
    # One row per file, so this window is as small as the listing of the folder.
    place = W.orderBy(listed.asc_nulls_last(), "sheet_name")
    return names.withColumn("sheet_order", F.row_number().over(place))


def with_sheet_order(rows: DataFrame, inventory: DataFrame) -> DataFrame:
    """Rows with the order of their sheet in the inventory."""
    return rows.join(inventory, "sheet_name")


def parquet_sheets(spark: SparkSession, path: str, order: list[str] | None = None) -> DataFrame:
    """One parquet file per sheet with cells c0, c1, ...; the row number comes from the file's own row
    index, so nothing is shuffled for it."""
    df = spark.read.parquet(path)
    cells = [F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string").alias(c) for c in _ALL_CELLS]
    rows = df.select(
        F.col("_metadata.file_path").alias("_file"),
        (F.col("_metadata.row_index") + 2).cast("bigint").alias("row_num"),
        *[c.alias(n) for c, n in zip(cells, _ALL_CELLS)],
    ).withColumn("sheet_name", _sheet_of("_file"))
    return with_sheet_order(rows, file_sheets(spark, path, order)).select(*ADDRESS, *_ALL_CELLS)


#: Lines that a quoted cell may have; a quote that is still open behind them is taken for a stray one.
MAX_CELL_LINES = 1000
# A field, a line that leaves a quoted field open, and a line that ends one which was open when it began. Nothing is looked at twice.
_QUOTED = r'[^"]*+(?:""[^"]*+)*+'
_FIELD = rf'(?:"{_QUOTED}"|[^",]*+)'
_OPENS = rf'^(?:{_FIELD},)*+"{_QUOTED}$'
_CLOSES = rf'^{_QUOTED}"(?:,{_FIELD})*+$'


def csv_sheets(spark: SparkSession, path: str, order: list[str] | None = None, multi_line: bool = False, max_cell_lines: int = MAX_CELL_LINES) -> DataFrame:
    """One CSV file per sheet, header in row 1. The row number is the position in the file; empty lines count as rows.

    A file is read in splits; a line's number is its number inside its split plus the lines of the earlier splits, so a
    large file is not numbered by one task. With `multi_line` cells may contain line ends inside quotes. A quote that cannot be one of a
    quoted cell, or that is never closed, makes its line a row of its own (see csv_problems); all other rows keep their cells, and their numbers
    count that line as one row."""
    if multi_line:
        return csv_sheets_and_problems(spark, path, order, max_cell_lines)[0]
    numbered, files = _numbered_lines(spark, path)
    return _with_cells(numbered.withColumnRenamed("_line", "row_num"), _named(files, file_sheets(spark, path, order)))


def csv_problems(spark: SparkSession, path: str, order: list[str] | None = None, max_cell_lines: int = MAX_CELL_LINES) -> DataFrame:
    """Rows of csv_sheets(multi_line=True) with a stray quote: their address and the line as it is written."""
    return csv_sheets_and_problems(spark, path, order, max_cell_lines)[1]


def csv_sheets_and_problems(spark: SparkSession, path: str, order: list[str] | None = None, max_cell_lines: int = MAX_CELL_LINES) -> tuple[DataFrame, DataFrame]:
    """csv_sheets(multi_line=True) and csv_problems of the same files, which are read and looked through for quotes once for both."""
    numbered, files = _numbered_lines(spark, path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    # Only lines with an odd number of quotes open or close a cell.
    odd = numbered.where(quotes % 2 == 1).select("_file", "_block", "_line", F.col("value").rlike(_OPENS).alias("opens"), F.col("value").rlike(_CLOSES).alias("closes"))
    marks = staged(_paired(staged(odd, "quotes"), max_cell_lines), "marks")
    blocks, sheets = staged(_blocks(files, marks), "blocks"), _named(files, file_sheets(spark, path, order))
    problems = _broken_rows(numbered, marks, blocks).where("row_num > 1").join(sheets, "_file").select(*ADDRESS, F.col("value").alias("line"))
    return _with_cells(_joined_lines(numbered, marks, blocks), sheets), problems


def _named(files: DataFrame, inventory: DataFrame) -> DataFrame:
    """(_file, sheet_name, sheet_order), written as a table of one row per file: a name is taken from a path once and not for each line, and
    Spark sees that the table is small."""
    return staged(with_sheet_order(files.select("_file", _sheet_of("_file").alias("sheet_name")), inventory), "sheets")


def _with_cells(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    schema = _CSV_SCHEMA.simpleString()[7:-1].replace(":", " ")
    cells = F.from_csv("value", schema, {"escape": '"', "multiLine": "true"})
    rows = rows.where("row_num > 1").select("_file", "row_num", cells.alias("_cells"))
    return rows.select("_file", "row_num", "_cells.*").join(sheets, "_file").select(*ADDRESS, *_ALL_CELLS)


def _numbered_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(_file, _line, _block, value), the lines of all files with their numbers from 1 and blocks of BUCKET_ROWS numbers; and (_file, _n), the lines of each file.

    The lines are written once with the split they came from and their order in it: how files are cut may differ from one scan to the next."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), "value")
    lines = staged(lines.withColumn("_seq", F.monotonically_increasing_id()), "lines")
    # A split lies in one task, which numbers its lines without a gap; the earlier splits are one row each.
    earlier = W.partitionBy("_file").orderBy("_split").rowsBetween(W.unboundedPreceding, -1)
    splits = lines.groupBy("_file", "_split").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    splits = staged(splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))), "splits")
    line = (F.col("_seq") - F.col("_first") + F.col("_before") + 1).alias("_line")
    numbered = lines.join(splits, ["_file", "_split"]).select("_file", line, "value").withColumn("_block", _block("_line"))
    return numbered, splits.groupBy("_file").agg(F.sum("_n").alias("_n"))


def _block(line: str) -> Column:
    return F.call_function("div", F.col(line), F.lit(BUCKET_ROWS))


def _paired(odd: DataFrame, max_cell_lines: int) -> DataFrame:
    """(_file, _block, _line, _last, broken) of lines that open a cell, up to the line that closes it, and of lines with a stray quote.

    A line that can only open or only close a cell tells the state behind it. One that can do both, such as a lone quote, changes the state, so the state
    behind it follows from the last line that tells it and the number of such lines since. A line opens if the state behind it is open. An opening line
    goes with the next line that opens or closes: if that one closes, and not too far away. Else its quote is stray, as is one that can do neither, or
    that closes what is not open; what comes after is read as if it were not there. Windows work inside a block; one row per block carries over."""
    strays = odd.where("NOT opens AND NOT closes").select("_file", "_block", "_line", F.col("_line").alias("_last"), F.lit(True).alias("broken"))
    lines = odd.where("opens OR closes").withColumn("_tells", F.when(F.col("opens") != F.col("closes"), F.col("opens").cast("int")))
    inside = W.partitionBy("_file", "_block").orderBy("_line")
    lines = _parity(lines, F.col("_tells"), F.col("_tells").isNull().cast("bigint"), inside)
    # The state behind a line: known, or the one before the block changed by _turns.
    edges = lines.groupBy("_file", "_block").agg(
        F.min("_line").alias("_first"), F.min_by("_tells", "_line").alias("_first_tells"), F.max("_line").alias("_end"),
        F.max_by("_state", "_line").alias("_tells"), F.max_by("_turns", "_line").alias("_by"),
    )
    by_block = W.partitionBy("_file").orderBy("_block")
    out = F.coalesce("_state", F.col("_turns") % 2)  # closed at the start of a file
    edges = _parity(edges, F.col("_tells"), F.when(F.col("_tells").isNull(), F.col("_by")).otherwise(0), by_block).withColumn("_out", out)
    edges = edges.withColumn("_in", F.coalesce(F.lag("_out").over(by_block), F.lit(0)))
    first_opens = F.coalesce(F.col("_first_tells"), 1 - F.col("_in")) == 1
    edges = edges.withColumn("_mark", F.struct(F.col("_first").alias("line"), first_opens.alias("opens"))).select(
        "_file", "_block", "_in", F.lead("_mark").over(by_block).alias("_later"),
        F.lag(F.struct(F.col("_end").alias("line"), (F.col("_out") == 1).alias("opens"))).over(by_block).alias("_earlier"),
    )
    lines = lines.join(edges, ["_file", "_block"])
    opens = F.coalesce("_state", (F.col("_in") + F.col("_turns")) % 2) == 1
    lines = lines.withColumn("_mark", F.struct(F.col("_line").alias("line"), opens.alias("opens")))
    lines = lines.withColumn("_next", F.coalesce(F.lead("_mark").over(inside), "_later")).withColumn("_before", F.coalesce(F.lag("_mark").over(inside), "_earlier"))
    pair = F.col("_mark.opens") & ~F.col("_next.opens") & (F.col("_next.line") - F.col("_line") <= max_cell_lines)
    closed = ~F.col("_mark.opens") & F.col("_before.opens") & (F.col("_line") - F.col("_before.line") <= max_cell_lines)
    pair, closed = F.coalesce(pair, F.lit(False)), F.coalesce(closed, F.lit(False))
    last = F.when(pair, F.col("_next.line")).otherwise(F.col("_line"))
    return lines.select("_file", "_block", "_line", last.alias("_last"), (~pair & ~closed).alias("broken")).unionAll(strays)


def _parity(rows: DataFrame, tells: Column, turns: Column, window: WindowSpec) -> DataFrame:
    """Adds _state, 0 or 1, behind each row: what the last row that tells it says, changed by each turn since; null if no row has told it. And _turns, the
    turns of all rows so far."""
    so_far = window.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_turns", F.sum(turns).over(so_far))
    told = F.last(F.when(tells.isNotNull(), F.struct(tells.alias("state"), F.col("_turns").alias("turns"))), True).over(so_far)
    return rows.withColumn("_told", told).withColumn("_state", (F.col("_told.state") + F.col("_turns") - F.col("_told.turns")) % 2).drop("_told")


def _blocks(files: DataFrame, marks: DataFrame) -> DataFrame:
    """(_file, _block, _base, _cell) of all blocks: the lines that only go on a cell which began in an earlier block, and the cell that
    reaches into the block, if one does: its last and first line and the block of that one."""
    goes_on = marks.where("_last > _line")
    added = goes_on.groupBy("_file", "_block").agg(F.sum(F.col("_last") - F.col("_line")).alias("_added"))
    cell = F.struct(F.col("_last").alias("last"), F.col("_line").alias("first"), F.col("_block").alias("home")).alias("_cell")
    over = goes_on.where(_block("_last") > F.col("_block")).select("_file", F.explode(F.sequence(F.col("_block") + 1, _block("_last"))).alias("_into"), cell)
    over = over.withColumnRenamed("_into", "_block")
    earlier = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = files.select("_file", F.explode(F.sequence(F.lit(0).cast("bigint"), _block("_n"))).alias("_block"))
    every = blocks.join(added, ["_file", "_block"], "left").join(over, ["_file", "_block"], "left")
    return every.select("_file", "_block", F.coalesce(F.sum("_added").over(earlier), F.lit(0)).alias("_base"), "_cell")


def _joined_lines(numbered: DataFrame, marks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(_file, row_num, value): the text of each row. The lines of a cell meet in the block in which it begins, where all lines are counted."""
    home = F.when(F.col("_line") <= F.col("_cell.last"), F.col("_cell.home")).otherwise(F.col("_block"))
    lines = numbered.join(blocks, ["_file", "_block"]).select("_file", home.alias("_block"), "_line", F.lit(None).cast("bigint").alias("_last"), "value")
    cells = marks.where("_last > _line").select("_file", "_block", "_line", "_last", F.lit(None).cast("string").alias("value"))
    # A cell stands right before the line that opens it.
    so_far = W.partitionBy("_file", "_block").orderBy("_line", F.col("_last").desc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    cell = F.max(F.when(F.col("_last").isNotNull(), F.struct("_last", "_line"))).over(so_far)
    there = lines.unionAll(cells).withColumn("_cell", cell)
    goes_on = F.col("value").isNotNull() & (F.col("_line") > F.col("_cell._line")) & (F.col("_line") <= F.col("_cell._last"))
    there = there.withColumn("_on", F.coalesce(goes_on, F.lit(False)).cast("bigint")).withColumn("_gone", F.sum("_on").over(so_far)).where("value IS NOT NULL")
    there = there.withColumn("_row", F.col("_line") - F.col("_gone"))
    # Lines of one cell only; a row has at most max_cell_lines of them for each cell.
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_line", "value"))), lambda x: x["value"]), "\n")
    rows = there.groupBy("_file", "_block", "_row").agg(joined.alias("value"))
    return rows.join(blocks.drop("_cell"), ["_file", "_block"]).select("_file", (F.col("_row") - F.col("_base")).alias("row_num"), "value")


def _broken_rows(numbered: DataFrame, marks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(_file, row_num, value) of the rows with a stray quote. Their numbers follow from the marks; only their lines are fetched."""
    earlier = W.partitionBy("_file", "_block").orderBy("_line").rowsBetween(W.unboundedPreceding, -1)
    cell = F.max(F.when(F.col("_last") > F.col("_line"), F.struct(F.col("_last").alias("last"), F.col("_line").alias("first")))).over(earlier)
    seen = marks.withColumn("_within", cell).withColumn("_gone", F.coalesce(F.sum(F.col("_last") - F.col("_line")).over(earlier), F.lit(0)))
    seen = seen.where("broken").join(blocks, ["_file", "_block"])
    seen = seen.withColumn("_within", F.coalesce("_within", F.struct("_cell.last", "_cell.first"))).withColumn("_gone", F.col("_gone") + F.col("_base"))
    within = F.coalesce(F.col("_within.last") >= F.col("_line"), F.lit(False))
    first, last = F.when(within, F.col("_within.first")).otherwise(F.col("_line")), F.when(within, F.col("_within.last")).otherwise(F.col("_line"))
    gone = F.col("_gone") - F.when(within, F.col("_within.last") - F.col("_within.first")).otherwise(0)
    rows = seen.select("_file", first.alias("_first"), last.alias("_end"), (first - gone).alias("row_num")).distinct()
    wanted = staged(rows.select("_file", "row_num", F.explode(F.sequence("_first", "_end")).alias("_line")), "broken")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_line", "value"))), lambda x: x["value"]), "\n")
    return numbered.join(wanted, ["_file", "_line"]).groupBy("_file", "row_num").agg(joined.alias("value"))


def catalog_tables(spark: SparkSession, schema: str | None = None) -> DataFrame:
    """Names of the tables that exist."""
    return spark.sql(f"SHOW TABLES IN `{schema}`" if schema else "SHOW TABLES").select(F.col("tableName").alias("table_name"))
