"""Writers: the duplicate list and results that are never replaced. Tables are written by tables.py, the ledger by ledger.py."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgate.operators.dedup import LIST_ORDER
from rowgate.session import remove_folder
from rowgate.sources.files import Folder

# Column names and action names of the duplicate list. The byte order mark makes
# spreadsheet programs read the file as UTF-8.
BYTE_ORDER_MARK = "﻿"
LIST_COLUMNS = ["处理", "Sheet名称", "Excel行号", "判重列原始值", "录入时间"]
LIST_ACTIONS = {"keep": "保留", "delete": "删除"}


def write_duplicate_list(listing: DataFrame, path: str) -> str:
    """One CSV file in listing order, with one byte order mark and one header; refuses to replace an existing one. Returns what to read.

    The list is sorted by range into parts without a header, so no task holds it; the file system then joins them behind the header. Where it cannot,
    the result is a folder whose files, read by name, are the same text."""
    spark = listing.sparkSession
    name, parts = path.rsplit("/", 1)[-1], Folder(spark, f"{path}-parts-{uuid.uuid4().hex}")
    if parts.fs.exists(Folder(spark, path).path()):
        raise FileExistsError(f"{path} exists already")
    action = F.when(F.col("action") == "keep", LIST_ACTIONS["keep"]).otherwise(LIST_ACTIONS["delete"])
    columns = [action, F.col("sheet_name"), F.col("row_num"), F.col("raw_key"), F.col("raw_time")]
    (
        listing.orderBy(*LIST_ORDER)
        .select(*[c.alias(n) for c, n in zip(columns, LIST_COLUMNS, strict=True)])
        .write.option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(parts.folder)
    )
    head = f"part--{name}"  # before all others by name
    parts.write(head, (BYTE_ORDER_MARK + ",".join(LIST_COLUMNS) + "\n").encode())
    joined = parts.join(head, [n for n in parts.sizes() if n.startswith("part-") and n != head])
    whole = parts.path(head) if joined else parts.path()
    if not parts.fs.rename(whole, Folder(spark, path).path()):
        raise OSError(f"{path} could not be written")
    if joined:
        remove_folder(spark, parts.folder)
    return path


def write_new(df: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Writes a result; never replaces an earlier one."""
    writer = df.write.mode("errorifexists")
    (writer.option("header", True).csv(path) if file_format == "csv" else writer.format(file_format).save(path))


def write_and_read(df: DataFrame, path: str) -> DataFrame:
    """Writes a result that several later results are made from, and returns the written rows."""
    write_new(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
