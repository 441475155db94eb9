"""The record schema: fields, constraints, column mapping and default names.

Everything here is a handful of entries that end up as literals in the plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

CELL_COUNT = 11  # cells that belong to a record; a twelfth may exist, but only as a dedup key
CELLS = [f"c{i}" for i in range(CELL_COUNT)]
ADDRESS = ["sheet_name", "sheet_order", "row_num"]


@dataclass(frozen=True)
class FieldMapping:
    col_order: int
    field: str
    cell_index: int
    description: str


@dataclass(frozen=True)
class Constraint:
    field: str
    not_null: bool = False
    max_len: int | None = None
    is_date: bool = False


# Default column mapping and constraints.
DEFAULT_MAPPING = [
    FieldMapping(1, "collected_at", 0, "日期"),
    FieldMapping(2, "team", 1, "负责人 / 小组"),
    FieldMapping(3, "source", 2, "来源"),
    FieldMapping(4, "company_name", 3, "企业名称"),
    FieldMapping(5, "link", 4, "官网"),
    FieldMapping(6, "industry", 5, "一级分类"),
    FieldMapping(7, "sub_category_2", 6, "二级分类"),
    FieldMapping(8, "sub_category_3", 7, "三级分类"),
    FieldMapping(9, "org_type", 8, "单位类型"),
    FieldMapping(10, "status", 9, "环节"),
    FieldMapping(11, "system_reply", 10, "系统重复"),
]
DEFAULT_CONSTRAINTS = [
    Constraint("collected_at", is_date=True),
    Constraint("team", max_len=50),
    Constraint("source", max_len=200),
    Constraint("company_name", not_null=True, max_len=500),
    Constraint("link", max_len=1000),
    Constraint("industry", not_null=True, max_len=100),
    Constraint("sub_category_2", max_len=100),
    Constraint("sub_category_3", max_len=100),
    Constraint("org_type", max_len=100),
    Constraint("status", max_len=200),
    Constraint("system_reply"),
]
DEFAULT_TABLE_PREFIX = "enterprise_info_"

DATE_FIELD = "collected_at"
DEFAULT_KEY_INDEX = 4  # 1-based cell number of the dedup key: D, the company name
MAX_KEY_INDEX = 12

RAW_ROW_SCHEMA = T.StructType(
    [
        T.StructField("sheet_name", T.StringType(), False),
        T.StructField("sheet_order", T.IntegerType(), False),
        T.StructField("row_num", T.LongType(), False),
        *[T.StructField(c, T.StringType()) for c in CELLS],
    ]
)


def default_table_name(sheet_order: int, prefix: str = DEFAULT_TABLE_PREFIX) -> str:
    return f"{prefix}{sheet_order:03d}"


def column_letter(number: int) -> str:
    """Spreadsheet letters of a 1-based column number: 1 is A, 27 is AA."""
    if number <= 0:
        return ""
    head, last = (number - 1) // 26, (number - 1) % 26
    return column_letter(head) + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[last]


def column_labels(mapping: list[FieldMapping] = DEFAULT_MAPPING) -> dict[str, str]:
    """Field -> label such as 'D列 企业名称'; an empty description falls back to the field name."""
    return {m.field: f"{column_letter(m.cell_index + 1)}列 {m.description or m.field}" for m in mapping}
