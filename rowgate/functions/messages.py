"""Texts of checks and reports, and the translation of writer errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowgate.functions.text import SHOWN_CHARS, first_line, strip

# Texts of findings and reports.
JOINER = "、"
PROBLEM_JOINER = "；"
RANGE_JOINER = ", "
UNKNOWN_ERROR = "未知错误"
NUMERIC_DATE_HINT = "（日期列应为文本格式，请勿使用数值/常规格式）"
NOT_NULL_TEXT = ("字段 [", "] 不能为空 (NOT NULL 约束)")
LENGTH_TEXT = ("字段 [", "] 值长度 ", " 超过限制 ")
LOAD_DATE_TEXT = ("字段 [", "] 第 ", " 行 值 '", "' 不是有效日期（应形如 2024-01-31）")
VALIDATION_DATE_TEXT = ("字段 [", "] 无法解析为日期")
ROWS_TEXT = ("第 ", " 行")
SCANNED_TEXT = ("，已扫描整个 Sheet 共 ", " 行")
LOAD_HEAD_TEXT = ("共 ", " 行数据存在错误")
VALIDATION_HEAD_TEXT = ("验证完成，Sheet [", "] 共 ", " 行数据存在错误")
LOAD_TITLE_TEXT = ("  · ", "：", " 行")
VALIDATION_TITLE_TEXT = ("\n■ 错误类型（", " 行）: ")
LOAD_ROWS_INDENT, VALIDATION_ROWS_INDENT = "    出错行: ", "  出错行: "
RUN_ERROR_TEXT = (" 张表导入失败：",)
PROBLEM_TEXT = {
    "null": "必填字段为空，请补填",
    "date": "日期格式无法识别（应形如 2024-01-31）",
    "length": "字段值超长，请缩短后重试",
}
REASON_LABEL = {
    "NOT NULL": "空值(必填)",
    "LENGTH": "超长",
    "DATE": "日期非法",
    "TYPE": "类型不符",
}
# Part of a writer error (lower case) -> text shown instead; the first match wins.
WRITER_ERROR_TEXT = [
    ("im002", "未安装数据库驱动：这台电脑缺少 SQL Server ODBC 驱动（需 64 位，ODBC Driver 17 或 18）。请到微软官网下载安装后再点一次「测试连接」——与网络、账号密码无关。"),
    ("22018", "数据格式错误：某个「日期/数字」字段里包含了非法字符（例如本该填日期的列被填成了人名或文字）。请先运行「验证数据」定位具体行。"),
    ("invalid character value for cast specification", "数据类型转换失败：字段值与目标列类型不匹配（常见于日期/数字列被填了文字）。请先运行「验证数据」定位具体行。"),
    ("string or binary data would be truncated", "数据过长：某个字段的值超出了数据库列的长度限制。请检查超长文本字段。"),
    ("right truncation", "数据过长：某个字段的值超出了数据库列的长度限制。请检查超长文本字段。"),
    ("将截断", "数据过长：某个字段的值超出了数据库列的长度限制。请检查超长文本字段。"),
    ("cannot insert the value null into column", "必填字段为空：有列被写入了 NULL，但该列不允许为空。请先运行「验证数据」检查空值。"),
    ("hy000", "数据库驱动错误：请确认 SQL Server ODBC 驱动已正确安装且连接参数正确。"),
    ("hy104", "数据库参数错误，请检查连接配置。"),
    ("08s01", "网络连接中断，请确认数据库服务器可达后重试。"),
    ("hy010", "连接状态异常（函数序列错误），请关闭后重新连接再试。"),
    ("ssl provider", "加密握手失败：数据库服务器证书不被信任。请改装 ODBC Driver 17 后重试，或联系数智组。"),
]


def humanize(message: Column) -> Column:
    """Writer error in plain words; messages without a known pattern stay as they are."""
    lowered = F.lower(message)
    chosen = None
    for part, text in WRITER_ERROR_TEXT:
        hit = lowered.contains(part)
        chosen = F.when(hit, F.lit(text)) if chosen is None else chosen.when(hit, F.lit(text))
    return chosen.otherwise(message)


def problem_text(kind: Column, message: Column) -> Column:
    """Short problem of a load error, by kind; other kinds show the first line of the message."""
    line = F.substring(strip(first_line(humanize(message))), 1, SHOWN_CHARS)
    chosen = None
    for name, text in PROBLEM_TEXT.items():
        chosen = F.when(kind == name, F.lit(text)) if chosen is None else chosen.when(kind == name, F.lit(text))
    return chosen.otherwise(F.coalesce(line, F.lit(UNKNOWN_ERROR)))


def reason_label(reason: Column) -> Column:
    chosen = None
    for code, label in REASON_LABEL.items():
        chosen = F.when(reason == code, F.lit(label)) if chosen is None else chosen.when(reason == code, F.lit(label))
    return chosen.otherwise(reason)
