"""Error groups, islands, summary and detail against plain Python."""

import random

from rowgate.operators import reports

ERRORS = "sheet_name string, sheet_order int, row_num bigint, kind string, message string, fields array<struct<label:string,value:string>>, team string, company_name string"
FINDINGS = "sheet_name string, sheet_order int, row_num bigint, check_pos int, field string, value string, reason string, message string"


def error(sheet, num, kind, message="m", fields=(("D列 企业名称", "v"),), team="t", company="Acme"):
    return (sheet, 1, num, kind, message, list(fields), team, company)


def ranges(numbers):
    have = set(numbers)
    pairs = zip(sorted(n for n in have if n - 1 not in have), sorted(n for n in have if n + 1 not in have))
    return [f"{a}" if a == b else f"{a}-{b}" for a, b in pairs]


def test_error_groups(spark):
    rng = random.Random(5)
    rows = [error("s", n, "null", rng.choice(["one", "two"])) for n in rng.sample(range(2, 200), 120)]
    found = reports.error_ranges(spark.createDataFrame(rows, ERRORS), bucket_rows=8)
    for r in reports.error_groups(found).collect():
        numbers = [e[2] for e in rows if e[4] == r.message]
        assert (r.n_errors, r.first_row) == (len(numbers), min(numbers))
        shown = found.where(f"message = '{r.message}'").orderBy("range_start").collect()
        assert [f"{x.range_start}" if x.range_start == x.range_end else f"{x.range_start}-{x.range_end}" for x in shown] == ranges(numbers)
        assert sum(x.n_errors for x in shown) == len(numbers)


def read_report(pieces):
    return "".join(r.text for r in pieces.orderBy(*reports.REPORT_ORDER).collect())


def test_reports_read_as_one_text(spark):
    df = spark.createDataFrame([error("s", 5, "null", "one"), error("s", 6, "null", "one"), error("s", 9, "null", "one"), error("s", 3, "null", "two")], ERRORS)
    counts = spark.createDataFrame([("s", 1, 10, 4), ("ok", 2, 4, 0)], "sheet_name string, sheet_order int, n_rows bigint, n_errors bigint")
    found = reports.error_ranges(df)
    assert read_report(reports.report_pieces(counts, found, "load")) == (
        "共 4 行数据存在错误，已扫描整个 Sheet 共 10 行:\n  · two：1 行\n    出错行: 第 3 行\n  · one：3 行\n    出错行: 第 5-6 行, 第 9 行")
    assert read_report(reports.report_pieces(counts, found, "validation")) == (
        "验证完成，Sheet [s] 共 4 行数据存在错误，已扫描整个 Sheet 共 10 行:\n\n■ 错误类型（1 行）: two\n  出错行: 第 3 行"
        "\n\n■ 错误类型（3 行）: one\n  出错行: 第 5-6 行, 第 9 行")


def test_titles_do_not_depend_on_the_row_number(spark):
    far = 1 << 41
    df = spark.createDataFrame([error("s", far + n, "null", m) for n, m in ((0, "x"), (1, "x"), (40, "y"))], ERRORS)
    counts = spark.createDataFrame([("s", 1, 0, 3)], "sheet_name string, sheet_order int, n_rows bigint, n_errors bigint")
    text = read_report(reports.report_pieces(counts, reports.error_ranges(df), "load"))
    assert text == f"共 3 行数据存在错误:\n  · x：2 行\n    出错行: 第 {far}-{far + 1} 行\n  · y：1 行\n    出错行: 第 {far + 40} 行"


def test_failed_table_without_row_errors_shows_its_error(spark):
    counts = spark.createDataFrame([("s", 1, 5, 0, "table is locked"), ("ok", 2, 5, 0, None)], "sheet_name string, sheet_order int, n_rows bigint, n_errors bigint, table_error string")
    pieces = reports.report_pieces(counts, reports.error_ranges(spark.createDataFrame([], ERRORS)), "load")
    assert read_report(pieces) == "table is locked"


def capped(lines):
    return "\n".join(lines) if len(lines) <= 12 else "\n".join(lines[:12]) + f"\n…(还有 {len(lines) - 12} 条未显示)"


def test_error_islands(spark):
    rng = random.Random(9)
    rows = []
    for n in [*range(10, 40), *rng.sample(range(41, 120), 40)]:
        for pos in sorted(rng.sample(range(5), rng.randint(1, 3))):
            rows.append(("s", 1, n, pos, f"f{pos}", rng.choice(["v", "a\nb", ""]), rng.choice(["LENGTH", "DATE"]) if n % 7 else "NOT NULL", "m"))
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, FINDINGS)
    labels = {"LENGTH": "超长", "DATE": "日期非法", "NOT NULL": "空值(必填)"}
    want = {}
    for text in ranges(r[2] for r in rows):
        a, b = int(text.split("-")[0]), int(text.split("-")[-1])
        part = sorted(r for r in rows if a <= r[2] <= b)
        values = "\n".join(r[5] for r in part).split("\n")
        want[text] = (len(part), capped([r[4] for r in part]), capped(values), capped([labels[r[6]] for r in part]), {r[6] for r in part})
    for buckets in (4, 1 << 16):
        got = {r.row_text: (r.n_errors, r.fields, r.shown_values, r.reasons) for r in reports.error_islands(df, bucket_rows=buckets).collect()}
        assert got == {k: v[:4] for k, v in want.items()}
        only = {r.row_text for r in reports.error_islands(df, "NOT NULL", bucket_rows=buckets).collect()}
        assert only == {k for k, v in want.items() if "NOT NULL" in v[4]}
        assert 0 < len(only) < len(want)


def all_errors(spark):
    rows = [
        error("s", 4, "null", fields=[("D列 企业名称", "（空）"), ("F列 一级分类", "（空）")]),
        error("s", 5, "date", team=" t "),
        error("s", 5, "db", "[HY000] driver", fields=[], company=" "),
        error("s", 9, "db", " \nodd thing\nmore", fields=[], team="　", company=" Acme "),
        error("s", 2, "null", team="u"),
    ]
    failed = spark.createDataFrame([("s", 1, 5, "ignored"), ("silent", 2, 0, "\n  locked\nx"), ("mute", 3, 0, None)], "sheet_name string, sheet_order int, n_errors bigint, error string")
    return reports.with_tableless_errors(spark.createDataFrame(rows, ERRORS), failed)


def test_error_detail(spark):
    got = reports.error_detail(all_errors(spark)).orderBy("sheet_order", "row_num", "problem", "field_pos").collect()
    driver = "数据库驱动错误：请确认 SQL Server ODBC 驱动已正确安装且连接参数正确。"
    assert [(r.sheet_name, r.row_num, r.label, r.value, r.problem, r.owner) for r in got] == [
        ("s", 2, "D列 企业名称", "v", "必填字段为空，请补填", "u"),
        ("s", 4, "D列 企业名称", "（空）", "必填字段为空，请补填", "t"),
        ("s", 4, "F列 一级分类", "（空）", "必填字段为空，请补填", "t"),
        ("s", 5, "—", "—", driver, "t"),
        ("s", 5, "D列 企业名称", "v", "日期格式无法识别（应形如 2024-01-31）", "t"),
        ("s", 9, "—", "Acme", "odd thing", "（未填负责人）"),
        ("silent", None, "—", "—", "locked", "（未填负责人）"),
        ("mute", None, "—", "—", "未知错误", "（未填负责人）"),
    ]


def listed(errors, part):
    """Texts of the summary by owner and sheet, read in order."""
    items = reports.summary_items(errors, reports.summary_ranges(errors, bucket_rows=16)).where(f"part = '{part}'").orderBy(*reports.SUMMARY_ORDER)
    out = {}
    for r in items.collect():
        out[r.owner, r.sheet_name] = out.get((r.owner, r.sheet_name), "") + r.text
    return out


def test_error_summary(spark):
    errors = all_errors(spark)
    summary = reports.error_summary(reports.summary_ranges(errors))
    driver = "数据库驱动错误：请确认 SQL Server ODBC 驱动已正确安装且连接参数正确。"
    none = "（未填负责人）"
    assert {(r.owner, r.sheet_name): (r.n_error_rows, r.first_row) for r in summary.collect()} == {
        ("t", "s"): (2, 4), ("u", "s"): (1, 2), (none, "s"): (1, 9), (none, "silent"): (1, 0), (none, "mute"): (1, 0)}
    assert listed(errors, "rows") == {("t", "s"): "4-5", ("u", "s"): "2", (none, "s"): "9"}
    assert listed(errors, "problems") == {
        ("t", "s"): f"必填字段为空，请补填；{driver}；日期格式无法识别（应形如 2024-01-31）", ("u", "s"): "必填字段为空，请补填",
        (none, "s"): "odd thing", (none, "silent"): "locked", (none, "mute"): "未知错误"}
    assert tuple(reports.summary_footer(summary).first()) == (3, 6)


def test_long_summary_has_every_row_and_problem(spark):
    numbers = list(range(2, 400, 2))
    df = spark.createDataFrame([error("s", n, "db", f"p{n}", fields=[]) for n in numbers], ERRORS)
    assert listed(df, "rows")["t", "s"] == "、".join(str(n) for n in numbers)
    assert listed(df, "problems")["t", "s"] == "；".join(f"p{n}" for n in numbers)
