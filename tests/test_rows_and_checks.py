"""Row projection, load verdict and full validation on small sheets."""

from datetime import date

from pyspark.sql import functions as F

from rowgate.functions.schema import Constraint, FieldMapping
from rowgate.operators import checks, rows

GOOD = {"c0": "2024-01-31", "c1": "t", "c3": "Acme", "c5": "x"}


def records(sheet, *cells):
    return rows.to_records(sheet(*[("s", 1, i + 2, c) for i, c in enumerate(cells)]))


def verdicts(df):
    return [r.kind for r in checks.with_verdict(df).orderBy("row_num").collect()]


def errors(df):
    return {r.row_num: r for r in checks.load_errors(df).collect()}


def findings(df):
    found = checks.validation_errors(df).orderBy("row_num", "check_pos").collect()
    return [(r.row_num, r.field, r.reason, r.value, r.message) for r in found]


def test_blank_rows_go_and_numbers_stay(sheet):
    df = sheet(("s", 1, 2, GOOD), ("s", 1, 3, {"c0": " ", "c3": "　", "c10": " \t"}), ("s", 1, 4, {}), ("s", 1, 5, {"c10": "x"}), ("s", 1, 6, {"c0": "0"}))
    assert [r.row_num for r in rows.nonblank_rows(df).orderBy("row_num").collect()] == [2, 5, 6]


def test_twelfth_cell_does_not_fill_a_row(sheet):
    df = sheet(("s", 1, 2, {})).withColumn("c11", F.lit("x"))
    assert rows.nonblank_rows(df).count() == 0


def test_projection(sheet):
    got = records(sheet, {"c0": "２０２４/1/5", "c3": " A "}, {"c0": "soon"}, {"c0": " "}).orderBy("row_num").collect()
    assert [r.collected_at for r in got] == [date(2024, 1, 5), None, None]
    assert [r.collected_at_raw for r in got] == ["２０２４/1/5", "soon", " "]
    assert [(r.company_name, r.team, r.system_reply) for r in got] == [(" A ", "", ""), ("", "", ""), ("", "", "")]


def test_custom_mapping(sheet):
    mapping = [FieldMapping(2, "company_name", 0, "n"), FieldMapping(1, "far", 40, "")]
    got = rows.to_records(sheet(("s", 1, 2, {"c0": "Acme"})), mapping)
    assert got.columns == ["sheet_name", "sheet_order", "row_num", "far", "company_name"]
    assert got.first()[3:] == ("", "Acme")


def test_selection(sheet):
    df = sheet(("a", 1, 2, GOOD), ("b", 2, 2, GOOD))
    assert [r.sheet_name for r in rows.select_sheets(df, ["b", "zzz"]).collect()] == ["b"]
    assert rows.select_sheets(df, None).count() == 2
    assert sorted(tuple(r) for r in rows.sheet_inventory(df).collect()) == [("a", 1), ("b", 2)]


def test_first_kind_wins_at_load_and_all_are_found_in_validation(sheet):
    df = records(sheet, {"c0": "soon", "c1": "t" * 51, "c3": "Acme", "c5": " "}, {**GOOD, "c0": "soon", "c1": "t" * 51}, {**GOOD, "c1": "t" * 51}, GOOD)
    assert verdicts(df) == ["null", "date", "length", None]
    assert [f[:3] for f in findings(df)] == [
        (2, "collected_at", "DATE"), (2, "team", "LENGTH"), (2, "industry", "NOT NULL"),
        (3, "collected_at", "DATE"), (3, "team", "LENGTH"), (4, "team", "LENGTH")]


def test_messages_and_fields(sheet):
    df = records(sheet, {"c0": "2024-01-31", "c3": "", "c5": "　"}, {**GOOD, "c0": "x" * 61}, {**GOOD, "c1": "t" * 51, "c9": "s" * 201})
    got = errors(df)
    assert got[2].message == "字段 [company_name, industry] 不能为空 (NOT NULL 约束)"
    assert [tuple(f) for f in got[2].fields] == [("D列 企业名称", "（空）"), ("F列 一级分类", "（空）")]
    assert got[3].message == f"字段 [collected_at] 第 3 行 值 '{'x' * 60}…' 不是有效日期（应形如 2024-01-31）"
    assert [tuple(f) for f in got[3].fields] == [("A列 日期", "x" * 60 + "…")]
    assert got[4].message == "字段 [team] 值长度 51 超过限制 50、字段 [status] 值长度 201 超过限制 200"
    assert [tuple(f) for f in got[4].fields] == [("B列 负责人 / 小组", "t" * 51), ("J列 环节", "s" * 60 + "…")]
    assert (got[4].team, got[4].company_name) == ("t" * 51, "Acme")


def test_validation_messages(sheet):
    df = records(sheet, {"c0": "soon", "c3": "　", "c5": "i" * 101})
    assert findings(df) == [
        (2, "collected_at", "DATE", "soon", "字段 [collected_at] 无法解析为日期"),
        (2, "company_name", "NOT NULL", "　", "字段 [company_name] 不能为空 (NOT NULL 约束)"),
        (2, "industry", "LENGTH", "i" * 60 + "…", "字段 [industry] 值长度 101 超过限制 100")]


def test_lengths_are_untrimmed_code_points(sheet):
    df = records(sheet, {**GOOD, "c1": "t" * 50}, {**GOOD, "c1": "t" * 50 + " "}, {**GOOD, "c1": "𠮷" * 50}, {**GOOD, "c1": "𠮷" * 51}, {**GOOD, "c10": "z" * 9000})
    assert verdicts(df) == [None, "length", None, "length", None]


def test_blank_and_missing_dates_are_no_errors(sheet):
    assert verdicts(records(sheet, {**GOOD, "c0": None}, {**GOOD, "c0": "　"})) == [None, None]


def test_numeric_dates(sheet):
    raw = sheet(("s", 1, 2, {**GOOD, "c0": "45322"}), ("s", 1, 3, {**GOOD, "c0": None})).withColumn("c0_is_numeric", F.lit(True))
    df = rows.to_records(raw)
    assert verdicts(df) == ["date", None]
    assert findings(df) == []
    assert errors(df)[2].message.endswith("值 '45322' 不是有效日期（应形如 2024-01-31）（日期列应为文本格式，请勿使用数值/常规格式）")


def test_clean_rows_and_own_constraints(sheet):
    df = records(sheet, GOOD, {**GOOD, "c3": ""})
    assert [r.row_num for r in checks.clean_rows(df).collect()] == [2]
    none = [Constraint("collected_at", is_date=True)]
    assert verdicts(df.transform(lambda d: d)) == [None, "null"]
    assert checks.clean_rows(df, none).count() == 2


def test_counts_per_sheet(sheet):
    df = rows.to_records(sheet(("a", 1, 2, GOOD), ("a", 1, 3, {"c0": "soon"}), ("b", 2, 2, GOOD)))
    by_sheet = checks.validation_by_sheet(df, checks.validation_errors(df))
    assert sorted(tuple(r) for r in by_sheet.collect()) == [("a", 1, 2, 3, 1), ("b", 2, 1, 0, 0)]
    assert tuple(checks.validation_totals(by_sheet).first()) == (2, 3, 3, False)
    assert tuple(checks.validation_totals(by_sheet.where("sheet_name = 'b'")).first()) == (1, 1, 0, True)
    assert tuple(checks.validation_totals(by_sheet.where("false")).first()) == (0, 0, 0, True)


def test_fields_without_a_mapping_are_missing(sheet):
    mapping = [FieldMapping(1, "company_name", 3, "n"), FieldMapping(2, "status", 9, "")]
    df = rows.to_records(sheet(("s", 1, 2, GOOD), ("s", 1, 3, {**GOOD, "c9": "s" * 201})), mapping)
    assert verdicts(df) == ["null", "null"]
    got = checks.load_errors(df, mapping=mapping).orderBy("row_num").collect()
    assert got[0].message == "字段 [industry] 不能为空 (NOT NULL 约束)"
    assert [tuple(f) for f in got[0].fields] == [("industry", "（空）")]
    assert (got[0].team, got[0].company_name) == (None, "Acme")
    assert [f[:3] for f in findings(df)] == [(2, "industry", "NOT NULL"), (3, "industry", "NOT NULL"), (3, "status", "LENGTH")]
    checked = checks.checked_rows(df, mapping=mapping)
    assert checks.found_errors(checked).count() == 2
