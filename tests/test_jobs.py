"""Load, de-duplication and validation jobs, readers and writers, on files."""

import csv
import glob
import os

import pytest
from pyspark.sql import functions as F

from rowgate.operators import gate
from rowgate.operators.reports import REPORT_ORDER
from rowgate.operators.rows import select_sheets
from rowgate.plans import jobs
from rowgate.sources import ledger, readers, sinks, tables

GOOD = {"c0": "2024-01-31", "c1": "t", "c3": "Acme", "c5": "x"}


@pytest.fixture
def wanted(spark):
    rows = [("clean", 1, "t/1"), ("dirty", 2, "t2"), ("empty", 3, "t 3"), ("absent", 4, "t4")]
    return spark.createDataFrame(rows, "sheet_name string, sheet_order int, table_name string")


def load(spark, rows, wanted, tmp, run, present, **more):
    inventory = spark.createDataFrame([(n, i + 1) for i, n in enumerate(present)], "sheet_name string, sheet_order int")
    return jobs.run_load(rows, wanted, f"{tmp}/target", f"{tmp}/ledger", run, run, inventory=inventory, **more)


def history(spark, tmp, run):
    entries = ledger.history(spark, f"{tmp}/ledger").where(f"run_id = '{run}'")
    return {r.table_name: (r.status, r.rows, r.error) for r in entries.collect()}


def stored(spark, tmp):
    rows = tables.read_tables(spark, f"{tmp}/target").collect()
    out = {}
    for r in rows:
        out.setdefault(r.table_name, []).append(r.company_name)
    return {k: sorted(v) for k, v in out.items()}


def test_load_gate_and_overwrite(spark, sheet, wanted, tmp_path):
    first = sheet(*[(s, o, 2, {**GOOD, "c3": f"old {s}"}) for o, s in enumerate(["clean", "dirty", "empty", "absent"])])
    load(spark, first, wanted, tmp_path, "r1", ["clean", "dirty", "empty", "absent"])
    assert stored(spark, tmp_path) == {"t/1": ["old clean"], "t2": ["old dirty"], "t 3": ["old empty"], "t4": ["old absent"]}

    second = sheet(
        ("clean", 1, 2, GOOD), ("clean", 1, 3, {}), ("clean", 1, 4, {**GOOD, "c3": " Beta "}),
        ("dirty", 2, 2, GOOD), ("dirty", 2, 3, {**GOOD, "c3": ""}), ("dirty", 2, 4, {**GOOD, "c0": "soon"}),
    )
    result = load(spark, second, wanted, tmp_path, "r2", ["clean", "dirty", "empty"], report_folder=f"{tmp_path}/reports")
    assert stored(spark, tmp_path) == {"t/1": [" Beta ", "Acme"], "t2": ["old dirty"], "t4": ["old absent"]}
    outcome = {r.table_name: (r.status, r.n_rows, r.n_errors, r.table_error) for r in result.gate.collect()}
    assert outcome == {"t/1": ("success", 2, 0, None), "t2": ("failed", 3, 2, None), "t 3": ("success", 0, 0, None), "t4": ("failed", 0, 0, gate.ABSENT)}
    assert sorted((r.table_name, r.n_rows, r.n_stored, r.diff) for r in result.reconciled.collect()) == [("t 3", 0, 0, 0), ("t/1", 2, 2, 0)]
    totals = gate.load_outcome(result.gate).first()
    assert (totals.n_loaded, totals.n_failed, totals.rows_loaded, totals.error_rows, totals.success, totals.partial) == (2, 2, 2, 2, False, True)
    assert history(spark, tmp_path, "r2") == {"t/1": ("success", 2, ""), "t2": ("failed", 0, ""), "t 3": ("success", 0, ""), "t4": ("failed", 0, gate.ABSENT)}

    reports = f"{tmp_path}/reports/run_id=r2"
    detail = spark.read.parquet(f"{reports}/detail").orderBy("sheet_order", "row_num").collect()
    assert [(r.sheet_name, r.row_num, r.value) for r in detail] == [("dirty", 3, "（空）"), ("dirty", 4, "soon"), ("absent", None, "—")]
    footer = spark.read.parquet(f"{reports}/footer").first()
    assert (footer.n_sheets, footer.n_error_rows) == (2, 3)
    pieces = spark.read.parquet(f"{reports}/report").orderBy(*REPORT_ORDER).collect()
    assert "".join(r.text for r in pieces if r.sheet_name == "dirty").startswith("共 2 行数据存在错误，已扫描整个 Sheet 共 3 行:\n  · ")
    assert [r.text for r in pieces if r.sheet_name == "absent"] == [gate.ABSENT]
    assert tuple(result.totals.first())[:3] == (4, 2, 2)


def test_a_load_can_be_repeated_with_its_run_id(spark, sheet, wanted, tmp_path):
    given = sheet(("clean", 1, 2, GOOD), ("dirty", 2, 2, {}), ("dirty", 2, 3, {**GOOD, "c3": ""}))
    for _ in range(2):
        load(spark, given, wanted.where("sheet_order <= 2"), tmp_path, "r", ["clean", "dirty"], report_folder=f"{tmp_path}/reports")
    assert stored(spark, tmp_path) == {"t/1": ["Acme"]}
    assert spark.read.parquet(f"{tmp_path}/reports/run_id=r/detail").count() == 1
    assert ledger.history(spark, f"{tmp_path}/ledger").count() == 2  # the repeated run replaced its entries


def test_refused_loads(spark, sheet, wanted, tmp_path):
    rows = sheet(("clean", 1, 2, GOOD))
    with pytest.raises(jobs.RefusedRequest, match="no sheet"):
        load(spark, rows, wanted.limit(0), tmp_path, "r", ["clean"])
    with pytest.raises(jobs.RefusedRequest, match="one table: same"):
        load(spark, rows, wanted.withColumn("table_name", F.lit("same")), tmp_path, "r", ["clean"])
    many = spark.createDataFrame([(f"s{i}", i, f"t{i:03d}") for i in range(25)], "sheet_name string, sheet_order int, table_name string")
    with pytest.raises(jobs.RefusedRequest, match="等 25 个") as refused:
        load(spark, rows, many, tmp_path, "r", ["clean"], existing=many.select("table_name").limit(0))
    assert refused.value.rows.count() == 25
    assert not os.path.exists(f"{tmp_path}/target")


def test_emptied_tables_with_odd_names(spark, sheet, tmp_path):
    names = ["表1", "x<y", "a%b c/d", "p=q", "t?*"]
    wanted = spark.createDataFrame([(f"s{i}", i, n) for i, n in enumerate(names)], "sheet_name string, sheet_order int, table_name string")
    sheets = [f"s{i}" for i in range(len(names))]
    load(spark, sheet(*[(s, i, 2, GOOD) for i, s in enumerate(sheets)]), wanted, tmp_path, "r1", sheets)
    assert sorted(stored(spark, tmp_path)) == sorted(names)
    result = load(spark, sheet(("s0", 0, 2, {})), wanted, tmp_path, "r2", sheets)
    assert stored(spark, tmp_path) == {}
    assert {r.status for r in result.gate.collect()} == {"success"} and {r.diff for r in result.reconciled.collect()} == {0}


def test_refused_writes_fail_their_table(spark, sheet, wanted, tmp_path):
    refused = spark.createDataFrame([("clean", 1, 3, "[08S01] gone", "t", "Acme")], "sheet_name string, sheet_order int, row_num bigint, message string, team string, company_name string")
    result = load(spark, sheet(("clean", 1, 2, GOOD), ("clean", 1, 3, GOOD)), wanted.limit(1), tmp_path, "r", ["clean"], writer_errors=refused, report_folder=f"{tmp_path}/reports")
    assert [(r.status, r.n_rows, r.n_errors) for r in result.gate.collect()] == [("failed", 2, 1)]
    assert stored(spark, tmp_path) == {}
    assert spark.read.parquet(f"{tmp_path}/reports/run_id=r/detail").first().problem.startswith("网络连接中断")


def test_tables_that_cannot_be_written_stand_alone(spark, sheet, tmp_path, monkeypatch):
    """Seven tables, two of which fail when they are written: the other five are loaded, and each outcome is its own."""
    names = [f"s{i}" for i in range(7)]
    wanted = spark.createDataFrame([(n, i, f"t{i}") for i, n in enumerate(names)], "sheet_name string, sheet_order int, table_name string")
    load(spark, sheet(*[(n, i, 2, {**GOOD, "c3": f"old {n}"}) for i, n in enumerate(names)]), wanted, tmp_path, "r1", names)
    write, groups = tables.write_version, []

    def failing(rows, *args):
        there = {r.table_name for r in rows.select("table_name").distinct().collect()}
        groups.append(len(there))
        if there & {"t2", "t6"}:
            spark.sql("SELECT raise_error('disk full')").collect()
        return write(rows, *args)

    monkeypatch.setattr(tables, "write_version", failing)
    result = load(spark, sheet(*[(n, i, 2, {**GOOD, "c3": f"new {n}"}) for i, n in enumerate(names)]), wanted, tmp_path, "r2", names)
    assert stored(spark, tmp_path) == {f"t{i}": [f"{'old' if i in (2, 6) else 'new'} s{i}"] for i in range(7)}
    told = {r.table_name: (r.status, "disk full" in (r.table_error or "")) for r in result.gate.collect()}
    assert told == {f"t{i}": ("failed", True) if i in (2, 6) else ("success", False) for i in range(7)}
    assert {t: s for t, (s, _, _) in history(spark, tmp_path, "r2").items()} == {t: s for t, (s, _) in told.items()}
    totals = result.totals.first()
    assert (totals.n_loaded, totals.n_failed, totals.rows_loaded, totals.partial) == (5, 2, 5, True)
    assert groups[0] == 7 and len(groups) <= 1 + 2 * 2 * 3


def test_a_failed_write_is_recorded(spark, sheet, wanted, tmp_path):
    (tmp_path / "target").write_text("a file stands where the tables should go")
    result = load(spark, sheet(("clean", 1, 2, GOOD)), wanted.limit(1), tmp_path, "r", ["clean"])
    (row,) = result.gate.collect()
    assert row.status == "failed" and row.table_error
    assert history(spark, tmp_path, "r") == {"t/1": ("failed", 0, row.table_error)}


def test_stored_rows_that_differ_fail_the_table(spark):
    decided = spark.createDataFrame([("a", "t1", 3, 0, None, "success"), ("b", "t2", 1, 0, None, "success")], "sheet_name string, table_name string, n_rows bigint, n_errors bigint, table_error string, status string")
    counted = spark.createDataFrame([("t1", 3, 4, 1), ("t2", 1, 1, 0)], "table_name string, n_rows bigint, n_stored bigint, diff bigint")
    assert {r.table_name: (r.status, r.table_error) for r in gate.settled(decided, counted).collect()} == {"t1": ("failed", "stored rows differ from scanned rows by 1"), "t2": ("success", None)}


def test_a_load_scans_only_the_wanted_sheets(spark, sheet, wanted, tmp_path):
    sheet(("clean", 1, 2, GOOD), ("other", 9, 2, GOOD)).write.parquet(f"{tmp_path}/rows")
    rows = readers.row_table(spark, f"{tmp_path}/rows")
    picked = select_sheets(rows, ["clean"])
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(sheet_name,clean)" in plan.split("PushedFilters")[1]
    load(spark, rows, wanted.limit(1), tmp_path, "r", ["clean"])
    assert stored(spark, tmp_path) == {"t/1": ["Acme"]}


def test_all_failed_is_partial(spark, sheet, wanted, tmp_path):
    result = load(spark, sheet(("dirty", 2, 2, {**GOOD, "c3": ""})), wanted.where("sheet_name = 'dirty'"), tmp_path, "r", ["dirty"])
    totals = gate.load_outcome(result.gate).first()
    assert (totals.success, totals.partial, totals.n_loaded) == (False, True, 0)


def test_whole_table_errors_fail_the_table(spark, sheet, wanted):
    from rowgate.operators import checks, rows

    broken = spark.createDataFrame([("t/1", "locked")], "table_name string, error string")
    verdicts = checks.with_verdict(rows.to_records(sheet(("clean", 1, 2, GOOD))))
    got = {r.table_name: (r.status, r.table_error) for r in gate.load_gate(wanted, verdicts, None, broken).collect()}
    assert got["t/1"] == ("failed", "locked") and got["t2"] == ("success", None)


def test_missing_target_refuses_the_run(spark, sheet, wanted, tmp_path):
    existing = spark.createDataFrame([("t2",)], "table_name string")
    with pytest.raises(jobs.RefusedRequest, match="t/1、t 3、t4"):
        load(spark, sheet(("clean", 1, 2, GOOD)), wanted, tmp_path, "r", ["clean"], existing=existing)
    assert not os.path.exists(f"{tmp_path}/target")


def test_catalog_tables(spark):
    spark.range(1).createOrReplaceTempView("one_table")
    assert "one_table" in [r.table_name for r in readers.catalog_tables(spark).collect()]


def test_counts_that_disagree(spark):
    a = spark.createDataFrame([("x", 3), ("y", 1)], "sheet_name string, n bigint")
    b = spark.createDataFrame([("x", 3), ("z", 1)], "sheet_name string, n bigint")
    got = {r.sheet_name: (r.n_first, r.n_second, r.agrees) for r in gate.counts_agree(a, b).collect()}
    assert got == {"x": (3, 3, True), "y": (1, 0, False), "z": (0, 1, False)}


def test_the_copy_shuffles_its_cells_once(spark, sheet):
    from rowgate.operators import dedup

    rows = sheet(*[("s", 1, i, {**GOOD, "c3": f"Acme {i % 5}", "c10": "wide"}) for i in range(2, 40)])
    keyed = dedup.keyed_rows(rows)
    gone = dedup.listing_of(keyed).where("action = 'delete'")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        copy = dedup.copy_rows(rows, dedup.numbering(keyed, gone))
        plan = copy._jdf.queryExecution().executedPlan().toString()
        wide = [i for i, line in enumerate(plan.splitlines()) if "Exchange" in line and "c10#" in "".join(plan.splitlines()[i : i + 2])]
        assert len(wide) == 1, plan
        got = sorted((r.old_row_num, r.row_num, r.c10) for r in copy.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == [(i, i, "wide") for i in range(2, 7)]


def test_the_list_is_one_file_in_order(spark, sheet, tmp_path):
    from rowgate.operators import dedup

    rows = sheet(*[("s", 1, i, {**GOOD, "c3": f'A "{i % 700}", x'}) for i in range(2, 3000)])
    listing = dedup.duplicate_list(rows)
    path = sinks.write_duplicate_list(listing, f"{tmp_path}/list.csv")
    assert os.listdir(tmp_path) == ["list.csv"]
    with open(path, "rb") as f:
        content = f.read()
    mark = "\ufeff".encode()
    assert content.startswith(mark) and content.count(mark) == 1 and content.count("处理".encode()) == 1
    with open(path, encoding="utf-8-sig", newline="") as f:
        lines = list(csv.reader(f))[1:]
    want = [(sinks.LIST_ACTIONS[r.action], r.sheet_name, str(r.row_num), r.raw_key, r.raw_time) for r in listing.orderBy(*dedup.LIST_ORDER).collect()]
    assert [tuple(x) for x in lines] == want and len(want) == 2998
    with pytest.raises(FileExistsError):
        sinks.write_duplicate_list(listing, path)
    empty = sinks.write_duplicate_list(listing.limit(0), f"{tmp_path}/empty.csv")
    with open(empty, encoding="utf-8-sig") as f:
        assert f.read().strip() == ",".join(sinks.LIST_COLUMNS)


def test_dedup_job(spark, sheet, tmp_path):
    rows = sheet(("s", 1, 2, {**GOOD, "c0": "2024-01-02"}), ("s", 1, 3, {}), ("s", 1, 4, GOOD | {"c0": "2024-01-01", "c3": 'Ａcme"　'}), ("s", 1, 5, GOOD | {"c0": "2024-01-03", "c3": 'Acme"'}),
                 ("other", 2, 2, {**GOOD, "c0": "2024-01-01"}))
    stats = jobs.run_dedup(rows, f"{tmp_path}/out", sheets=["s"])
    assert sorted((r.sheet_name, r.total, r.kept, r.deleted, r.copied_only) for r in stats.collect()) == [("other", 1, 1, 0, True), ("s", 4, 3, 1, False)]
    kept = spark.read.parquet(f"{tmp_path}/out/rows").orderBy("sheet_order", "row_num").collect()
    assert [(r.sheet_name, r.old_row_num, r.row_num) for r in kept] == [("s", 2, 2), ("s", 3, 3), ("s", 4, 4), ("other", 2, 2)]
    assert sorted(os.listdir(f"{tmp_path}/out")) == ["duplicates.csv", "listing", "rows", "stats"]
    with open(f"{tmp_path}/out/duplicates.csv", encoding="utf-8-sig", newline="") as f:
        lines = list(csv.reader(f))
    assert lines == [["处理", "Sheet名称", "Excel行号", "判重列原始值", "录入时间"], ["保留", "s", "4", 'Ａcme"　', "2024-01-01"], ["删除", "s", "5", 'Acme"', "2024-01-03"]]
    with pytest.raises(Exception, match="exist"):
        jobs.run_dedup(rows, f"{tmp_path}/out")


def test_validation_job(sheet):
    errors, by_sheet = jobs.run_validation(sheet(("a", 1, 2, GOOD), ("b", 2, 2, {"c3": "x"})), sheets=["b"])
    assert [(r.sheet_name, r.field) for r in errors.collect()] == [("b", "industry")]
    assert [(r.sheet_name, r.n_errors) for r in by_sheet.collect()] == [("b", 1)]
    with pytest.raises(jobs.RefusedRequest):
        jobs.run_validation(sheet(("a", 1, 2, GOOD)), sheets=[])


def test_validation_counts_selected_sheets_without_rows(spark, sheet):
    inventory = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "sheet_name string, sheet_order int")
    _, by_sheet = jobs.run_validation(sheet(("a", 1, 2, GOOD)), sheets=["a", "c"], inventory=inventory)
    assert sorted(tuple(r) for r in by_sheet.collect()) == [("a", 1, 1, 0, 0), ("c", 3, 0, 0, 0)]


def write_csv(path, lines):
    with open(path, "w", encoding="utf-8", newline="") as f:
        csv.writer(f, lineterminator="\n").writerow([f"head{i}" for i in range(12)])
        f.writelines(lines)


def test_csv_sheets_keep_positions_over_many_splits(spark, tmp_path):
    n = 3000
    body = [f'2024-01-01,t,"a, ""b""",Co {i},,x,,,,,,k\n' if i % 10 else "\n" for i in range(2, n)]
    write_csv(f"{tmp_path}/big+one 表.csv", body)
    write_csv(f"{tmp_path}/small.csv", ["2024-01-01,only\n"])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = readers.csv_sheets(spark, str(tmp_path), ["small", "big+one 表"])
        assert rows.count() == n - 2 + 1
        got = rows.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    big = {r.row_num: r for r in got if r.sheet_name == "big+one 表"}
    assert sorted(big) == list(range(2, n))
    assert all(r.c3 == (f"Co {i}" if i % 10 else None) for i, r in big.items())
    assert (big[3].c2, big[3].c11, big[3].sheet_order) == ('a, "b"', "k", 2)
    small = [r for r in got if r.sheet_name == "small"]
    assert [(r.row_num, r.sheet_order, r.c1, r.c2) for r in small] == [(2, 1, "only", None)]


def test_csv_cells_with_line_ends(spark, tmp_path):
    body = ['2024-01-01,"a\nb",src\n', "\n", "2024-01-02,c,src\n", '2024-01-03,"say ""x""\n\n, y",src\n', "last,d\n"]
    write_csv(f"{tmp_path}/s.csv", body)
    want = [(2, "a\nb", "src"), (3, None, None), (4, "c", "src"), (5, 'say "x"\n\n, y', "src"), (6, "d", None)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("128m", "20"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = readers.csv_sheets(spark, str(tmp_path), multi_line=True).orderBy("row_num").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert [(r.row_num, r.c1, r.c2) for r in got] == want


STRAY = [
    ('5" pipe,x', "a quote inside a field"), ('"never closed,x', "a cell that is never closed"), ('a,"b" c",d', "quotes at wrong places"),
    ('x,"', "an opened cell, nothing else"), ('y",z', "a closing quote without a cell"),
]


@pytest.mark.parametrize("size", ["128m", "64", "300"])
@pytest.mark.parametrize("stray", [s for s, _ in STRAY])
def test_a_stray_quote_breaks_its_own_line_only(spark, tmp_path, stray, size):
    """Cells of several lines before and behind a broken line; every other row is as it would be without it, one row later."""
    cells = [('2024-01-01,"a\nb",src', ("a\nb", "src")), ("2024-01-02,c,src", ("c", "src")), ('2024-01-03,"say ""x""\n\n, y",src', ('say "x"\n\n, y', "src")),
             ('2024-01-04,"\nlater",u', ("\nlater", "u")), ('2024-01-05,"ends\n",v', ("ends\n", "v")), ("", (None, None)), ('2024-01-06,"one line",w', ("one line", "w"))]
    many = cells * 6
    write_csv(f"{tmp_path}/s.csv", [f"{t}\n" for t, _ in many[:20]] + [stray + "\n"] + [f"{t}\n" for t, _ in many[20:]])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = {r.row_num: (r.c1, r.c2) for r in readers.csv_sheets(spark, str(tmp_path), multi_line=True, max_cell_lines=5).collect()}
        told = [tuple(r) for r in readers.csv_problems(spark, str(tmp_path), max_cell_lines=5).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {i + 2 + (i >= 20): v for i, (_, v) in enumerate(many)}
    assert {n: v for n, v in got.items() if n != 22} == want and 22 in got
    assert told == [("s", 1, 22, stray)]


def test_csv_cells_over_block_borders(spark, tmp_path, monkeypatch):
    """Cells and stray quotes at the borders of blocks of four lines, beside a second file; a sheet's name is not made for each line."""
    monkeypatch.setattr(readers, "BUCKET_ROWS", 4)
    cells = [('1,"a\nb",s', "a\nb"), ('2,"c\n\n\n\n\n\nd",s', "c\n\n\n\n\n\nd"), ('3,"never,s', None), ('4,"e\n5"" p\n"x",y', None), ("5,f,s", "f"), ('6,"\n",s', "\n"), ('y",7', None)] * 3
    write_csv(f"{tmp_path}/s.csv", [f"{t}\n" for t, _ in cells])
    write_csv(f"{tmp_path}/other.csv", ['1,"g\nh",s\n'])
    rows, problems = readers.csv_sheets_and_problems(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "regexp_extract" not in plan
    got = {(r.sheet_name, r.row_num): r.c1 for r in rows.collect()}
    told = sorted((r.row_num, r.line) for r in problems.collect())
    monkeypatch.setattr(readers, "BUCKET_ROWS", 1 << 16)
    rows, problems = readers.csv_sheets_and_problems(spark, str(tmp_path))
    assert got == {(r.sheet_name, r.row_num): r.c1 for r in rows.collect()}
    assert told == sorted((r.row_num, r.line) for r in problems.collect())
    assert got["other", 2] == "g\nh" and [got["s", 2 + i] for i in (0, 1)] == ["a\nb", "c\n\n\n\n\n\nd"]
    assert told == [(n, '3,"never,s') for n in (4, 9, 14)]


def test_inventory_of_files(spark, tmp_path):
    for name in ("b", "a", "only header", "表 1"):
        write_csv(f"{tmp_path}/{name}.csv", ["2024-01-01,x\n"] if name != "only header" else [])
    assert sorted(tuple(r) for r in readers.file_sheets(spark, str(tmp_path)).collect()) == [("a", 1), ("b", 2), ("only header", 3), ("表 1", 4)]
    listed = readers.file_sheets(spark, str(tmp_path), ["表 1", "gone", "b"])
    assert {r.sheet_name: r.sheet_order for r in listed.collect()} == {"表 1": 1, "b": 2, "a": 3, "only header": 4}
    rows = readers.csv_sheets(spark, str(tmp_path), ["b"]).collect()
    assert sorted((r.sheet_name, r.sheet_order) for r in rows) == [("a", 2), ("b", 1), ("表 1", 4)]


def test_header_only_sheet_empties_its_table(spark, sheet, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    write_csv(f"{tmp_path}/in/gone.csv", [])
    write_csv(f"{tmp_path}/in/here.csv", ["2024-01-31,t,,Acme,,x\n"])
    wanted = spark.createDataFrame([("gone", 1, "t1"), ("here", 2, "t2")], "sheet_name string, sheet_order int, table_name string")
    load(spark, sheet(("gone", 1, 2, GOOD), ("here", 2, 2, GOOD)), wanted, tmp_path, "r1", ["gone", "here"])
    inventory = readers.file_sheets(spark, f"{tmp_path}/in")
    result = jobs.run_load(readers.csv_sheets(spark, f"{tmp_path}/in"), wanted, f"{tmp_path}/target", f"{tmp_path}/ledger", "r2", "r2", inventory=inventory)
    assert {r.table_name: r.status for r in result.gate.collect()} == {"t1": "success", "t2": "success"}
    assert stored(spark, tmp_path) == {"t2": ["Acme"]}


def test_parquet_sheets(spark, tmp_path):
    df = spark.range(500).select(F.col("id").cast("string").alias("c0"), F.lit("x").alias("c3")).coalesce(1)
    df.write.parquet(f"{tmp_path}/in")
    (part,) = glob.glob(f"{tmp_path}/in/part-*.parquet")
    os.makedirs(f"{tmp_path}/sheets")
    with open(part, "rb") as src, open(f"{tmp_path}/sheets/表 1.parquet", "wb") as dst:
        dst.write(src.read())
    got = readers.parquet_sheets(spark, f"{tmp_path}/sheets").orderBy("row_num").collect()
    assert [(r.sheet_name, r.sheet_order, r.row_num, r.c0) for r in got] == [("表 1", 1, i + 2, str(i)) for i in range(500)]


def test_row_table(spark, sheet, tmp_path):
    sheet(("s", 1, 2, GOOD)).write.parquet(f"{tmp_path}/rows")
    assert readers.row_table(spark, f"{tmp_path}/rows").first().c3 == "Acme"
    spark.range(1).write.parquet(f"{tmp_path}/bad")
    with pytest.raises(ValueError, match="sheet_name"):
        readers.row_table(spark, f"{tmp_path}/bad")
    few = spark.createDataFrame([("s", 1, 2, "2024-01-31"), ("s", 1, 3, "x")], "sheet_name string, sheet_order int, row_num int, c0 string")
    few.write.parquet(f"{tmp_path}/few")
    assert readers.row_table(spark, f"{tmp_path}/few").first().c10 is None
    few.unionAll(few).write.parquet(f"{tmp_path}/twice")
    with pytest.raises(ValueError, match="repeated"):
        readers.row_table(spark, f"{tmp_path}/twice")


def test_results_are_never_replaced(spark, tmp_path):
    for file_format in ("parquet", "csv"):
        sinks.write_new(spark.range(3), f"{tmp_path}/{file_format}", file_format)
        with pytest.raises(Exception, match="exist"):
            sinks.write_new(spark.range(3), f"{tmp_path}/{file_format}", file_format)
