"""De-duplication against a reader that goes down the sheets row by row."""

import random

import pytest
from pyspark.sql import functions as F

from rowgate.operators import dedup
from rowgate.operators.rows import sheet_inventory


def day(n):
    return f"2024-01-{n:02d}"


def row(name, order, num, key, n):
    return (name, order, num, {"c0": day(n) if isinstance(n, int) else n, "c3": key})


def taking_part(rows, selected):
    """(position, key, day) of the rows that have a key and a day."""
    for name, order, num, cells in rows:
        key, text = (cells["c3"] or "").strip(), cells["c0"] or ""
        if key and text.startswith("2024-") and (selected is None or name in selected):
            yield (order, name, num), key, text


def expected_list(rows, mode, selected=None):
    """[(keeper, losers in the order in which they go)], groups by first occurrence. From the definition: a row that was earlier
    than all before it goes when the next such row comes, any other row goes at its own place."""
    groups = {}
    for place, key, day in sorted(taking_part(rows, selected)):
        groups.setdefault((place[1], key) if mode == dedup.SHEET else key, []).append((place, day))
    out = []
    for members in groups.values():
        if len(members) == 1:
            continue
        best = [i for i, (_, d) in enumerate(members) if all(d < e for _, e in members[:i])]
        goes = {i: next((members[j][0] for j in best if j > i), None) if i in best else members[i][0] for i in range(len(members))}
        lost = sorted((i for i in goes if goes[i]), key=lambda i: (goes[i], i not in best))
        out.append((members[best[-1]][0][1:], [members[i][0][1:] for i in lost]))
    return out


def listed(df, rows, mode, selected=None):
    out = []
    for r in dedup.duplicate_list(df, mode, sheets=selected).orderBy(*dedup.LIST_ORDER).collect():
        if r.action == "keep":
            out.append(((r.sheet_name, r.row_num), []))
        else:
            out[-1][1].append((r.sheet_name, r.row_num))
    return out


@pytest.mark.parametrize("mode", [dedup.GLOBAL, dedup.SHEET])
@pytest.mark.parametrize("selected", [None, ["s3", "s1"]])
def test_random_sheets(spark, sheet, mode, selected):
    rng = random.Random(11)
    rows = [
        row(f"s{s}", s, n, rng.choice(["A", "B", "C", " A", "hot", "hot", "hot", "", None, f"u{n}"]), rng.choice([*range(1, 12), "soon", None]))
        for s in (1, 2, 3) for n in range(2, 120)
    ]
    rng.shuffle(rows)
    df = sheet(*rows)
    want = expected_list(rows, mode, selected)
    assert any(dropped != sorted(dropped) for _, dropped in want)
    assert listed(df, rows, mode, selected) == want
    gone = {d for _, dropped in want for d in dropped}
    everything = {(r[0], r[2]) for r in rows}
    kept = dedup.kept_rows(df, mode, sheets=selected)
    assert {(r.sheet_name, r.row_num) for r in kept.collect()} == everything - gone
    assert kept.columns == df.columns
    losers = dedup.losers(df, mode, sheets=selected)
    assert {(r.sheet_name, r.row_num) for r in losers.collect()} == gone
    assert {(r.sheet_name, r.row_num) for r in dedup.remove_rows(df, losers).collect()} == everything - gone
    for r in dedup.dedup_stats(df, mode, sheets=selected).collect():
        total = sum(n == r.sheet_name for n, _ in everything)
        assert (r.total, r.deleted) == (total, sum(n == r.sheet_name for n, _ in gone))
        assert r.kept + r.deleted == r.total
        assert r.copied_only == (selected is not None and r.sheet_name not in selected)
    keepers = dedup.keepers(df, mode, sheets=selected).where("n_rows > 1").collect()
    assert {(f"s{r.keep_sheet_order}", r.keep_row_num) for r in keepers} == {k for k, _ in want}


def test_order_in_which_rows_are_dropped(sheet):
    rows = [row("s", 1, 2, "A", 3), row("s", 1, 3, "A", 4), row("s", 1, 4, "A", 1)]
    assert listed(sheet(*rows), rows, dedup.GLOBAL) == [(("s", 4), [("s", 3), ("s", 2)])]
    assert expected_list(rows, dedup.GLOBAL) == [(("s", 4), [("s", 3), ("s", 2)])]


def test_ties_go_to_the_first_sheet_then_row(sheet):
    df = sheet(row("late", 2, 2, "A", 1), row("early", 1, 9, "A", 1), row("early", 1, 8, "A", 1))
    assert [(r.sheet_name, r.row_num) for r in dedup.kept_rows(df).collect()] == [("early", 8)]
    kept = dedup.kept_rows(df, sheets=["late", "early"]).collect()
    assert [(r.sheet_name, r.row_num) for r in kept] == [("early", 8)]


def test_keys_are_folded_but_keep_case_and_signs(sheet):
    df = sheet(row("s", 1, 2, "Ａcme　", 2), row("s", 1, 3, " Acme", 1), row("s", 1, 4, "acme", 1), row("s", 1, 5, "㈱A", 1), row("s", 1, 6, "(株)A", 1))
    assert sorted(r.row_num for r in dedup.kept_rows(df).collect()) == [3, 4, 5, 6]


def test_rows_without_key_or_date_stay(sheet):
    df = sheet(row("s", 1, 2, "　", 1), row("s", 1, 3, "　", 1), row("s", 1, 4, "A", "soon"), row("s", 1, 5, "A", "soon"), row("s", 1, 6, "A", 1))
    assert dedup.kept_rows(df).count() == 5
    assert dedup.duplicate_list(df).count() == 0
    number = df.withColumn("c0_is_numeric", F.lit(True))
    assert dedup.with_key(number).where("eligible").count() == 0


def test_other_key_cells(sheet):
    df = sheet(row("s", 1, 2, "A", 2), row("s", 1, 3, "B", 1)).withColumn("c11", F.lit("same"))
    assert [r.row_num for r in dedup.kept_rows(df, key_index=12).collect()] == [3]
    assert dedup.kept_rows(df.drop("c11"), key_index=12).count() == 2
    with pytest.raises(ValueError):
        dedup.kept_rows(df, key_index=13)
    with pytest.raises(ValueError):
        dedup.kept_rows(df, mode="other")


def test_stats_of_sheets_without_rows(spark, sheet):
    df = sheet(row("a", 1, 2, "A", 1))
    inventory = sheet_inventory(df).unionByName(spark.createDataFrame([("empty", 2)], "sheet_name string, sheet_order int"))
    got = {r.sheet_name: (r.total, r.kept, r.deleted) for r in dedup.dedup_stats(df, inventory=inventory).collect()}
    assert got == {"a": (1, 1, 0), "empty": (0, 0, 0)}


def test_renumber_closes_gaps(sheet):
    df = sheet(row("a", 1, 3, "A", 1), row("a", 1, 7, "B", 1), row("a", 1, 9, "C", 1), row("b", 2, 5, "A", 1))
    got = dedup.renumber(df, bucket_rows=2).orderBy("sheet_name", "row_num").collect()
    assert [(r.row_num, r.new_row_num) for r in got] == [(3, 2), (7, 3), (9, 4), (5, 2)]


def test_row_numbers_beyond_32_bits(spark):
    far = 3 * 10**11
    df = spark.createDataFrame(
        [("s", 40, far, day(2), "A"), ("s", 40, far + 1, day(1), "A")], "sheet_name string, sheet_order int, row_num bigint, c0 string, c3 string"
    )
    assert tuple(dedup.keepers(df).first())[2:] == (40, "s", far + 1, 2)
    assert [(r.action, r.row_num) for r in dedup.duplicate_list(df).orderBy(*dedup.LIST_ORDER).collect()] == [("keep", far + 1), ("delete", far)]


def test_keepers_are_cut_before_the_shuffle(spark, sheet):
    df = dedup.kept_rows(sheet(row("s", 1, 2, "A", 1)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_sheets_that_share_an_order_or_have_none(spark, sheet):
    df = sheet(row("a", 1, 2, "A", 1), row("a", 1, 3, "", 1), row("b", 1, 2, "A", 1), row("b", 1, 3, "", 1), row("far", 70_000, 2, "A", 1))
    assert sorted((r.sheet_name, r.row_num) for r in dedup.kept_rows(df).collect()) == [("a", 2), ("a", 3), ("b", 3)]
    stats = {r.sheet_name: (r.total, r.kept, r.deleted) for r in dedup.dedup_stats(df).collect()}
    assert stats == {"a": (2, 2, 0), "b": (2, 1, 1), "far": (1, 0, 1)}
    none = df.withColumn("sheet_order", F.lit(None).cast("int"))
    assert dedup.kept_rows(none).count() == 3 and dedup.losers(none).count() == 2
    blank = df.where("c3 = ''").withColumn("sheet_order", F.lit(None).cast("int"))
    assert dedup.kept_rows(blank).count() == 2
