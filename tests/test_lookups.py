"""Lookups on sheet map and ledger."""

import pytest

from rowgate.operators import lookups
from rowgate.plans.jobs import RefusedRequest, resolve_selection

MAP = "id int, sheet_order int, sheet_name string, table_name string"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def sheet_map(spark):
    return frame(spark, [(1, 1, "a", "t1"), (2, 2, "b", "t2"), (3, 9, "a", "t9"), (4, 4, "c", ""), (5, 5, "d", "t2"), (6, 9, "e", "x"), (7, 9, "e", "y")], MAP)


def selection(spark, *names):
    return frame(spark, [(n, i + 1) for i, n in enumerate(names)], "sheet_name string, sheet_order int")


def test_last_entry_of_a_name_counts(sheet_map):
    got = {r.sheet_name: r.table_name for r in lookups.sheet_tables(sheet_map).collect()}
    assert got == {"a": "t9", "b": "t2", "c": "", "d": "t2", "e": "y"}


def test_unmapped_and_conflicts(spark, sheet_map):
    wanted = selection(spark, "a", "b", "c", "d", "A")
    assert sorted(r.sheet_name for r in lookups.unmapped_sheets(wanted, sheet_map).collect()) == ["A", "c"]
    conflicts = lookups.table_conflicts(wanted, sheet_map).orderBy("sheet_order").collect()
    assert [(r.table_name, r.n_sheets, r.sheet_name) for r in conflicts] == [("t2", 2, "b"), ("t2", 2, "d")]
    assert lookups.table_conflicts(selection(spark, "a", "b"), sheet_map).isEmpty()


def test_requests_are_refused(spark, sheet_map):
    for names, text in [((), "no sheet"), (("a", "c"), "without a table: c"), (("b", "d"), "one table: t2")]:
        with pytest.raises(RefusedRequest, match=text):
            resolve_selection(selection(spark, *names) if names else selection(spark, "a").where("false"), sheet_map)
    got = resolve_selection(selection(spark, "b", "a"), sheet_map).orderBy("sheet_order").collect()
    assert [(r.sheet_name, r.table_name) for r in got] == [("b", "t2"), ("a", "t9")]


def test_ledger_states_and_retry(spark, sheet_map):
    ledger = frame(
        spark,
        [("r1", "t9", "success", "2024-01-01"), ("r2", "t9", "failed", "2024-01-08"), ("r1", "t2", "failed", "2024-01-01"), ("r2", "t2", "success", "2024-01-08"),
         ("r2", "y", "failed", "2024-01-08")],
        "run_id string, table_name string, status string, finished_at string",
    )
    state = {r.table_name: (r.last_status, r.last_success_at) for r in lookups.ledger_state(ledger).collect()}
    assert state == {"t9": ("failed", "2024-01-01"), "t2": ("success", "2024-01-08"), "y": ("failed", None)}
    present = selection(spark, "a", "b", "new")
    shown = {r.sheet_name: (r.last_load_time, r.failed) for r in lookups.sheet_states(present, sheet_map, ledger).collect()}
    assert shown == {"a": ("2024-01-01", True), "b": ("2024-01-08", False), "new": ("", False)}
    assert [r.sheet_name for r in lookups.retry_sheets(present, sheet_map, ledger).collect()] == ["a"]


def test_preview(spark):
    few = lookups.preview(selection(spark, "x", "y")).first()
    assert (few.n_total, few.preview) == (2, "x、y")
    many = lookups.preview(selection(spark, *"abcdefghij")).first()
    assert (many.n_total, many.preview) == (10, "a、b、c、d、e、f、g、h 等 10 个")


def test_missing_tables_in_request_order(spark):
    wanted = frame(spark, [("t3", 1), ("t1", 2), ("t2", 3)], "table_name string, n int")
    got = lookups.missing_tables(wanted, frame(spark, [("t1",)], "table_name string")).orderBy("n")
    assert [r.table_name for r in got.collect()] == ["t3", "t2"]


def test_replace_selects_without_case_and_replaces_with_case(spark):
    entries = frame(spark, [(1, 1, "Ab ab", "ab_ab"), (2, 2, "AB", "ab"), (3, 3, "zz", "ab")], MAP)
    got = {r.id: (r.n_replaced, r.new_sheet_name, r.new_table_name) for r in lookups.keyword_replace(entries, "ab", "x").collect()}
    assert got == {1: (3, "Ab x", "x_x"), 2: (1, "AB", "x"), 3: (0, "zz", "ab")}
    with pytest.raises(ValueError):
        lookups.keyword_replace(entries, "", "x")
