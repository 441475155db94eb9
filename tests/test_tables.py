"""Versions and the manifest, the ledger and its folded state, on files."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from rowgate.functions.schema import DEFAULT_MAPPING
from rowgate.operators import lookups
from rowgate.sources import ledger, tables
from rowgate.sources.files import Folder, States


def rows(spark, table, n):
    cells = [F.lit("2024-01-01").cast("date" if m.field == "collected_at" else "string").alias(m.field) for m in DEFAULT_MAPPING]
    return spark.range(n).select(F.lit(table).alias("table_name"), F.col("id").alias("row_num"), *cells)


def counts(df):
    return {r.table_name: r["count"] for r in df.groupBy("table_name").count().collect()}


def test_readers_see_whole_versions(spark, tmp_path):
    target, odd = str(tmp_path), "x<y %20/p=q"
    assert counts(tables.read_tables(spark, target)) == {}
    first = tables.write_version(rows(spark, "1", 5).unionAll(rows(spark, odd, 3)), target)
    assert counts(tables.read_tables(spark, target)) == {}  # written, not committed
    tables.commit(spark, target, {"1": first, odd: first})
    opened = tables.read_tables(spark, target)
    second = tables.write_version(rows(spark, "1", 7), target)
    tables.commit(spark, target, {"1": second, "none": None})
    assert counts(opened) == {"1": 5, odd: 3} and counts(tables.read_tables(spark, target)) == {"1": 7, odd: 3}
    assert counts(tables.read_tables(spark, target, names=[odd, "none"])) == {odd: 3}
    tables.remove_old(spark, target)
    assert counts(tables.read_tables(spark, target)) == {"1": 7, odd: 3}  # the first version is still in use
    tables.commit(spark, target, {odd: None})
    tables.write_version(rows(spark, "1", 9), target)  # a run that may be about to commit
    tables.remove_old(spark, target)
    assert counts(tables.read_tables(spark, target)) == {"1": 7}
    assert len(Folder(spark, f"{target}/data").sizes()) == 2 and len(States(spark, f"{target}/manifest").numbers()) == 1


def test_commits_side_by_side_lose_nothing(spark, tmp_path):
    target = str(tmp_path)
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: tables.commit(spark, target, {f"t{i}": None}), range(40)))
    assert set(tables.manifest(spark, target)) == {f"t{i}" for i in range(40)}
    states = States(spark, f"{target}/manifest")
    states.write("_mine", b"{}")
    assert not states.rename_to_new("_mine", f"{states.numbers()[-1]}.json")  # another writer was first
    assert len(tables.manifest(spark, target)) == 40 and "_mine" not in states.sizes()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = rows(spark, "1", 5).withColumn("team", F.raise_error("no").cast("string"))
    with pytest.raises(Exception, match="no"):
        tables.write_version(bad, str(tmp_path))
    assert Folder(spark, f"{tmp_path}/data").sizes() == {}


def test_the_recount_reads_no_column(spark, tmp_path):
    target = str(tmp_path)
    version = tables.write_version(rows(spark, "a", 100).unionAll(rows(spark, "b", 30)).unionAll(rows(spark, "c", 1)), target)
    tables.commit(spark, target, {"a": version, "b": version, "c": version, "e": None})
    plan = tables._footer_counts(spark, target, ["a", "b", "e"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan.replace("COUNT(1)", "COUNT(*)"), plan
    got = tables.count_from_footers(spark, target, ["a", "b", "e"])
    assert {r.table_name: r.n_stored for r in got.collect()} == {"a": 100, "b": 30}
    assert tables.count_from_footers(spark, target, []).count() == 0
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"  # the caller's session is as it was


ENTRIES = [("r1", "a", "success", "01"), ("r1", "b", "failed", "01"), ("r2", "a", "failed", "02"), ("r3", "b", "success", "03"), ("2024", "a", "success", "03")]


def entries(spark, *runs):
    return spark.createDataFrame([e for e in ENTRIES if e[0] in runs], "run_id string, table_name string, status string, finished_at string")


def state(df):
    return {r.table_name: (r.last_status, r.last_success_at) for r in df.select("table_name", "last_status", "last_success_at").collect()}


def test_state_before_and_after_folding(spark, tmp_path):
    path, done = str(tmp_path), []
    for run in ("r1", "r2", "r3", "2024"):
        ledger.append(entries(spark, run), path)
        done.append(run)
        want = state(lookups.ledger_state(entries(spark, *done)))
        assert state(ledger.state(spark, path)) == want
        ledger.fold(spark, path)
        assert state(ledger.state(spark, path)) == want
    assert want == {"a": ("success", "03"), "b": ("success", "03")}
    assert ledger.history(spark, path).count() == len(ENTRIES)
    assert state(lookups.ledger_state(ledger.state(spark, path))) == want  # a state counts as its own state


def test_a_repeated_run_replaces_its_entries(spark, tmp_path):
    path = str(tmp_path)
    ledger.append(entries(spark, "r1", "r2", "r3"), path, fold_after=2)  # folds
    assert States(spark, f"{path}/folded").latest()["snapshot"]
    ledger.append(entries(spark, "r1", "r2", "r3"), path, fold_after=99)
    assert ledger.history(spark, path).count() == 4
    assert state(ledger.state(spark, path)) == state(lookups.ledger_state(entries(spark, "r1", "r2", "r3")))
    ledger.append(entries(spark, "r2").withColumn("status", F.lit("success")), path, fold_after=99)
    assert state(ledger.state(spark, path))["a"] == ("success", "02")


def test_only_runs_behind_the_snapshot_are_read(spark, tmp_path):
    path = str(tmp_path)
    ledger.append(entries(spark, "r1", "r2"), path)
    ledger.fold(spark, path)
    ledger.append(entries(spark, "r3"), path)
    files = ledger.state(spark, path).inputFiles()
    assert len([f for f in files if "/runs/" in f]) == 1 and len([f for f in files if "/state/" in f]) == 1
