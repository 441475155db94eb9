"""The ledger: the history of all runs, and the state of each table folded from it.

    ledger/runs/run=<hash of the run id>/...    entries of a run; a repeated run replaces its own
    ledger/state/<id>/...                       a snapshot: the state of each table after some runs
    ledger/folded/<number>.json                 which snapshot holds, and the runs that are in it

The state is the snapshot and the entries of the runs after it, so looking it up does not read all history. Folding makes a new snapshot of
both. When a run is repeated that a snapshot holds, the snapshot is given up first: the next fold starts from the history."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgate.operators.lookups import STATE, entries_as_state, latest_state
from rowgate.session import remove_folder
from rowgate.sources.files import States

#: Runs that are not in the snapshot, from which an append folds.
FOLD_AFTER = 50


def _folder_of(run_id: F.Column) -> F.Column:
    """Name of a run's folder: a hash, so that no run id is read as a number or a date."""
    return F.concat(F.lit("r"), F.md5(run_id))


def append(rows: DataFrame, ledger: str, fold_after: int = FOLD_AFTER) -> None:
    """Adds the entries of one or several runs (column run_id). Entries that are there under the same run ids are replaced."""
    spark, folded = rows.sparkSession, States(rows.sparkSession, f"{ledger}/folded")
    named = rows.withColumn("run", _folder_of(F.col("run_id")))
    runs = {r.run for r in named.select("run").distinct().collect()}  # as many as runs are being written
    if runs & set(folded.latest().get("runs", [])):
        folded.change(lambda held: {"snapshot": None, "runs": []})
    named.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{ledger}/runs")
    if "status" in rows.columns and len(_unfolded(spark, ledger, folded.latest())) >= fold_after:
        fold(spark, ledger)


def _unfolded(spark: SparkSession, ledger: str, held: dict) -> list[str]:
    names = [n.removeprefix("run=") for n in States(spark, f"{ledger}/runs").sizes() if n.startswith("run=")]
    return sorted(set(names) - set(held.get("runs", [])))


def history(spark: SparkSession, ledger: str) -> DataFrame:
    """The entries of all runs."""
    return spark.read.parquet(f"{ledger}/runs").drop("run")


def _parts(spark: SparkSession, ledger: str, held: dict, runs: list[str]) -> DataFrame:
    parts = spark.createDataFrame([], STATE)
    if held.get("snapshot"):
        parts = parts.unionByName(spark.read.schema(STATE).parquet(f"{ledger}/state/{held['snapshot']}"))
    if runs:
        new = spark.read.option("basePath", f"{ledger}/runs").parquet(*[f"{ledger}/runs/run={r}" for r in runs])
        parts = parts.unionByName(entries_as_state(new))
    return parts


def state(spark: SparkSession, ledger: str) -> DataFrame:
    """The current state of each table, in the shape of lookups.ledger_state: from the snapshot and the runs after it."""
    held = States(spark, f"{ledger}/folded").latest()
    return latest_state(_parts(spark, ledger, held, _unfolded(spark, ledger, held))).select("table_name", "last_status", "last_success_at")


def fold(spark: SparkSession, ledger: str) -> None:
    """Makes a snapshot of the state; the history stays as it is."""
    folded = States(spark, f"{ledger}/folded")
    held = folded.latest()
    runs, snapshot = _unfolded(spark, ledger, held), uuid.uuid4().hex
    if not runs:
        return
    latest_state(_parts(spark, ledger, held, runs)).coalesce(1).write.parquet(f"{ledger}/state/{snapshot}")
    new = {"snapshot": snapshot, "runs": sorted({*held.get("runs", []), *runs})}
    # Another fold or a repeated run may have come first; then this snapshot is of no use.
    folded.change(lambda now: new if now == held else now)
    if folded.latest() != new:
        remove_folder(spark, f"{ledger}/state/{snapshot}")
    elif held.get("snapshot"):
        remove_folder(spark, f"{ledger}/state/{held['snapshot']}")
