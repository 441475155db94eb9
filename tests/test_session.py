"""Where intermediate tables go."""

import os
from types import SimpleNamespace

import pytest

from rowgate import session


class Settings(dict):
    def get(self, key, default=None):
        return super().get(key, default)

    def set(self, key, value):
        self[key] = value


def fake(master, **settings):
    conf = Settings({k.replace("_", "."): v for k, v in settings.items()})
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_the_cluster_names_the_folder():
    spark = fake("yarn", spark_checkpoint_dir="hdfs://shared/ckpt/")
    assert session.shared_folder(spark) == "hdfs://shared/ckpt"
    first, second = session.run_folder(spark, "x"), session.run_folder(spark, "x")
    assert first.startswith("hdfs://shared/ckpt/x-") and first != second


def test_a_cluster_without_the_setting_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(fake("spark://host:7077"))


def test_a_local_cluster_is_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(fake("local-cluster[2,1,1024]"))


def test_local_mode_gets_its_own_folder_once():
    spark = fake("local[2]")
    folder = session.shared_folder(spark)
    assert os.path.isdir(folder) and session.shared_folder(spark) == folder


def test_staged_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    back = session.staged(df, "test")
    assert back.schema == df.schema
    assert sorted(r.a for r in back.collect()) == [1, 2]
    assert "ExistingRDD" not in back._jdf.queryExecution().executedPlan().toString()


def test_folders_can_be_removed(spark):
    path = session.run_folder(spark, "gone")
    spark.range(3).write.parquet(path)
    session.remove_folder(spark, path)
    assert not os.path.exists(path)
