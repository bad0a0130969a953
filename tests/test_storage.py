"""The shared folder, with and without a name."""

import pytest

from sparkloom import storage


class Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value or default


class Session:
    def __init__(self, value, master="local[4]"):
        self.conf = Conf(value)
        self.sparkContext = type("Context", (), {"applicationId": "app-1", "master": master, "getConf": lambda self: Conf(None)})()


def test_named_and_unnamed_folders():
    assert storage.shared_root(Session("hdfs://x/y/")) == "hdfs://x/y"
    first = storage.shared_root(Session(None))
    assert first.startswith("file:///") and storage.shared_root(Session(None)) == first


def test_a_cluster_must_name_its_folder():
    assert storage.shared_root(Session("hdfs://x/y", "yarn")) == "hdfs://x/y"
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(ValueError):
            storage.shared_root(Session(None, master))


def test_a_path_gets_its_file_system(spark, monkeypatch):
    real = spark.conf.get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: "/mnt/shared" if key == storage.CHECKPOINT_KEY else real(key, *default))
    assert storage.shared_root(spark) == "file:///mnt/shared"


def test_kept_tables_are_built_once_for_their_files(spark, tmp_path):
    source, built = f"{tmp_path}/in", []
    spark.range(3).write.parquet(source)

    def make():
        rows = spark.read.parquet(source)

        def build():
            built.append(1)
            return rows.selectExpr("id + 1 AS id")

        return sorted(r.id for r in storage.kept(spark, "plus", [source], build).collect())

    assert make() == make() == [1, 2, 3] and len(built) == 1
    spark.range(5).write.mode("overwrite").parquet(source)
    assert make() == [1, 2, 3, 4, 5] and len(built) == 2


def test_small_tables_are_spread(spark):
    assert storage.spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert storage.spread(spark.range(10, numPartitions=9)).rdd.getNumPartitions() == 9


def test_written_tables_come_back(spark):
    df = spark.range(3).selectExpr("id", "cast(null as string) s")
    back = storage.written(df, "some")
    assert back.dtypes == df.dtypes and back.count() == 3
    assert storage.new_folder(spark, "a") != storage.new_folder(spark, "a")
