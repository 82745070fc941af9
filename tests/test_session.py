"""Where intermediate tables go."""

import os

import pytest

from answerproof import session


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Fake:
    def __init__(self, master, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})
        self.sparkContext = type("Context", (), {"master": master})


def test_the_named_folder_is_used():
    assert session.shared_folder(Fake("yarn", spark_checkpoint_dir="hdfs:///x/")) == "hdfs:///x"


def test_own_folder_only_on_one_machine():
    assert session.shared_folder(Fake("local[4]")) == session.shared_folder(Fake("local[*]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Fake("spark://host:7077"))


def test_written_tables_come_back(spark):
    df = session.written(spark.range(5).selectExpr("id", "id * 2 as twice"))
    assert df.filter("twice = 8").count() == 1


def test_spread_leaves_large_inputs_alone(spark):
    wide = spark.range(10, numPartitions=64)
    assert session.spread(wide) is wide
    assert session.spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == 4


def test_scratch_tables_go_at_the_end_of_the_block(spark, tmp_path):
    with session.scratch(spark):
        df = session.written(spark.range(5))
        folder = os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
        assert os.path.isdir(folder)
        df.write.parquet(str(tmp_path / "kept"))
    assert not os.path.exists(folder)
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 5
    after = session.written(spark.range(3))
    assert after.count() == 3 and "scratch-" not in after.inputFiles()[0]


def test_scratch_tables_go_when_the_block_fails(spark):
    with pytest.raises(ZeroDivisionError), session.scratch(spark):
        folder = os.path.dirname(session.written(spark.range(5)).inputFiles()[0].removeprefix("file://"))
        1 / 0
    assert not os.path.exists(folder)


def test_only_written_tables_are_discarded(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "own"))
    own, made = spark.read.parquet(str(tmp_path / "own")), session.written(spark.range(5))
    folder = os.path.dirname(made.inputFiles()[0].removeprefix("file://"))
    session.discard(own, made)
    assert not os.path.exists(folder) and own.count() == 3
