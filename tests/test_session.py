from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from twinframe import compare
from twinframe.session import fresh_path, recommended_settings, remove, scratch, shared_dir, stored


class FakeConf(dict):
    def set(self, key, value):
        self[key] = value


class FakeSession:
    def __init__(self, **conf):
        self.conf = FakeConf({key.replace("_", "."): value for key, value in conf.items()})


def test_shared_folder_is_the_configured_one(spark):
    assert shared_dir(FakeSession(spark_checkpoint_dir="s3a://b/cp/", spark_master="yarn")) == "s3a://b/cp"
    assert fresh_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir") + "/x-")


def test_the_warehouse_takes_its_place():
    for master in ("yarn", "local[2]"):
        assert shared_dir(FakeSession(spark_master=master, spark_sql_warehouse_dir="hdfs:/w")) == "hdfs:/w"


def test_stored_cuts_the_lineage(spark):
    df = stored(spark.range(10).selectExpr("id", "id * 2 AS twice"), "numbers")
    assert df.count() == 10
    assert "FileScan" in df._jdf.queryExecution().executedPlan().toString()


def test_recommended_settings_grow_with_the_input():
    small, large = recommended_settings(10**9), recommended_settings(10**14, columns=300)
    assert small["spark.sql.shuffle.partitions"] == "200"
    assert int(large["spark.sql.shuffle.partitions"]) > 400_000
    assert int(large["spark.sql.codegen.maxFields"]) > 600


def test_what_is_stored_in_a_scratch_block_goes_with_it(spark, frame):
    outside = stored(spark.range(3), "outside")
    with pytest.raises(RuntimeError), scratch(spark) as folder:
        inside = stored(spark.range(5), "inside")
        with scratch(spark) as inner:
            assert inner.startswith(folder + "/")
            assert stored(spark.range(2), "nested").count() == 2
        assert not Path(inner).exists()
        assert inside.count() == 5 and inside.inputFiles()[0].split("://")[-1].startswith(folder)
        indexed = compare(outside.withColumn("v", F.lit(1)), outside.withColumn("v", F.lit(2)), pk_columns=["id"]).indexed()
        assert indexed.rows("diffs").count() == 3
        raise RuntimeError
    assert not Path(folder).exists()
    assert outside.count() == 3
    remove(spark, folder)
