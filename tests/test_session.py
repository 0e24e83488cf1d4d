"""Session helpers: shared folder and scale sizing."""

from __future__ import annotations

from portlens.session import scale_conf, scratch_path, shared_root

GB = 1 << 30
TB = 1 << 40


def test_scale_conf_bounds():
    small = scale_conf(10 * GB)
    assert small["spark.sql.shuffle.partitions"] == "200"
    assert small["spark.sql.files.maxPartitionBytes"] == str(128 << 20)
    mid = scale_conf(10 * TB)
    assert mid["spark.sql.files.maxPartitionBytes"] == str(512 << 20)
    assert mid["spark.sql.shuffle.partitions"] == str(10 * TB // 2 // (512 << 20))
    huge = scale_conf(100 * TB)
    # no clamp: a reducer's share stays 512 MB at every size
    assert huge["spark.sql.shuffle.partitions"] == str(100 * TB // 2 // (512 << 20))
    assert huge["spark.sql.files.maxPartitionBytes"] == str(1 << 30)


def test_shared_folder_comes_from_the_session(spark):
    root = shared_root(spark)
    assert root == spark.sparkContext.getCheckpointDir().rstrip("/")
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(root + "/portlens/x-")
