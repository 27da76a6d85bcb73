"""Stage outputs of the catalog: how they are dealt to tasks before they are written."""

import pytest

from catalog import base


@pytest.mark.parametrize("size, spread", [("1g", True), ("1k", False)])
def test_only_small_inputs_are_shuffled_before_a_write(spark, tmp_path, size, spread):
    path = f"{tmp_path}/one file"
    spark.range(50_000).coalesce(1).write.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", size)  # the least size of a split
    try:
        frame = spark.read.parquet(path)
        assert len(frame.inputFiles()) == 1 < cores
        found = base._spread(frame)
        assert (found is not frame) == spread and found.count() == 50_000
        if spread:
            assert found.rdd.getNumPartitions() == cores
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_many_files_and_no_files(spark, tmp_path):
    many = spark.sparkContext.defaultParallelism + 1
    spark.range(many).repartition(many).write.parquet(f"{tmp_path}/many")
    frame = spark.read.parquet(f"{tmp_path}/many")
    if len(frame.inputFiles()) >= many - 1:
        assert base._spread(frame) is frame
    assert base._spread(spark.range(3)).count() == 3
    assert [base._bytes(x) for x in ("4194304", "134217728b", "16m", "2GB")] == [1 << 22, 1 << 27, 1 << 24, 1 << 31]
