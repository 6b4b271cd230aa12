import os

from paperloom.llm import _shared


def test_folders_are_removed(spark):
    path = _shared.new_folder(spark, "mine")
    table = _shared.kept(spark.range(3), "mine")
    _shared.write_whole(f"{path}/x", [b"a", b"b"], 1)
    source = _shared.Ranges(f"{path}/x")
    assert source.size == 2 and source.read(1, 1) == b"b" and table.count() == 3
    source.close()
    local = _shared.file_system(path)[1]
    assert os.path.exists(local)
    _shared.remove_folders(spark)
    assert not os.path.exists(local)


def test_batches_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, 10_000)
    _shared.bounded_batches(spark.range(1))
    assert spark.conf.get(name) == "1000"
    spark.conf.set(name, 7)
    _shared.bounded_batches(spark.range(1))
    assert spark.conf.get(name) == "7"
    spark.conf.set(name, 1000)
