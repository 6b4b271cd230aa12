"""What operators need besides the shared folder: tables that end lineage, and bounded Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame

from paperloom.sources.shared import Ranges, file_system, new_folder, remove_folders, shared_folder, write_whole

__all__ = ["Ranges", "bounded_batches", "file_system", "kept", "new_folder", "remove_folders", "shared_folder", "write_whole"]


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and the loss of an executor loses nothing."""
    spark = df.sparkSession
    df.write.parquet(path := new_folder(spark, name))
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch, at most: texts can be long.
BATCH_ROWS = 1_000


def bounded_batches(df: DataFrame) -> DataFrame:
    """df; batches between Spark and Python have at most BATCH_ROWS rows in its session from now on, fewer if fewer were set."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df
