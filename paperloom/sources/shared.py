"""Folders and files that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set a temporary one is made, in local mode only: executors of a cluster would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="paperloom-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    own = _MADE.setdefault(spark.sparkContext.applicationId, [])
    own.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return own[-1]


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and the loss of an executor loses nothing."""
    spark = df.sparkSession
    df.write.parquet(path := new_folder(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def remove_folders(spark: SparkSession) -> None:
    """Deletes what this application has put into the shared folder. Results read it until they are written, so call this after."""
    conf, own = spark.sparkContext._jsc.hadoopConfiguration(), _MADE.get(spark.sparkContext.applicationId, [])
    while own:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own.pop())
        path.getFileSystem(conf).delete(path, True)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """Python's view of a path of the shared folder; Hadoop's names of schemes are mapped to Arrow's."""
    for hadoop, arrow in (("s3a://", "s3://"), ("s3n://", "s3://")):
        uri = uri.replace(hadoop, arrow, 1) if uri.startswith(hadoop) else uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_whole(uri: str, parts: list[bytes], attempt: int) -> None:
    """Writes a file under another name and moves it in place, so that a task that is run twice leaves one whole file."""
    store, path = file_system(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(draft := f"{path}.{attempt}.draft") as out:
        for x in parts:
            out.write(x)
    store.move(draft, path)


class Ranges:
    """Positional reads of a file."""

    def __init__(self, uri: str):
        store, path = file_system(uri)
        self.file = store.open_input_file(path)
        self.size = self.file.size()

    def read(self, offset: int, n: int) -> bytes:
        return self.file.read_at(n, offset)

    def close(self) -> None:
        self.file.close()
