"""Points and catalog tables as Parquet: partitioned upserts, and versions instead of updates."""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.embedding import Embedder, embedded
from paperloom.sources.shared import file_system, write_whole

#: Buckets of a collection of points, by a hash of their ids; tasks of a write for each core, at least, which share out the buckets' ids.
BUCKETS, TASKS = 16, 2
#: How these are written: row groups of 16 MB, which a bloom filter of their ids lets a lookup skip.
FILES = {"parquet.block.size": 16 << 20, "parquet.bloom.filter.enabled#point_id": "true", "parquet.bloom.filter.expected.ndv#point_id": 20_000, "parquet.bloom.filter.max.bytes": 1 << 16}


def point_id(*parts: Column) -> Column:
    """The same parts give the same id, so a run that is repeated replaces its points."""
    return F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256)


def as_points(chunks: DataFrame, collection: Column, extra: Column | None = None, embedder: Embedder | None = None) -> DataFrame:
    """Chunks (source, chunk_index, total_chunks, page, text, ...) as points, with vectors if there is an embedder. A key of extra
    that is also a fixed one overrides it. Files of one name in several folders have points of their own if filepath is there."""
    extra = extra if extra is not None else F.create_map().cast("map<string,string>")
    over = lambda c: F.coalesce(extra[c], F.col(c).cast("string")).alias(c) if c in ("text", "source", "page") else F.coalesce(extra[c].cast("int"), F.col(c)).alias(c)
    optional = [F.nullif(F.col(c), F.lit("")).alias(c) if c == "category" else F.col(c) for c in ("filepath", "category", "tags") if c in chunks.columns]
    place = F.col("filepath") if "filepath" in chunks.columns else F.col("source")
    made = chunks.select(collection.alias("collection"), point_id(collection, place, F.col("chunk_index"), F.col("text")).alias("point_id"), *[over(c) for c in ("text", "source", "page", "chunk_index", "total_chunks")], *optional, extra.alias("extra"))
    return made if embedder is None else embedded(made, embedder)


def points_table(spark: SparkSession, path: str, columns: T.StructType | None = None, buckets: int = BUCKETS) -> str:
    """The name of the table of points at path: a directory a collection, files by a hash of point_id, sorted by source and id. A session that
    does not know the table yet learns its columns from the files; the number of buckets is kept beside them."""
    name = "points_" + hashlib.sha256(path.encode()).hexdigest()[:24]
    if spark.catalog.tableExists(name):
        return name
    store, at = file_system(f"{path}/_buckets")
    if store.get_file_info(at).is_file:
        with store.open_input_file(at) as f:
            buckets = int(f.read())
    else:
        write_whole(f"{path}/_buckets", [str(buckets).encode()], 0)
    columns = columns or spark.read.parquet(path).schema
    ddl = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in columns)
    order = ", ".join(c for c in ("source", "point_id") if c in columns.fieldNames())
    options = ", ".join(f"'{k}' '{v}'" for k, v in FILES.items())
    spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet OPTIONS ({options}) PARTITIONED BY (collection) CLUSTERED BY (point_id) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{path}'")
    spark.catalog.recoverPartitions(name)
    return name


def upsert_points(points: DataFrame, path: str, version: int | None = None, buckets: int = BUCKETS) -> None:
    """Adds points; one that is there already, by collection and id, is replaced for readers, all others stay. version: greater ones
    win; by default the clock of the driver in nanoseconds. Of one version each point counts once, however often it is written. Only
    the new points are shuffled, once: to parts of their buckets, where equal ones meet."""
    spark = points.sparkSession
    stamp = F.lit(time.time_ns() if version is None else version).cast("long")
    rows = points.withColumn("_version", stamp)
    name = points_table(spark, path, rows.schema, buckets)
    known = spark.table(name).columns
    if extra := set(rows.columns) - set(known):
        raise ValueError(f"the table of points has no {', '.join(sorted(extra))}")
    held = int(spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").first().data_type)
    parts = held * max(1, -(-spark.sparkContext.defaultParallelism * TASKS // held))
    placed = rows.repartition(parts, "point_id").dropDuplicates(["collection", "point_id"])
    placed.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in known]).write.insertInto(name)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """The latest of each point. Points lie in buckets by id, so nothing is shuffled."""
    name = points_table(spark, path)
    spark.catalog.refreshTable(name)
    spark.catalog.recoverPartitions(name)
    last = F.row_number().over(Window.partitionBy("collection", "point_id").orderBy(F.desc("_version")))
    return spark.table(name).withColumn("_n", last).where("_n = 1").drop("_n", "_version")


def points_by_id(spark: SparkSession, path: str, *ids: str) -> DataFrame:
    """The latest of some points. Only the files of their buckets are opened, and of these only row groups whose bloom filter may have them."""
    return read_points(spark, path).where(F.col("point_id").isin(*ids))


def compact_points(spark: SparkSession, path: str, to: str) -> None:
    """Writes the latest points only."""
    upsert_points(read_points(spark, path), to, 0)


def append_usage(events: DataFrame, path: str, batch: str | int) -> None:
    """Adds usage events to a table, as the events of a batch. A batch that is written again replaces itself, so a job or a stream's
    batch that is run twice leaves its events once."""
    events.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def append_versions(rows: DataFrame, path: str, version: int, deleted: bool = False) -> None:
    rows.withColumn("_version", F.lit(version).cast("long")).withColumn("_deleted", F.lit(deleted)).write.mode("append").parquet(path)


def current(versions: DataFrame, key: str = "id") -> DataFrame:
    """The latest version of each key that is not deleted."""
    last = versions.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*versions.columns), F.struct("_version", "_deleted")).alias("row"))
    return last.where("NOT row._deleted").select("row.*").drop("_version", "_deleted")


def compact(spark: SparkSession, path: str, to: str, key: str = "id") -> None:
    current(spark.read.parquet(path), key).withColumn("_version", F.lit(0).cast("long")).withColumn("_deleted", F.lit(False)).write.parquet(to)
