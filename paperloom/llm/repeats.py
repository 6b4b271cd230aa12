"""Units of texts that a document of lower rank has already: shared by line and substring dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm._shared import bounded_batches, kept

#: The rank of rows without one.
LAST = (1 << 63) - 1


def ranked(docs: DataFrame, rank: str = "doc_id") -> DataFrame:
    """row (all columns), d (rank), u (number of the row). Numbers are written with the rows, so each row is itself, whatever its text and rank."""
    rows = bounded_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    numbered = kept(rows.withColumn("u", F.monotonically_increasing_id()), "rows")
    return numbered.select("row", F.coalesce(F.col(f"row.`{rank}`").cast("long"), F.lit(LAST)).alias("d"), "u")


def later(units: DataFrame, keys: list[str]) -> DataFrame:
    """units (keys, d, u, at, again) that are not the first of their keys: again marks those that their own text has before, the
    others are compared by d, and those of one d by u. Least ranks are gathered before rows move; only keys that two rows have
    are joined back, and a common key is a large partition of a plain join, which Spark can split. A row has a key once that is not again."""
    first = units.where("not again").withColumn("r", F.struct("d", "u"))
    shared = first.groupBy(*keys).agg(F.min("r").alias("low"), F.count("*").alias("n")).where("n > 1").select(*keys, "low")
    return first.join(shared, keys).where("r > low").select("u", "at").union(units.where("again").select("u", "at"))


def gathered(places: DataFrame) -> DataFrame:
    """at of one row as a sorted array; a row has as many as its own text holds."""
    return places.groupBy("u").agg(F.sort_array(F.collect_set("at")).alias("later"))
