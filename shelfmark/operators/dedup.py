"""Which row of a key stays, and row ranges. A distributed table has no row order, so every operator takes its order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.folders import written


def top_n_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    return df.withColumn("_turn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_turn") <= n).drop("_turn")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_n_per(df, keys, order)


def keep_latest(df: DataFrame, keys: list[str], time: str, tie: list[Column]) -> DataFrame:
    return top_n_per(df, keys, [F.col(time).desc(), *tie])


def largest(df: DataFrame, column: str, n: int, tie: str) -> DataFrame:
    """The n rows with the largest number; rows without one are left out."""
    number = F.col(column).cast("string").try_cast("double")
    return df.withColumn("_number", number).filter("_number is not null").orderBy(F.desc("_number"), tie).limit(n).drop("_number")


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with each row's place in the order, from 1, without a window over all rows in one task.

    Rows are dealt by ranges of the order and numbered within their range; the
    ranges' sizes, one row a partition, give what stands before each. The dealt
    rows are written when this is called, so both steps see the same ranges; they
    go when the driver ends.
    """
    dealt = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    rows = written(dealt.withColumn("_within", F.row_number().over(W.partitionBy("_range").orderBy(*order))))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_before"))
    return rows.join(F.broadcast(starts), "_range").select(*df.columns, (F.col("_before") + F.col("_within")).alias(name))


def row_slice(df: DataFrame, index: str, start: int, end: int | None = None) -> DataFrame:
    """Rows with start <= index, and < end if there is one."""
    return df.filter((F.col(index) >= start) & (F.lit(True) if end is None else F.col(index) < end))


def carry_forward(df: DataFrame, value: str, keys: list[str], order: str) -> Column:
    """The last value up to the row that is not null."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))


def carried(df: DataFrame, value: str, order: list[str], keys: list[str] | None = None, name: str = "carried") -> DataFrame:
    """df with the last value up to each row that is not null, within equal keys or over all rows, as a segmented prefix scan.

    Rows are dealt by ranges of keys and order, so neither a long key nor a table
    without keys is one task's. Each range is scanned by itself; what it leaves to
    later ranges is one row, its last value with the key that has it, and reaches
    the rows of that key at the start of the next range that needs it. The dealt
    rows are written when this is called and go when the driver ends.
    """
    keys = keys or []
    key = F.struct(F.lit(0).alias("_0"), *keys)
    dealt = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    rows = written(dealt)
    left = F.max(F.when(F.col(value).isNotNull(), F.struct(key.alias("key"), F.struct(*order).alias("at"), F.col(value).alias("value"))))
    ends = rows.groupBy("_range").agg(F.min(key).alias("_first"), left.alias("_left"))
    before = F.last("_left", ignorenulls=True).over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))  # a row a range
    brought = ends.select("_range", "_first", before.alias("_before")).filter(F.col("_before.key") == F.col("_first")).select("_range", "_first", F.col("_before.value").alias("_brought"))
    within = F.last(value, ignorenulls=True).over(W.partitionBy("_range", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    scanned = rows.withColumn("_within", within).join(F.broadcast(brought), "_range", "left")
    return scanned.select(*df.columns, F.coalesce("_within", F.when(key == F.col("_first"), F.col("_brought"))).alias(name))


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, order: str, default: str = "") -> DataFrame:
    """df with the value that the last row of its key has in a lookup table."""
    last = table.groupBy(key).agg(F.max_by(value, order).alias(value))
    return df.join(last, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def fallback_content(files: DataFrame, repo: str, name: str, content: str, least: int = 200) -> DataFrame:
    """Per repository its readme; one of less than ``least`` characters is followed by the first manifest there is, cut to 1000."""
    priority = F.array_position(F.array(*map(F.lit, ("package.json", "setup.py", "requirements.txt", "Cargo.toml", "go.mod"))), F.col(name))
    readme = F.when(F.lower(name).startswith("readme"), F.concat(F.lit("README:\n"), F.col(content)))
    manifest = F.when(priority > 0, F.struct(priority.alias("priority"), F.concat(F.col(name), F.lit(":\n"), F.substring(content, 1, 1000)).alias("text")))
    picked = files.groupBy(repo).agg(F.min(readme).alias("readme"), F.min(manifest)["text"].alias("manifest"))
    short = F.col("readme").isNull() | (F.length("readme") < least)
    return picked.select(repo, F.concat_ws("\n\n", "readme", F.when(short, F.col("manifest"))).alias("content"))
