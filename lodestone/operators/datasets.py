"""Typed user tables: create, append, query, statistics, set updates."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.operators.storage import written

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
#: The declared types.
TYPES = {"text": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType()}


def declared(columns: dict[str, str]) -> T.StructType:
    """The schema of a dataset from its declared columns."""
    for name in columns:
        if not _NAME.fullmatch(name):
            raise ValueError(f"not a column name: {name!r}")
    return T.StructType([T.StructField(n, TYPES[t]) for n, t in columns.items()])


def append(df: DataFrame, path: str, key: str | None = None) -> None:
    (df.sortWithinPartitions(key) if key else df).write.mode("append").parquet(path)


def scan(df: DataFrame, where: Column | None = None, columns: Sequence[str] | None = None, order_by: Sequence[Column] = (), limit: int | None = None, offset: int = 0) -> DataFrame:
    """Filter, order, offset and limit, project; nulls come first ascending, as Spark has it."""
    out = df if where is None else df.where(where)
    out = out.orderBy(*order_by) if order_by else out
    out = out.offset(offset) if offset else out
    out = out if limit is None else out.limit(limit)
    return out if columns is None else out.select(*columns)


def column_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a column: count, distinct_count, null_count, min, max (as text).

    Counts, minima and maxima are sums of one aggregation, typed as the columns
    are; distinct values are counted over (column, value) rows, which are made
    distinct in each task before anything is shuffled.
    """
    one = df.agg(F.count(F.lit(1)).alias("_all"), *(x for c in columns for x in (F.count(c).alias(f"{c}_n"), F.min(c).cast("string").alias(f"{c}_lo"), F.max(c).cast("string").alias(f"{c}_hi"))))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"{c}_n").alias("count"), (F.col("_all") - F.col(f"{c}_n")).alias("null_count"), F.col(f"{c}_lo").alias("min_value"), F.col(f"{c}_hi").alias("max_value")) for c in columns))
    values = reduce(DataFrame.unionByName, [df.select(F.lit(c).alias("column_name"), F.xxhash64(c).alias("v"), F.col(c).isNotNull().alias("held")).where("held").groupBy("column_name", "v").agg(F.lit(1).alias("one")) for c in columns])
    distinct = values.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count"))
    return one.select(F.inline(rows)).join(F.broadcast(distinct), "column_name", "left").select("column_name", "count", F.coalesce("distinct_count", F.lit(0).cast("long")).alias("distinct_count"), "null_count", "min_value", "max_value")


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """old with new's rows in place of those of the same key."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").select(*old.columns).unionByName(new)


def updated(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def deleted(df: DataFrame, where: Column) -> DataFrame:
    """Rows for which where isn't true, null included."""
    return df.where(~F.coalesce(where, F.lit(False)))


def last_writer(df: DataFrame, key: Sequence[str], clock: Sequence[str]) -> DataFrame:
    """The newest row of each key: an aggregation with a partial step, no window over a hot key."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*clock)).alias("row"))
    return best.select(*key, "row.*").select(*df.columns)


def field_last_writer(df: DataFrame, key: Sequence[str], clock: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The newest value of each field that isn't null."""
    return df.groupBy(*key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*clock))).alias(c) for c in fields))


def visible_at(df: DataFrame, at: Column, created: str, tombstoned: str) -> DataFrame:
    return df.where((F.col(created) <= at) & (F.col(tombstoned).isNull() | (F.col(tombstoned) > at)))


def numbered(df: DataFrame, order: Sequence[Column], name: str = "number") -> DataFrame:
    """df with 0-based places in an order: ranges of the order are numbered apart, then moved on by the rows before them.

    The rows are put in ranges once and written (the ranges must not change
    between the two steps); no task holds more than a range.
    """
    parts = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_own", own).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_own")).drop("_part", "_own", "_start")


def paged(df: DataFrame, order: Sequence[Column], per_page: int = 50) -> DataFrame:
    """page and is_last of every row in an order."""
    n = df.agg(F.count(F.lit(1)).alias("_all"))
    pages = numbered(df, order, "_place").join(F.broadcast(n)).withColumn("page", F.floor(F.col("_place") / per_page))
    return pages.withColumn("is_last", F.col("page") == F.floor((F.col("_all") - 1) / per_page)).drop("_place", "_all")


def inventory(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row count and a digest of all rows that doesn't depend on their order: the sum, modulo 2**64, of 60 bits of each
    row's MD5.  Equal rows add up, so repeats show; null is the empty text."""
    row = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns or df.columns))
    bits = F.conv(F.substring(F.md5(row.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("row_count"), (F.coalesce(F.sum(bits), F.lit(0)) % F.lit(str(1 << 64)).cast("decimal(38,0)")).cast("decimal(20,0)").cast("string").alias("digest"))


def create(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """An empty stored dataset of the declared columns; its folder must not be there yet."""
    spark.createDataFrame([], declared(columns)).write.mode("error").parquet(path)
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def drop(spark: SparkSession, path: str) -> bool:
    """Delete a dataset; false if there was none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def filed(spark: SparkSession, path: str, columns: dict[str, str], csv: str, key: str | None = None) -> DataFrame:
    """Create a dataset and fill it from a CSV with a header; a failure leaves nothing behind.

    Rows are read with the declared types and one malformed row fails all.
    """
    create(spark, path, columns)
    try:
        append(spark.read.csv(csv, header=True, schema=declared(columns), mode="FAILFAST"), path, key)
    except Exception:
        drop(spark, path)
        raise
    return opened(spark, path)
