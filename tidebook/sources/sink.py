"""Results by key that a job can stop and go on with: what is committed is not computed again, and what is half written is not seen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Keys that are worked on before their results are committed.
AT_ONCE = 1_000


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def committed(spark: SparkSession, path: str, keys: StructType) -> DataFrame:
    """(keys, rows): what has been stored, from JSON beside the data."""
    schema = StructType([*keys.fields]).add("rows", "long")
    return spark.read.schema(schema).json(f"{path}/commits") if _exists(spark, f"{path}/commits") else spark.createDataFrame([], schema)


def store_by_key(keys: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, at_once: int = AT_ONCE) -> int:
    """Stores work(keys) under path, a folder a key, for those keys that are not committed yet; returns how many these were.

    keys: one row each, no nulls; work gets some of them and returns rows with the same key columns, which become folders. A key's rows replace what a run that was
    killed left of it; keys without rows are committed too, so they are not tried again. A commit covers about at_once keys. Two runs at a time may
    do the same work twice, with the same result.
    """
    spark, names = keys.sparkSession, keys.columns
    keys = keys.dropna().distinct()
    done = committed(spark, path, keys.schema)
    todo = keys.join(done.select(*names), names, "left_anti")
    n = todo.count()
    parts = -(-n // at_once)
    for k in range(parts):
        some = todo.where(F.pmod(F.xxhash64(*names), F.lit(parts)) == k) if parts > 1 else todo
        # What is committed meanwhile drops out of todo, so each part's keys are fixed before its work begins.
        fixed = f"{path}/plans/{k}"
        some.write.mode("overwrite").parquet(fixed)
        some = spark.read.schema(keys.schema).parquet(fixed)
        out = work(some)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*names).parquet(f"{path}/data")
        rows = spark.read.schema(out.schema).parquet(f"{path}/data").join(some, names, "left_semi").groupBy(*names).agg(F.count("*").alias("rows"))
        some.join(rows, names, "left").select(*names, F.coalesce("rows", F.lit(0)).alias("rows")).coalesce(1).write.mode("append").json(f"{path}/commits")
    return n


def read_by_key(spark: SparkSession, path: str, schema: StructType, names: list[str]) -> DataFrame:
    """What is committed; schema and names of the key columns as they were stored. Filters on keys choose folders."""
    data = spark.read.schema(schema).parquet(f"{path}/data")
    return data.join(committed(spark, path, StructType([schema[c] for c in names])).select(*names).distinct(), names, "left_semi")
