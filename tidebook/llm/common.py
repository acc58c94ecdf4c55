"""Helpers shared by the corpus operators: shared storage, batches, column names, components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no spark.checkpoint.dir and runs on one machine, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/tidebook"
#: Bytes of an Arrow batch that goes to Python, unless the session sets its own.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; only a session on one machine may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = LOCAL_CHECKPOINTS
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches in this session, so that long texts do not add up in a Python worker; results do not depend on it."""
    if int(spark.conf.get(_BATCH, str(2**31 - 1))) > 64 << 20:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, which cuts its lineage.

    The table survives the loss of any executor. Its path is kept on the result
    as ``_tidebook_path`` so that ``discard`` can remove it once it is superseded.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidebook_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables written by ``materialize`` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._tidebook_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The given names, each with as many underscores before it as tell it from all of df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def no_clash(keep: tuple[str, ...], *added: str) -> None:
    """Raises where a kept column has the name of one that an operator adds, as the result would have it twice."""
    if clash := {c.lower() for c in keep} & set(added):
        raise ValueError(f"kept columns {sorted(clash)} would be in the result twice; rename them first")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """Smallest reachable vertex of each vertex that has an edge.

    Alternating large-star and small-star steps: in each, a vertex and its
    neighbours move to the smallest of them. Each step is an aggregate by vertex
    and a join that adaptive execution may split, so a vertex with very many
    edges is no bottleneck, and the steps are logarithmic in a chain's length.
    Null ends are ignored; the order of ends and repeated edges do not matter.
    Returns (node, component). No edge ever reaches the driver. Raises if components are not
    complete after max_rounds; each about doubles the longest chain that can be followed.
    """
    cur = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u is not null and v is not null and u != v").distinct(), "edges")
    if cur.isEmpty():
        return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        # It is over once every edge goes to a vertex that has none to a smaller one, and no vertex has two.
        ends = cur.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).union(cur.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)").isEmpty():
            break
        # Large star: neighbours larger than u go to the smallest of u and its neighbours.
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = materialize(large, "large-star")  # repeated edges go in the next step
        # Small star: u and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        nxt = materialize(small, "small-star")
        discard(large, cur)
        cur = nxt
    else:
        raise RuntimeError(f"components: not complete after {max_rounds} rounds")
    roots = cur.select("v").distinct()  # none of them is a u, and each u is there once
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("v", "v"))
