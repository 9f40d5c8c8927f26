"""Written intermediate tables: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``; a temporary one where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="deltaweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def buckets_of(spark: SparkSession) -> int:
    return max(1, min(200, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt out as the tables of :func:`write_bucketed` are."""
    return df.repartition(buckets_of(df.sparkSession), *[F.col(f"`{c}`") for c in df.columns]) if df.columns else df


def write_bucketed(df: DataFrame) -> tuple[DataFrame, int, bool, str]:
    """Write ``df`` as a table bucketed and sorted by all columns: what reads it, its rows, whether a column has a null, its name."""
    spark, name = df.sparkSession, f"deltaweave_{uuid.uuid4().hex}"
    seen = Observation()
    null = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in df.columns], F.lit(False))
    counted = df.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(null).alias("nulls"))
    writer = counted.write.option("compression", "lz4").option("path", f"{scratch_root(spark)}/deltaweave/{name}")
    writer.bucketBy(buckets_of(spark), *df.columns).sortBy(*df.columns).saveAsTable(name)
    return spark.table(name), int(seen.get["n"]), seen.get["nulls"] > 0, name


def delete(spark: SparkSession, paths: Sequence[str], table: str | None = None) -> None:
    """Delete written tables that nothing reads any more, and forget a bucketed one."""
    if table:
        spark.sql(f"drop table if exists {table}")
        paths = [*paths, f"{scratch_root(spark)}/deltaweave/{table}"]
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_counted(df: DataFrame) -> tuple[str, int, bool]:
    """Write ``df`` as a table in one job; its path, its number of rows and whether a column has a null."""
    path = f"{scratch_root(df.sparkSession)}/deltaweave/{uuid.uuid4().hex}"
    seen = Observation()
    null = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in df.columns], F.lit(False))
    df.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(null).alias("nulls")).write.option("compression", "lz4").parquet(path)
    return path, int(seen.get["n"]), seen.get["nulls"] > 0


def materialize(df: DataFrame) -> DataFrame:
    path, _, _ = write_counted(df)
    return df.sparkSession.read.schema(df.schema).parquet(path)
