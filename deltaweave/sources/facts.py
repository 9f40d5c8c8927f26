"""Facts from tables and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.relation import Relation


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_facts(spark: SparkSession, path: str) -> tuple[Relation, Relation]:
    """(nodes, edges) from lines ``src dst type``; blank lines and lines that start with ``#`` are skipped.

    Type ``n`` gives the node (dst, src), ``e`` the edge (src, dst); further words
    are ignored. Another type, or a number that isn't one, fails the job that reads it.
    """
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (line != ""))
    words = lines.select(F.split(line, r"\s+").alias("w"))
    rows = words.select(F.col("w")[0].cast("long").alias("src"), F.col("w")[1].cast("long").alias("dst"), F.get("w", F.lit(2)).alias("kind"))
    known = F.when(F.col("kind").isin("n", "e"), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown type: "), F.coalesce("kind", F.lit("none")))))
    rows = rows.withColumn("kind", known)
    nodes = rows.where("kind = 'n'").select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return Relation(nodes), Relation(rows.where("kind = 'e'").select(F.col("src").alias("a"), F.col("dst").alias("b")))


def part_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(a, b): every part but the first and the half of its number."""
    return table(spark, folder, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("a"), F.expr("p_partkey div 2").alias("b"))


def order_chains(spark: SparkSession, folder: str) -> DataFrame:
    """(a, b): every order and the same customer's next."""
    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("a"), following.alias("b")).where("b is not null")


def user_edges(spark: SparkSession, folder: str, event_type: str | None = None) -> DataFrame:
    """(a, b): users of events that follow each other in time, distinct, a <> b.

    The order is global, but only the first event of each day crosses a day:
    days are ordered apart, and the table of days alone is gathered.
    """
    events = table(spark, folder, "events").select("ts", "event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    inside = F.lead("user_id").over(Window.partitionBy("day").orderBy("ts", "event_id"))
    days = events.groupBy("day").agg(F.min(F.struct("ts", "event_id", "user_id"))["user_id"].alias("first"))
    days = days.select("day", F.lead("first").over(Window.orderBy("day")).alias("crossing"))
    rows = events.withColumn("inside", inside).join(days, "day").select("event_type", F.col("user_id").alias("a"), F.coalesce("inside", "crossing").alias("b"))
    if event_type:
        rows = rows.where(F.col("event_type") == event_type)
    return rows.where("b is not null and a <> b").select("a", "b").distinct()
