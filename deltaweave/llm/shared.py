"""What the corpus operators share: scratch tables, input projection and Arrow passes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables that every executor can read.

    It is the session's ``spark.checkpoint.dir``; where that is unset (tests,
    local mode) a temporary folder is made once and set for the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="deltaweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, by: str | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back; ``by`` names a column to divide it by."""
    path = f"{scratch_root(df.sparkSession)}/deltaweave/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, test: Column | None = None) -> tuple[DataFrame, int]:
    """:func:`materialize`, and how many rows there are, or pass ``test``, counted by the job that writes."""
    seen = Observation()
    one = F.lit(1) if test is None else F.when(test, F.lit(1))
    made = materialize(df.observe(seen, F.count(one).alias("n")))
    return made, int(seen.get["n"])


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for name in {m[0] for f in df.inputFiles() if (m := re.match(r".*/deltaweave/[0-9a-f]{32}(?=/)", f))}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str):
    return F.coalesce(F.col(name), F.lit(""))


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that begins like ``name`` and that ``df`` hasn't."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lookup(rows: DataFrame, key: str, found: DataFrame, light: Column | None = None, hot: int = 1000) -> DataFrame:
    """``rows`` with the other columns of ``found`` (one row a key at most), null where the key isn't there.

    The ``hot`` keys of most rows come by broadcast, so at most that many rows of
    ``found`` do; ``light``, a condition on these, keeps large ones out. All other
    keys come by an ordinary join, in which rows that are done, and rows without
    a key, are dealt by their places.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1000").orderBy(F.desc("count"), key).limit(hot)
    top = counts.select(key).join(found, key, "left")
    top = materialize(top if light is None else top.where(light))
    values = [c for c in found.columns if c != key]
    done, by, value, wanted, deal = (fresh_name(rows, n) for n in ("done", "by", "value", "wanted", "deal"))
    known = top.select(F.col(key).alias(wanted), F.struct(*values).alias(value), F.lit(True).alias(done))
    marked = rows.join(F.broadcast(known), F.col(key) == F.col(wanted), "left").drop(wanted)
    cold = F.col(done).isNull() & F.col(key).isNotNull()
    marked = marked.withColumns({by: F.when(cold, F.xxhash64(key)).otherwise(F.monotonically_increasing_id()), deal: F.when(cold, F.col(key))})
    other = found.select(F.xxhash64(key).alias("o_by"), F.col(key).alias("o_key"), F.struct(*values).alias("o_value"))
    both = marked.join(other, (F.col(by) == F.col("o_by")) & (F.col(deal) == F.col("o_key")), "left")
    return both.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.coalesce(F.col(value), F.col("o_value"))[c].alias(c) for c in values])


def row_blocks(column: pa.Array, limit: int):
    """Consecutive row ranges of about ``limit`` bytes of text; a longer text is a range of its own."""
    lengths = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    lo = size = 0
    for i, n in enumerate(lengths):
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += int(n)
    if lo < len(lengths):
        yield lo, len(lengths)


_held: dict = {}


def remembered(name, make: Callable):
    """What a Python worker keeps from task to task: one thing, so that operators that share a worker don't add up."""
    if name not in _held:
        forget()
        _held[name] = make()
    return _held[name]


def forget() -> None:
    _held.clear()
    trim()


def trim() -> None:
    """Give freed memory back to the system; the allocator would keep it for this worker."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only some C libraries have it
        return


def lean(run: Callable) -> Callable:
    """The Arrow pass ``run``, which leaves no freed memory in its worker."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return passed
