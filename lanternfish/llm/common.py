"""What the training-data operators share: scratch tables, word splitting, components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of anything but ASCII white space (U+0020, U+0009 to U+000D).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a session on one machine may do without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lanternfish-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the actions inside; the caller's come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Tables of one operator call, written in the shared folder.

    A written table cuts lineage, survives lost executors, and has a known size, by
    which Spark decides about a broadcast join.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        # a task has one core: Spark would let each worker's matrix products run on all of an executor's
        spark.sparkContext.environment.setdefault("OPENBLAS_NUM_THREADS", "1")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def action(self, rows: int = 1000, mb: int = 8):
        """Settings of one action: Arrow batches bounded by rows and bytes, shuffle files gone when it ends."""
        arrow = "spark.sql.execution.arrow.max"
        return settings(self.spark, {f"{arrow}RecordsPerBatch": str(rows), f"{arrow}BytesPerBatch": str(mb << 20), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})

    def keep(self, df: DataFrame, name: str, *, rows: int = 1000, mb: int = 8) -> DataFrame:
        """Write df and read it back."""
        with self.action(rows, mb):
            df.write.option("compression", "zstd").parquet(self.path(name))
        fields = [T.StructField(f.name, f.dataType, True) for f in df.schema.fields]
        return self.spark.read.schema(T.StructType(fields)).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def pieces_of(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches cut to a few rows each, for results that run under the caller's settings."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def shards_for(n: float, each: float, least: int = 1) -> int:
    """How many shards hold n units, each of them about `each`."""
    return max(least, int(-(-n // each)))


def components(edges: DataFrame, scratch: Scratch, rounds: int = 500) -> DataFrame:
    """(node, label) for every node of the edges (u, v): label is the component's least node.

    Alternates large-star and small-star steps, each one aggregation and one join on the
    same key; every round is written, so nothing is gathered in one place and a lost
    executor costs one round. Stars are stable, so the loop ends when a round changes
    nothing; more rounds than `rounds` are an error, never a result. Rows with a null end
    are no edges. Nodes without an edge to another node don't appear.
    """
    cur = scratch.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc0")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    seen = mark(cur)
    for i in range(rounds):
        if not seen[0]:
            break
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        nxt = scratch.keep(small.distinct(), f"cc{i + 1}")
        now = mark(nxt)
        scratch.drop(f"cc{i}")
        cur = nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = cur.select(F.col("v").alias("node")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots.select("node", F.col("node").alias("label")))
