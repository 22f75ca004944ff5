"""Helpers shared by the training-data operators.

Intermediate tables are written below the folder that the session names in
``spark.checkpoint.dir``, so a lost executor never takes the only copy with it.
"""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch between JVM and Python, unless the session sets its own.
ARROW_BATCH, BATCH_SETTING = "16m", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Removes a finished query's shuffle files.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Work is dealt into parts of so many bytes: small ones at first, larger ones beyond ``PARTS`` parts, since lists go from every part to every part.
LEAST_PART, PART, LARGEST_PART, PARTS = 1 << 20, 16 << 20, 512 << 20, 8192


def with_code(query):
    """``query`` after the executors' Python workers were sent this package."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args):
        ship_code(spark)
        return query(spark, *args)

    return run


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors once per Spark context, as a zip of its sources."""
    context = spark.sparkContext
    if not getattr(context, "pipeloom_shipped", False):
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="pipeloom-code-")) / "pipeloom_code.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
        context.pipeloom_shipped = True
    # bounds what the JVM and a worker hold of a table at a time, however long its rows; lazy results need it after this call
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, ARROW_BATCH)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables.  Only on a local master, where all share one disk, a temporary one is set if the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pipeloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """``value`` of a setting while the block runs, then what was there before."""
    before = spark.conf.getAll.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, is computed once, and leaves no shuffle files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with setting(spark, CLEANUP_SETTING, "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.materialised_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by :func:`materialise`; only for tables that no later plan reads."""
    path = getattr(df, "materialised_at", None)
    if path:
        jvm = df.sparkSession._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def parts_of(spark: SparkSession, size: int | None) -> int:
    """Into how many parts ``size`` bytes are dealt; on a large cluster small inputs in as many as there are cores."""
    size = size or 1
    cores = min(spark.sparkContext.defaultParallelism, -(-size // LEAST_PART))
    return max(cores, min(PARTS, -(-size // PART)), -(-size // LARGEST_PART))


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """``df`` in at least ``parts`` partitions by ``keys``; up to the session's number the next operator's own exchange does it."""
    return df.repartition(parts, *keys) if parts > shuffle_partitions(df.sparkSession) else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash (ignoring case) with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        candidate = name
        while candidate.lower() in taken:
            candidate += "_"
        taken.add(candidate.lower())
        out.append(candidate)
    return out


def scrambled(column: Column) -> Column:
    """A 64-bit order unrelated to the ids' own order."""
    return F.xxhash64(column, F.lit("component"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Components of an undirected graph as (node, component), component = smallest node id of its component.

    Contraction by random priority: every vertex points at the neighbour (or
    itself) with the smallest hashed id, the edges are rewritten to the pointed-at
    vertices, and this repeats until no edge is left.  The number of edges falls
    by a constant factor a round, every step is a hash join or aggregate over
    distributed tables, and only one row count a round reaches the driver.
    Nodes without edges are absent.
    """
    pairs = edges.select(scrambled(F.col(src)).alias("u"), scrambled(F.col(dst)).alias("v"), F.col(src).alias("a"), F.col(dst).alias("b"))
    names = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("key"), F.col("a").alias("node")), F.struct(F.col("v").alias("key"), F.col("b").alias("node")))).alias("x")).select("x.*").distinct()
    labels = materialise(names.select("node", "key", F.col("key").alias("label")), "cc-labels")
    live = materialise(pairs.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges")
    while live.limit(1).count():
        both = live.select(F.explode(F.array(F.struct(F.col("u").alias("p"), F.col("v").alias("q")), F.struct(F.col("v").alias("p"), F.col("u").alias("q")))).alias("x")).select("x.*")
        parent = materialise(both.groupBy("p").agg(F.min("q").alias("least")).select("p", F.least("p", "least").alias("parent")), "cc-parents")
        left = parent.select(F.col("p").alias("u"), F.col("parent").alias("pu"))
        right = parent.select(F.col("p").alias("v"), F.col("parent").alias("pv"))
        step = live.join(left, "u").join(right, "v").where("pu != pv")
        before, live = live, materialise(step.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "cc-edges")
        moved = labels.join(parent.select(F.col("p").alias("label"), "parent"), "label", "left")
        old, labels = labels, materialise(moved.select("node", "key", F.coalesce("parent", "label").alias("label")), "cc-labels")
        for done in (before, parent, old):
            discard(done)
    discard(live)
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")
