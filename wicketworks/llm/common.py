"""What several operators share: lineage cuts and the pairing of rows inside buckets."""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def ready(spark: SparkSession) -> SparkSession:
    """The session, with this package on the search path of the Python workers that it starts."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where that is unset and all runs in one process, as in tests, a temporary folder is taken.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Spark then removes the shuffle files of a query when it ends; what stored() writes does not need them any more.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame) -> DataFrame:
    """``df`` from a table written to the shared folder: compressed, of known size, and without shuffle files left behind.

    ``dropped`` removes it.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(folder)
    _folders[table] = folder
    return table


def dropped(*tables: DataFrame) -> None:
    """Removes what ``stored`` wrote for these tables. Nothing that is still to be computed may read them."""
    for table in tables:
        if folder := _folders.pop(table, None):
            session = table.sparkSession
            path = session._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/embeddings.parquet")


def partitions(df: DataFrame) -> int:
    """How many partitions an exchange of this session makes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sha256_or_empty(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def block_pairs(rows: DataFrame, key: str, node: str, block: int) -> DataFrame:
    """Deals the rows of each bucket to groups of at most about two blocks, so that all pairs meet once.

    ``rows`` hold a bucket in ``key`` and a unique node in ``node``. Buckets of one row go. A bucket of
    ``n`` rows is cut into ``ceil(n / block)`` blocks by a hash of the node; each row goes to the group
    of every pair of blocks that holds its own. Adds ``left_block``, ``right_block`` and ``own_block``:
    the pairs of a group are those within the block if both are equal, else those across.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("bucket_rows")).where("bucket_rows > 1")
    blocks = F.ceil(F.col("bucket_rows") / block).cast("int")
    own = F.pmod(F.xxhash64(node, F.lit(17)), F.col("blocks")).cast("int")
    return (
        rows.join(sizes, key)
        .withColumn("blocks", blocks)
        .withColumn("own_block", own)
        .withColumn("other_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("left_block", F.least("own_block", "other_block"))
        .withColumn("right_block", F.greatest("own_block", "other_block"))
        .drop("blocks", "other_block", "bucket_rows")
    )


def grouped(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a group side by side in one partition; ``groups`` reads them there."""
    return df.repartition(partitions(df), *keys).sortWithinPartitions(*keys)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table per run of equal keys. Holds one group and one batch at a time."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        values = list(zip(*(table[k].to_pylist() for k in keys)))
        starts = [0] + [i for i in range(1, len(values)) if values[i] != values[i - 1]]
        for a, b in zip(starts, starts[1:] + [len(values)]):
            if held and values[a] != last:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            last = values[a]
            held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Row numbers of the left and the right block of a group that block_pairs has dealt; whether they are one."""
    left, right = table["left_block"][0].as_py(), table["right_block"][0].as_py()
    own = table["own_block"].to_numpy()
    return np.flatnonzero(own == left), np.flatnonzero(own == right), left == right


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for the nodes that have edges.

    Alternates large-star and small-star steps; each is one exchange, pre-aggregated, and moves one
    row per edge. A hot node's neighbours meet only in minima, never in a list. ``keep`` cuts the lineage of each step.
    """
    edges = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(down, "a")
            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .where("a > b")
            .distinct()
        )
        last, edges = edges, keep(small)
        dropped(last)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def ceil_div(n: int, size: int) -> int:
    return max(1, math.ceil(n / size))
