"""Shared plumbing: tables, shared work folders, lineage cuts, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in the regular-expression dialects of Java, Python and RE2 alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that the driver and every executor can see.

    The cluster names the parent in ``spark.checkpoint.dir``; only in local mode,
    as in tests, is a temporary one chosen where that is unset.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"


#: Rows of an Arrow batch: whole texts in batches of 10,000 would fill hundreds of MB in each of a worker's buffers.
ARROW_ROWS = 2000


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Plans made inside pass rows to Python ARROW_ROWS at a time, or fewer if
    the session says so."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    spark.conf.set(key, str(min(ARROW_ROWS, int(own)) if int(own) > 0 else ARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def cut(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Lost executors then cost a re-read, not a recomputation of the lineage.
    """
    with small_batches(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(batches):
    """``batches`` of a function for mapInArrow; at their end the worker, which
    Spark keeps for whatever runs next, gives back the memory they took."""
    yield from batches
    del batches
    trim()


#: Bytes up to which a side goes to every executor.
BROADCAST_BYTES = 32 << 20


def size_of(df: DataFrame) -> int:
    """Bytes of a written table's values, counted in one pass over it."""
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    wide += [F.coalesce(8 * F.size(c), F.lit(0)) for c, t in df.dtypes if t.startswith("array<")]
    each = sum(wide, F.lit(16 + 8 * len(df.columns)).cast("long"))
    return int(df.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0])


def checked(df: DataFrame) -> DataFrame:
    """Broadcast only when the counted bytes are within the bound; else Spark
    shuffles. ``df`` is a written table, so the count is a scan of it."""
    return F.broadcast(df) if size_of(df) <= BROADCAST_BYTES else df


#: Rows of one key that one task takes, and the most keys beyond it that go to every executor.
HOT_ROWS, HOT_KEYS = 4096, 1 << 18


def spread(big: DataFrame, small: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """``big.join(small, keys, how)`` (inner or left) for a written ``small``
    with a row for each key, whose ``count`` says how many rows of ``big`` it
    meets. A key of very many rows is salted: its row of ``small`` is repeated
    for each salt. Fewer than HOT_KEYS keys can have a count beyond the HOT_KEYS-th
    part of all, so the table of their salts is small at any size."""
    total = int(small.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0])
    most = max(HOT_ROWS, total // HOT_KEYS)
    salts = F.ceil(F.col(count) / most).cast("int")
    hot = small.filter(F.col(count) > most).select(*keys, salts.alias("_salts"))
    if not hot.limit(1).count():
        return big.join(small, keys, how)
    salted = big.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*big.columns), F.col("_salts")), F.lit(0)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return salted.drop("_salts").join(copies, [*keys, "_salt"], how).drop("_salt")


def ascii_lower(col):
    """Lower-cases A-Z only, as the contracts ask."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, work: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, label)``; label is the
    smallest node of the component.

    Every round takes the smallest label among neighbours, then follows labels
    of labels (pointer jumping), so rounds grow with the logarithm of the
    longest path. Each round is a written table; nothing is collected but one
    count of changed rows. Nodes of very many links, and labels of very many
    nodes, are salted.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{work}/both")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"), F.count("*").alias("links")), f"{work}/l0")
    for n in range(1, max_rounds + 1):
        ends = labels.select(F.col("node").alias("b"), "label", "links")
        near = spread(both, ends, ["b"], "links").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = cut(labels.join(near, "node").select("node", "links", F.col("label").alias("old"), F.least("label", "near").alias("label")), f"{work}/s{n}")
        own = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        heads = cut(step.groupBy("label").agg(F.count("*").alias("nodes")).join(own, "label"), f"{work}/h{n}")
        new = cut(spread(step, heads, ["label"], "nodes").select("node", "links", "old", F.least("label", "far").alias("label")), f"{work}/l{n}")
        labels = new.select("node", "label", "links")
        if not new.filter(F.col("old") != F.col("label")).limit(1).count():
            return labels.select("node", "label")
    raise RuntimeError("components did not settle")
