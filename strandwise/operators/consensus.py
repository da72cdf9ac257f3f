"""Cross-sample consensus: reciprocal-overlap clusters, votes, summaries."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import MergeConfig
from ..functions.scalars import reciprocal_overlap, region_id
from .classify import ARTIFACT, BIDIRECTIONAL, GDNA, NOVEL
from .intervals import overlap_join

#: Names of the classes in consensus tables, in the order in which ties are broken.
RENAMED = {GDNA: "recurrent_gDNA", ARTIFACT: "recurrent_multimapper_artifact", BIDIRECTIONAL: "reproducible_bidirectional", NOVEL: "reproducible_novel"}
TIE_ORDER = (GDNA, ARTIFACT, BIDIRECTIONAL, NOVEL)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: below ``spark.checkpoint.dir``,
    or where that is unset, in local mode alone, a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """The table at ``path``: what is read again has no lineage to repeat."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reciprocal_pairs(rows: DataFrame, keys: list[str], least: float, id_col: str = "id") -> DataFrame:
    """Pairs a < b of intervals on the same keys with reciprocal overlap >= least."""
    own = rows.select(*keys, "s", "e", id_col)
    hits = overlap_join(own, own, keys)
    a, b = f"a_{id_col}", f"b_{id_col}"
    shared = reciprocal_overlap(F.col("a_s"), F.col("a_e"), F.col("b_s"), F.col("b_e"))
    return hits.filter((F.col(a) < F.col(b)) & (shared >= least)).select(*keys, F.col(a).alias("a"), F.col(b).alias("b"))


def components(rows: DataFrame, pairs: DataFrame, id_col: str = "id") -> DataFrame:
    """Single linkage: every row with cluster, the smallest id it reaches. Each
    round takes the smallest label around and then follows labels of labels."""
    work = shared_dir(rows.sparkSession)
    both = written(pairs.select("a", "b").union(pairs.select("b", "a")).distinct(), f"{work}/both")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{work}/0")
    for n in range(1, 64):
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = written(labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), f"{work}/{n}a")
        far = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = written(step.join(far, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), f"{work}/{n}b")
        labels = new.select("node", "label")
        if not new.filter("old <> label").limit(1).count():
            break
    else:
        raise RuntimeError("clusters did not settle")
    return rows.join(labels.withColumnRenamed("node", id_col), id_col, "left").withColumn("cluster", F.coalesce("label", id_col)).drop("label")


def clusters(rows: DataFrame, keys: list[str], least: float, id_col: str = "id") -> DataFrame:
    """``components`` over ``reciprocal_pairs``. Equal intervals overlap wholly, so
    each distinct one is paired once, under its smallest id."""
    place = [*keys, "s", "e"]
    reps = written(rows.groupBy(*place).agg(F.min(id_col).alias(id_col)), f"{shared_dir(rows.sparkSession)}/places")
    found = components(reps, reciprocal_pairs(reps, keys, least, id_col), id_col)
    return rows.join(found.select(*place, "cluster"), place)


def vote(rows: DataFrame, by: list[str], column: str, out: str, order: tuple[str, ...] = TIE_ORDER) -> DataFrame:
    """The most frequent value by group; ties by ``order``, then by code point.
    Also {out}_votes, its number of members."""
    rank = F.lit(len(order))
    for k, v in enumerate(order):
        rank = F.when(F.col(column) == v, k).otherwise(rank) if k == 0 else F.when(F.col(column) == v, F.lit(k)).otherwise(rank)
    counts = rows.groupBy(*by, column).agg(F.count("*").alias("_n"))
    best = F.min_by(F.struct(F.col(column).alias("v"), F.col("_n").alias("n")), F.struct(-F.col("_n"), rank, F.col(column)))
    return counts.groupBy(*by).agg(best.alias("_best")).select(*by, F.col("_best.v").alias(out), F.col("_best.n").alias(f"{out}_votes"))


def consensus(rows: DataFrame, cfg: MergeConfig) -> DataFrame:
    """One row a cluster. ``rows``: id (input order), sample, region_id, chrom,
    s, e, class, dominant_strand and four optional metric columns.

    A class's votes are those of members, so a sample with two members votes
    twice, and class_agreement divides by members; n_samples are distinct.
    """
    keys = ["chrom"] if cfg.ignore_strand else ["chrom", "dominant_strand"]
    member = clusters(rows, keys, cfg.min_reciprocal_overlap)
    member = written(member, f"{shared_dir(rows.sparkSession)}/members")
    mean = lambda c: F.round(F.avg(F.col(c).try_cast("double")), 4).alias(f"mean_{c}") if c in rows.columns else F.lit(None).cast("double").alias(f"mean_{c}")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("id", c))), lambda x: x[c])
    g = member.groupBy("cluster").agg(
        F.first("chrom").alias("chrom"), F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n_members"), F.sort_array(F.collect_set("sample")).alias("samples"),
        listed("class").alias("member_classes"), listed("region_id").alias("member_region_ids"), listed("sample").alias("member_samples"), *[mean(c) for c in ("unique_fraction", "dual_strand_fraction", "profile_correlation", "avg_depth")],
    )
    g = g.join(vote(member, ["cluster"], "class", "majority_class"), "cluster").join(vote(member, ["cluster"], "dominant_strand", "strand").drop("strand_votes"), "cluster")
    renamed = F.create_map(*[x for k, v in RENAMED.items() for x in (F.lit(k), F.lit(v))])
    g = g.withColumn("n_samples", F.size("samples")).withColumn("class_agreement", F.col("majority_class_votes").cast("double") / F.col("n_members")).withColumn("consensus_class", F.coalesce(F.try_element_at(renamed, "majority_class"), "majority_class"))
    g = g.withColumn("passes_min_samples", F.col("n_samples") >= cfg.min_samples)
    wanted = F.col("majority_class") == NOVEL
    if cfg.include_bidirectional:
        wanted = wanted | (F.col("majority_class") == BIDIRECTIONAL)
    return g.withColumn("in_consensus_gtf", F.col("passes_min_samples") & wanted).withColumn("consensus_id", region_id(F.col("chrom"), F.col("s"), F.col("e"))).drop("majority_class_votes")


def numbered(rows: DataFrame, flag: str, order: list, prefix: str, out: str) -> DataFrame:
    """Names prefix_1, prefix_2, ... over the rows with ``flag`` alone, in order.
    One sorted window: the table has a row for each region, not for each read."""
    n = F.row_number().over(Window.partitionBy(flag).orderBy(*order))
    return rows.withColumn(out, F.when(F.col(flag), F.concat(F.lit(prefix + "_"), n.cast("string"))))
