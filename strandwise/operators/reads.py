"""Read filters and strands, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DetectConfig
from ..functions.scalars import flip

PAIRED, UNMAPPED, REVERSE, FIRST, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 1, 4, 16, 64, 256, 512, 1024, 2048


def has(bit: int, flag: str = "flag") -> Column:
    return F.col(flag).bitwiseAND(F.lit(bit)) != 0


def category(cfg: DetectConfig, duplicates: bool | None = None) -> Column:
    """unique, multi or null (dropped)."""
    keep = cfg.keep_duplicates if duplicates is None else duplicates
    bad = has(UNMAPPED) | has(QC_FAIL) | has(SUPPLEMENTARY)
    if not keep:
        bad = bad | has(DUPLICATE)
    return F.when(bad, None).when(has(SECONDARY), F.lit("multi" if cfg.count_secondary else None)).when(F.col("mapq") >= cfg.min_mapq, "unique").otherwise("multi")


def dropped_duplicate(cfg: DetectConfig) -> Column:
    """Duplicates left out of the main tracks that would be unique otherwise."""
    return F.lit(not cfg.keep_duplicates) & has(DUPLICATE) & F.coalesce(category(cfg, True) == "unique", F.lit(False))


def strand(library: str) -> Column:
    """Strand of transcription. The first read of a pair, or a single read, keeps
    its strand in forward libraries; the second one is flipped; reverse is the opposite."""
    aligned = F.when(has(REVERSE), "-").otherwise("+")
    if library not in ("forward", "reverse"):
        return aligned
    leads = has(FIRST) | ~has(PAIRED)
    return F.when(leads if library == "forward" else ~leads, aligned).otherwise(flip(aligned))


def midpoint() -> Column:
    return F.floor((F.col("s") + F.coalesce("e", F.col("s") + 1)) / 2)


def blocks(reads: DataFrame, sizes: DataFrame | None = None, min_baseq: int = 0) -> DataFrame:
    """A row for each aligned block, clipped to the chromosome. With a base
    quality bound, one for each base that passes; reads without qualities pass."""
    rows = reads.withColumn("b", F.explode("blocks"))
    if min_baseq > 0:
        at = F.explode(F.transform(F.sequence(F.lit(0), F.col("b.end") - F.col("b.start") - 1), lambda i: F.struct((F.col("b.start") + i).alias("start"), (F.col("b.start") + i + 1).alias("end"), F.get(F.col("b.quals"), i.cast("int")).alias("q"))))
        rows = rows.filter("b.end > b.start").withColumn("b", at).filter(F.col("b.q").isNull() | (F.col("b.q") >= min_baseq))
    rows = rows.withColumn("s", F.greatest(F.col("b.start"), F.lit(0))).withColumn("e", F.col("b.end")).drop("b")
    if sizes is not None:
        rows = rows.join(F.broadcast(sizes.select("chrom", F.col("length").alias("_len"))), "chrom").withColumn("e", F.least("e", "_len")).drop("_len")  # a row for each chromosome of the header
    return rows.filter("s < e")


def read_stats(reads: DataFrame) -> DataFrame:
    """Counts of unique, of these annotated, and multi reads; ``annotated`` says
    whether the midpoint lies in the mask of the read's own strand."""
    return reads.agg(F.count_if(F.col("category") == "unique").alias("unique_reads"), F.count_if((F.col("category") == "unique") & F.col("annotated")).alias("annotated_reads"), F.count_if(F.col("category") == "multi").alias("multi_reads"))
