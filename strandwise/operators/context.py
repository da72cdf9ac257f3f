"""Where a region stands among genes, and who its nearest gene is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import nearest, overlap_join


def with_genes(regions: DataFrame, genes: DataFrame, window: int = 10_000, keys: list[str] = ["chrom"], strand: str = "dominant_strand") -> DataFrame:  # noqa: B006
    """Adds nearest_feature_id, nearest_feature_distance (-1 without genes on the
    chromosome) and context_label. ``genes`` have s, e, strand, gene_id, ord.

    Over genes of the other strand alone: antisense. Else over an exon:
    sense_genic_unannotated, or intronic. Off genes: near_gene up to ``window``
    bases away, the bound included, or intergenic. A gene or region without
    strand counts as the same strand.
    """
    near = nearest(regions, genes.select(*keys, "s", "e", "strand", "gene_id", "ord"), keys, ["s", "ord"])
    hits = overlap_join(regions.select(*keys, "s", "e", strand), genes.select(*keys, "s", "e", "strand"), keys)
    same = (F.col("b_strand") == F.col(f"a_{strand}")) | ~F.col("b_strand").isin("+", "-") | ~F.col(f"a_{strand}").isin("+", "-")
    over = hits.groupBy(*keys, F.col("a_s").alias("s"), F.col("a_e").alias("e")).agg(F.max(same).alias("_same"))
    d = F.col("distance")
    context = (
        F.when(F.col("_same").isNull(), F.when((d >= 0) & (d <= window), "near_gene").otherwise("intergenic")).when(~F.col("_same"), "antisense").when(F.col("exonic"), "sense_genic_unannotated").otherwise("intronic")
    )
    joined = near.join(over, [*keys, "s", "e"], "left").withColumn("context_label", context)
    return joined.withColumn("nearest_feature_id", F.col("near.gene_id")).withColumnRenamed("distance", "nearest_feature_distance").drop("near", "_same")
