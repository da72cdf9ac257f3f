"""Region metrics from integer moments of run-length rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import binary_entropy, ratio, share

WIDE = "decimal(38,0)"


def _spread(n: str, sq: str, s: str) -> Column:
    """n * sum of squares - square of sum: n^2 times the population variance."""
    d = lambda c: F.col(c).cast("decimal(19,0)")
    return (d(n) * F.col(sq).cast("decimal(19,0)") - d(s) * d(s)).cast("double")


def pearson(n: str, sxy: str, sx: str, sy: str, sxx: str, syy: str) -> Column:
    """Population correlation; 0 where a side is constant or n < 2."""
    d = lambda c: F.col(c).cast("decimal(19,0)")
    a, b = _spread(n, sxx, sx), _spread(n, syy, sy)
    top = (d(n) * d(sxy) - d(sx) * d(sy)).cast("double")
    r = top / (F.sqrt(a) * F.sqrt(b))
    return F.when((F.col(n) < 2) | (a <= 0) | (b <= 0), F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def variation(n: str, sq: str, s: str) -> Column:
    """Population standard deviation over mean; 0 where the sum is 0."""
    return F.when(F.col(s) == 0, F.lit(0.0)).otherwise(F.sqrt(F.greatest(_spread(n, sq, s), F.lit(0.0))) / F.col(s))


def region_metrics(segs: DataFrame, keys: list[str], min_depth: int = 10, strand_min_depth: int = 3) -> DataFrame:
    """One row a region (keys, s, e) with every metric. ``segs`` carry r_s, r_e;
    bases without a segment have depth 0 and count in the length alone."""
    w = F.col("e") - F.col("s")
    p, m, x = F.col("plus"), F.col("minus"), F.col("multi")
    on = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0))
    plus_on, minus_on = p >= strand_min_depth, m >= strand_min_depth
    g = segs.groupBy(*keys, F.col("r_s").alias("s"), F.col("r_e").alias("e")).agg(
        on(p + m >= min_depth).alias("covered_bases"),
        F.max(p + m).alias("max_depth"),
        on(plus_on).alias("plus_covered_len"),
        on(minus_on).alias("minus_covered_len"),
        on(plus_on & minus_on).alias("_both"),
        on(plus_on | minus_on).alias("_either"),
        F.sum(w * p).alias("plus_total"),
        F.sum(w * m).alias("minus_total"),
        F.sum(w * x).alias("multi_total"),
        F.sum(w * p * p).alias("_pp"),
        F.sum(w * m * m).alias("_mm"),
        F.sum(w * p * m).alias("_pm"),
        F.max(F.col("exon") > 0).alias("exonic"),
    )
    g = g.withColumn("length", F.col("e") - F.col("s")).withColumn("total_coverage", F.col("plus_total") + F.col("minus_total"))
    t = F.col("total_coverage")
    return g.select(
        *keys, "s", "e", "length", "covered_bases", share(F.col("covered_bases"), F.col("length")).alias("covered_fraction"), "total_coverage", share(t, F.col("length")).alias("avg_depth"), "max_depth",
        t.alias("unique_total"), "multi_total", share(t, t + F.col("multi_total"), 1.0).alias("unique_fraction"), "plus_covered_len", "minus_covered_len",
        share(F.col("plus_total"), F.col("length")).alias("plus_mean_depth"), share(F.col("minus_total"), F.col("length")).alias("minus_mean_depth"),
        ratio(share(F.col("plus_total"), F.col("length")), share(F.col("minus_total"), F.col("length"))).alias("pm_depth_ratio"),
        ratio(F.col("plus_covered_len"), F.col("minus_covered_len")).alias("covered_len_ratio"),
        share(F.abs(F.col("plus_covered_len") - F.col("minus_covered_len")), F.greatest("plus_covered_len", "minus_covered_len")).alias("strand_length_ratio_diff"),
        F.when(F.col("plus_total") > F.col("minus_total"), "+").when(F.col("plus_total") < F.col("minus_total"), "-").otherwise(".").alias("dominant_strand"),
        share(F.greatest("plus_total", "minus_total"), t, 1.0).alias("dominant_strand_fraction"),
        share(F.col("_both"), F.col("length")).alias("dual_strand_fraction"), share(F.col("_both"), F.col("_either")).alias("strand_overlap_jaccard"),
        pearson("length", "_pm", "plus_total", "minus_total", "_pp", "_mm").alias("profile_correlation"),
        variation("length", "_pp", "plus_total").alias("plus_cv"), variation("length", "_mm", "minus_total").alias("minus_cv"),
        binary_entropy(share(F.col("plus_total"), t, 0.5)).alias("strand_balance"), "exonic",
    )
