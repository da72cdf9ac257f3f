"""The rule classifier as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DetectConfig

ARTIFACT, NOVEL, GDNA, BIDIRECTIONAL = "likely_multimapper_artifact", "likely_novel_transcript", "likely_gDNA", "possible_bidirectional_RNA"


def tests(cfg: DetectConfig) -> dict[str, Column]:
    c = F.col
    flat = (c("plus_cv") <= cfg.gdna_max_cv) & (c("minus_cv") <= cfg.gdna_max_cv)
    return {
        "unique_reads_majority": c("unique_fraction") >= cfg.min_unique_fraction,
        "single_strand_dominant": c("dominant_strand_fraction") >= cfg.novel_min_dominant_strand_fraction,
        "gdna_dual_strand": c("dual_strand_fraction") >= cfg.gdna_min_dual_strand_fraction,
        "gdna_symmetric_length": c("strand_length_ratio_diff") <= cfg.gdna_max_length_ratio_diff,
        "gdna_depth_balanced": c("pm_depth_ratio") >= cfg.gdna_min_depth_ratio,
        "gdna_profile_correlated": c("profile_correlation") >= cfg.gdna_min_correlation,
        "gdna_both_strands_flat": flat,
        "gdna_pattern_consistent": (c("profile_correlation") >= cfg.gdna_min_correlation) | flat,
        "gdna_broad_continuous": c("covered_fraction") >= cfg.gdna_min_covered_fraction,
    }


def label(cfg: DetectConfig) -> Column:
    """Artifact first, then a dominant strand, then all gDNA tests, else both strands transcribed."""
    t = tests(cfg)
    gdna = t["gdna_dual_strand"] & t["gdna_symmetric_length"] & t["gdna_depth_balanced"] & t["gdna_pattern_consistent"] & t["gdna_broad_continuous"]
    return F.when(~t["unique_reads_majority"], ARTIFACT).when(t["single_strand_dominant"], NOVEL).when(gdna, GDNA).otherwise(BIDIRECTIONAL)


def flags(cfg: DetectConfig) -> Column:
    t = tests(cfg)
    every = F.create_map(*[x for k, v in t.items() for x in (F.lit(k), v)])
    return F.when(t["unique_reads_majority"], every).otherwise(F.create_map(F.lit("unique_reads_majority"), F.lit(False)))


def reason(cfg: DetectConfig) -> Column:
    t, c = tests(cfg), F.col
    failed = F.array_compact(
        F.array(
            F.when(~t["gdna_dual_strand"], F.format_string("dual-strand fraction %.2f", c("dual_strand_fraction"))),
            F.when(~t["gdna_symmetric_length"], F.format_string("strand length difference %.2f", c("strand_length_ratio_diff"))),
            F.when(~t["gdna_depth_balanced"], F.format_string("depth ratio %.2f", c("pm_depth_ratio"))),
            F.when(~t["gdna_pattern_consistent"], F.format_string("profile correlation %.2f", c("profile_correlation"))),
            F.when(~t["gdna_broad_continuous"], F.format_string("covered fraction %.2f", c("covered_fraction"))),
        )
    )
    gdna = t["gdna_dual_strand"] & t["gdna_symmetric_length"] & t["gdna_depth_balanced"] & t["gdna_pattern_consistent"] & t["gdna_broad_continuous"]
    return (
        F.when(~t["unique_reads_majority"], F.format_string("unique fraction %.2f is below the bound", c("unique_fraction")))
        .when(t["single_strand_dominant"], F.format_string("%.0f%% of coverage is on strand %s", c("dominant_strand_fraction") * 100, c("dominant_strand")))
        .when(gdna, F.format_string("both strands alike: dual-strand fraction %.2f, depth ratio %.2f, correlation %.2f", c("dual_strand_fraction"), c("pm_depth_ratio"), c("profile_correlation")))
        .otherwise(F.concat(F.lit("both strands covered, but not alike: "), F.array_join(failed, "; ")))
    )


def kept(column: str = "class") -> Column:
    return ~F.col(column).isin(GDNA, ARTIFACT)


def classified(regions: DataFrame, cfg: DetectConfig) -> DataFrame:
    return regions.withColumn("class", label(cfg)).withColumn("reason", reason(cfg)).withColumn("flags", flags(cfg)).withColumn("kept", kept())
