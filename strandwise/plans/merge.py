"""merge: candidate tables of many samples to annotated consensus regions."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MergeConfig
from ..functions.scalars import normalise_chrom
from ..operators import consensus, overlay
from ..sources import sinks, text
from . import report

ORDER = ["chrom", "s", "e", "strand"]


def annotate(regions: DataFrame, sources: dict[str, DataFrame], cfg: MergeConfig) -> tuple[DataFrame, DataFrame | None]:
    """Regions with eight columns for each label, and the long table of all
    labels. Nothing but the overlay's own columns changes."""
    rows = regions.withColumn("chrom_key", normalise_chrom(F.col("chrom")))
    long = None
    for label, features in sources.items():
        overlay.check_chromosomes(rows, features, label)
        got = overlay.annotated(rows, features, cfg.annotate_nearest_window, cfg.annotate_stranded, id_col="cluster").withColumn("label", F.lit(label))
        got = consensus.written(got, f"{consensus.shared_dir(rows.sparkSession)}/{label}")
        long = got if long is None else long.unionByName(got)
        regions = regions.join(got.select("cluster", *[F.col(c).alias(f"{label}_{c}") for c in overlay.COLUMNS], F.col("type_list").alias(f"_types_{label}")), "cluster", "left")
    return regions, long


def build(spark: SparkSession, cfg: MergeConfig, rows: DataFrame, sources: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """Consensus with names and overlay columns; and the long overlay table."""
    g = consensus.written(consensus.consensus(rows, cfg), f"{consensus.shared_dir(spark)}/consensus")
    g = consensus.numbered(g, "in_consensus_gtf", ORDER, "consensus_transcript", "consensus_transcript_name")
    g, long = annotate(g, sources, cfg)
    if sources and cfg.annotate_names:
        token = overlay.token([F.col(f"_types_{label}") for label in sources])
        g = g.withColumn("consensus_transcript_name", F.when(F.col("consensus_transcript_name").isNotNull(), F.concat_ws("-", "consensus_transcript_name", token)))
    g = g.withColumn("gene_id", F.col("consensus_transcript_name")).drop(*[f"_types_{label}" for label in sources])
    return consensus.written(g, f"{consensus.shared_dir(spark)}/named"), long


def nested(cross: list, labels: list[str]) -> dict:
    """Crosstab rows as label -> by_consensus_class -> class -> type -> regions,
    beside each class's n_regions and, where there are any, n_with_overlap."""
    out: dict = {label: {"n_regions_with_overlap": 0, "by_consensus_class": {}} for label in labels}
    for r in sorted(cross, key=lambda r: (r["label"], r["class"], r["ftype"] or "")):
        entry = out[r["label"]]
        of = entry["by_consensus_class"].setdefault(r["class"], {"n_regions": r["n_regions"]})
        if r["ftype"] is None:
            entry["n_regions_with_overlap"] += r["n_with"]
        if r["n_with"]:
            of["n_with_overlap" if r["ftype"] is None else r["ftype"]] = r["n_with"]
    return out


def run(spark: SparkSession, cfg: MergeConfig) -> dict:
    cfg.validate()
    rows = text.candidate_tables(spark, cfg.tsvs, cfg.sample_names)
    sources = text.overlay_sources(spark, cfg.annotate, cfg.annotate_labels, cfg.annotate_feature_types)
    g, long = build(spark, cfg, rows, sources)
    out = cfg.out_prefix
    shown = g.withColumn("start", F.col("s") + 1).withColumn("end", F.col("e")).withColumn("length", F.col("e") - F.col("s"))
    for c, sep in (("samples", ","), ("member_classes", ","), ("member_region_ids", ";")):
        shown = shown.withColumn(c, F.array_join(c, sep))
    extra = [(f"{label}_{c}", 4 if c == "overlap_frac" else None) for label in sources for c in overlay.COLUMNS]
    passing = shown.filter("passes_min_samples")
    files = {"tsv": sinks.write_table(passing, (*sinks.CONSENSUS_COLUMNS, *extra), f"{out}.consensus_regions.tsv", ORDER)}
    more = [sinks.attribute("consensus_class", F.col("consensus_class")), sinks.attribute("n_samples", F.col("n_samples").cast("string")), sinks.attribute("samples", F.col("samples")), sinks.attribute("member_region_ids", F.col("member_region_ids"))]
    for label in sources:
        for c in overlay.COLUMNS[:6]:
            v = (sinks.python_round(F.col(f"{label}_{c}"), 4) if c == "overlap_frac" else F.col(f"{label}_{c}")).cast("string")
            more.append(F.when((F.col(f"{label}_n") > 0) & ~v.isin("", "NA"), sinks.attribute(f"{label}_{c}", v)))
    new = sinks.gtf_rows(shown.filter("in_consensus_gtf"), "consensus_transcript_name", "strandwise", more, ORDER)
    files["gtf"] = sinks.write_lines(new, f"{out}.consensus_transcripts.gtf", [*ORDER, "kind"], ["##description: consensus transcripts"])
    if cfg.reference_gtf:
        files["merged_gtf"] = sinks.write_merged(cfg.reference_gtf, new, f"{out}.reference_plus_consensus.gtf", [*ORDER, "kind"], "# consensus transcripts")
    counts = {r["consensus_class"]: r["n"] for r in passing.groupBy("consensus_class").agg(F.count("*").alias("n")).collect()}  # four classes
    whole = shown.agg(F.count("*").alias("n_clusters_total"), F.count_if("passes_min_samples").alias("n_clusters_passing_min_samples"), F.count_if("in_consensus_gtf").alias("n_written_to_consensus_gtf")).first().asDict()
    summary = {"parameters": dataclasses.asdict(cfg) | {"n_samples_input": len(cfg.tsvs)}, **whole, **{f"n_{c}": counts.get(c, 0) for c in consensus.RENAMED.values()}}
    if long is not None:
        cross = overlay.crosstab(long.withColumnRenamed("cluster", "consensus_id"), passing.select(F.col("cluster").alias("consensus_id"), F.col("consensus_class").alias("class")))
        paths = text.overlay_paths(cfg.annotate, cfg.annotate_labels)
        stats = {r["label"]: r.asDict() for r in overlay.source_stats(long).collect()}  # a row for each label
        counted = {label: text.overlay_counts(spark, path, cfg.annotate_feature_types) for label, path in paths.items()}
        summary["annotation"] = {
            "sources": [stats.get(label, {"label": label}) | {"path": path} | counted[label] for label, path in paths.items()],
            "crosstab_passing": nested(cross.collect(), list(paths)),  # rows by label, class and type
        }
    files["summary"] = sinks.write_json(f"{out}.consensus_summary.json", summary)
    if cfg.emit_plots:
        files["plots"] = report.build(spark, cfg, g, rows, sources)
    return summary | {"files": files}
