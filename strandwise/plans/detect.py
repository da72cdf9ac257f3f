"""detect: alignments and annotation to classified candidate regions."""

from __future__ import annotations

import dataclasses
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DetectConfig
from ..functions.scalars import region_id
from ..operators import classify, consensus, context, coverage, reads, strandedness
from ..sources import bam, sinks, text

log = logging.getLogger("strandwise")
KEYS = ["chrom"]


def alignments(spark: SparkSession, path: str, quals: bool = True) -> tuple[DataFrame, DataFrame]:
    """(alignments, chrom_sizes) of a BAM, SAM or Parquet input; Parquet tables
    have chrom sizes beside them as ``<path>.sizes``."""
    if path.endswith(".bam"):
        return bam.alignments(spark, path, quals=quals), bam.chrom_sizes(spark, path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path), spark.read.parquet(f"{path}.sizes")
    return text.sam(spark, path)


def size_mismatches(sizes: DataFrame, fai: DataFrame) -> DataFrame:
    return sizes.join(fai.select("chrom", F.col("length").alias("fai_length")), "chrom").filter("length <> fai_length").select("chrom", "length", "fai_length")


def candidates(spark: SparkSession, cfg: DetectConfig, aligned: DataFrame, sizes: DataFrame, annotation: DataFrame) -> dict:
    """The detect plan without files: candidates, totals, read statistics, QC."""
    exons = annotation.filter("ftype = 'exon'").select("chrom", "s", "e", "strand")
    cat = aligned.withColumn("category", reads.category(cfg))
    unique = cat.filter("category = 'unique'")
    library = strandedness.resolve(unique, exons, cfg)
    if library["confidence"] < cfg.strand_infer_min_confidence and library["library"] != "unstranded":
        library["library"] = "unstranded"
    stranded = cfg.stranded_masking and library["library"] in ("forward", "reverse")
    mask = text.masks(annotation, cfg.annotation_mode)
    genes = text.genes(annotation)
    placed = cat.withColumn("strand", reads.strand(library["library"]))
    placed = consensus.written(placed, f"{consensus.shared_dir(spark)}/reads")
    blocks = reads.blocks(placed, sizes, cfg.min_baseq)
    parts = [coverage.read_intervals(blocks, KEYS), coverage.mask_intervals(mask, KEYS), coverage.mask_intervals(exons, KEYS, exons=True)]
    segs = consensus.written(coverage.sweep(parts, KEYS, cfg.tile), f"{consensus.shared_dir(spark)}/segments")
    found = classify.classified(coverage.discover(segs, KEYS, cfg, stranded), cfg)
    found = context.with_genes(found, genes, cfg.nearest_feature_window)
    found = found.join(F.broadcast(sizes.select("chrom", "ordinal")), "chrom").withColumn("region_id", region_id(F.col("chrom"), F.col("s"), F.col("e")))  # a row for each chromosome of the header
    found = consensus.numbered(found, "kept", ["ordinal", "s", "e"], "unknown_transcript", "unknown_transcript_name")
    found = consensus.written(found, f"{consensus.shared_dir(spark)}/candidates")
    mids = placed.filter("category is not null").withColumn("pos", reads.midpoint())
    mids = strandedness.midpoint_in_mask(mids.select("chrom", "strand", "category", "pos"), mask)
    mids = consensus.written(mids, f"{consensus.shared_dir(spark)}/midpoints")
    stats = reads.read_stats(mids)
    per = strandedness.reads_per_region(mids.filter("category = 'unique'"), found).join(found.select("chrom", "s", "e", "class"), ["chrom", "s", "e"])
    total = coverage.totals(segs)
    return {"candidates": found, "segments": segs, "library": library, "stranded": stranded, "stats": stats, "assignment": strandedness.assignment(per, stats), "qc": strandedness.gdna_qc(found, total), "totals": total, "placed": placed, "mask": mask}


def store_segments(placed: DataFrame, sizes: DataFrame, mask: DataFrame, cfg: DetectConfig, stranded: bool, sample: str) -> DataFrame:
    """Run-length rows of six channels, masked; rows without any depth are left out."""
    names = [f"{k}_{s}" for k in ("unique", "dup", "multi") for s in ("plus", "minus")]
    dup = placed.withColumn("category", F.when(reads.dropped_duplicate(cfg), "dup").otherwise(F.col("category"))).filter("category is not null")
    b = reads.blocks(dup, sizes, cfg.min_baseq)
    b = b.select("chrom", "s", "e", *[((F.col("category") == n.split("_")[0]) & (F.col("strand") == ("+" if n.endswith("plus") else "-"))).cast("long").alias(n) for n in names])
    rows = coverage.sweep([b, coverage.mask_intervals(mask, KEYS)], KEYS, cfg.tile, (*names, "pmask", "mmask"))
    anywhere = (F.col("pmask") > 0) | (F.col("mmask") > 0)
    for n in names:
        off = (F.col("pmask" if n.endswith("plus") else "mmask") > 0) if stranded else anywhere
        rows = rows.withColumn(n, F.when(off, 0).otherwise(F.col(n)))
    return rows.filter(" or ".join(f"{n} > 0" for n in names)).select(F.lit(sample).alias("sample"), "chrom", "s", "e", *names)


def run(spark: SparkSession, cfg: DetectConfig) -> dict:
    """Reads the inputs of ``cfg``, writes all its files, and returns the summary."""
    cfg.validate()
    aligned, sizes = alignments(spark, cfg.bam, cfg.min_baseq > 0)
    if cfg.fai:
        for r in size_mismatches(sizes, text.chrom_sizes(spark, cfg.fai)).collect():  # a row for each chromosome at most
            log.warning("%s: %d bases in the alignments, %d in the index", *r)
    got = candidates(spark, cfg, aligned, sizes, text.annotation_lines(spark, cfg.gtf))
    out, order = cfg.out_prefix, ["ordinal", "s", "e"]
    rows = got["candidates"].withColumn("start", F.col("s") + 1).withColumn("end", F.col("e")).withColumn("kept_as_unknown_transcript", F.col("kept")).withColumn("reason_for_classification", F.col("reason")).withColumn("strand", F.col("dominant_strand"))
    sample = cfg.sample_name or os.path.basename(out)
    files = {"tsv": sinks.write_table(rows, sinks.CANDIDATE_COLUMNS, f"{out}.candidate_regions.tsv", order)}
    new = sinks.gtf_rows(rows.filter("kept"), "unknown_transcript_name", "strandwise", [sinks.attribute("classification", F.col("class")), sinks.attribute("context", F.col("context_label")), sinks.attribute("original_region_id", F.col("region_id"))], order)
    files["gtf"] = sinks.write_lines(new, f"{out}.unknown_transcripts.gtf", [*order, "kind"], ["##description: transcripts found outside the annotation"])
    files["merged_gtf"] = sinks.write_merged(cfg.gtf, new, f"{out}.annotation_plus_unknowns.gtf", [*order, "kind"], "# transcripts found outside the annotation")
    if cfg.emit_bed:
        files["bed"] = sinks.write_lines(sinks.bed_rows(rows, order), f"{out}.candidate_regions.bed", order)
    if cfg.emit_bedgraph:
        for side in ("plus", "minus"):
            files[f"bedgraph_{side}"] = sinks.write_lines(sinks.bedgraph_rows(rows, f"{side}_mean_depth", order), f"{out}.candidates.{side}.bedgraph", order, [f'track type=bedGraph name="candidates_{side}"'])
    assigned, qc = got["assignment"].first().asDict(), got["qc"].first().asDict()
    if cfg.emit_multiqc:
        files["multiqc"] = sinks.write_multiqc(f"{out}.gdna_mqc.tsv", sample, assigned)
    if cfg.emit_coverage_store:
        files["store"] = f"{out}.coverage"
        coverage.store(store_segments(got["placed"], sizes, got["mask"], cfg, got["stranded"], sample), files["store"])
    classes = {r["class"]: r["n"] for r in rows.groupBy("class").agg(F.count("*").alias("n")).collect()}  # four classes
    rescued = rows.filter("kept").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    summary = {
        "run_parameters": dataclasses.asdict(cfg), "inferred_library_strandedness": got["library"]["library"], "strandedness_metrics": got["library"], "stranded_masking": got["stranded"], "n_candidate_regions": sum(classes.values()),
        **{f"n_{c}": classes.get(c, 0) for c in (classify.GDNA, classify.BIDIRECTIONAL, classify.NOVEL, classify.ARTIFACT)}, "n_rescued_unknown_transcripts": rescued[0], "total_bases_in_rescued_unknown_transcripts": rescued[1],
        "gdna_contamination_qc": {k: round(v, 4) if isinstance(v, float) else v for k, v in qc.items()}, "read_assignment_counts": assigned, "reads": got["stats"].first().asDict(),
    }
    files["summary"] = sinks.write_json(f"{out}.summary.json", summary)
    return summary | {"files": files}
