"""Locus pages: Spark makes the plot data, the driver renders one page a locus."""

from __future__ import annotations

import html
import logging
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MergeConfig
from ..functions.scalars import normalise_chrom
from ..operators.coverage import max_pool
from ..operators.intervals import overlap_join
from ..sources import sinks, text

log = logging.getLogger("strandwise")
BINS = 3500
CHANNELS = [f"{k}_{s}" for k in ("unique", "dup", "multi") for s in ("plus", "minus")]


def store_paths(cfg: MergeConfig) -> list[str]:
    """Stores that detect wrote beside the tables, as far as they are there."""
    beside = [re.sub(r"(\.candidate_regions)?\.tsv$", "", p) + ".coverage" for p in cfg.tsvs]
    return [p for p in beside if sinks.exists(p)]


def targets(g: DataFrame, cfg: MergeConfig) -> DataFrame:
    """Loci with a page: named consensus transcripts, or all that pass."""
    rows = g.filter("passes_min_samples") if cfg.plot_all_passing else g.filter("in_consensus_gtf and consensus_transcript_name is not null")
    return rows.select("cluster", "chrom", F.greatest(F.col("s") - cfg.plot_shoulder, F.lit(0)).alias("s"), (F.col("e") + cfg.plot_shoulder).alias("e"), F.col("s").alias("own_s"), F.col("e").alias("own_e"), "consensus_id", F.coalesce("consensus_transcript_name", "consensus_id").alias("title"), "consensus_class", "samples", *MEANS)


def coverage_data(loci: DataFrame, stores: DataFrame, bins: int = BINS) -> DataFrame:
    """Pooled channels of every sample in each locus's window."""
    hits = overlap_join(stores, loci.select("chrom", "s", "e", "cluster"), ["chrom"])
    rows = hits.select(F.col("b_cluster").alias("cluster"), F.col("a_sample").alias("sample"), F.col("a_s").alias("s"), F.col("a_e").alias("e"), F.col("b_s").alias("from"), F.col("b_e").alias("to"), *[F.col(f"a_{c}").alias(c) for c in CHANNELS])
    return max_pool(rows, ["cluster", "sample"], CHANNELS, "from", "to", bins)


def y_scale(pooled: DataFrame) -> DataFrame:
    """By locus, the greatest stacked depth of a strand in any sample."""
    plus, minus = (sum((F.col(c) for c in CHANNELS if c.endswith(s)), F.lit(0)) for s in ("plus", "minus"))
    return pooled.groupBy("cluster").agg(F.max(F.greatest(plus, minus)).alias("top"))


def lanes(loci: DataFrame, sources: dict[str, DataFrame]) -> DataFrame | None:
    out = None
    for label, f in sources.items():
        hits = overlap_join(loci.withColumn("chrom_key", normalise_chrom(F.col("chrom"))).select("chrom_key", "s", "e", "cluster"), f.select("chrom_key", "s", "e", "ftype", "fid", "strand"), ["chrom_key"])
        rows = hits.select(F.col("a_cluster").alias("cluster"), F.lit(label).alias("label"), F.col("b_s").alias("s"), F.col("b_e").alias("e"), F.col("b_ftype").alias("ftype"), F.col("b_fid").alias("fid"), F.col("b_strand").alias("strand"))
        out = rows if out is None else out.unionByName(rows)
    return out


#: Columns of the candidate table that a page's evidence shows, beside the sample.
EVIDENCE = ("region_id", "class", "avg_depth", "max_depth", "covered_fraction", "unique_fraction", "dual_strand_fraction", "profile_correlation", "dominant_strand", "context_label", "nearest_feature_id", "nearest_feature_distance", "reason_for_classification")
MEANS = ("mean_unique_fraction", "mean_dual_strand_fraction", "mean_profile_correlation", "mean_avg_depth")


def reference_genes(spark: SparkSession, gtf: str | None) -> dict[str, DataFrame]:
    """The lane of the reference's gene lines; pages do without a file that can't be read."""
    if not gtf:
        return {}
    try:
        found = text.overlay_features(spark, gtf, "gene", ("gene",)).cache()
        log.info("%d reference genes for the pages", found.count())
        return {"gene": found}
    except Exception as error:  # noqa: BLE001
        log.warning("no reference genes on the pages: %s", error)
        return {}


def shown(value) -> str:
    """NA for nothing, three significant digits of fractions, escaped."""
    if value is None:
        return "NA"
    return html.escape(f"{value:.3g}" if isinstance(value, float) else str(value))


def _lane(label: str, features: list, s: int, e: int) -> str:
    width, shapes = 900, []
    for f in features:
        x, to = (max(s, f["s"]) - s) / max(1, e - s) * width, (min(e, f["e"]) - s) / max(1, e - s) * width
        name = f"{shown(f['ftype'])} {shown(f['fid'])} {f['s'] + 1}-{f['e']} {shown(f['strand'])}"
        shapes.append(f'<rect x="{x:.1f}" y="2" width="{max(1.0, to - x):.1f}" height="10" fill="#38a169"><title>{name}</title></rect>')
    return f'<div><b>{shown(label)}</b><br><svg width="{width}" height="14">{"".join(shapes)}</svg></div>'


def _bars(rows: list, s: int, e: int, top: int) -> str:
    width, half = 900, 60
    shapes = []
    for r in rows:
        x = (r["x"] - s) / max(1, e - s) * width
        for side, sign in (("plus", -1), ("minus", 1)):
            base = half
            for k, colour in (("unique", "#2b6cb0"), ("dup", "#d69e2e"), ("multi", "#a0aec0")):
                h = r[f"{k}_{side}"] / max(1, top) * half
                if h:
                    shapes.append(f'<rect x="{x:.1f}" y="{base - h if sign < 0 else base:.1f}" width="1" height="{h:.1f}" fill="{colour}"/>')
                    base += sign * h
    return f'<svg width="{width}" height="{2 * half}"><line x1="0" y1="{half}" x2="{width}" y2="{half}" stroke="#333"/>{"".join(shapes)}</svg>'


def _page(locus: dict, cover: list, top: int, features: list, evidence: list) -> str:
    esc = lambda x: html.escape(str(x))
    body = [f"<h1>{esc(locus['title'])}</h1><p>{esc(locus['chrom'])}:{locus['own_s'] + 1}-{locus['own_e']} {esc(locus['consensus_class'])}, shown from {locus['s'] + 1} to {locus['e']}</p>"]
    for sample in sorted({r["sample"] for r in cover}):
        body.append(f"<h2>{esc(sample)}</h2>" + _bars([r for r in cover if r["sample"] == sample], locus["s"], locus["e"], top))
    body.append("<h2>Features</h2>")
    for label in sorted({f["label"] for f in features}):
        own = sorted((f for f in features if f["label"] == label), key=lambda f: (f["s"], f["e"]))
        body.append(_lane(label, own, locus["s"], locus["e"]))
        body.append("<ul>" + "".join(f"<li>{esc(f['label'])}: {esc(f['ftype'])} {esc(f['fid'])} {f['s'] + 1}-{f['e']}</li>" for f in own) + "</ul>")
    body.append("<h2>Evidence</h2><table>" + "".join(f"<tr><th>{n}</th><td>{shown(locus[n])}</td></tr>" for n in MEANS) + "</table>")
    names = ["sample", *EVIDENCE]
    body.append("<table><tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>" + "".join("<tr>" + "".join(f"<td>{shown(r.get(n))}</td>" for n in names) + "</tr>" for r in evidence) + "</table>")
    return "<!doctype html><meta charset='utf-8'><title>" + esc(locus["title"]) + "</title>" + "\n".join(body)


def build(spark: SparkSession, cfg: MergeConfig, g: DataFrame, rows: DataFrame, sources: dict[str, DataFrame]) -> str:
    """Writes the pages and an index, locus by locus; returns the folder."""
    folder = f"{cfg.out_prefix}_plots"
    loci = targets(g, cfg)
    stores = None
    for path in cfg.coverage_stores or store_paths(cfg):
        one = spark.read.parquet(path).withColumn("chrom", F.col("chrom").cast("string")).withColumn("sample", F.col("sample").cast("string"))
        stores = one if stores is None else stores.unionByName(one)
    pooled = coverage_data(loci, stores) if stores is not None else None
    genes = reference_genes(spark, cfg.reference_gtf)
    lane = lanes(loci, {**sources, **({f"{k} (reference)" if k in sources else k: v for k, v in genes.items()})})
    member = g.select("cluster", F.explode(F.arrays_zip("member_samples", "member_region_ids")).alias("m"))
    member = member.select("cluster", F.col("m.member_samples").alias("sample"), F.col("m.member_region_ids").alias("region_id")).distinct()
    fractions = {name for name, digits in sinks.CANDIDATE_COLUMNS if digits is not None}
    have = [F.col(c).try_cast("double").alias(c) if c in fractions else F.col(c) for c in ("sample", *EVIDENCE) if c in rows.columns]
    evidence = member.join(rows.select(*have).dropDuplicates(["sample", "region_id"]), ["sample", "region_id"])
    by = lambda df: df.groupBy("cluster").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "cluster"])).alias("rows"))
    whole = loci.join(by(evidence).withColumnRenamed("rows", "evidence"), "cluster", "left")
    if pooled is not None:
        whole = whole.join(by(pooled.orderBy("x")).withColumnRenamed("rows", "cover"), "cluster", "left").join(y_scale(pooled), "cluster", "left")
    if lane is not None:
        whole = whole.join(by(lane).withColumnRenamed("rows", "lanes"), "cluster", "left")
    index: list[tuple[str, str]] = []
    used: set[str] = set()
    for r in whole.orderBy("chrom", "own_s").toLocalIterator():  # one locus at a time, bins bounded
        d = r.asDict(recursive=True)
        stem = re.sub(r"[^A-Za-z0-9_.-]+", "_", d["title"])
        name = f"{stem}.html" if stem not in used else f"{stem}_{len(index)}.html"  # titles can be alike without their signs
        used.add(stem)
        cover = sorted(d.get("cover") or [], key=lambda x: (x["sample"], x["x"]))
        sinks.write_text(f"{folder}/{name}", _page(d, cover, d.get("top") or 1, d.get("lanes") or [], d.get("evidence") or []))
        index.append((name, d["title"]))
    items = "".join(f'<li><a href="{html.escape(n)}">{html.escape(t)}</a></li>' for n, t in index)
    sinks.write_text(f"{folder}/index.html", "<!doctype html><meta charset='utf-8'><title>Loci</title><ul>" + items + "</ul>")
    return folder
