"""Strand coverage as run-length rows, masks in the same sweep, region discovery.

Reads and annotation become +1/-1 events clipped to tiles; sums by position and
a running sum inside each tile give segments on which every counter is
constant. A block opens and closes inside its tile, so no state crosses tiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DetectConfig

COUNTERS = ("plus", "minus", "multi", "pmask", "mmask", "exon")


def _flag(cond):
    return F.when(cond, 1).otherwise(0).cast("long")


def read_intervals(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Classified blocks (category, strand, s, e) as intervals with counters;
    multimappers have no strand here."""
    unique = F.col("category") == "unique"
    return blocks.filter("category is not null").select(*keys, "s", "e", _flag(unique & (F.col("strand") == "+")).alias("plus"), _flag(unique & (F.col("strand") == "-")).alias("minus"), _flag(~unique).alias("multi"))


def mask_intervals(mask: DataFrame, keys: list[str], exons: bool = False) -> DataFrame:
    """Annotated intervals (strand, s, e) as intervals with counters; features
    without strand mask both strands."""
    rows = mask.select(*keys, "s", "e", _flag(F.col("strand") != "-").alias("pmask"), _flag(F.col("strand") != "+").alias("mmask"))
    return rows.select(*keys, "s", "e", F.lit(0).cast("long").alias("pmask"), F.lit(0).cast("long").alias("mmask"), F.lit(1).cast("long").alias("exon")) if exons else rows


def sweep(parts: list[DataFrame], keys: list[str], tile: int = 1_000_000, counters: tuple[str, ...] = COUNTERS) -> DataFrame:
    """Segments (keys, tile, s, e, counters) on which all counters are constant;
    those where every one is 0 are left out."""
    rows = None
    for p in parts:
        one = p.filter("s < e").select(*keys, "s", "e", *[F.col(c) if c in p.columns else F.lit(0).cast("long").alias(c) for c in counters])
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.withColumn("tile", F.explode(F.sequence(F.floor(F.col("s") / tile), F.floor((F.col("e") - 1) / tile))))
    ends = F.array(
        F.struct(F.greatest("s", F.col("tile") * tile).alias("pos"), F.lit(1).alias("sign")),
        F.struct(F.least("e", (F.col("tile") + 1) * tile).alias("pos"), F.lit(-1).alias("sign")),
    )
    events = rows.withColumn("x", F.explode(ends))
    sums = events.groupBy(*keys, "tile", F.col("x.pos").alias("s")).agg(*[F.sum(F.col(c) * F.col("x.sign")).alias(c) for c in counters])
    order = Window.partitionBy(*keys, "tile").orderBy("s")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    segs = sums.select(*keys, "tile", "s", F.lead("s").over(order).alias("e"), *[F.sum(c).over(run).alias(c) for c in counters])
    return segs.filter("e is not null").filter(" or ".join(f"{c} <> 0" for c in counters))


def masked(segs: DataFrame, stranded: bool) -> DataFrame:
    """Adds blocked, and takes coverage off masked strands. Multimappers stay."""
    if stranded:
        return segs.withColumn("blocked", (F.col("pmask") > 0) & (F.col("mmask") > 0)).withColumn("plus", F.when(F.col("pmask") > 0, 0).otherwise(F.col("plus"))).withColumn("minus", F.when(F.col("mmask") > 0, 0).otherwise(F.col("minus")))
    return segs.withColumn("blocked", (F.col("pmask") > 0) | (F.col("mmask") > 0))


def regions(segs: DataFrame, keys: list[str], min_depth: int, max_gap: int, tile: int = 1_000_000) -> DataFrame:
    """Maximal runs of covered, unblocked bases, joined over gaps of ``max_gap``
    at most that hold no blocked base: keys, s, e. ``segs`` comes from ``masked``."""
    part = [*keys, "tile"]
    order = Window.partitionBy(*part).orderBy("s")
    # Blocked bases before each segment, within its tile and then from the chromosome's start.
    width = F.when(F.col("blocked"), F.col("e") - F.col("s")).otherwise(0)
    rows = segs.withColumn("b", F.coalesce(F.sum(width).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    tiles = segs.groupBy(*part).agg(F.sum(width).alias("own"))
    tiles = tiles.withColumn("base", F.coalesce(F.sum("own").over(Window.partitionBy(*keys).orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("own")
    covered = rows.filter((F.col("plus") + F.col("minus") >= min_depth) & ~F.col("blocked")).select(*part, "s", "e", "b")

    def bridged(df: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("s")
        gap = F.col("s") - F.lag("e").over(w)
        stop = gap.isNull() | (gap > max_gap) | ((gap > 0) & (F.col("b") > F.lag("b").over(w)))
        marked = df.withColumn("_new", F.when(stop, 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return marked.groupBy(*by, "_run").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min("b").alias("b"), F.max("b").alias("b_end")).drop("_run")

    # A run's covered segments hold no blocked base, nor do its gaps: b is one value throughout.
    runs = bridged(covered, part).drop("b_end").join(tiles, part).withColumn("b", F.col("b") + F.col("base")).drop("base", "tile")
    return bridged(runs, keys).select(*keys, "s", "e")


def in_regions(segs: DataFrame, found: DataFrame, keys: list[str], tile: int = 1_000_000) -> DataFrame:
    """Segments with the region (r_s, r_e) that holds them."""
    spread = found.select(*keys, F.col("s").alias("r_s"), F.col("e").alias("r_e")).withColumn("tile", F.explode(F.sequence(F.floor(F.col("r_s") / tile), F.floor((F.col("r_e") - 1) / tile))))
    return segs.join(spread, [*keys, "tile"]).filter((F.col("s") >= F.col("r_s")) & (F.col("s") < F.col("r_e")))


def totals(segs: DataFrame) -> DataFrame:
    """Genome totals before masking: unique and multimapping base counts."""
    w = F.col("e") - F.col("s")
    return segs.agg(F.coalesce(F.sum(w * (F.col("plus") + F.col("minus"))), F.lit(0)).alias("unique_total"), F.coalesce(F.sum(w * F.col("multi")), F.lit(0)).alias("multi_total"))


def discover(segs: DataFrame, keys: list[str], cfg: DetectConfig, stranded: bool) -> DataFrame:
    """Regions with metrics that pass the length, bases and fraction filters."""
    from .metrics import region_metrics

    own = masked(segs, stranded)
    found = regions(own, keys, cfg.min_depth, cfg.max_gap, cfg.tile)
    m = region_metrics(in_regions(own, found, keys, cfg.tile), keys, cfg.min_depth, cfg.strand_min_depth)
    return m.filter((F.col("length") >= cfg.min_region_length) & (F.col("covered_bases") >= cfg.min_covered_bases) & (F.col("covered_fraction") >= cfg.min_covered_fraction))


def store(segs: DataFrame, path: str, keys: list[str] = ["sample", "chrom"]) -> None:  # noqa: B006
    """The coverage store: run-length rows, a folder for each sample and chromosome."""
    segs.write.mode("overwrite").partitionBy(*keys).parquet(path)


def window(stored: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Stored rows that overlap [start, end), clipped to it; absent bases are 0."""
    rows = stored.filter((F.col("chrom") == chrom) & (F.col("s") < end) & (F.col("e") > start))
    return rows.withColumn("s", F.greatest("s", F.lit(start))).withColumn("e", F.least("e", F.lit(end)))


def max_pool(segs: DataFrame, keys: list[str], channels: list[str], start: str, end: str, bins: int = 3500) -> DataFrame:
    """At most ``bins`` maxima over each locus's window: keys, x (a bin's first
    base) and the channels; bases without rows count as 0 and give no bin."""
    size = F.greatest(F.ceil((F.col(end) - F.col(start)) / bins), F.lit(1))
    rows = segs.withColumn("_size", size).withColumn("_from", F.greatest("s", F.col(start))).withColumn("_to", F.least("e", F.col(end))).filter("_from < _to")
    spread = rows.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("_from") - F.col(start)) / F.col("_size")), F.floor((F.col("_to") - 1 - F.col(start)) / F.col("_size")))))
    x = (F.col(start) + F.col("_bin") * F.col("_size")).alias("x")
    return spread.groupBy(*keys, x).agg(*[F.max(c).alias(c) for c in channels])
