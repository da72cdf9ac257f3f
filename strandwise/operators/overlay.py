"""External interval annotation on consensus regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import gap, name_token
from .intervals import islands, overlap_join

MAX_IDS = 10
COLUMNS = ("n", "types", "ids", "overlap_bp", "overlap_frac", "genes", "nearest", "nearest_distance")


def shown(ftype, fid):
    return F.when(F.coalesce(fid, F.lit("")) == "", ftype).otherwise(F.concat(ftype, F.lit(":"), fid))


def overlaps(regions: DataFrame, features: DataFrame, stranded: bool = False, keys: list[str] = ["chrom_key"], id_col: str = "consensus_id") -> DataFrame:  # noqa: B006
    """Region and feature pairs; with ``stranded``, not those of opposite strands."""
    hits = overlap_join(regions.select(*keys, "s", "e", id_col, "strand"), features, keys)
    differ = F.col("a_strand").isin("+", "-") & F.col("b_strand").isin("+", "-") & (F.col("a_strand") != F.col("b_strand"))
    return hits.filter(~differ) if stranded else hits


def annotated(regions: DataFrame, features: DataFrame, window: int = 10_000, stranded: bool = False, id_col: str = "consensus_id", most_ids: int | None = MAX_IDS) -> DataFrame:
    """One row a region: id, the eight columns and types_map. Features that
    overlap, or else the nearest one closer than ``window`` (the bound itself is
    too far; one that only touches has distance 0). Without one nearest is NA, its
    distance -1; with overlaps they are NA and 0. Of more ids than ``most_ids`` the
    text has the first ones and the number left out; None lists all."""
    rid = F.col(f"a_{id_col}").alias(id_col)
    hits = overlaps(regions, features, stranded, id_col=id_col)
    types = hits.groupBy(rid, F.col("b_ftype").alias("ftype")).agg(F.count("*").alias("c"))
    types = types.groupBy(id_col).agg(F.sum("c").alias("n"), F.array_sort(F.collect_list(F.struct("ftype", "c"))).alias("t"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("b_s").alias("s"), F.col("b_e").alias("e"), F.col("b_ord").alias("ord"), F.col("b_fid").alias("fid"), F.col("b_genes").alias("genes"))))
    lists = hits.groupBy(rid).agg(ordered.alias("f"))
    clipped = hits.select(rid, F.greatest("a_s", "b_s").alias("s"), F.least("a_e", "b_e").alias("e"))
    bp = islands(clipped, [id_col], tile=None).groupBy(id_col).agg(F.sum(F.col("e") - F.col("s")).alias("overlap_bp"))
    wide = regions.withColumn("_s", F.col("s")).withColumn("_e", F.col("e")).withColumn("s", F.col("s") - window).withColumn("e", F.col("e") + window)
    near = overlap_join(wide.select("chrom_key", "s", "e", "_s", "_e", id_col, "strand").join(types.select(id_col), id_col, "left_anti"), features, ["chrom_key"])
    if stranded:
        near = near.filter(~(F.col("a_strand").isin("+", "-") & F.col("b_strand").isin("+", "-") & (F.col("a_strand") != F.col("b_strand"))))
    d = gap(F.col("a__s"), F.col("a__e"), F.col("b_s"), F.col("b_e"))
    near = near.withColumn("d", d).groupBy(rid).agg(F.min_by(F.struct(shown(F.col("b_ftype"), F.col("b_fid")).alias("nearest"), F.col("d").alias("nearest_distance")), F.struct("d", "b_s", "b_e", "b_ord")).alias("x"))
    ids = F.filter(F.transform("f", lambda x: x["fid"]), lambda i: F.coalesce(i, F.lit("")) != "")
    shown_ids = F.array_join(ids, ";")
    if most_ids is not None:
        shown_ids = F.when(F.size(ids) > most_ids, F.concat(F.array_join(F.slice(ids, 1, most_ids), ";"), F.lit(";+"), (F.size(ids) - most_ids).cast("string"), F.lit("_more"))).otherwise(shown_ids)
    genes = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform("f", lambda x: F.coalesce(x["genes"], F.array().cast("array<string>")))))), ",")
    full = regions.select(id_col, (F.col("e") - F.col("s")).alias("_len")).join(types, id_col, "left").join(lists, id_col, "left").join(bp, id_col, "left").join(near, id_col, "left")
    hit = F.col("n").isNotNull()
    none = F.lit("NA")
    text = lambda c: F.when(hit & (c != ""), c).otherwise(none)
    return full.select(
        id_col, F.coalesce("n", F.lit(0)).alias("n"), text(F.array_join(F.transform("t", lambda x: F.concat(x["ftype"], F.lit(":"), x["c"].cast("string"))), ",")).alias("types"), text(shown_ids).alias("ids"),
        F.coalesce("overlap_bp", F.lit(0)).alias("overlap_bp"), F.when(F.col("_len") > 0, F.coalesce("overlap_bp", F.lit(0)).cast("double") / F.col("_len")).otherwise(0.0).alias("overlap_frac"), text(genes).alias("genes"),
        F.when(~hit & F.col("x").isNotNull(), F.col("x.nearest")).otherwise(none).alias("nearest"), F.when(hit, F.lit(0)).otherwise(F.coalesce("x.nearest_distance", F.lit(-1))).cast("long").alias("nearest_distance"), F.transform(F.coalesce("t", F.array().cast("array<struct<ftype:string,c:bigint>>")), lambda x: x["ftype"]).alias("type_list"),
    )


def footprint(features: DataFrame) -> DataFrame:
    """Union bases by feature type, over all chromosomes."""
    return islands(features, ["chrom_key", "ftype"]).groupBy("ftype").agg(F.sum(F.col("e") - F.col("s")).alias("bp"))


def crosstab(annotated_rows: DataFrame, classes: DataFrame, id_col: str = "consensus_id") -> DataFrame:
    """For each label, class and type: regions with such a feature; type null
    for regions with any; n_regions counts the class's regions."""
    rows = annotated_rows.join(classes, id_col)
    every = rows.groupBy("label", "class").agg(F.count_distinct(id_col).alias("n_regions"), F.count_distinct(F.when(F.col("n") > 0, F.col(id_col))).alias("n_with"))
    by = rows.withColumn("ftype", F.explode("type_list")).groupBy("label", "class", "ftype").agg(F.count_distinct(id_col).alias("n_with"))
    by = by.join(every.select("label", "class", "n_regions"), ["label", "class"])
    return every.withColumn("ftype", F.lit(None).cast("string")).select("label", "class", "ftype", "n_regions", "n_with").unionByName(by.select("label", "class", "ftype", "n_regions", "n_with"))


def source_stats(annotated_rows: DataFrame) -> DataFrame:
    return annotated_rows.groupBy("label").agg(F.count("*").alias("n_regions"), F.count_if(F.col("n") > 0).alias("n_with_overlap"))


def check_chromosomes(regions: DataFrame, features: DataFrame, label: str) -> None:
    """Raises unless some chromosome is on both sides or a side is empty."""
    a, b = regions.select("chrom_key").distinct(), features.select("chrom_key").distinct()
    if a.limit(1).count() and b.limit(1).count() and not a.join(b, "chrom_key", "left_semi").limit(1).count():
        raise ValueError(f"annotation {label} shares no chromosome name with the regions")


def token(columns: list):
    """Name token: the first type, by code point, of the first source that hits."""
    return F.coalesce(*[F.when(F.size(c) > 0, name_token(F.array_min(c))) for c in columns])
