"""Interval operators on half-open ``[s, e)`` rows.

Range joins go by bins, so that the equi-join on (keys, bin) spreads one
chromosome over many tasks; a pair counts in the bin of the later start alone.
Islands are found within tiles first and stitched across tiles on the small
table of runs, so no window ever spans the rows of a whole chromosome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _on(a: str, b: str, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"{a}.{k}") == F.col(f"{b}.{k}"))
    return cond


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Equal values, nulls included; the right side's names begin with ``_``."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & left[c].eqNullSafe(right[f"_{c}"])
    return cond


def binned(df: DataFrame, width: int, s: str = "s", e: str = "e") -> DataFrame:
    """A row for every bin that [s, e) touches; an empty interval has one bin."""
    last = F.floor((F.greatest(F.col(e) - 1, F.col(s))) / width)
    return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col(s) / width), last)))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], width: int = 10_000, how: str = "inner") -> DataFrame:
    """Pairs with a.s < b.e and a.e > b.s, as columns of ``a`` (named a_*) and
    ``b`` (b_*), keys once. ``how='left'`` keeps rows of ``a`` without partner."""
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in a.columns if c not in keys])
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys])
    x = binned(left, width, "a_s", "a_e")
    y = binned(right, width, "b_s", "b_e")
    hit = x.join(y, [*keys, "bin"]).filter((F.col("a_s") < F.col("b_e")) & (F.col("a_e") > F.col("b_s")) & (F.floor(F.greatest("a_s", "b_s") / width) == F.col("bin"))).drop("bin")
    if how == "inner":
        return hit
    # Whether a row has a partner depends on its place alone; ids of rows could differ from one evaluation to the next.
    place = [*keys, "a_s", "a_e"]
    met = hit.select(*[F.col(c).alias(f"_{c}") for c in place]).distinct()
    lonely = left.join(met, _same(left, met, place), "left_anti")
    return hit.unionByName(lonely, allowMissingColumns=True)


def islands(runs: DataFrame, keys: list[str], max_gap: int = 0, tile: int | None = 1_000_000) -> DataFrame:
    """Merges intervals closer than or as close as ``max_gap`` (0: touching or
    overlapping): keys, s, e, n (intervals merged)."""

    def merged(df: DataFrame, part: list[str]) -> DataFrame:
        order = Window.partitionBy(*part).orderBy("s", "e")
        reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
        new = F.when(F.col("s") - reach <= max_gap, 0).otherwise(1)
        marked = df.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return marked.groupBy(*part, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("n").alias("n")).drop("_island")

    rows = runs.select(*keys, "s", "e", F.lit(1).cast("long").alias("n"))
    if tile:
        rows = merged(rows.withColumn("_tile", F.floor(F.col("s") / tile)), [*keys, "_tile"]).drop("_tile")
    return merged(rows, keys)


def union_length(runs: DataFrame, keys: list[str], out: str = "bp") -> DataFrame:
    """Bases under the union of intervals."""
    return islands(runs, keys).groupBy(*keys).agg(F.sum(F.col("e") - F.col("s")).alias(out))


def contained_points(points: DataFrame, spans: DataFrame, keys: list[str], pos: str = "pos", width: int = 10_000) -> DataFrame:
    """Point rows that lie in one of the intervals, once each (left semi)."""
    x = points.withColumn("bin", F.floor(F.col(pos) / width))
    y = binned(spans.select(*keys, "s", "e"), width)
    return x.alias("a").join(y.alias("b"), _on("a", "b", [*keys, "bin"]) & (F.col(f"a.{pos}") >= F.col("b.s")) & (F.col(f"a.{pos}") < F.col("b.e")), "left_semi").drop("bin")


def nearest(a: DataFrame, b: DataFrame, keys: list[str], order: list[str], tile: int = 1_000_000) -> DataFrame:
    """For every row of ``a`` the closest row of ``b`` on the same keys, at any
    distance, ties by ``order``: columns of a, then near (a struct of b's) and
    distance; -1 and null where ``b`` has none.

    The best partner overlaps, or has the greatest end at or before a.s, or the
    least start at or after a.e. Overlaps come from the range join; the two
    others from running extremes over both tables' rows, kept as structs. All of
    it is found for places, as ids of rows could differ between evaluations.
    """
    own = [c for c in b.columns if c not in keys]
    thing = F.struct(*[F.col(c) for c in own])
    rows = a.select(*keys, "s", "e").distinct()
    hits = overlap_join(rows, b, keys).withColumn("near", F.struct(*[F.col(f"b_{c}").alias(c) for c in own]))
    hits = hits.select(*keys, F.struct(F.col("a_s").alias("s"), F.col("a_e").alias("e")).alias("_row"), "near", F.lit(0).cast("long").alias("distance"))
    rows = rows.select(*keys, F.struct("s", "e").alias("_row"))
    # Sides: one candidate for each point, as-of by end (before) and by start (behind).
    ends = b.select(*keys, F.col("e").alias("pos"), thing.alias("near")).groupBy(*keys, "pos").agg(F.min_by("near", F.struct(*[F.col(f"near.{c}") for c in order])).alias("near"))
    starts = b.select(*keys, F.col("s").alias("pos"), thing.alias("near")).groupBy(*keys, "pos").agg(F.min_by("near", F.struct(*[F.col(f"near.{c}") for c in order])).alias("near"))
    before = _as_of(rows.select(*keys, F.col("_row.s").alias("pos"), "_row"), ends, keys, forward=False)
    behind = _as_of(rows.select(*keys, F.col("_row.e").alias("pos"), "_row"), starts, keys, forward=True)
    sides = before.withColumn("distance", F.col("pos") - F.col("near.e")).unionByName(behind.withColumn("distance", F.col("near.s") - F.col("pos"))).select(*keys, "_row", "near", "distance")
    best = hits.unionByName(sides.filter("near is not null")).groupBy(*keys, "_row").agg(F.min_by(F.struct("near", "distance"), F.struct("distance", *[F.col(f"near.{c}") for c in order])).alias("_best"))
    best = best.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_row.s").alias("_s"), F.col("_row.e").alias("_e"), "_best")
    return a.join(best, _same(a, best, [*keys, "s", "e"]), "left").select(*[a[c] for c in a.columns], F.col("_best.near").alias("near"), F.coalesce("_best.distance", F.lit(-1)).cast("long").alias("distance"))


def _as_of(points: DataFrame, marks: DataFrame, keys: list[str], forward: bool, tile: int = 1_000_000) -> DataFrame:
    """The last mark at or before (or first at or after) each point. Within a
    tile a window finds it; tiles without one take it from the tiles' own table."""
    side = F.col("pos") if not forward else -F.col("pos")
    rows = points.select(*keys, "pos", "_row", F.lit(None).cast(marks.schema["near"].dataType).alias("near")).unionByName(marks.select(*keys, "pos", F.lit(None).cast(points.schema["_row"].dataType).alias("_row"), "near"))
    rows = rows.withColumn("_side", side).withColumn("_tile", F.floor(F.col("_side") / tile))
    # A mark at the point's own position counts: marks sort first.
    order = Window.partitionBy(*keys, "_tile").orderBy("_side", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.last("near", ignorenulls=True).over(order))
    tiles = rows.groupBy(*keys, "_tile").agg(F.max_by("near", F.when(F.col("near").isNotNull(), F.col("_side"))).alias("_last"))
    past = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    tiles = tiles.withColumn("_carry", F.last("_last", ignorenulls=True).over(past)).drop("_last")
    rows = rows.filter("_row is not null").join(tiles, [*keys, "_tile"])
    return rows.select(*keys, "pos", "_row", F.coalesce("_in", "_carry").alias("near"))
