"""MinHash near-duplicate detection with min-max hashing.

Every permutation of a document's shingle set yields two signature values, its
minimum and its maximum, so 24 hash evaluations a shingle fill 48 values. They
are cut into 16 bands of 3; a pair of Jaccard similarity 0.85 shares at least
one band but for a probability of 3e-7, one of 0.8 but for 1e-5. Whatever shares a band is a candidate
and is confirmed on the full sets.

Skew: equal sets collapse into one class first, so copies are never paired.
Classes are known by 128 bits of sums over their whole set and its size: the
sets of copies are not moved to compare them. What a hot center or a hot bucket
needs is dealt to many tasks (``common.spread``). A band's bucket has a center, its member whose bands are the most
common ones, and every other member is confirmed against it: linear in the
bucket. What the center doesn't confirm (outsiders) can still link with other
members of its buckets. Let D(x) be the symmetric difference of x and the
center. Two members link only if their D share at least

    k = (|D(u)| + |D(v)| - t (|u| + |v|)) / 2,  t = (100 - percent) / (100 + percent)

shingles, and for an outsider k is over half of what the other one has. So both
are looked up by a prefix of their D, its rarest shingles, of length |D| - k + 1
by the least k possible for them: members that link share one of these, and
behind the first they share both have room for k. Pairs found so, from different
components, are confirmed on the full sets. No pair that shares a band is lost,
and no bucket is expanded into all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, components, cut, shared_dir, spread, trimmed
from .textvec import U, runs, shingle_sets, splitmix

PERMUTATIONS, ROWS = 24, 3


def min_max_bands(values: np.ndarray, at: np.ndarray, permutations: int = PERMUTATIONS, rows: int = ROWS) -> np.ndarray:
    """Band hashes, one row a set: of minima in the first half of the columns,
    of maxima in the second. Empty sets give zeros."""
    n = len(at) - 1
    full = np.flatnonzero(np.diff(at) > 0)
    keys, add = splitmix(permutations, 7) | U(1), splitmix(permutations, 8)
    out = np.zeros((n, 2 * permutations // rows), U)
    if not len(full):
        return out
    starts = at[full]
    with np.errstate(over="ignore"):
        for p in range(permutations):
            v = (values ^ add[p]) * keys[p]
            v ^= v >> U(31)
            v *= U(0xD6E8FEB86659FD93)
            for half, f in ((0, np.minimum), (permutations // rows, np.maximum)):
                got = f.reduceat(v, starts)
                b = half + p // rows
                out[full, b] = (out[full, b] ^ (got >> U(17)) ^ got) * U(0x9E3779B97F4A7C15) + U(p)
    return out


def _small(batches):
    """(first column, texts) of runs of rows with a bounded number of bytes."""
    for b in batches:
        texts = b.column(b.num_columns - 1).to_pylist()
        for lo, hi in runs(texts):
            yield b.slice(lo, hi - lo), texts[lo:hi]


def _signatures(batches, k: int):
    for b, texts in _small(batches):
        values, at = shingle_sets(texts, k)
        bands = min_max_bands(values, at).view(np.int64)
        n = np.diff(at)
        with np.errstate(over="ignore"):
            total = np.concatenate(([U(0)], np.cumsum(values, dtype=U)))
            spread_out = values * U(0xBF58476D1CE4E5B9)
            spread_out ^= spread_out >> U(29)
            total2 = np.concatenate(([U(0)], np.cumsum(spread_out * U(0x94D049BB133111EB), dtype=U)))
            d1, d2 = total[at[1:]] - total[at[:-1]], total2[at[1:]] - total2[at[:-1]]
        w = bands.shape[1]
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * w, pa.int32()), pa.array(bands.ravel()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), rows], ["id", "h", "n", "d1", "d2", "bands"])


def _sets(batches, k: int):
    for b, texts in _small(batches):
        values, at = shingle_sets(texts, k)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))], ["node", "items"])


def _apart(f):
    """f(x, y) of two set columns, evaluated outside generated code: the loops of
    set operations, fused with joins, can cost the compiler far over 1 GB."""
    return F.element_at(F.transform(F.array(F.struct("x", "y")), lambda p: f(p["x"], p["y"])), 1)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of full sets."""
    left = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    right = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    both = pairs.join(left, "b").join(right, "a").withColumn("i", _apart(lambda x, y: F.size(F.array_intersect(x, y))).cast("long"))
    return both.filter(100 * F.col("i") >= percent * (F.size("x") + F.size("y") - F.col("i"))).select("a", "b")


def _differences(star: DataFrame, sets: DataFrame, work: str) -> DataFrame:
    """Pairs (a, b) of ``star`` with the sizes n_a and n_b of their sets and d,
    their symmetric difference. A center's set goes to as many tasks as its
    pairs need."""
    arms = cut(star.groupBy("a").agg(F.count("*").alias("arms")), f"{work}/arms")
    centers = cut(arms.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a"), f"{work}/centers")
    left = star.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    both = spread(left, centers, ["a"], "arms")
    differ = _apart(lambda x, y: F.concat(F.array_except(x, y), F.array_except(y, x)))
    return both.select("a", "b", F.size("x").alias("n_a"), F.size("y").alias("n_b"), differ.alias("d"))


def _classes(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, work: str) -> tuple[DataFrame, DataFrame]:
    """(signatures, classes). A signature row for each row of ``docs``: id, h
    (hash of the text), n, d1, d2. A row for each distinct set (n, d1, d2): its
    copies, and as component and first_h the id and h of the first row of its
    component, by id (nulls last), then h."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("binary").alias("t"))
    sigs = cut(texts.mapInArrow(lambda it: trimmed(_signatures(it, k)), "id long, h long, n long, d1 long, d2 long, bands array<long>"), f"{work}/sigs")
    key = ["n", "d1", "d2"]
    first = F.min(F.struct(F.col("id").isNull(), "id", "h")).alias("first")
    grouped = sigs.filter("n > 0").groupBy(*key).agg(first, F.count("*").alias("copies"), F.first("bands").alias("bands"))
    grouped = cut(grouped.select(*key, "copies", "bands", F.col("first.id").alias("id"), F.col("first.h").alias("h")), f"{work}/grouped")
    # Nodes are numbered in the order of ids, so that the smallest node of a component has its smallest id.
    order = [F.asc_nulls_last("id"), F.asc("h")]
    classes = cut(grouped.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()), f"{work}/classes")
    banded = classes.select("node", F.posexplode("bands").alias("band", "value"))
    buckets = cut(banded.groupBy("band", "value").agg(F.count("*").alias("members")).filter("members > 1"), f"{work}/buckets")
    members = cut(spread(banded, buckets, ["band", "value"], "members"), f"{work}/members")
    # How common a class's bands are; the most central member leads its bucket.
    common = members.groupBy("node").agg(F.sum("members").alias("common"))
    named = members.join(common, "node")
    centers = named.groupBy("band", "value").agg(F.max_by("node", F.struct("common", -F.col("node"))).alias("center"), F.count("*").alias("members"))
    centers = cut(centers, f"{work}/leads")
    star = spread(members.select("band", "value", "node"), centers, ["band", "value"], "members").filter("node <> center")
    star = cut(star.select(F.col("center").alias("a"), F.col("node").alias("b")).distinct(), f"{work}/star")
    wanted = classes.select("node", "id", "h").join(members.select("node").distinct(), "node", "left_semi")
    wanted = cut(wanted.select("node", F.col("id").alias("_id"), F.col("h").alias("_h")), f"{work}/wanted")
    read = texts.join(checked(wanted), F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("node", "t")
    sets = cut(read.mapInArrow(lambda it: trimmed(_sets(it, k)), "node long, items array<long>").dropDuplicates(["node"]), f"{work}/sets")
    t = F.lit((100 - percent) / (100 + percent))
    size = F.col("n_a") + F.col("n_b")
    linked = (100 - percent) * size >= (100 + percent) * F.size("d")
    measured = cut(_differences(star, sets, work).withColumn("linked", linked), f"{work}/measured")
    links = measured.filter("linked").select("a", "b")
    labels = components(links, f"{work}/c1")
    # Groups of a center with outsiders, and in each the shingles that differ from the center's, with their counts.
    groups = measured.groupBy("a").agg(F.count("*").alias("m"), F.count_if(~F.col("linked")).alias("outside")).filter("m > 1 and outside > 0")
    groups = cut(groups, f"{work}/groups")
    eps = 1e-9
    least_out = F.greatest(F.lit(1), F.ceil((F.size("d") - t * size) / 2 - eps))
    least_in = F.greatest(F.lit(1), F.ceil((F.size("d") - t * (F.col("n_b") - F.col("n_a"))) / 2 - eps))
    differing = spread(measured, groups, ["a"], "m").withColumn("as_in", F.size("d") - least_in + 1).withColumn("as_out", F.size("d") - least_out + 1)
    differing = differing.select("a", "b", "n_b", "linked", "as_in", "as_out", F.explode("d").alias("item"))
    counts = cut(differing.groupBy("a", "item").agg(F.count("*").alias("df")), f"{work}/counts")
    counted = spread(differing, counts, ["a", "item"], "df")
    ranked = counted.groupBy("a", "b", "n_b", "linked", "as_in", "as_out").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("d"))
    prefix = ranked.select("a", "b", "n_b", "linked", "as_in", "as_out", F.size("d").alias("n_d"), F.posexplode("d").alias("place", "x")).filter("x.df > 1 and place < greatest(as_in, as_out)")
    prefix = prefix.join(labels.withColumnRenamed("node", "b"), "b", "left").select("a", "b", "n_b", "n_d", "linked", F.coalesce("label", "b").alias("label"), "place", "as_in", "as_out", F.col("x.item").alias("item"))
    prefix = cut(prefix, f"{work}/prefix")
    inner = prefix.filter("place < as_in").select("a", "item", F.col("b").alias("v"), F.col("label").alias("label_v"), F.col("n_b").alias("n_v"), F.col("n_d").alias("d_v"), F.col("place").alias("at_v"))
    outer = prefix.filter("not linked and place < as_out").select("a", "item", F.col("b").alias("u"), "label", "n_b", "n_d", "place")
    # Behind the first shingle that both share, each must have enough left to reach k.
    need = (F.col("n_d") + F.col("d_v") - t * (F.col("n_b") + F.col("n_v"))) / 2 - eps
    room = F.least(F.col("n_d") - F.col("place"), F.col("d_v") - F.col("at_v")) >= need
    o, i = outer.alias("o"), inner.alias("i")
    cross = o.join(i, (F.col("o.a") == F.col("i.a")) & (F.col("o.item") == F.col("i.item")) & (F.col("u") != F.col("v")) & (F.col("label") != F.col("label_v")) & room)
    cross = cross.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    more = cut(_confirmed(cross, sets, percent), f"{work}/cross")
    if more.limit(1).count():
        labels = components(links.unionByName(more), f"{work}/c2")
    heads = cut(labels.groupBy("label").agg(F.count("*").alias("nodes")).join(classes.select(F.col("node").alias("label"), F.col("id").alias("component"), F.col("h").alias("first_h")), "label"), f"{work}/heads")
    placed = classes.join(spread(labels, heads, ["label"], "nodes").select("node", "component", "first_h", F.lit(True).alias("moved")), "node", "left")
    own = lambda c, d: F.when(F.col("moved"), F.col(c)).otherwise(F.col(d)).alias(c)
    return sigs.drop("bands"), cut(placed.select(*key, "copies", own("component", "id"), own("first_h", "h")), f"{work}/placed")


def _placed(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, work: str) -> DataFrame:
    sigs, classes = _classes(docs, id_col, text_col, k, percent, work)
    return spread(sigs, classes, ["n", "d1", "d2"], "copies", "left").withColumn("component", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 85) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id (the
    smallest id it reaches over links), kept (it is that id itself).

    Null or empty texts have no shingles and link with nothing, and stay. Equal
    sets always link. Rows are documents even where they repeat an id: each
    links by its own text. A null id counts only where no other is reached; such
    rows are never kept. Other columns, whatever their names, are ignored. An
    empty table gives no rows.
    """
    out = _placed(docs, id_col, text_col, k, percent, shared_dir(docs.sparkSession))
    component = F.col("component")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 85) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the
    smallest id (null last), of equal ids that of the smallest hash of the text,
    of rows equal in both one by the hash of all columns. Rows without words are
    no group and all stay. Columns stay as they are."""
    work = shared_dir(docs.sparkSession)
    placed = cut(_placed(docs, id_col, text_col, k, percent, work).filter("n > 0").withColumn("stays", F.col("id").eqNullSafe(F.col("component")) & (F.col("h") == F.col("first_h"))), f"{work}/rows")
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    named = lambda df: df.select(F.col("id").alias("_id"), F.col("h").alias("_h"))
    gone = cut(named(placed.filter("not stays")).distinct(), f"{work}/gone")
    rest = rows.join(checked(gone), same, "left_anti")
    again = cut(named(placed.filter("stays").groupBy("id", "h").agg(F.count("*").alias("c")).filter("c > 1")), f"{work}/again")
    if not again.limit(1).count():
        return rest.select("doc.*")
    repeats = rest.join(checked(again), same, "left_semi").groupBy("id", "h").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
    return rest.join(checked(again), same, "left_anti").select("doc.*").unionByName(repeats.select("doc.*"))
