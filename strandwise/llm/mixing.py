"""Mixing sources to target weights by a low-discrepancy schedule.

Slots of equal word counts are numbered 0, 1, 2, ...; slot i takes the source
in whose share of the cumulative targets the golden-ratio point frac((i + 1/2) *
phi) falls, so that every run of slots is close to the targets. A source's k-th
slot takes its k-th block: the source's documents, shuffled by a hash, form a
stream of words that repeats, cut into blocks of equal words. A source takes
its target to the word: its last block is cut there, and what the schedule
leaves it short of follows in slots behind all others.

Skew: orders and running sums within a source go by hash buckets (sums over
buckets first, then within each), ranks within a source by runs of slots, and
what a source's rows need to know of it by salted copies, so a source with most
of the rows is never in one task. Sources are found for points by ranges of the
points, not by a list of all sources; tables with a row for each source are the
only ones that a single task sorts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checked, cut, shared_dir

#: frac(golden ratio) as a 62-bit fraction, in three digits of 21 bits.
PHI = 2850126214211066189
DIGIT = (1 << 21) - 1
ONE = 1 << 62
BUCKET_DOCS, RUN, SALTS, RANGES = 512, 4096, 32, 1 << 12
BEFORE = Window.unboundedPreceding


def targets(sizes: DataFrame, max_times: int = 3) -> DataFrame:
    """``sizes(source, source_size)`` with number (its rank), weight, target and
    words (the target, rounded).

    Sources by code point, null last, weigh 1, 2, 3, repeating. Targets share
    all sizes by weight; where a target passes ``max_times`` its source's size
    it stops there and the excess is shared anew. In the order of size over
    weight the stopped sources come first, so one pass finds the level at which
    the others share. The table has a row for each source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    s = sizes.withColumn("number", F.row_number().over(by_name).cast("long"))
    s = s.withColumn("weight", ((F.col("number") - 1) % 3 + 1).cast("double")).withColumn("most", F.col("source_size") * float(max_times))
    by_room = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    stopped = F.coalesce(F.sum("most").over(by_room.rowsBetween(BEFORE, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    s = s.withColumn("level", (total - stopped) / open_weight).withColumn("fits", F.col("level") * F.col("weight") <= F.col("most"))
    s = s.withColumn("place", F.row_number().over(by_room))
    level = F.min(F.when(F.col("fits"), F.struct("place", "level"))).over(Window.partitionBy())["level"]
    s = s.withColumn("target", F.least("most", F.coalesce(level * F.col("weight"), F.col("most"))))
    return s.select("source", "number", "source_size", "weight", "target", F.least(F.round("target"), "most").cast("long").alias("words"))


def points(slot):
    """frac((slot + 1/2) * phi) as a 62-bit fraction, without wider numbers: the
    slot times each digit of phi stays below 2^63, what passes 2^62 is dropped."""
    low, mid, high = PHI & DIGIT, PHI >> 21 & DIGIT, PHI >> 42
    parts = (PHI // 2, slot * low), ((slot * mid).bitwiseAND((1 << 41) - 1) * (1 << 21),), ((slot * high).bitwiseAND((1 << 20) - 1) * (1 << 42),)
    x = (F.lit(parts[0][0]) + parts[0][1].bitwiseAND(ONE - 1)).bitwiseAND(ONE - 1)
    for (p,) in parts[1:]:
        x = (x + p).bitwiseAND(ONE - 1)
    return x


def schedule(aimed: DataFrame, block: int, work: str) -> DataFrame:
    """Slots (slot, number, block, n_words): block is the rank of the slot among
    its source's. ``aimed`` is ``targets``'. Every source gets its words: blocks beyond it are left out, the last one is cut, and the
    blocks that the schedule doesn't reach have slots behind the others."""
    spark, in_order = aimed.sparkSession, Window.orderBy("number")
    sums = aimed.select("number", "target", F.sum("target").over(in_order.rowsBetween(BEFORE, 0)).alias("upto"))
    whole = sums.agg(F.max("upto")).first()[0] or 0.0
    n = -(-int(whole) // block)
    if n >= 1 << 41:
        raise ValueError("too many slots for 62-bit points; take larger blocks")
    hi = F.when(F.col("upto") >= whole, F.lit(ONE)).otherwise(F.round(F.col("upto") / F.lit(whole or 1.0) * ONE).cast("long"))
    edges = sums.select("number", hi.alias("hi")).withColumn("lo", F.coalesce(F.lag("hi").over(in_order), F.lit(0))).filter("lo < hi")
    width = ONE // RANGES
    edges = edges.withColumn("range", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    edges = cut(edges, f"{work}/edges")
    slots = spark.range(n).select(F.col("id").alias("slot"), points(F.col("id")).alias("x")).withColumn("range", F.shiftright("x", 62 - RANGES.bit_length() + 1))
    slots = slots.join(checked(edges), "range").filter("x >= lo and x < hi")
    slots = cut(slots.select("slot", "number", F.floor(F.col("slot") / RUN).alias("run")), f"{work}/points")
    counts = cut(slots.groupBy("run", "number").agg(F.count("*").alias("n")).withColumn("group", F.floor(F.col("run") / RUN)), f"{work}/counts")
    # Runs before this one, by whole groups of runs first: no source's counts meet in one task unsummed.
    groups = counts.groupBy("group", "number").agg(F.sum("n").alias("m"))
    groups = groups.withColumn("m", F.coalesce(F.sum("m").over(Window.partitionBy("number").orderBy("group").rowsBetween(BEFORE, -1)), F.lit(0)))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("group", "number").orderBy("run").rowsBetween(BEFORE, -1)), F.lit(0))
    before = counts.withColumn("inner", inner).join(groups, ["group", "number"]).select("run", "number", (F.col("inner") + F.col("m")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("run", "number").orderBy("slot")) - 1
    ranked = slots.withColumn("r", rank).join(before, ["run", "number"]).select("slot", "number", (F.col("before") + F.col("r")).alias("block"))
    aim = aimed.select("number", "words")
    short = aim.join(counts.groupBy("number").agg(F.sum("n").alias("have")), "number", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    short = short.withColumn("need", F.ceil(F.col("words") / block)).filter("need > have")
    first = F.coalesce(F.sum(F.col("need") - F.col("have")).over(in_order.rowsBetween(BEFORE, -1)), F.lit(0)) + n
    short = short.withColumn("first", first).withColumn("block", F.explode(F.sequence(F.col("have"), F.col("need") - 1)))
    extra = short.select((F.col("first") + F.col("block") - F.col("have")).alias("slot"), "number", "block")
    n_words = F.least(F.lit(block).cast("long"), F.col("words") - F.col("block") * block)
    return ranked.unionByName(extra).join(checked(cut(aim, f"{work}/aim")), "number").select("slot", "number", "block", n_words.alias("n_words")).filter("n_words > 0")


def _streams(rows: DataFrame, total: int) -> DataFrame:
    """``rows(number, size, key, ...)`` with at: the words before each row in its
    source's stream, which runs by bucket of the key, then by key and row."""
    buckets = max(1, -(-total // BUCKET_DOCS))
    rows = rows.withColumn("bucket", F.pmod(F.shiftright("key", 8), F.lit(buckets)))
    sums = rows.groupBy("number", "bucket").agg(F.sum("size").alias("w")).withColumn("zone", F.floor(F.col("bucket") / 4096))
    zones = sums.groupBy("number", "zone").agg(F.sum("w").alias("z"))
    zones = zones.withColumn("z", F.coalesce(F.sum("z").over(Window.partitionBy("number").orderBy("zone").rowsBetween(BEFORE, -1)), F.lit(0)))
    inner = F.coalesce(F.sum("w").over(Window.partitionBy("number", "zone").orderBy("bucket").rowsBetween(BEFORE, -1)), F.lit(0))
    base = sums.withColumn("w", inner).join(zones, ["number", "zone"]).select("number", "bucket", (F.col("w") + F.col("z")).alias("base"))
    own = Window.partitionBy("number", "bucket").orderBy("key", "row").rowsBetween(BEFORE, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(own), F.lit(0)))
    return rows.join(base, ["number", "bucket"]).withColumn("at", F.col("at") + F.col("base")).drop("base", "bucket")


def measured(docs: DataFrame, source_col: str = "source", text_col: str = "text", seed: int = 1):
    """``docs`` as doc (a struct, so that no name can clash) with row, source,
    size and key; key shuffles the rows by all their columns' hash."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct("*").alias("doc"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    return rows.withColumn("row", F.monotonically_increasing_id()).withColumn("key", F.xxhash64(F.lit(seed), "doc"))


def arrange(rows: DataFrame, work: str, block: int | None = None, max_times: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plan, pieces, slots) of written ``measured`` rows; see ``mix``."""
    rows = rows.select("row", "source", "size", "key")
    sizes = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), f"{work}/sizes")
    total = sizes.agg(F.sum("source_size"), F.sum("n")).first()
    block = block or max(1, min(128, int(total[0] or 0) >> 20))
    aimed = cut(targets(sizes.drop("n"), max_times), f"{work}/targets")
    slots = cut(schedule(aimed, block, work), f"{work}/slots")
    salted = aimed.select(F.col("source").alias("_s"), "number", "source_size", "target", "words", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = checked(cut(salted, f"{work}/salted"))
    known = rows.withColumn("salt", F.pmod("row", F.lit(SALTS))).join(salted, F.col("source").eqNullSafe(F.col("_s")) & (F.col("salt") == F.col("_salt")))
    known = known.select("row", "number", "size", "key", "source_size", "target", "words")
    placed = cut(_streams(known, int(total[1] or 0)).drop("key"), f"{work}/placed")
    turns = placed.filter("size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(max_times - 1))))
    turns = turns.withColumn("lo", F.col("at") + F.col("turn") * F.col("source_size")).withColumn("hi", F.least(F.col("lo") + F.col("size"), "words")).filter("lo < hi")
    turns = turns.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    begin = F.greatest("lo", F.col("block") * block)
    end = F.least("hi", F.col("block") * block + F.col("n_words"))
    # Slots compress so well that their file size would pass for a small table.
    pieces = turns.join(slots.hint("merge"), ["number", "block"])
    pieces = pieces.select("slot", "number", "block", "row", "turn", (begin - F.col("lo")).alias("from_word"), (end - begin).alias("n_words")).filter("n_words > 0")
    taken = pieces.groupBy("row").agg(F.sum("n_words").alias("taken"))
    plan = placed.join(taken, "row", "left").select("row", "number", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return plan, pieces, slots


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", max_times: int = 3, seed: int = 1, block: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plan, pieces, slots). plan has a row for each row of ``docs``: id, source,
    size, source_size, target, taken; pieces say which words of which row (its
    number, and its id) each slot's block holds (slot, number, block, row, id,
    from_word, n_words, turn); slots are ``schedule``'s.

    A block holds ``block`` words, by default 1/2^20 of all, 1 at least and 128
    at most. Null texts have no words and are never taken; a null source is a
    source. Repeated rows are rows of their own, each with its own place in the
    stream; which of wholly equal ones is which, nobody can tell. Other columns
    only bear on the shuffle. An empty table gives no rows.
    """
    work = shared_dir(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    rows = measured(own, seed=seed).select("row", "source", "size", "key", F.col("doc.id").alias("id"))
    rows = cut(rows, f"{work}/rows")
    plan, pieces, slots = arrange(rows, work, block, max_times)
    names = rows.select("row", F.col("id").alias(id_col), "source")
    out = plan.join(names, "row").select(id_col, "source", "size", "source_size", "target", "taken")
    return out, pieces.join(names.drop("source"), "row"), slots


def repeated(docs: DataFrame, max_times: int = 3, **options) -> DataFrame:
    """``docs`` as often as the mix takes most of their words: once for every
    turn of their source's stream in which half of them or more is scheduled.
    Rows without words are never scheduled. All columns stay as they are."""
    work = shared_dir(docs.sparkSession)
    rows = cut(measured(docs, **options), f"{work}/rows")
    _, pieces, _ = arrange(rows, work, max_times=max_times)
    turns = pieces.groupBy("row", "turn").agg(F.sum("n_words").alias("w"))
    return rows.join(turns, "row").filter("2 * w >= size").select("doc.*")
