"""Brown class-based n-gram scoring.

P(w | v) = P(class(w) | class(v)) * P(w | class(w)). Classes come from exchange
clustering: a unit moves to the class that gains most likelihood of the class
bigrams. The clustered words are the 4 sqrt(N) most frequent of N training
tokens, the classes N^(1/4) times 0.6 (64 at least), so both grow with the
corpus; each word beyond shares a unit with the words of its shape. The SEEDS
most frequent units exchange one after the other on the driver, over the table
of their bigrams; then all other words exchange in blocks on the executors, each
by its own sparse counts of the classes beside it, in PASSES passes over the
whole training corpus. Emission is smoothed by 0.1, one unseen word reserved in
each class; transitions are smoothed by the classes' own shares.

Words are 64-bit hashes. Words with high counts (FREQUENT at most) are looked
up from a broadcast; the rest are joined with the table of counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir
from .textvec import SHAPES, U, runs, word_hashes

SEEDS, CLASSES, SWEEPS, PASSES, FREQUENT, FLUSH = 1024, 64, 5, 2, 1 << 18, 2_000_000
#: The end of a text as a word, and as a unit.
END = U(0)


def _merged(parts: list) -> list:
    h = np.concatenate([p[0] for p in parts])
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    counts = np.add.reduceat(np.concatenate([p[2] for p in parts])[order], first) if len(h) else np.zeros(0, np.int64)
    return [(h[first], np.concatenate([p[1] for p in parts])[order][first], counts)]


def _counted(batches):
    def rows(p):
        return pa.RecordBatch.from_arrays([pa.array(p[0].view(np.int64)), pa.array(p[1].astype(np.int32)), pa.array(p[2])], ["h", "shape", "c"])

    parts, size = [], 0
    for b in batches:
        texts = b.column(0).to_pylist()
        for lo, hi in runs(texts):
            shapes: list = [np.zeros(0, np.int64)]
            h, _ = word_hashes(texts[lo:hi], shapes)
            parts += _merged([(h, np.concatenate(shapes), np.ones(len(h), np.int64))])
            size += len(parts[-1][0])
            if size > FLUSH:
                parts = _merged(parts)
                size = len(parts[0][0])
                if size > FLUSH // 2:
                    yield rows(parts[0])
                    parts, size = [], 0
        yield rows((np.array([END]), np.array([0]), np.array([len(texts)], np.int64)))
    if parts:
        yield rows(_merged(parts)[0])


def _units(h: np.ndarray, shapes: np.ndarray, top: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Unit of each word: 0 is the end, then shapes, then the top words."""
    keys, unit = top
    if not len(keys):
        return shapes + 1
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, unit[at], shapes + 1)


def _with_ends(units: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(units with an end after each text, index of each text's first)."""
    n = len(at) - 1
    out = np.zeros(len(units) + n, np.int64)
    place = np.arange(len(units)) + np.repeat(np.arange(n), np.diff(at))
    out[place] = units
    return out, at + np.arange(n + 1)


def _unit_rows(batches, shared):
    """Units of each text, closed by an end, as int32 bytes."""
    for b in batches:
        texts = b.column(0).to_pylist()
        for lo, hi in runs(texts):
            shapes: list = [np.zeros(0, np.int64)]
            h, at = word_hashes(texts[lo:hi], shapes)
            seq, first = _with_ends(_units(h, np.concatenate(shapes), shared.value), at)
            bounds = pa.py_buffer((4 * first).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), hi - lo, [None, bounds, pa.py_buffer(seq.astype("<i4").tobytes())])], ["units"])


def _steps(batches, size: int = 1 << 18):
    """(unit before, unit) of all places of ``_unit_rows``; what stands before a text is an end."""
    for b in batches:
        column = b.column(0)
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1]
        if not len(column) or ends[0] == ends[-1]:
            continue
        seq, last = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<i4"), 0
        for lo in range(0, len(seq), size):
            part = seq[lo : lo + size].astype(np.int64)
            yield np.concatenate(([last], part[:-1])), part
            last = part[-1]


def _bigrams(batches, shared, size: int):
    """Counts of adjacent groups; ``shared`` has each unit's group."""
    total, of = np.zeros(size * size, np.int64), shared.value
    for prev, seq in _steps(batches):
        total += np.bincount(of[prev] * size + of[seq], minlength=size * size)
    table = total.reshape(size, size)
    rows = np.flatnonzero(table.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([np.flatnonzero(table[r]).astype("<u2").tobytes() for r in rows], pa.binary()), pa.array([table[r][table[r] > 0].astype("<i8").tobytes() for r in rows], pa.binary())], ["prev", "units", "counts"])


def _table(units: DataFrame, shared, size: int) -> np.ndarray:
    """The summed table of adjacent groups, size x size."""
    grams = units.mapInArrow(lambda it: _bigrams(it, shared, size), "prev int, units binary, counts binary")
    grams = grams.repartition("prev").mapInArrow(lambda it: _summed(it, size), "prev int, row binary").toArrow()
    table = np.zeros((size, size), np.int64)
    for prev, row in zip(grams.column("prev").to_pylist(), grams.column("row").to_pylist()):
        table[prev] = np.frombuffer(row, np.int64)
    return table


def _contexts(batches, shared, first: int, classes: int):
    """Counts of (unit, slot) for units from ``first`` on: slot c is class c
    before it, classes + c class c behind it, 2 * classes itself."""
    of = shared.value
    wide, parts, size = 2 * classes + 1, [], 0

    def merged():
        keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[start], np.add.reduceat(counts[order], start)

    def rows(keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(keys // wide), pa.array((keys % wide).astype(np.int32)), pa.array(counts)], ["unit", "slot", "n"])

    for prev, seq in _steps(batches):
        own, back = seq >= first, prev >= first
        keys = np.concatenate((seq[own] * wide + of[prev[own]], prev[back] * wide + classes + of[seq[back]], seq[own & (seq == prev)] * wide + 2 * classes))
        if len(keys):
            parts.append(np.unique(keys, return_counts=True))
            size += len(parts[-1][0])
        if size > FLUSH:
            parts = [merged()]
            size = len(parts[0][0])
            if size > FLUSH // 2:
                yield rows(*parts[0])
                parts, size = [], 0
    if parts:
        yield rows(*merged())


def _exchanged(batches, shared, classes: int):
    """Rows (unit, slot, n), sorted by unit: each unit's best class."""
    of, big = shared.value
    # Words that move at the same time would all take the same empty class.
    empty = big.sum(0) + big.sum(1) == 0
    rest, out = None, []

    def settle(unit, slot, n):
        counts = np.zeros(2 * classes + 1)
        np.add.at(counts, slot, n)
        table = big.copy()
        left, right, self_n = counts[:classes], counts[classes:-1], counts[-1]
        out.append((unit, _moved(table, int(of[unit]), right, left, self_n, empty)[0]))

    for b in batches:
        cols = [c.to_numpy() for c in b.columns]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols)]
        edge = np.flatnonzero(np.diff(cols[0])) + 1
        for at, end in zip(np.concatenate(([0], edge[:-1])), edge) if len(edge) else ():
            settle(int(cols[0][at]), cols[1][at:end], cols[2][at:end])
        last = edge[-1] if len(edge) else 0
        rest = [c[last:] for c in cols]
    if rest is not None and len(rest[0]):
        settle(int(rest[0][0]), rest[1], rest[2])
    yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), pa.array([c for _, c in out], pa.int32())], ["unit", "class"])


def _summed(batches, size: int):
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for prev, units, counts in zip(*(c.to_pylist() for c in b.columns)):
            row = sums.setdefault(prev, np.zeros(size, np.int64))
            row[np.frombuffer(units, "<u2")] += np.frombuffer(counts, "<i8")
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([r.tobytes() for r in sums.values()], pa.binary())], ["prev", "row"])


def _xlogx(x):
    return x * np.log(np.maximum(x, 1))


def _moved(big: np.ndarray, k: int, right: np.ndarray, left: np.ndarray, self_n: float, closed: np.ndarray | None = None) -> tuple[int, float]:
    """Moves a unit of class k to the class of most likelihood, in the class
    bigrams ``big`` too; ``right`` and ``left`` are its counts with the classes
    behind and before it, with itself among them; it can't move to a ``closed``
    class. The class and the gain."""
    r, l = right.copy(), left.copy()  # noqa: E741
    r[k] -= self_n
    l[k] -= self_n
    big[k] -= r
    big[:, k] -= l
    big[k, k] -= self_n
    n_row, n_col = big.sum(1), big.sum(0)
    c, d = np.flatnonzero(r), np.flatnonzero(l)
    gain = (_xlogx(big[:, c] + r[c]) - _xlogx(big[:, c])).sum(1) + (_xlogx(big[d] + l[d, None]) - _xlogx(big[d])).sum(0)
    x = np.diag(big)
    gain += _xlogx(x + r + l + self_n) + _xlogx(x) - _xlogx(x + r) - _xlogx(x + l)
    out_n, in_n = r.sum() + self_n, l.sum() + self_n
    gain -= _xlogx(n_row + out_n) - _xlogx(n_row) + _xlogx(n_col + in_n) - _xlogx(n_col)
    gain[0] = -np.inf
    if closed is not None:
        gain[closed & (np.arange(len(gain)) != k)] = -np.inf
    best = int(np.argmax(gain))
    new = best if gain[best] > gain[k] + 1e-9 else k
    big[new] += r
    big[:, new] += l
    big[new, new] += self_n
    return new, float(gain[new] - gain[k])


def exchange(table: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit; unit 0 (the end) keeps class 0 to itself. Maximises
    sum n(c, d) log n(c, d) - 2 sum n(c) log n(c) over class bigrams."""
    size = len(table)
    table = table.astype(np.float64)
    often = np.argsort(-table.sum(0), kind="stable")
    # Start: signs of the leading singular vectors of what follows and precedes each unit, beyond chance.
    out_n, in_n = table.sum(1), table.sum(0)
    apart = table / np.sqrt(np.outer(np.maximum(out_n, 1), np.maximum(in_n, 1))) - np.sqrt(np.outer(out_n, in_n)) / max(1.0, out_n.sum())
    bits = max(1, (max(2, classes - 1) - 1).bit_length())
    left_of = np.linalg.svd(np.concatenate((apart, apart.T), 1), full_matrices=False)[0]
    lead = left_of[:, :bits]
    code = ((lead > np.median(lead[1:], 0)) << np.arange(lead.shape[1])).sum(1)
    of = 1 + code % max(1, classes - 1)
    of[0] = 0
    member = np.zeros((size, classes))
    member[np.arange(size), of] = 1
    big = member.T @ table @ member
    right, left = table @ member, table.T @ member  # of each unit to and from each class
    for _ in range(sweeps):
        moved = 0
        for u in often:
            if not u or not table[u].any() and not table[:, u].any():
                continue
            k = of[u]
            new, _ = _moved(big, k, right[u], left[u], table[u, u])
            if new != k:
                moved += 1
                of[u] = new
                right[:, k] -= table[:, u]
                right[:, new] += table[:, u]
                left[:, k] -= table[u]
                left[:, new] += table[u]
        if not moved:
            break
    return of


def _scored(batches, shared):
    top, (keys, counts), of, step = shared.value
    logs = np.log10(counts + 0.1)
    for b in batches:
        texts = b.column(1).to_pylist()
        for lo, hi in runs(texts):
            shapes: list = [np.zeros(0, np.int64)]
            h, at = word_hashes(texts[lo:hi], shapes)
            n = len(at) - 1
            seq, first = _with_ends(_units(h, np.concatenate(shapes), top), at)
            cls = of[seq]
            prev = np.concatenate(([0], cls[:-1]))
            text = np.repeat(np.arange(n), np.diff(first))
            steps = np.bincount(text, step[prev, cls], n)
            words, _ = _with_ends(h.view(np.int64), at)
            i = np.minimum(np.searchsorted(keys, words.view(U)), len(keys) - 1)
            found = keys[i] == words.view(U)
            sums = np.bincount(text[found], logs[i[found]], n)
            known = np.bincount(text[found], counts[i[found]] > 0, n).astype(np.int64)
            rare = np.concatenate(([0], np.cumsum(np.bincount(text[~found], minlength=n))))
            lists = pa.ListArray.from_arrays(pa.array(rare, pa.int32()), pa.array(words[~found]))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), pa.array(np.diff(first)), pa.array(known), pa.array(sums), pa.array(steps), lists], ["id", "n", "known", "logs", "steps", "rare"])


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """One row a document: id, held_out, n_tokens, n_known, train_tokens,
    base_score (unigram), score (class model), log10 of the whole text.

    Texts whose id's crc32 is not divisible by ``folds`` train; a null id is
    held out. Null texts are empty: their one token is the end. Rows that repeat
    are scored, and train, each for itself. Other columns are ignored. Without
    training texts every count is zero. An empty table gives no rows.
    """
    spark, work = docs.sparkSession, shared_dir(docs.sparkSession)
    sc = spark.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    out = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % folds == 0, F.lit(True))
    train = rows.filter(~out).select("t")
    counts = train.mapInArrow(_counted, "h long, shape int, c long").groupBy("h").agg(F.first("shape").alias("shape"), F.sum("c").alias("c"))
    counts = cut(counts, f"{work}/counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    all_n, all_v = int(total[0]), int(total[1])
    clustered = int(np.ceil(4 * np.sqrt(all_n)))
    classes = max(CLASSES, int(0.6 * all_n**0.25))
    # The least count that at most this many words reach.
    most = max(FREQUENT, clustered)
    levels = counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(most).toArrow()
    upto = np.cumsum(levels.column("n").to_numpy())
    fits = int(np.searchsorted(upto, most, side="right"))
    least = levels.column("c").to_numpy()[fits - 1] if fits else 1 << 62
    often = counts.filter(F.col("c") >= int(least)).toArrow()
    h, c, shape = (often.column(n).to_numpy() for n in ("h", "c", "shape"))
    h = h.view(U)
    order = np.argsort(h)
    h, c, shape = h[order], c[order].astype(np.float64), shape[order].astype(np.int64)
    ranked = np.lexsort((h, -c))
    ranked = ranked[h[ranked] != END][:clustered]
    first = 1 + SHAPES + min(SEEDS, len(ranked))  # units by rank: the end, shapes, seeds, the other words
    unit = np.full(len(h), -1)
    unit[ranked] = 1 + SHAPES + np.arange(len(ranked))
    best = np.sort(ranked)
    top, size = (h[best], unit[best]), 1 + SHAPES + len(ranked)
    # Seeds exchange over their own bigrams, other words counted by shape; then all words by theirs.
    coarse = np.concatenate((np.arange(first), 1 + shape[ranked[first - 1 - SHAPES :]]))
    units = cut(train.mapInArrow(lambda it, t=sc.broadcast(top): _unit_rows(it, t), "units binary"), f"{work}/units")
    table = _table(units, sc.broadcast(coarse), first)
    seeds = exchange(table, classes)
    of = seeds[coarse]
    member = np.zeros((first, classes))
    member[np.arange(first), seeds] = 1
    big = (member.T @ table @ member).astype(np.int64)
    for n in range(PASSES if size > first else 0):
        shared = sc.broadcast(of)
        beside = units.mapInArrow(lambda it, t=shared: _contexts(it, t, first, classes), "unit long, slot int, n long")
        beside = beside.repartition("unit").sortWithinPartitions("unit")
        moved = beside.mapInArrow(lambda it, t=sc.broadcast((of, big.astype(np.float64))): _exchanged(it, t, classes), "unit long, class int").toArrow()
        of = of.copy()
        of[moved.column("unit").to_numpy()] = moved.column("class").to_numpy()
        big = _table(units, sc.broadcast(of), classes)
    member = np.zeros((size, classes))
    member[np.arange(size), of] = 1
    # Distinct words of each unit: top words are one each, shapes have the rest.
    types = np.zeros(size)
    types[1 + SHAPES :] = 1
    for s, n in counts.filter(F.col("h") != int(END)).groupBy("shape").agg(F.count("*").alias("n")).collect():  # SHAPES rows
        types[1 + s] = n - np.count_nonzero(shape[ranked] == s)
    types[0] = 1 if all_n else 0
    class_n, class_v = big.sum(0), member.T @ types
    share = (class_n + 0.1 * (class_v + 1)) / (all_n + 0.1 * (all_v + classes))
    pull = 50.0
    move = (big + pull * share[None, :]) / (big.sum(1)[:, None] + pull)
    step = np.log10(move) - np.log10(class_n + 0.1 * (class_v + 1))[None, :]
    if not len(h):
        h, c = np.array([END]), np.zeros(1)
    shared = sc.broadcast((top, (h, c), of, step))
    scored = rows.mapInArrow(lambda it: _scored(it, shared), "id long, n long, known long, logs double, steps double, rare array<long>")
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()), f"{work}/scored")
    rare = scored.select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count("*").alias("n"))
    rare = rare.join(counts.filter(F.col("c") < int(least)).select("h", "c"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * F.log10(F.col("c") + 0.1)).alias("l"))
    logs = F.col("logs") + F.coalesce("l", F.lit(0.0))
    base = logs - F.col("n") * float(np.log10(all_n + 0.1 * (all_v + 1)))
    return scored.join(rare, "row", "left").select(
        F.col("id").alias(id_col), out.alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(all_n).cast("long").alias("train_tokens"), base.alias("base_score"), (logs + F.col("steps")).alias("score")
    )
