"""Exact removal of repeated 200-byte strings by difference-cover suffix sorting.

Distribution: every 200-byte window is dealt by its minimizer, the smallest
hashed 32-gram in it, leftmost on ties. Equal windows have equal minimizers at
equal places, so they meet in one class, and a document's windows fall into
segments of consecutive windows with one minimizer occurrence. Segments travel
as hashes first; only classes with two segments that aren't equal throughout
need bytes. Segments that are equal throughout repeat as a whole. Classes of
very many different segments are dealt again, by ranges of the windows' offsets
from the minimizer and the bytes that all windows of a range share, in up to
three stages of ever smaller ranges; equal windows again meet, and at last a
range is one offset and a class one window's copies.

Suffix sorting: the bytes of a run of classes form one string. The difference
cover {1, 2} mod 3 is sorted by triples, named, and sorted recursively on the
names until names are unique; the remaining suffixes are sorted by first symbol
and the rank of the next, and merged. Then neighbours compare their first 200
bytes: a window repeats if it equals one beside it.

A text's copies are collapsed to one before all this. Texts are known by their
64-bit hash (at 10^10 distinct texts a few would be taken for one another).
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, cut, shared_dir
from .textvec import PIECE, U, mix, powers, splitmix

LENGTH, GRAM = 200, 32
#: Bytes of segments that one suffix sort takes; a larger class is cut by the windows' places in it.
SORT_BYTES = 2 << 20
#: Classes of more different segments than this are dealt again, by ranges of so many offsets in each stage.
LARGE, RANGES = 1000, (64, 8, 1)
_BYTE = splitmix(256, 31)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` (positive integers) in order, by the skew algorithm."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.concatenate((text, np.zeros(3, np.int64)))
    base = int(t.max()) + 1
    if base > 1 << 20:
        t = np.unique(t, return_inverse=True)[1].astype(np.int64)
        base = int(t.max()) + 1
    lead = t[:-1] * base + t[1:]
    if base * base * max(base, n + 3) >= 1 << 63:  # pairs by number, so that triples fit in 63 bits
        lead = np.unique(lead, return_inverse=True)[1].astype(np.int64)
    one = np.arange(1, n + (n % 3 == 1), 3)  # with one past the end if that evens the halves
    two = np.arange(2, n, 3)
    cover = np.concatenate((one, two))
    triple = lead[cover] * base + t[cover + 2]
    order = np.argsort(triple, kind="stable")
    name = np.empty(len(cover), np.int64)
    name[order] = np.cumsum(np.concatenate(([1], triple[order][1:] != triple[order][:-1])))
    if name[order[-1]] < len(cover):
        order = suffix_array(name)
    rank = np.zeros(n + 3, np.int64)
    rank[cover[order]] = np.arange(1, len(cover) + 1)
    sorted12 = cover[order]
    sorted12 = sorted12[sorted12 < n]
    zero = np.arange(0, n, 3)
    wide = n + 3
    zero = zero[np.argsort(t[zero] * wide + rank[zero + 1], kind="stable")]
    ones, twos = sorted12[sorted12 % 3 == 1], sorted12[sorted12 % 3 == 2]
    below = np.searchsorted(t[ones] * wide + rank[ones + 1], t[zero] * wide + rank[zero + 1])
    pair = lambda i: lead[i] * wide + rank[i + 2]
    below += np.searchsorted(pair(twos), pair(zero))
    out = np.empty(n, np.int64)
    place = below + np.arange(len(zero))
    out[place] = zero
    rest = np.ones(n, bool)
    rest[place] = False
    out[rest] = sorted12
    return out


def repeated_windows(data: np.ndarray, valid: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the ``valid`` starts (a mask over ``data``, uint8) begin a string
    of ``length`` bytes that another valid start begins as well."""
    out = np.zeros(len(data), bool)
    order = suffix_array(data.astype(np.int64) + 1)
    order = order[valid[order]]
    a, b = order[:-1], order[1:]
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    for at in [*range(0, length - 8, 8), length - 8]:
        same = words[a + at] == words[b + at]
        a, b = a[same], b[same]
    out[a] = out[b] = True
    return out


def segments(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(begin, windows, minimizer, hash of the bytes) of each segment; ``starts``
    are the offsets of the texts in ``data``, with its end as the last."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, U),) * 2
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, U)
        np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
        m = len(data) - gram + 1
        h = mix((total[gram:] - total[:m]) * down[:m])
    low = (h & ~U((1 << 24) - 1)) | np.arange(m, dtype=U)
    span, width = 1, length - gram + 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    place = (low & U((1 << 24) - 1)).astype(np.int64)
    ok = np.zeros(n + 1, bool)
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if e - s >= length:
            ok[s : e - length + 1] = True
    ok = ok[:n]
    edge = np.ones(n, bool)
    edge[1:] = (place[1:] != place[:-1]) | (ok[1:] != ok[:-1])
    first = np.flatnonzero(edge)
    count = np.diff(np.append(first, n))
    keep = ok[first]
    first, count = first[keep], count[keep]
    end = first + count + length - 1
    with np.errstate(over="ignore"):
        whole = mix((total[end] - total[first]) * down[first] + count.astype(U))
    return first, count, h[place[first]], whole


def _dealt(batches):
    """Segments of each batch of texts. Of those that are equal throughout only
    one goes on, marked as met again; the others are spans already (class null)."""
    for b in batches:
        keys, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
        run, size, parts = [], 0, []  # (text's index, offset in the text, bytes)

        def flush():
            data = np.frombuffer(b"".join(p for _, _, p in run), np.uint8)
            starts = np.concatenate(([0], np.cumsum([len(p) for _, _, p in run])))
            first, count, least, whole = segments(data, starts)
            of = np.searchsorted(starts, first, side="right") - 1
            lo = first - starts[of] + np.array([o for _, o, _ in run], np.int64)[of]
            parts.append((least.view(np.int64), whole.view(np.int64), keys[np.array([i for i, _, _ in run], np.int64)[of]], lo, count.astype(np.int32)))

        for i, t in enumerate(texts):
            t = t or b""
            for at in range(0, max(1, len(t) - LENGTH + 1), PIECE):
                run.append((i, at, t[at : at + PIECE + LENGTH - 1]))
                size += len(run[-1][2])
                if size >= PIECE:
                    flush()
                    run, size = [], 0
        if run:
            flush()
        if not parts:
            continue
        cls, whole, text, lo, n = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((whole, cls))
        cls, whole, text, lo, n = cls[order], whole[order], text[order], lo[order], n[order]
        new = np.ones(len(cls), bool)
        new[1:] = (cls[1:] != cls[:-1]) | (whole[1:] != whole[:-1])
        again = np.zeros(len(cls), bool)
        again[:-1] = ~new[1:]
        yield pa.RecordBatch.from_arrays([pa.array(cls, mask=~new), pa.array(whole, mask=~new), pa.array(text), pa.array(lo), pa.array(n), pa.array(again & new)], ["class", "whole", "text", "lo", "n", "again"])


def _classes(batches, most: int):
    """Sorted by class, whole, text, lo: drops repeated rows and classes of one
    segment; marks whether the segment repeats as a whole, whether it stands for
    its equals in a class of several kinds, and whether these are more than ``most``."""
    held: list = []  # of the class that the last batch ended in

    def marked(t):
        c, w, x, lo = (t.column(k).to_numpy() for k in range(4))
        again = np.zeros(len(c), bool)
        again[1:] = (c[1:] == c[:-1]) & (w[1:] == w[:-1]) & (x[1:] == x[:-1]) & (lo[1:] == lo[:-1])
        t = t.filter(pa.array(~again))
        c, w = t.column(0).to_numpy(), t.column(1).to_numpy()
        new_c = np.ones(len(c), bool)
        new_c[1:] = c[1:] != c[:-1]
        new_w = new_c.copy()
        new_w[1:] |= w[1:] != w[:-1]
        met = np.add.reduceat(t.column(5).to_numpy(zero_copy_only=False).astype(np.int64), np.flatnonzero(new_w))
        size_w = (np.diff(np.append(np.flatnonzero(new_w), len(c))) + met)[np.cumsum(new_w) - 1]
        kinds = np.add.reduceat(new_w.astype(np.int64), np.flatnonzero(new_c))[np.cumsum(new_c) - 1]
        multi, differs = size_w > 1, kinds > 1
        keep = multi | differs
        full = pa.RecordBatch.from_arrays([*(t.column(k) for k in (0, 2, 3, 4)), pa.array(multi), pa.array(new_w & differs), pa.array(kinds > most)], ["class", "text", "lo", "n", "multi", "sorts", "large"])
        return full.filter(pa.array(keep))

    for b in batches:
        t = pa.Table.from_batches([b])
        c = t.column(0).to_numpy()
        last = int(np.searchsorted(c, c[-1])) if len(c) else 0
        if held and len(c) and (last or held[0].column(0)[0].as_py() != c[0]):  # the class before ends
            yield marked(pa.concat_tables([*held, t.slice(0, last)]).combine_chunks().to_batches()[0])
            held = []
        elif last:
            yield marked(t.slice(0, last).combine_chunks().to_batches()[0])
        if len(c):
            held.append(t.slice(last))
    if held:
        yield marked(pa.concat_tables(held).combine_chunks().to_batches()[0])


def _bytes(batches):
    """Segments with their bytes, from the run of their text's bytes that starts at ``base`` and holds them."""
    for b in batches:
        out: list[list] = [[], [], [], [], [], []]
        for key, base, text, segs in zip(*(c.to_pylist() for c in b.columns)):
            for s in segs:
                at, size = s["lo"] - base, s["n"] + LENGTH - 1
                if 0 <= at <= len(text) - size:
                    for c, v in zip(out, (s["class"], key, s["lo"], s["multi"], s["large"], text[at : at + size])):
                        c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["class", "text", "lo", "multi", "large", "seg"])


def _dealt_again(batches, span: int):
    """Segments of large classes in parts of windows that start in one range of
    ``span`` offsets before the minimizer. A part's class is its segment's, the
    range and a hash of the bytes that all windows of the range cover: equal
    windows have equal offsets, so they agree in all three."""
    grams, low = LENGTH - GRAM + 1, ~U((1 << 24) - 1)

    def parts(run):
        cls, text, lo, n = (np.array(c) for c in list(zip(*run))[:4])
        data = np.frombuffer(b"".join(r[4] for r in run), np.uint8)
        start = np.concatenate(([0], np.cumsum(n[:-1] + LENGTH - 1)))
        up, down = powers(len(data) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(data) + 1, U)
            np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
            h = mix((total[GRAM:] - total[:-GRAM]) * down[: len(data) - GRAM + 1])
        at = np.argmin(h[start[:, None] + np.arange(grams)] & low, axis=1)
        # The window at i stands at - i before the minimizer: ranges from that of the last window to that of the first.
        least = (at - n + 1) // span
        count = at // span - least + 1
        of = np.repeat(np.arange(len(n)), count)
        part = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + least[of]
        top = at[of] - part * span  # the range's last window, within the segment or past its last one
        first, last = np.maximum(0, top - span + 1), np.minimum(n[of] - 1, top)
        inner, windows = start[of] + top, last - first + 1
        a, e = start[of] + first, start[of] + last + LENGTH
        with np.errstate(over="ignore"):
            shared = (total[inner - span + 1 + LENGTH] - total[inner]) * down[inner]
            key = mix(mix(shared) + mix(cls[of].view(U) + part.astype(U) * U(0x9E3779B97F4A7C15) + U(span)))
            whole = mix((total[e] - total[a]) * down[a] + windows.astype(U))
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(text[of]), pa.array(lo[of] + first), pa.array(windows.astype(np.int32)), pa.array(np.zeros(len(of), bool))], ["class", "whole", "text", "lo", "n", "again"])

    for b in batches:
        run, size = [], 0
        for cls, key, lo, seg in zip(*(c.to_pylist() for c in b.columns)):
            run.append((cls, key, lo, len(seg) - LENGTH + 1, seg))
            size += len(seg)
            if size >= PIECE:
                yield parts(run)
                run, size = [], 0
        if run:
            yield parts(run)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def _sorted_block(rows: list[tuple]) -> tuple[list, list, list]:
    """Found intervals (text, begin, end) of segments that don't repeat as a whole."""
    data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
    size = np.array([len(r[3]) for r in rows])
    start = np.cumsum(size) - size
    valid = np.zeros(len(data), bool)
    for s, n in zip(start.tolist(), size.tolist()):
        valid[s : s + n - LENGTH + 1] = True
    found = repeated_windows(data, valid)
    single = np.repeat([not r[2] for r in rows], size)
    b, e = _runs(found & single)
    of = np.searchsorted(start, b, side="right") - 1
    parts = ([], [], [])
    for i, x, y in zip(of.tolist(), b.tolist(), e.tolist()):
        # Runs of windows of neighbouring segments can touch: a window's segment ends before its last start.
        while x < y:
            stop = min(y, int(start[i] + size[i]))
            shift = rows[i][1] - int(start[i])
            parts[0].append(rows[i][0])
            parts[1].append(x + shift)
            parts[2].append(stop + shift + LENGTH - 1)
            x, i = stop, i + 1
    return parts


def _sort_classes(batches):
    """Sorted by class: suffix-sorts runs of whole classes."""
    def out(parts):
        return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()) for p in parts], ["text", "begin", "end"])

    def blocks(rows):
        """A class beyond SORT_BYTES by the windows' offsets from the class's minimizer: equal windows have equal ones."""
        if sum(len(r[4]) for r in rows) <= SORT_BYTES or len({r[0] for r in rows}) > 1:
            yield [r[1:] for r in rows]
            return
        data = [np.frombuffer(r[4], np.uint8) for r in rows]
        at = [_minimizer(d) for d in data]
        far = max(at)
        step = max(1, SORT_BYTES // len(rows) - LENGTH + 1)
        for lo in range(0, far + 1, step):  # a window that starts d before the minimizer, lo <= d < lo + step
            part = []
            for r, a in zip(rows, at):
                windows = len(r[4]) - LENGTH + 1
                first, last = max(0, a - lo - step + 1), min(windows - 1, a - lo)
                if first <= last:
                    part.append((r[1], r[2] + first, r[3], r[4][first : last + LENGTH]))
            if part:
                yield part

    run: list[tuple] = []
    size = 0
    own: list[tuple] = []

    def close():
        nonlocal run, size, own
        if size + sum(len(r[4]) for r in own) > SORT_BYTES and run:
            yield from (out(_sorted_block(p)) for p in blocks(run))
            run, size = [], 0
        run += own
        size += sum(len(r[4]) for r in own)
        own = []

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if own and own[0][0] != row[0]:
                yield from close()
            own.append(row)
    if own:
        yield from close()
    if run:
        yield from (out(_sorted_block(p)) for p in blocks(run))


def _minimizer(data: np.ndarray) -> int:
    """Where the minimizer of a segment's windows stands in its bytes."""
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, U)
        np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
        m = len(data) - GRAM + 1
        h = mix((total[GRAM:] - total[:m]) * down[:m])
    return int(np.argmin((h[: LENGTH - GRAM + 1] & ~U((1 << 24) - 1)) | np.arange(LENGTH - GRAM + 1, dtype=U)))


def _cut_out(batches):
    for b in batches:
        cols: list[list] = [[], [], [], [], []]
        for text, copied, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            t = text or b""
            runs = []
            if copied and len(t) >= LENGTH:
                runs = [(0, len(t))]
            elif spans:
                for x, y in sorted((s["begin"], s["end"]) for s in spans):
                    if runs and x <= runs[-1][1]:
                        runs[-1] = (runs[-1][0], max(y, runs[-1][1]))
                    else:
                        runs.append((x, y))
            at, kept = 0, []
            for x, y in runs:
                kept.append(t[at:x])
                at = y
            kept.append(t[at:])
            rest = b"".join(kept)
            for c, v in zip(cols, (len(t), len(t) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), [{"begin": x, "end": y} for x, y in runs])):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_bytes, n_removed, n_spans, kept_sha256 and
    removed (its maximal runs of removed bytes).

    Texts are UTF-8 bytes, null ones empty. A byte goes if a 200-byte string
    over it starts anywhere else as well, in the same text or another; rows that
    repeat, ids and all, are copies of each other. Texts under 200 bytes stay.
    Other columns are ignored; an empty table gives no rows.
    """
    work = shared_dir(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("t"))
    rows = rows.withColumn("text", F.xxhash64("t"))
    ids = cut(rows.filter(F.length("t") >= LENGTH).select("id", "text"), f"{work}/ids")
    copied = cut(ids.groupBy("text").agg(F.count("*").alias("copies"), F.min("id").alias("id")).filter("copies > 1"), f"{work}/copied")
    others = cut(ids.join(copied.select("text", F.col("id").alias("stays")), "text").filter("id <> stays").select("id").distinct(), f"{work}/others")
    alone = rows.filter(F.length("t") >= LENGTH).join(checked(others), "id", "left_anti")
    dealt = cut(alone.select("text", "t").mapInArrow(_dealt, "class long, whole long, text long, lo long, n int, again boolean"), f"{work}/dealt")
    met = dealt.filter("class is null")
    most, found_schema = LARGE, "class long, text long, lo long, n int, multi boolean, sorts boolean, large boolean"

    def classes(parts, name):
        parts = parts.repartition("class").sortWithinPartitions("class", "whole", "text", "lo")
        return cut(parts.mapInArrow(lambda it: _classes(it, most), found_schema), f"{work}/{name}")

    def located(segs, source):
        wanted = segs.groupBy("text").agg(F.collect_list(F.struct("class", "lo", "n", "multi", "large")).alias("segs"))
        return source.join(wanted, "text").mapInArrow(_bytes, "class long, text long, lo long, multi boolean, large boolean, seg binary")

    segs = classes(dealt.filter("class is not null"), "segs")
    whole = segs.filter("multi").select("text", "lo", "n").unionByName(met.select("text", "lo", "n"))
    held = located(segs.filter("sorts"), alone.select("text", F.lit(0).cast("long").alias("base"), "t"))
    kept = []
    for span in RANGES:
        if not segs.filter("sorts and large").limit(1).count():
            break
        held = cut(held, f"{work}/held{span}")  # the bytes of large classes are read again
        kept.append(held.filter("not large"))
        held = held.filter("large")
        segs = classes(held.select("class", "text", "lo", "seg").mapInArrow(lambda it, span=span: _dealt_again(it, span), "class long, whole long, text long, lo long, n int, again boolean"), f"segs{span}")
        whole = whole.unionByName(segs.filter("multi").select("text", "lo", "n"))
        held = located(segs.filter("sorts"), held.select("text", F.col("lo").alias("base"), F.col("seg").alias("t")))
    # What is left large after the last range is one window's copies, unless hashes clash.
    fetched = functools.reduce(DataFrame.unionByName, kept, held).drop("large")
    whole = whole.select("text", F.col("lo").alias("begin"), (F.col("lo") + F.col("n") + LENGTH - 1).alias("end"))
    fetched = fetched.repartition("class").sortWithinPartitions("class")
    found = fetched.mapInArrow(_sort_classes, "text long, begin long, end long")
    spans = whole.unionByName(found).groupBy("text").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    spans = cut(spans.join(copied.select("text", F.lit(True).alias("copied")), "text", "full").select("text", F.coalesce("copied", F.lit(False)).alias("copied"), F.when(F.col("copied").isNull(), F.col("spans")).alias("spans")), f"{work}/spans")
    schema = f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<begin:long,end:long>>"
    return rows.join(spans, "text", "left").select("id", "t", "copied", "spans").mapInArrow(_cut_out, schema)
