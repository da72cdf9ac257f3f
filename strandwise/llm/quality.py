"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features gives a score s; ordered thresholds
t1 < t2 < ... give P(grade >= k) = sigmoid(s - tk). Features of a document are
its distinct lower-cased runs of letters and digits, hashed, and the bins of a
few proportions of its bytes and words (capitals, signs, repeats, lengths).
Each feature is scaled by how much its share differs between the best grade and
another (log of the ratio) and how surely (z statistic), so that a word that
marks a grade outweighs the many others of a long text and words seen by chance
weigh little. It is fitted on at most MAX_ROWS labelled rows, those with the smallest
hashes of their ids, and then applied to every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import trimmed
from .textvec import U, mix, runs, word_hashes

DIMS_LOG2, MAX_ROWS, BINS = 20, 12_000, 24
#: Documents' worth of the overall share that steadies a feature's share in a grade.
PRIOR = 5
#: Tail probability of the best grade from which a document is kept, chosen on held-out labels.
KEEP = 0.7
_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 sign, 4 digit
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[33:48] = _KIND[58:65] = _KIND[91:97] = _KIND[123:127] = 3
_KIND[48:58] = 4
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _shares(text: bytes, h: np.ndarray) -> np.ndarray:
    """Proportions in [0, 1]: capitals, signs, digits of all bytes; words equal
    to the word before; distinct words; mean word length over 20."""
    n = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=5) / max(1, len(text))
    again = np.count_nonzero(h[1:] == h[:-1]) / max(1, len(h) - 1)
    return np.array([n[2], n[3], n[4], again, len(np.unique(h)) / max(1, len(h)), min(1.0, len(text) / max(1, len(h)) / 20)])


def features(texts: list[bytes | None]) -> list[np.ndarray]:
    return [f for lo, hi in runs(texts) for f in _features(texts[lo:hi])]


def _features(texts: list[bytes | None]) -> list[np.ndarray]:
    h, at = word_hashes(texts)
    w, w_at = word_hashes(texts, space=_APART)
    out = []
    for i, t in enumerate(texts):
        own = w[w_at[i] : w_at[i + 1]]
        bins = np.floor(np.sqrt(_shares(t or b"", h[at[i] : at[i + 1]])) * (BINS - 1)).astype(U)
        marks = mix(np.arange(len(bins), dtype=U) * U(1000) + bins + U(1 << 40))
        out.append(np.unique((np.concatenate((own, marks)) >> U(64 - DIMS_LOG2)).astype(np.int32)))
    return out


def _featured(batches):
    for b in batches:
        rows = features(b.column(1).to_pylist())
        ends = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], ["grade", "features"])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _scales(col: np.ndarray, row: np.ndarray, grades: np.ndarray, size: int, least: int, sure: float) -> np.ndarray:
    """A feature's scale, the greatest over the grades below the best: by the
    log of its shares' ratio, or by the z statistic of their difference. 0 under
    ``least`` documents or a z of ``sure``."""
    top, seen, of = grades.max(initial=0), np.bincount(col, minlength=size), grades[row]
    n_top, in_top, out = max(1, int((grades == top).sum())), np.bincount(col, of == top, size), np.zeros(size)
    prior = PRIOR * seen / max(1, len(grades)) + 0.01
    for g in range(int(top)):
        n, inside = int((grades == g).sum()), np.bincount(col, of == g, size)
        if not n:
            continue
        apart = np.abs(np.log((inside + prior) / (n + PRIOR)) - np.log((in_top + prior) / (n_top + PRIOR)))
        share = (inside + in_top) / (n + n_top)
        z = np.abs(inside / n - in_top / n_top) / np.sqrt(share * (1 - share) * (1 / n + 1 / n_top) + 1e-12)
        scale = np.maximum(3 * np.minimum(1, (z / 8) ** 2), np.minimum(apart, 6) * np.minimum(1, (z / 4) ** 2))
        out = np.maximum(out, np.where(z > sure, scale, 0))
    return np.where(seen >= least, out, 0)


def fit(rows: list[np.ndarray], grades: np.ndarray, steps: int = 200, rate: float = 0.05, ridge: float = 3e-4, least: int = 3, sure: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by Adam on the mean log-likelihood."""
    top = max(1, int(grades.max(initial=1)))
    used, col = np.unique(np.concatenate(rows), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    scale = _scales(col, row, grades, len(used), least, sure)
    col, row = col[scale[col] > 0], row[scale[col] > 0]
    x = scale[col]
    p = np.concatenate((np.zeros(len(used)), np.linspace(-1, 1, top) if top > 1 else np.zeros(1)))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        s = np.bincount(row, p[col] * x, len(rows))
        t = np.concatenate(([-np.inf], p[len(used) :], [np.inf]))
        # P(grade = g) = sigmoid(s - t_g) - sigmoid(s - t_(g+1))
        a, b = _sigmoid(s - t[grades]), _sigmoid(s - t[grades + 1])
        like, da, db = np.maximum(a - b, 1e-9), a * (1 - a), b * (1 - b)
        da, db = np.where(grades > 0, da, 0), np.where(grades < top, db, 0)
        ds = -(da - db) / like / len(rows)
        of_t = np.bincount(grades, da / like, top + 1)[1:] - np.bincount(grades + 1, db / like, top + 2)[1 : top + 1]
        g = np.concatenate((np.bincount(col, ds[row] * x, len(used)) + ridge * p[: len(used)], of_t / len(rows)))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        p[len(used) :] = np.sort(p[len(used) :])
    weights = np.zeros(1 << DIMS_LOG2, np.float32)
    weights[used] = p[: len(used)] * scale
    return weights, p[len(used) :]


def train(docs: DataFrame, graded: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS):
    """Fits on ``graded(id, grade)``; rows with nulls are skipped. Of grades that
    conflict on an id the lowest counts, of texts that share one that of the
    smallest hash. Without any graded document the weights are zeros and every
    tail probability 1/2."""
    picked = graded.filter(f"`{id_col}` is not null and grade is not null").groupBy(F.col(id_col).alias("_id")).agg(F.min("grade").cast("int").alias("grade"))
    picked = picked.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)  # max_rows rows
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("t"))
    rows = texts.join(F.broadcast(picked), "_id").groupBy("_id", "grade").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    got = rows.orderBy("_id").select("grade", "t").mapInArrow(lambda it: trimmed(_featured(it)), "grade int, features array<int>").toArrow()
    if not got.num_rows:
        return np.zeros(1 << DIMS_LOG2, np.float32), np.zeros(1)
    grades = got.column("grade").to_numpy()
    lists = got.column("features").combine_chunks()
    flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return fit([flat[a:b] for a, b in zip(ends[:-1], ends[1:])], grades)


def _scored(batches, model, text_col: str):
    weights, cuts = model.value
    for b in batches:
        doc = b.column(0)
        texts = pc.struct_field(doc, [doc.type.get_field_index(text_col)]).cast(pa.binary()).to_pylist()
        s = np.array([float(weights[r].sum(dtype=np.float64)) for r in features(texts)]) if b.num_rows else np.zeros(0)
        tails = _sigmoid(s[:, None] - cuts[None, :])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * len(cuts), pa.int32()), pa.array(tails.ravel()))
        yield pa.RecordBatch.from_arrays([doc, pa.array(s), pa.array(tails.sum(1)), lists], ["doc", "score", "expected_grade", "tails"])


def scored(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """doc (a row of ``docs`` as a struct, so that no name can clash), score,
    expected_grade and tails (P(grade >= 1), P(grade >= 2), ...). A null or empty
    text has no words but the bins of zero shares."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct("*").alias("doc"))
    schema = StructType([rows.schema["doc"], *StructType.fromDDL("score double, expected_grade double, tails array<double>")])
    return rows.mapInArrow(lambda it: trimmed(_scored(it, shared, text_col)), schema)


def score(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``scored``'s columns; own columns of these names give way."""
    out = scored(docs, model, text_col)
    added = out.columns[1:]
    return out.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns if c not in added], *added)


def grades(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Graded ratings: 0 poor, 1 good but toxic, 2 good and clean; null where
    the quality is unknown and the text isn't toxic."""
    return labels.select(id_col, F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 2).alias("grade"))


def rate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = KEEP) -> DataFrame:
    """``docs`` with the classifier's columns and kept: the tail probability of
    the highest grade is ``least`` or more. Rows are rated each by its own text,
    also where they repeat an id. An empty table gives no rows."""
    model = train(docs, grades(labels, id_col), id_col, text_col)
    return score(docs, model, text_col).withColumn("kept", F.element_at("tails", -1) >= least)


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that ``rate`` keeps, their columns as they are. A
    classifier without a single label rejects nothing."""
    model = train(docs, grades(labels, id_col), id_col, text_col)
    least = least if model[0].any() else 0.0
    return scored(docs, model, text_col).filter(F.element_at("tails", -1) >= least).select("doc.*")
