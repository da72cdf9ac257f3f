"""The pipeline's stages one by one, each on what the one before it kept."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from strandwise.llm import mixing, quality, queries

from .test_ops import SF, WORD, brute_components, shingles


def test_stages(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontaminate", "mix", "records"]
    stage, docs, kept = dict(pipeline.STAGES), source, {}
    for n in names[:-1]:
        docs = spark.createDataFrame(stage[n](spark, docs, SF).collect(), source.schema)
        assert docs.columns == source.columns
        kept[n] = [r.asDict() for r in docs.collect()]
    rated = {r["doc_id"]: r["kept"] for r in quality.rate(source, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r["doc_id"] for r in kept["quality"]} == {i for i, k in rated.items() if k}
    want = {i for i, _, _, k in brute_components([(r["doc_id"], r["text"], None) for r in kept["quality"]]) if k}
    assert {r["doc_id"] for r in kept["near_dedup"]} == want and len(kept["near_dedup"]) == len(want)
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in kept["near_dedup"] if not any(b and 100 * len(shingles(r["text"]) & b) >= 80 * len(b) for b in items)}
    assert {r["doc_id"] for r in kept["decontaminate"]} == clean
    plan = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(kept["decontaminate"], source.schema))[0].collect()}
    times = Counter(r["doc_id"] for r in kept["mix"])
    assert all(times[i] - 0.5 <= r["taken"] / r["size"] + 0.5 and r["taken"] / r["size"] - 0.5 <= times[i] + 0.5 for i, r in plan.items() if r["size"])
    assert set(times) <= clean and max(times.values()) <= 3
    from tokenizers import Tokenizer

    lib, start, ids_of = Tokenizer.from_file(queries.vocabulary()), 0, []
    for r in sorted(kept["mix"], key=lambda r: r["doc_id"]):
        ids = [*lib.encode(r["text"] or "", add_special_tokens=False).ids, queries.END_ID]
        ids_of.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = stage["records"](spark, docs, SF).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(ids_of)


def test_near_dedup_from_80_percent(spark):
    rng = np.random.default_rng(4)
    texts, at = [], 0
    for g in range(40):  # a text and a copy with one to three changed words, apart or side by side
        words = [f"g{g}w{i}" for i in range(rng.integers(45, 70))]
        copy = list(words)
        for p in rng.choice(len(words), rng.integers(1, 4), replace=False):
            copy[p] = f"g{g}c{p}"
        texts += [(at, " ".join(words)), (at + 1, " ".join(copy))]
        at += 2
    sets = [shingles(t) for _, t in texts]
    alike = [100 * len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert sum(80 <= x < 85 for x in alike) >= 3 and sum(x < 80 for x in alike) >= 3
    want = {i for i, _ in texts if i % 2 == 0 or alike[i // 2] < 80}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], spark.read.parquet(f"{SF}/documents.parquet").schema)
    assert {r["doc_id"] for r in dict(pipeline.STAGES)["near_dedup"](spark, docs, SF).collect()} == want


def test_run(spark):
    assert pipeline.run(spark, SF).count() > 0 and pipeline.ORACLE_SQL is None and WORD.findall("a b") == ["a", "b"]


def messy(spark):
    """Documents with nulls, empty texts, repeated rows and ids, and columns named as the operators' own."""
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    more = [(9001, None, None, None, None), (9002, "", "en", None, 0), (None, rows[3][1], "en", "src1", 1), (None, None, "en", "src1", 1), (9003, rows[4][1], "en", None, 5), (9003, rows[4][1], "en", None, 5), (9003, rows[9][1] + " more", "en", "src2", 5)]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    d = spark.createDataFrame(rows + more, schema)
    for n, name in enumerate(("size", "w", "score", "kept", "expected_grade", "tails", "row", "key", "turn", "id", "h", "t", "doc", "component", "label")):
        d = d.withColumn(name, F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return d


def whole(rows):
    return Counter(tuple(sorted((k, str(v)) for k, v in r.asDict().items())) for r in rows)


def test_stages_on_messy_rows(spark):
    """Every stage but the last gives rows of its input, unchanged, and what a plain version gives."""
    stage, docs = dict(pipeline.STAGES), messy(spark)
    before = docs.collect()
    for name in list(stage)[:-1]:
        got = stage[name](spark, docs, SF).collect()
        assert all(set(r.asDict()) == set(docs.columns) for r in got)
        had, has = whole(before), whole(got)
        assert set(has) <= set(had) and (name == "mix" or all(has[k] <= had[k] for k in has)), name
        if name == "near_dedup":
            worded = [r for r in before if WORD.findall(r["text"] or "")]
            plain = brute_groups([shingles(r["text"]) for r in worded], 80)
            first = {}
            for g, r in zip(plain, worded):
                at = (r["doc_id"] is None, r["doc_id"] or 0)
                first[g] = min(first.get(g, at), at)
            stays = Counter(first.values())
            assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in got if WORD.findall(r["text"] or "")) == stays
            assert sum(not WORD.findall(r["text"] or "") for r in got) == len(before) - len(worded)
        if name == "decontaminate":
            items = [shingles(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            hit = {r["doc_id"] for r in before if any(b and 100 * len(shingles(r["text"]) & b) >= 80 * len(b) for b in items)} - {None}
            assert whole(got) == whole([r for r in before if r["doc_id"] not in hit])
        if name == "mix":
            plan = mixing.mix(docs)[0].collect()
            taken, size = Counter(), Counter()
            for r in plan:
                taken[r["doc_id"]] += r["taken"]
                size[r["doc_id"]] = max(size[r["doc_id"]], r["size"])
            times = Counter(r["doc_id"] for r in got)
            assert all(abs(times[i] * size[i] - taken[i]) <= size[i] * sum(r["doc_id"] == i for r in plan) for i in size if sum(r["doc_id"] == i for r in plan) == 1)
        docs = spark.createDataFrame(got, docs.schema)
        before = got
    ids = sorted(((r["doc_id"] is not None, r["doc_id"] or 0) for r in before))
    out = stage["records"](spark, docs, SF).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in out) == ids
    at = 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def brute_groups(sets, percent):
    of = list(range(len(sets)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                of[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(sets))]


def test_stages_on_empty_tables(spark):
    docs = spark.createDataFrame([], spark.read.parquet(f"{SF}/documents.parquet").schema)
    for name, stage in pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert got.count() == 0 and (name == "records" or got.columns == docs.columns)
