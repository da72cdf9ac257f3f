"""The interval engine: pinned cases, brute force over dense arrays, files end to end."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from strandwise import cli
from strandwise.config import DetectConfig, MergeConfig
from strandwise.functions import scalars
from strandwise.operators import classify, consensus, context, coverage, overlay, reads, strandedness
from strandwise.operators.intervals import islands, nearest, overlap_join, union_length
from strandwise.operators.metrics import region_metrics
from strandwise.plans import extract, merge, report
from strandwise.sources import bam, sinks, text

KEYS = ["chrom"]
SEG = "chrom string, tile long, s long, e long, plus long, minus long, multi long, pmask long, mmask long, exon long"


def one(spark, expr, **values):
    return spark.createDataFrame([Row(**values)] if values else [Row(x=0)]).select(expr.alias("v")).first()["v"]


def dense(spark, plus, minus, multi=None, mask=None):
    """Dense arrays as one-base segments of one region."""
    n = len(plus)
    multi = np.zeros(n, int) if multi is None else multi
    rows = [("c", 0, i, i + 1, int(plus[i]), int(minus[i]), int(multi[i]), 0, 0, 0) for i in range(n)]
    return spark.createDataFrame(rows, SEG).withColumn("r_s", F.lit(0).cast("long")).withColumn("r_e", F.lit(n).cast("long"))


def metric_row(spark, plus, minus, multi=None, **cfg):
    c = DetectConfig(**cfg)
    return classify.classified(region_metrics(dense(spark, plus, minus, multi), KEYS, c.min_depth, c.strand_min_depth), c).first()


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(7)
    p, m, x = rng.poisson(12, 600), rng.poisson(9, 600), rng.poisson(2, 600)
    r = metric_row(spark, p, m, x)
    assert r["length"] == 600 and r["total_coverage"] == (p + m).sum() and r["max_depth"] == (p + m).max()
    assert r["covered_bases"] == ((p + m) >= 10).sum() and r["plus_covered_len"] == (p >= 3).sum()
    assert abs(r["profile_correlation"] - np.corrcoef(p, m)[0, 1]) < 1e-12
    assert abs(r["plus_cv"] - p.std() / p.mean()) < 1e-12 and abs(r["minus_cv"] - m.std() / m.mean()) < 1e-12
    assert abs(r["dual_strand_fraction"] - ((p >= 3) & (m >= 3)).mean()) < 1e-12
    assert abs(r["unique_fraction"] - (p + m).sum() / (p + m + x).sum()) < 1e-12
    q = p.sum() / (p + m).sum()
    assert abs(r["strand_balance"] + q * np.log2(q) + (1 - q) * np.log2(1 - q)) < 1e-12


def test_classes(spark):
    rng = np.random.default_rng(11)
    flat = rng.normal(30, 3, 900).clip(0).astype(int), rng.normal(30, 3, 900).clip(0).astype(int)
    assert metric_row(spark, *flat)["class"] == classify.GDNA
    assert metric_row(spark, np.full(800, 12), np.zeros(800, int))["class"] == classify.NOVEL
    artifact = metric_row(spark, np.full(800, 12), np.zeros(800, int), np.full(800, 100))
    assert artifact["class"] == classify.ARTIFACT and artifact["flags"] == {"unique_reads_majority": False} and not artifact["kept"]
    ramp = np.linspace(1, 40, 800).astype(int)
    assert metric_row(spark, ramp, ramp[::-1])["class"] == classify.BIDIRECTIONAL
    zero = metric_row(spark, np.zeros(300, int), np.zeros(300, int))
    assert zero["dominant_strand_fraction"] == 1.0 and zero["unique_fraction"] == 1.0 and zero["profile_correlation"] == 0.0 and zero["strand_balance"] == 1.0


def brute_regions(reads_, masks, n, stranded, min_depth, gap):
    p, m, pm, mm = (np.zeros(n, int) for _ in range(4))
    for s, e, strand in reads_:
        (p if strand == "+" else m)[s:e] += 1
    for s, e, strand in masks:
        if strand != "-":
            pm[s:e] += 1
        if strand != "+":
            mm[s:e] += 1
    if stranded:
        p[pm > 0], m[mm > 0], blocked = 0, 0, (pm > 0) & (mm > 0)
    else:
        blocked = (pm > 0) | (mm > 0)
    cov = (p + m >= min_depth) & ~blocked
    runs, i = [], 0
    while i < n:
        if cov[i]:
            j = i
            while j < n and cov[j]:
                j += 1
            if runs and i - runs[-1][1] <= gap and not blocked[runs[-1][1] : i].any():
                runs[-1][1] = j
            else:
                runs.append([i, j])
            i = j
        else:
            i += 1
    return [tuple(r) for r in runs], p, m


@pytest.mark.parametrize("stranded,seed", [(True, 1), (False, 2), (True, 3)])
def test_sweep_and_regions_match_dense(spark, stranded, seed):
    rng = np.random.default_rng(seed)
    n, tile = 4000, 300
    rd = [(int(s), int(s) + int(w), "+-"[k]) for s, w, k in zip(rng.integers(0, n - 120, 700), rng.integers(20, 120, 700), rng.integers(0, 2, 700))]
    mk = [(int(s), int(s) + int(w), "+-."[k]) for s, w, k in zip(rng.integers(0, n - 60, 40), rng.integers(1, 60, 40), rng.integers(0, 3, 40))]
    b = spark.createDataFrame([("c", s, e, t, "unique") for s, e, t in rd], "chrom string, s long, e long, strand string, category string")
    k = spark.createDataFrame([("c", s, e, t) for s, e, t in mk], "chrom string, s long, e long, strand string")
    segs = coverage.sweep([coverage.read_intervals(b, KEYS), coverage.mask_intervals(k, KEYS)], KEYS, tile)
    own = coverage.masked(segs, stranded)
    found = coverage.regions(own, KEYS, 6, 15, tile)
    want, p, m = brute_regions(rd, mk, n, stranded, 6, 15)
    assert sorted((r["s"], r["e"]) for r in found.collect()) == want and len(want) > 10
    got = {(r["s"], r["e"]): r for r in region_metrics(coverage.in_regions(own, found, KEYS, tile), KEYS, 6, 3).collect()}
    for s, e in want:
        assert got[s, e]["total_coverage"] == p[s:e].sum() + m[s:e].sum() and got[s, e]["plus_covered_len"] == (p[s:e] >= 3).sum()


def test_islands_and_union(spark):
    d = spark.createDataFrame([("a", 0, 10), ("a", 10, 20), ("a", 5, 7), ("a", 30, 40), ("b", 0, 1)], "chrom string, s long, e long")
    assert sorted(map(tuple, islands(d, KEYS, tile=6).collect())) == [("a", 0, 20, 3), ("a", 30, 40, 1), ("b", 0, 1, 1)]
    assert sorted(map(tuple, islands(d, KEYS, 10, tile=6).collect())) == [("a", 0, 40, 4), ("b", 0, 1, 1)]
    assert {r["chrom"]: r["bp"] for r in union_length(d, KEYS).collect()} == {"a": 30, "b": 1}


def test_joins_match_brute_force(spark):
    rng = np.random.default_rng(4)
    mk = lambda n, w: [("c", int(s), int(s) + int(x), i) for i, (s, x) in enumerate(zip(rng.integers(0, 5000, n), rng.integers(1, w, n)))]
    a, b = mk(150, 80), mk(60, 900)
    A = spark.createDataFrame(a, "chrom string, s long, e long, i long")
    B = spark.createDataFrame(b, "chrom string, s long, e long, ord long")
    got = sorted((r["a_i"], r["b_ord"]) for r in overlap_join(A, B, KEYS, 128).collect())
    assert got == sorted((x[3], y[3]) for x in a for y in b if x[1] < y[2] and x[2] > y[1])
    few = spark.createDataFrame(b[:7], "chrom string, s long, e long, ord long")
    near = {r["i"]: (r["near"]["ord"], r["distance"]) for r in nearest(A, few, KEYS, ["s", "ord"], 500).collect()}
    for _, s, e, i in a:
        best = min((max(y[1] - e, s - y[2], 0), y[1], y[3]) for y in b[:7])
        assert near[i] == (best[2], best[0])
    none = nearest(A.withColumn("chrom", F.lit("z")), few, KEYS, ["s", "ord"]).first()
    assert none["distance"] == -1 and none["near"] is None


def test_read_rules(spark):
    d = spark.createDataFrame([Row(flag=f, mapq=q) for f, q in [(0, 60), (4, 60), (512, 60), (2048, 60), (256, 60), (1024, 60), (0, 5), (16, 60), (1 + 64, 60), (1 + 128, 60), (1 + 128 + 16, 60)]])
    got = d.select(reads.category(DetectConfig()).alias("c"), reads.strand("forward").alias("f"), reads.strand("reverse").alias("r"), reads.strand("unstranded").alias("u"), reads.dropped_duplicate(DetectConfig()).alias("d")).collect()
    assert [r["c"] for r in got] == ["unique", None, None, None, "multi", None, "multi", "unique", "unique", "unique", "unique"]
    assert [r["f"] for r in got][7:] == ["-", "+", "-", "+"] and [r["r"] for r in got][7:] == ["+", "-", "+", "-"] and got[7]["u"] == "-"
    assert [r["d"] for r in got].index(True) == 5


def test_base_quality(spark):
    d = spark.createDataFrame([("c", [Row(start=5, end=8, quals=[30, 2, 30]), Row(start=20, end=22, quals=None)])], "chrom string, blocks array<struct<start:long,end:long,quals:array<int>>>")
    assert sorted((r["s"], r["e"]) for r in reads.blocks(d, None, 10).collect()) == [(5, 6), (7, 8), (20, 21), (21, 22)]
    sizes = spark.createDataFrame([("c", 21)], "chrom string, length long")
    assert sorted((r["s"], r["e"]) for r in reads.blocks(d, sizes).collect()) == [(5, 8), (20, 21)]


def test_cigar(spark):
    r = spark.createDataFrame([Row(c="2S3M1I2M10N4M2D1M", s=100, q="!!ABCDEFGHIJK")]).select(text.cigar_blocks(F.col("c"), F.col("s"), F.col("q")).alias("b")).first()["b"]
    assert [(x["start"], x["end"]) for x in r] == [(100, 103), (103, 105), (115, 119), (121, 122)] and r[0]["quals"] == [32, 33, 34]


def test_context(spark):
    regions = spark.createDataFrame([("c", 100, 200, "+", False), ("c", 100, 200, "-", True), ("c", 700, 800, "+", False), ("c", 20_000, 20_100, "+", False), ("d", 1, 2, "+", False)], "chrom string, s long, e long, dominant_strand string, exonic boolean")
    genes = spark.createDataFrame([("c", 50, 300, "-", "g1", 1), ("c", 810, 900, "+", "g2", 2)], "chrom string, s long, e long, strand string, gene_id string, ord long")
    got = {(r["chrom"], r["s"], r["dominant_strand"]): (r["context_label"], r["nearest_feature_id"], r["nearest_feature_distance"]) for r in context.with_genes(regions.filter("dominant_strand = '+'"), genes).unionByName(context.with_genes(regions.filter("dominant_strand = '-'"), genes)).collect()}
    assert got["c", 100, "+"] == ("antisense", "g1", 0) and got["c", 100, "-"] == ("sense_genic_unannotated", "g1", 0)
    assert got["c", 700, "+"] == ("near_gene", "g2", 10) and got["c", 20_000, "+"][0] == "intergenic" and got["d", 1, "+"] == ("intergenic", None, -1)
    exact = context.with_genes(spark.createDataFrame([("c", 10_900, 11_000, "+", False), ("c", 10_901, 11_001, "+", False)], regions.schema), genes)
    assert sorted(r["context_label"] for r in exact.collect()) == ["intergenic", "near_gene"]


def test_strandedness(spark):
    ex = spark.createDataFrame([("c", 0, 1000, "+"), ("c", 0, 10, "+"), ("c", 2000, 2100, ".")], "chrom string, s long, e long, strand string")
    mk = lambda flags: spark.createDataFrame([("c", 100 + i, 150 + i, f) for i, f in enumerate(flags)], "chrom string, s long, e long, flag int")
    got = lambda flags: strandedness.decision(strandedness.votes(mk(flags), strandedness.sampled_exons(ex))).first()
    assert (got([0] * 9 + [16])["library"], got([16] * 10)["library"]) == ("forward", "reverse")
    half = got([0, 16])
    assert half["library"] == "unstranded" and half["confidence"] == 1.0
    none = strandedness.decision(strandedness.votes(mk([0]).filter("false"), ex)).first()
    assert none["library"] == "unstranded" and none["confidence"] == 0.0 and none["p_forward"] is None


def test_qc(spark):
    regions = spark.createDataFrame([("likely_gDNA", 100, 750), ("likely_novel_transcript", 50, 250)], "class string, length long, total_coverage long")
    total = spark.createDataFrame([(10_000, 0)], "unique_total long, multi_total long")
    q = strandedness.gdna_qc(regions, total).first()
    assert q["pct_gDNA_of_mapped_coverage"] == 7.5 and q["pct_gDNA_of_candidate_coverage"] == 75.0
    per = spark.createDataFrame([("likely_gDNA", 7), ("likely_novel_transcript", 5)], "class string, n_reads long")
    stats = spark.createDataFrame([(20, 10, 3)], "unique_reads long, annotated_reads long, multi_reads long")
    a = strandedness.assignment(per, stats).first()
    assert (a["annotated"], a["gDNA"], a["novel_transcript"], a["other_unannotated"]) == (10, 7, 5, 0)


def cand(spark, rows):
    d = spark.createDataFrame([(i, s, c, a, b, k, st) for i, (s, c, a, b, k, st) in enumerate(rows)], "id long, sample string, chrom string, s long, e long, class string, dominant_strand string")
    return d.withColumn("region_id", scalars.region_id(F.col("chrom"), F.col("s"), F.col("e"))).withColumn("avg_depth", F.lit(2.5))


def test_consensus(spark):
    n, g = classify.NOVEL, classify.GDNA
    rows = [("A", "1", 100, 300, n, "+"), ("B", "1", 110, 310, n, "+"), ("C", "1", 90, 290, g, "+"), ("A", "1", 250, 450, n, "+"), ("A", "2", 0, 100, g, "-"), ("B", "2", 0, 100, n, "-"), ("A", "1", 100, 300, n, "-"), ("A", "MT", 5, 10, n, "+"), ("A", "MT", 5, 10, n, "+")]
    got = {(r["chrom"], r["s"], r["strand"]): r for r in consensus.numbered(consensus.consensus(cand(spark, rows), MergeConfig()), "in_consensus_gtf", ["chrom", "s", "e", "strand"], "t", "name").collect()}
    first = got["1", 90, "+"]
    assert (first["e"], first["n_samples"], first["n_members"], first["consensus_class"], first["consensus_id"]) == (310, 3, 3, "reproducible_novel", "1:90-310")
    assert first["samples"] == ["A", "B", "C"] and abs(first["class_agreement"] - 2 / 3) < 1e-12 and first["member_region_ids"] == ["1:100-300", "1:110-310", "1:90-290"] and first["name"] == "t_1"
    tie = got["2", 0, "-"]
    assert tie["majority_class"] == g and tie["passes_min_samples"] and not tie["in_consensus_gtf"]
    assert not got["1", 250, "+"]["passes_min_samples"] and not got["1", 100, "-"]["passes_min_samples"]
    two = got["MT", 5, "+"]
    assert two["n_samples"] == 1 and two["n_members"] == 2 and not two["passes_min_samples"]


def features(spark, rows):
    return spark.createDataFrame([("L", *r, i) for i, r in enumerate(rows)], "label string, chrom_key string, s long, e long, ftype string, fid string, strand string, genes array<string>, ord long")


def test_overlay(spark):
    regions = spark.createDataFrame([("r1", "1", 100, 200, "+"), ("r2", "1", 1000, 1100, "-"), ("r3", "2", 0, 10, "+")], "consensus_id string, chrom_key string, s long, e long, strand string")
    f = features(spark, [("1", 50, 150, "enhancer", "E1", "+", ["B", "A"]), ("1", 120, 160, "enhancer", "E2", "-", []), ("1", 190, 900, "CTCF_site", "C1", ".", ["A"]), ("1", 1110, 1120, "promoter", "", ".", None)])
    got = {r["consensus_id"]: r for r in overlay.annotated(regions, f, window=10).collect()}
    r = got["r1"]
    assert (r["n"], r["types"], r["ids"], r["overlap_bp"], r["genes"], r["nearest_distance"]) == (3, "CTCF_site:1,enhancer:2", "E1;E2;C1", 70, "A,B", 0)
    assert got["r2"]["n"] == 0 and (got["r2"]["nearest"], got["r2"]["nearest_distance"]) == ("NA", -1)  # exactly the window away
    assert {r["consensus_id"]: (r["nearest"], r["nearest_distance"]) for r in overlay.annotated(regions, f, window=11).collect()}["r2"] == ("promoter", 10)
    touching = overlay.annotated(regions, features(spark, [("1", 200, 210, "x", "X", ".", [])]), window=5).filter("consensus_id = 'r1'").first()
    assert (touching["n"], touching["nearest"], touching["nearest_distance"]) == (0, "x:X", 0)
    assert overlay.overlaps(regions, f, stranded=True).filter("a_consensus_id = 'r1'").count() == 2
    assert {r["ftype"]: r["bp"] for r in overlay.footprint(f).collect()} == {"enhancer": 110, "CTCF_site": 710, "promoter": 10}
    with pytest.raises(ValueError, match="shares no chromosome"):
        overlay.check_chromosomes(regions, features(spark, [("9", 0, 1, "x", "", ".", [])]), "L")
    many = features(spark, [("2", 0, 5, "t", f"i{k:02}", ".", []) for k in range(12)])
    assert overlay.annotated(regions, many).filter("consensus_id = 'r3'").first()["ids"].endswith("i09;+2_more")


def test_scalars(spark):
    t = spark.createDataFrame([Row(a='gene_id "x"; note "b c"; gene_id "y";', b="ID=e%2C1;Parent = p+q ;=;bad", c=" chrM ", d="..a b/c__", q="acgtNRBx")])
    r = t.select(scalars.attributes(F.col("a")).alias("a"), scalars.attributes(F.col("b")).alias("b"), scalars.normalise_chrom(F.col("c")).alias("c"), scalars.name_token(F.col("d")).alias("d"), scalars.reverse_complement(F.col("q")).alias("q"), scalars.wrap(F.lit("x" * 120)).alias("w"), scalars.parse_region_id(F.lit("a:b:5-9")).alias("p")).first()
    assert r["a"] == {"gene_id": "y", "note": "b c"} and r["b"]["ID"] == "e,1" and r["b"]["Parent"] == "p+q"
    assert (r["c"], r["d"], r["q"], r["w"]) == ("MT", "a_b_c", "xBYNacgt", "x" * 60 + "\n" + "x" * 60) and tuple(r["p"]) == ("a:b", 5, 9)


def test_labels():
    assert text.derive_label("/x/homo.Regulatory_features.gff3.gz", set()) == "regulatory" and text.derive_label("regulatory.gff", {"regulatory"}) == "regulatory2" and text.derive_label("hs.my-peaks.bed.gz", set()) == "my_peaks"
    assert text.sample_names(("a/s1.candidate_regions.tsv", "s2.tsv.gz")) == ["s1", "s2"]
    with pytest.raises(ValueError):
        text.sample_names(("a.tsv", "b/a.tsv"))


def test_config():
    for bad in ({"min_depth": 0}, {"min_covered_fraction": 1.5}, {"annotation_mode": "x"}, {"library_strandedness": "x"}):
        with pytest.raises(ValueError):
            DetectConfig(**bad).validate(files=False)
    with pytest.raises(ValueError):
        MergeConfig(min_reciprocal_overlap=0).validate(files=False)
    with pytest.raises(FileNotFoundError):
        DetectConfig(bam="/none.bam", gtf="/none.gtf", out_prefix="x").validate()


# Files

GTF = 'chr_test\tsrc\tgene\t1001\t3000\t.\t+\t.\tgene_id "known";\nchr_test\tsrc\texon\t1001\t3000\t.\t+\t.\tgene_id "known"; transcript_id "known.1";\n'


def simulated():
    rng = np.random.default_rng(3)
    out = []

    def add(s, e, n, flag, mapq=255):
        out.extend((int(x), flag, mapq) for x in rng.integers(s, e - 75, n))

    add(1000, 3000, 400, 0)
    add(6000, 8000, 500, 0), add(6000, 8000, 500, 16)
    add(11000, 12500, 400, 0)
    add(15000, 16200, 300, 0), add(15800, 17000, 220, 16)
    add(18000, 18800, 400, 0), add(18000, 18800, 1000, 0, 1)
    return sorted(out)


def write_sam(path):
    rows = ["@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:chr_test\tLN:20000"] + [f"r{i}\t{f}\tchr_test\t{s + 1}\t{q}\t75M\t*\t0\t0\t*\t*" for i, (s, f, q) in enumerate(simulated())]
    path.write_text("\n".join(rows) + "\n")


def write_bam(path, block=700):
    head = b"@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:chr_test\tLN:20000\n"
    data = b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<ii", 1, 9) + b"chr_test\0" + struct.pack("<i", 20000)
    for i, (s, f, q) in enumerate(simulated()):
        name = b"r%d\0" % i
        rec = struct.pack("<iiBBHHHiiii", 0, s, len(name), q, 0, 1, f, 75, -1, -1, 0) + name + struct.pack("<I", 75 << 4) + b"\x11" * 38 + b"\xff" * 75
        data += struct.pack("<i", len(rec)) + rec
    with open(path, "wb") as out:
        for at in [*range(0, len(data), block), None]:
            part = b"" if at is None else data[at : at + block]
            c = zlib.compressobj(6, zlib.DEFLATED, -15)
            body = c.compress(part) + c.flush()
            out.write(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<HBBHH", 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))


def test_bam_splits(spark, tmp_path):
    write_bam(tmp_path / "x.bam")
    whole = bam.alignments(spark, str(tmp_path / "x.bam")).select("name", "flag", "s", "e", "mapq", F.size("blocks").alias("b")).collect()
    parts = bam.alignments(spark, str(tmp_path / "x.bam"), split=5000)
    assert parts.rdd.getNumPartitions() > 4
    assert sorted(map(tuple, parts.select("name", "flag", "s", "e", "mapq", F.size("blocks").alias("b")).collect())) == sorted(map(tuple, whole))
    assert sorted((r["s"], r["flag"], r["mapq"]) for r in whole) == simulated() and all(r["e"] == r["s"] + 75 and r["b"] == 1 for r in whole)


@pytest.mark.parametrize("kind", ["sam", "bam"])
def test_detect_end_to_end(spark, tmp_path, kind):
    (write_sam if kind == "sam" else write_bam)(tmp_path / f"x.{kind}")
    (tmp_path / "a.gtf").write_text(GTF)
    out = str(tmp_path / "out")
    assert cli.main(["detect", "--bam", str(tmp_path / f"x.{kind}"), "--gtf", str(tmp_path / "a.gtf"), "--out-prefix", out, "--emit-bedgraph", "--emit-coverage-store"]) == 0
    s = json.loads((tmp_path / "out.summary.json").read_text())
    assert all(s[f"n_{c}"] == 1 for c in (classify.GDNA, classify.NOVEL, classify.BIDIRECTIONAL, classify.ARTIFACT)) and s["n_rescued_unknown_transcripts"] == 2
    assert s["inferred_library_strandedness"] == "forward" and s["strandedness_metrics"]["p_forward"] > 0.9
    a = s["read_assignment_counts"]
    assert sum(a.values()) == s["reads"]["unique_reads"] and a["annotated"] > 380
    rows = [x.split("\t") for x in (tmp_path / "out.candidate_regions.tsv").read_text().splitlines()]
    assert len(rows) == 5 and len(rows[0]) == 35 and rows[1][rows[0].index("class")] == classify.GDNA
    assert int(rows[1][2]) == int(rows[1][0].split(":")[1].split("-")[0]) + 1
    assert (tmp_path / "out.annotation_plus_unknowns.gtf").read_text().startswith(GTF) and (tmp_path / "out.gdna_mqc.tsv").read_text().count("#") == 9
    assert len((tmp_path / "out.candidate_regions.bed").read_text().splitlines()) == 4 and (tmp_path / "out.candidates.plus.bedgraph").exists()
    store = spark.read.parquet(f"{out}.coverage")
    assert coverage.window(store, "chr_test", 6000, 8000).agg(F.sum((F.col("e") - F.col("s")) * F.col("unique_plus"))).first()[0] > 500 * 60
    assert store.filter("s < 3000 and e > 1000").agg(F.max("unique_plus")).first()[0] in (None, 0)


def candidates_file(path, shift, cls="likely_novel_transcript"):
    head = "region_id\tchrom\tstart\tend\tclass\tdominant_strand\tunique_fraction\tavg_depth\treason_for_classification"
    path.write_text("\n".join([head, f"1:{12700 + shift}-{13000 + shift}\t1\t{12701 + shift}\t{13000 + shift}\t{cls}\t+\t0.9\t20\tclear", f"MT:800000-800400\tMT\t800001\t800400\t{cls}\t-\tNA\t30\tclear"]) + "\n")


def test_merge_end_to_end(spark, tmp_path):
    for name, shift in (("A", 0), ("B", 10)):
        candidates_file(tmp_path / f"{name}.candidate_regions.tsv", shift)
    (tmp_path / "ref.gtf").write_text(GTF)
    (tmp_path / "regulatory.gff3").write_text("##gff\nchr1\te\tenhancer\t12601\t12800\t.\t.\t.\tID=enh1;gene_name=G1, G2\nchr1\te\tCTCF_binding_site\t12750\t12760\t.\t.\t.\tID=c1\nchr1\te\tbad\tx\ty\t.\t.\t.\tID=z\n")
    write_sam(tmp_path / "x.sam")
    out = str(tmp_path / "m")
    args = ["merge", "--tsv", str(tmp_path / "A.candidate_regions.tsv"), str(tmp_path / "B.candidate_regions.tsv"), "--out-prefix", out, "--reference-gtf", str(tmp_path / "ref.gtf"), "--annotate", str(tmp_path / "regulatory.gff3"), "--emit-plots"]
    assert cli.main(args) == 0
    rows = [dict(zip(x[0], r)) for x in [[y.split("\t") for y in (tmp_path / "m.consensus_regions.tsv").read_text().splitlines()]] for r in x[1:]]
    assert [r["chrom"] for r in rows] == ["1", "MT"] and rows[0]["consensus_transcript_name"] == "consensus_transcript_1-CTCF_binding_site" and rows[0]["start"] == "12701" and rows[0]["end"] == "13010"
    assert rows[0]["regulatory_types"] == "CTCF_binding_site:1,enhancer:1" and rows[0]["regulatory_genes"] == "G1,G2" and rows[1]["regulatory_n"] == "0" and rows[1]["consensus_transcript_name"] == "consensus_transcript_2"
    gtf = (tmp_path / "m.consensus_transcripts.gtf").read_text()
    assert 'regulatory_ids "enh1;c1";' in gtf and "nearest" not in gtf and gtf.count("\texon\t") == 2
    assert (tmp_path / "m.reference_plus_consensus.gtf").read_text().startswith(GTF)
    s = json.loads((tmp_path / "m.consensus_summary.json").read_text())
    assert s["n_clusters_total"] == 2 and s["n_written_to_consensus_gtf"] == 2 and s["annotation"]["sources"][0]["n_with_overlap"] == 1
    assert (tmp_path / "m_plots" / "index.html").read_text().count("<li>") == 2
    bare = merge.run(spark, MergeConfig(tsvs=tuple(args[2:4]), out_prefix=str(tmp_path / "n")))
    assert bare["n_reproducible_novel"] == s["n_reproducible_novel"] == 2
    assert cli.main(["merge", "--tsv", "/none.tsv", "--out-prefix", out]) == 1


def test_plots_use_stores(spark, tmp_path):
    candidates_file(tmp_path / "A.tsv", 0), candidates_file(tmp_path / "B.tsv", 10)
    rows = [(n, "1", s, e, *[v] * 6) for n in "ABC" for s, e, v in ((12690, 12900, 25), (12900, 13020, 6))]
    names = "sample string, chrom string, s long, e long, " + ", ".join(f"{c} long" for c in ("unique_plus", "unique_minus", "dup_plus", "dup_minus", "multi_plus", "multi_minus"))
    coverage.store(spark.createDataFrame(rows, names), str(tmp_path / "store"))
    merge.run(spark, MergeConfig(tsvs=(str(tmp_path / "A.tsv"), str(tmp_path / "B.tsv")), out_prefix=str(tmp_path / "p"), emit_plots=True, coverage_stores=(str(tmp_path / "store"),)))
    page = (tmp_path / "p_plots" / "consensus_transcript_1.html").read_text()
    assert all(f"<h2>{n}</h2>" in page for n in "ABC") and "<rect" in page and "clear" in page


def test_extract(spark, tmp_path):
    seq = {"chr1": "ACGTACGTAATTGGCCAATTCCGGTTAACC", "chr2": "GATTACAGATTACAGATTAC"}
    (tmp_path / "g.fa").write_text("".join(f">{n} x\n" + "\n".join(s[i : i + 10] for i in range(0, len(s), 10)) + "\n" for n, s in seq.items()))
    (tmp_path / "t.gtf").write_text('chr2\ts\texon\t1\t5\t.\t-\t.\ttranscript_id "t2";\nchr1\tu\texon\t21\t30\t.\t+\t.\ttranscript_id "t1";\nchr1\tu\texon\t1\t4\t.\t+\t.\ttranscript_id "t1";\nchr9\tu\texon\t1\t4\t.\t+\t.\ttranscript_id "t9";\n')
    assert extract.run(spark, str(tmp_path / "g.fa"), str(tmp_path / "t.gtf"), str(tmp_path / "o.fa"), width=8) == 2
    got = (tmp_path / "o.fa").read_text().split("\n")
    assert got[0] == ">t2 gene_id= strand=- loc=chr2:1-5(-) class= length=5" and got[1] == "GTAATC"[:0] + "TAATC" and "loc=chr1:1-30(+)" in got[2] and "".join(got[3:5]) == "ACGT" + seq["chr1"][20:30]
    assert extract.run(spark, str(tmp_path / "g.fa"), str(tmp_path / "t.gtf"), str(tmp_path / "u.fa"), source="s") == 1


def test_compressed_annotation(spark, tmp_path):
    import gzip

    for name in ("a.gtf.gz", "a.gtf.bgz"):
        (tmp_path / name).write_bytes(gzip.compress(GTF.encode()))
        assert [(r["ftype"], r["s"]) for r in text.annotation_lines(spark, str(tmp_path / name)).orderBy("ord").collect()] == [("gene", 1000), ("exon", 1000)]


def test_gtf_rules(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('# c\nc\ts\tgene\t1\t10\t.\t+\t.\tgene_id "g";\nc\ts\tgene\t5\tx\t.\t+\t.\tgene_id "h";\nshort\nc\ts\tgene\t21\t30\t.\t-\t.\tgene_id "g";\nc\ts\texon\t3\t4\t.\t.\t.\ttranscript_id "t";\nd\ts\texon\t9\t12\t.\t-\t.\ttranscript_id "t";\n')
    rows = text.annotation_lines(spark, str(tmp_path / "a.gtf"))
    g = text.genes(rows).collect()
    assert [(r["s"], r["e"], r["strand"], r["gene_id"]) for r in g] == [(20, 30, "-", "g")]
    t = text.transcript_spans(rows).first()
    assert (t["chrom"], t["s"], t["e"], t["strand"]) == ("c", 2, 12, ".")
    assert text.masks(rows, "all").count() == 4
    with pytest.raises(ValueError, match="lacks columns"):
        (tmp_path / "bad.tsv").write_text("chrom\tstart\n1\t2\n")
        text.candidate_tables(spark, (str(tmp_path / "bad.tsv"),))
    (tmp_path / "q.sam").write_text("@HD\tSO:queryname\n")
    with pytest.raises(ValueError, match="queryname"):
        text.sam(spark, str(tmp_path / "q.sam"))
    (tmp_path / "f.fai").write_text("c\t5\tx\nbad\nd\tz\nc\t7\n")
    assert [(r["chrom"], r["length"]) for r in text.chrom_sizes(spark, str(tmp_path / "f.fai")).collect()] == [("c", 7)]


def test_bam_long_records_across_splits(spark, tmp_path):
    rng = np.random.default_rng(6)
    head = b"@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:chr_test\tLN:9000000\n"
    data = b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<ii", 1, 9) + b"chr_test\0" + struct.pack("<i", 9000000)
    sizes = [120_000, 40, 90_000, 75, 75, 300_000, 60, 150_000, 10, 80_000]
    for i, n in enumerate(sizes):
        name = b"r%d\0" % i
        body = rng.integers(0, 256, (n + 1) // 2, dtype=np.uint8).tobytes() + rng.integers(0, 42, n, dtype=np.uint8).tobytes()
        rec = struct.pack("<iiBBHHHiiii", 0, 1000 * i, len(name), 60, 0, 1, 0, n, -1, -1, 0) + name + struct.pack("<I", n << 4) + body
        data += struct.pack("<i", len(rec)) + rec
    with open(tmp_path / "long.bam", "wb") as out:
        for at in [*range(0, len(data), 30_000), None]:
            part = b"" if at is None else data[at : at + 30_000]
            c = zlib.compressobj(1, zlib.DEFLATED, -15)
            body = c.compress(part) + c.flush()
            out.write(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<HBBHH", 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    for split in (64_000, 200_000, 1 << 25):
        got = bam.alignments(spark, str(tmp_path / "long.bam"), split=split).select("name", "s", "e").collect()
        assert sorted((r["s"], r["e"]) for r in got) == [(1000 * i, 1000 * i + n) for i, n in enumerate(sizes)], split


def test_strandedness_votes_come_from_all_exons(spark):
    off = [("chr1", i, i + 75, 0) for i in range(200)]
    on = [("chr2", 5000 + i % 40, 5075 + i % 40, 0) for i in range(150)]
    reads = spark.createDataFrame(off + on, "chrom string, s long, e long, flag int")
    exons = spark.createDataFrame([("chr2", 5000, 5200, "+")], "chrom string, s long, e long, strand string")
    for most in (100, 200_000):
        got = strandedness.resolve(reads, exons, DetectConfig(strand_infer_max_reads=most))
        assert got["library"] == "forward" and got["confidence"] == 1.0 and 0 < got["n_forward"] <= 150
        assert most > 100 or got["n_forward"] < 150


def test_genes_without_ids_and_spans_of_any_line(spark, tmp_path):
    (tmp_path / "g.gff3").write_text("".join(f"c1\tx\tgene\t{a}\t{a + 99}\t.\t+\t.\tNote=n\n" for a in (1, 501, 901)))
    got = text.genes(text.annotation_lines(spark, str(tmp_path / "g.gff3"))).collect()
    assert sorted(r["gene_id"] for r in got) == ["gene@c1:0", "gene@c1:500", "gene@c1:900"]
    (tmp_path / "c.gtf").write_text("".join(f'c1\tx\tCDS\t{a}\t{a + 9}\t.\t-\t0\ttranscript_id "t1";\n' for a in (100, 300)))
    got = text.genes(text.annotation_lines(spark, str(tmp_path / "c.gtf"))).collect()
    assert [(r["gene_id"], r["s"], r["e"], r["strand"]) for r in got] == [("t1", 99, 309, "-")]


def test_detect_options():
    args = cli.parser().parse_args(
        "detect --bam b --gtf g --out-prefix o --gdna-max-strand-length-ratio-diff 0.1 --gdna-min-profile-correlation 0.2 --gdna-min-depth-balance 0.3 --gdna-flat-cv-threshold 0.5".split()
    )
    assert (args.gdna_max_length_ratio_diff, args.gdna_min_correlation, args.gdna_min_depth_ratio, args.gdna_max_cv) == (0.1, 0.2, 0.3, 0.5)
    with pytest.raises(SystemExit):
        cli.parser().parse_args("detect --bam b --gtf g --out-prefix o --annotation-mode intron".split())


def test_overlay_counts(spark, tmp_path):
    (tmp_path / "o.gff3").write_text("1\tx\tenhancer\t5\t9\t.\t.\t.\tID=a\n1\tx\tenhancer\tfive\t9\t.\t.\t.\tID=b\n1\tx\tpromoter\t9\t5\t.\t.\t.\tID=c\nshort\tline\n")
    assert text.overlay_counts(spark, str(tmp_path / "o.gff3")) == {"n_features": 1, "n_skipped": 2, "feature_types": {"enhancer": 1}}
    assert text.overlay_counts(spark, str(tmp_path / "o.gff3"), ("Promoter",)) == {"n_features": 0, "n_skipped": 1, "feature_types": {}}


@pytest.mark.parametrize("path,label", [("/a/My.Regulatory_Features.v1.gff3.gz", "regulatory"), ("x/hg38_rmsk.bed", "repeat"), ("sites.of.interest-2.gff.bgz", "interest_2"), (".gff3", "annotation"), ("--.tsv", "annotation")])
def test_derived_labels(path, label):
    assert text.derive_label(path, set()) == label and text.derive_label(path, {label, label + "2"}) == label + "3"


def write_sorted_bam(path, reads_, sizes, block):
    """A BAM file of (chromosome, start, length) in order, and its index."""
    head = b"@HD\tVN:1.6\tSO:coordinate\n"
    data = b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<i", len(sizes))
    for i, n in enumerate(sizes):
        data += struct.pack("<i", 3) + b"c%d\0" % i + struct.pack("<i", n)
    places = []
    for i, (ref, s, n) in enumerate(reads_):
        name = b"r%d\0" % i
        rec = struct.pack("<iiBBHHHiiii", ref, s, len(name), 60, 0, 1, 0, 0, -1, -1, 0) + name + struct.pack("<I", n << 4)
        places.append(len(data))
        data += struct.pack("<i", len(rec)) + rec
    places.append(len(data))
    starts = []
    with open(path, "wb") as out:
        for at in [*range(0, len(data), block), None]:
            part = b"" if at is None else data[at : at + block]
            starts.append(out.tell())
            c = zlib.compressobj(1, zlib.DEFLATED, -15)
            body = c.compress(part) + c.flush()
            out.write(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<HBBHH", 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    offset = lambda p: starts[p // block] << 16 | p % block
    index = b"BAI\1" + struct.pack("<i", len(sizes))
    for r in range(len(sizes)):
        bins, linear = {}, {}
        for i, (ref, s, n) in enumerate(reads_):
            if ref != r:
                continue
            number = next((first + (s >> bits) for first, bits in reversed(bam.BINS) if s >> bits == (s + n - 1) >> bits), 0)
            bins.setdefault(number, []).append((offset(places[i]), offset(places[i + 1])))
            for w in range(s >> 14, ((s + n - 1) >> 14) + 1):
                linear.setdefault(w, offset(places[i]))
        index += struct.pack("<i", len(bins) + 1) + struct.pack("<Ii4Q", bam.STATISTICS_BIN, 2, 1, 2, 3, 4)
        for number, chunks in bins.items():
            index += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        n = max(linear, default=-1) + 1
        index += struct.pack("<i", n) + b"".join(struct.pack("<Q", linear.get(w, 0)) for w in range(n))
    (path.parent / f"{path.name}.bai").write_bytes(index)


def test_bam_scans_by_chromosome_and_range(spark, tmp_path):
    rng = np.random.default_rng(8)
    sizes = [400_000, 90_000, 50_000, 600_000]
    reads_ = sorted((int(r), int(s), int(n)) for r, s, n in zip(rng.choice([0, 1, 3], 1500), rng.integers(0, 80_000, 1500), rng.choice([50, 75, 9_000], 1500)))
    reads_ += [(3, 300_000, 100_000), (3, 500_000, 20), (-1, -1, 0)]
    write_sorted_bam(tmp_path / "x.bam", reads_, sizes, 3000)
    wanted = [("c0", 0, 400_000), ("c1", 16_384, 16_385), ("c1", 20_000, 41_000), ("c2", 0, 9), ("c3", 350_000, 360_000), ("c3", 79_000, 600_000), ("c9", 0, 9)]
    read_all = bam.BamReader(str(tmp_path / "x.bam"), 2000)
    for indexed in (True, False):
        for split in (9000, 1 << 25) if indexed else (9000,):
            for chrom, s, e in wanted if split == 9000 else wanted[1:4]:
                got = bam.overlapping(spark, str(tmp_path / "x.bam"), chrom, s, e, split=split)
                want = sorted((a, a + n) for r, a, n in reads_ if f"c{r}" == chrom and a < e and a + n > s)
                assert sorted((r["s"], r["e"]) for r in got.select("s", "e").collect()) == want, (indexed, split, chrom, s, e)
            df = bam.alignments(spark, str(tmp_path / "x.bam"), split=split)
            assert df.count() == len(reads_)
            assert df.filter("chrom in ('c1', 'c3') and s >= 70000").count() == sum(r in (1, 3) and s >= 70_000 for r, s, _ in reads_)
            assert df.filter("chrom is null").count() == 1 and df.filter("s < 5").count() == sum(s < 5 for _, s, _ in reads_)
        if indexed:
            narrow = bam.BamReader(str(tmp_path / "x.bam"), 2000)
            list(narrow.pushFilters([bam.EqualTo(("chrom",), "c1"), bam.LessThan(("s",), 100), bam.GreaterThan(("e",), 50)]))
            assert 0 < len(narrow.partitions()) < len(read_all.partitions()) / 2
            (tmp_path / "x.bam.bai").unlink()


def test_pages_have_genes_and_evidence(spark, tmp_path):
    candidates_file(tmp_path / "A.tsv", 0), candidates_file(tmp_path / "B.tsv", 10)
    (tmp_path / "r.gtf").write_text('1\ts\tgene\t12500\t13100\t.\t+\t.\tgene_id "near<1>";\n1\ts\texon\t12500\t12600\t.\t+\t.\tgene_id "near<1>"; transcript_id "t";\n1\ts\tgene\t900000\t900100\t.\t+\t.\tgene_id "far";\n')
    merge.run(spark, MergeConfig(tsvs=(str(tmp_path / "A.tsv"), str(tmp_path / "B.tsv")), out_prefix=str(tmp_path / "p"), emit_plots=True, reference_gtf=str(tmp_path / "r.gtf")))
    page = (tmp_path / "p_plots" / "consensus_transcript_1.html").read_text()
    assert "gene near&lt;1&gt; 12500-13100 +" in page and "far" not in page and "exon" not in page and "mean_avg_depth" in page
    assert report.shown(0.123456) == "0.123" and report.shown(None) == "NA" and report.shown(12345.678) == "1.23e+04"
    assert report.reference_genes(spark, str(tmp_path / "none.gtf")) == {} and report.reference_genes(spark, None) == {}


def test_indexed_genome(spark, tmp_path):
    rng = np.random.default_rng(9)
    seq = {f"c{i}": "".join(rng.choice(list("acgtACGTN"), n)) for i, n in enumerate((1000, 61, 60, 0, 7))}
    data, index = "", ""
    for k, (name, s) in enumerate(seq.items()):
        data += f">{name} some text\r\n"
        end = "\r\n" if k % 2 == 0 else "\n"
        index += f"{name}\t{len(s)}\t{len(data)}\t60\t{60 + len(end)}\n"
        data += "".join(s[i : i + 60] + end for i in range(0, len(s), 60))
    (tmp_path / "g.fa").write_bytes(data.encode())
    (tmp_path / "g.fa.fai").write_text(index)
    wanted = spark.createDataFrame([(c, t) for c in (*seq, "c9") for t in range(-1, 30)] * 2, "chrom string, tile long")
    got = {(r["chrom"], r["tile"]): r["seq"] for r in text.indexed_genome(spark, str(tmp_path / "g.fa"), wanted, 100).collect()}
    assert got == {(c, i // 100): s[i : i + 100] for c, s in seq.items() for i in range(0, len(s), 100)}
    plain = {(r["chrom"], r["tile"]): r["seq"] for r in text.genome(spark, str(tmp_path / "g.fa"), 100).collect()}
    assert plain == got
    exons = [("c0", "+", (1, 5)), ("c0", "-", (90, 215)), ("c1", "+", (50, 400)), ("c3", "+", (1, 9)), ("c9", "+", (1, 9))]
    (tmp_path / "t.gtf").write_text("".join(f'{c}\ts\texon\t{s}\t{e}\t.\t{d}\t.\ttranscript_id "t{i}";\n' for i, (c, d, (s, e)) in enumerate(exons)))
    extract.run(spark, str(tmp_path / "g.fa"), str(tmp_path / "t.gtf"), str(tmp_path / "with.fa"))
    (tmp_path / "g.fa.fai").unlink()
    extract.run(spark, str(tmp_path / "g.fa"), str(tmp_path / "t.gtf"), str(tmp_path / "without.fa"))
    assert (tmp_path / "with.fa").read_text() == (tmp_path / "without.fa").read_text() and (tmp_path / "with.fa").read_text().count(">") == 3


def test_votes_are_counted_as_pairs_are(spark):
    rng = np.random.default_rng(11)
    spans = lambda n, far: [(f"c{rng.integers(2)}", int(s), int(s + rng.integers(-2, far)), s) for s in rng.integers(0, 2_500, n) * rng.choice([1, 997], n)]
    reads = [(c, s, e, int(rng.choice([0, 16, 1, 17, 65, 129]))) for c, s, e, _ in spans(400, 90)] + [(None, 1, 9, 0), ("c0", None, 9, 0)]
    exons = [(c, s, e, [".", "+", "-", None][int(rng.integers(4))]) for c, s, e, _ in spans(500, 300)]
    want = [0, 0]
    for c, s, e, flag in reads:
        strand = "-" if bool(flag & 16) != (flag & 1 == 1 and not flag & 64) else "+"
        for d, a, b, other in exons:
            if None not in (s, other) and c == d and s < b and e > a:
                want[strand != other] += 1
    r, x = spark.createDataFrame(reads, "chrom string, s long, e long, flag int"), spark.createDataFrame(exons, "chrom string, s long, e long, strand string")
    got = strandedness.votes(r, x)
    assert list(got.first()) == want and min(want) > 100
    assert strandedness.votes(r.limit(0), x).collect() == strandedness.votes(r, x.limit(0)).collect() and list(strandedness.votes(r.limit(0), x).first()) == [0, 0]
    many = spark.range(400).select(F.lit("c").alias("chrom"), (F.col("id") * 0).alias("s"), (F.col("id") * 0 + 60).alias("e"), F.lit("+").alias("strand"))
    one = many.limit(300).select("chrom", "s", "e", F.lit(0).alias("flag"))
    pairs = []
    old = strandedness.overlap_join
    strandedness.overlap_join = lambda a, b, keys, **k: pairs.append(out := old(a, b, keys, **k)) or out
    try:
        assert strandedness.votes(one, many).first()["n_forward"] == 300 * 400
    finally:
        strandedness.overlap_join = old
    assert sum(p.count() for p in pairs) == 0  # no pair of ordinary rows is made


def test_strandedness_takes_every_exon(spark):
    exons = spark.range(6_000).select(F.lit("c").alias("chrom"), (F.col("id") * 100).alias("s"), (F.col("id") * 100 + 60).alias("e"), F.lit("+").alias("strand"))
    assert strandedness.sampled_exons(exons).count() == 6_000
    reads = exons.select("chrom", "s", "e", F.lit(0).alias("flag"))
    assert strandedness.resolve(reads, exons, DetectConfig())["n_forward"] == 6_000


def test_nearest_and_left_joins_keep_rows_apart_when_read_again(spark):
    """A source that gives its rows in another order at each evaluation, as shuffles of large tables do."""
    spans = [("c", 100 * i, 100 * i + 10) for i in range(40)] + [("c", 100, 110), ("d", 5, 9), (None, 1, 2)]

    def mixed(batches):
        import random

        import pandas as pd

        rows = [r for b in batches for r in b.values.tolist()]
        random.shuffle(rows)
        yield pd.DataFrame(rows, columns=["chrom", "s", "e"]).astype({"s": "int64", "e": "int64"})

    a = spark.createDataFrame(spans, "chrom string, s long, e long").coalesce(1).mapInPandas(mixed, "chrom string, s long, e long")
    b = spark.createDataFrame([("c", 100 * i + 12, 100 * i + 20, f"g{i}") for i in range(40)], "chrom string, s long, e long, gene_id string")
    got = nearest(a, b, ["chrom"], ["s"]).select("chrom", "s", "near.gene_id", "distance").collect()
    assert sorted(map(str, got)) == sorted(str(Row(chrom=c, s=s, gene_id=f"g{s // 100}" if c == "c" else None, distance=2 if c == "c" else -1)) for c, s, _ in spans)
    left = overlap_join(a, b.withColumn("s", F.col("s") - 5).filter("gene_id <> 'g1'"), ["chrom"], how="left").select("chrom", "a_s", "b_gene_id").collect()
    assert sorted(map(str, left)) == sorted(str(Row(chrom=c, a_s=s, b_gene_id=f"g{s // 100}" if c == "c" and s != 100 else None)) for c, s, _ in spans)


def test_overlay_strings_list_every_id(spark, tmp_path):
    from strandwise.plans import queries

    spark.createDataFrame([(331 * 0, 2, "A", 1.0, "BUILDING")] + [(500_000 * i, 2, "A", 1.0, "BUILDING") for i in range(1, 25)], "c_custkey long, c_nationkey int, c_name string, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(0, 0, "O", 1.0, "1-URGENT")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    got = queries.overlay_strings(spark, str(tmp_path)).first()
    assert got["n"] == 25 and got["ids"] == ";".join(f"F{500_000 * i}" for i in range(25))


def test_files_are_sorted_and_joined_from_many_parts(spark, tmp_path, monkeypatch):
    rows = spark.range(5_000, numPartitions=6).select((F.col("id") * 7919 % 5_000).alias("k")).withColumn("value", F.concat(F.lit("v"), F.col("k").cast("string")))
    lines, most, join = [f"v{i}" for i in range(5_000)], [], sinks._one_file

    def watched(*args):
        most.extend(len(f.read_text().splitlines()) for f in tmp_path.glob("*.parts/part-*"))
        return join(*args)

    monkeypatch.setattr(sinks, "_one_file", watched)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sinks.write_lines(rows, str(tmp_path / "a.txt"), ["k"], ["h1", "h2"])
        assert max(most) < 5_000  # no task writes all
        assert (tmp_path / "a.txt").read_text().splitlines() == ["h1", "h2", *lines] and [f.name for f in tmp_path.iterdir() if f.name[0] != "."] == ["a.txt"]
        merged = sinks.write_merged(got, rows.filter("k < 100"), str(tmp_path / "m.txt"), ["k"], "# mark")
        assert (tmp_path / "m.txt").read_text().splitlines() == ["h1", "h2", *lines, "# mark", *lines[:100]]
        assert sinks.write_lines(rows.limit(0), merged, ["k"]) and (tmp_path / "m.txt").read_text() == ""
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_candidate_ids_count_on_across_splits(spark, tmp_path):
    head = "region_id\tchrom\tstart\tend\tclass\tdominant_strand"
    for name, n in (("b", 700), ("a", 900)):
        (tmp_path / f"{name}.tsv").write_text("\n".join([head, *[f"{name}{i}\tchr1\t{i + 1}\t{i + 9}\tx\t+" for i in range(n)]]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = text.candidate_tables(spark, (str(tmp_path / "b.tsv"), str(tmp_path / "a.tsv")))
        assert [r["region_id"] for r in got.select("region_id", "id").orderBy("id").collect()] == [f"b{i}" for i in range(700)] + [f"a{i}" for i in range(900)]
        assert sorted(r["id"] for r in got.select("id").collect()) == list(range(1, 1_601))
        assert got.select(F.spark_partition_id()).distinct().count() > 1  # no task numbers all rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
