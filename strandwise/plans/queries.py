"""Registered queries of the interval engine: one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import DetectConfig, MergeConfig
from ..functions import scalars
from ..operators import classify, consensus, context, coverage, overlay, reads, sequence, strandedness
from ..operators.intervals import contained_points, islands, nearest, overlap_join, union_length
from . import fixtures
from .fixtures import CANDIDATES, EXONS, FEATURES, GENES, READS, candidates, exons, features, genes, table

CFG, KEYS = DetectConfig(), ["chrom"]
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Reads

_DROPPED = "flag & 4 <> 0 or flag & 512 <> 0 or flag & 2048 <> 0"
_CATEGORY = f"case when {_DROPPED} or flag & 1024 <> 0 then null when flag & 256 <> 0 then 'multi' when mapq >= 20 then 'unique' else 'multi' end"


@query(f"""with {READS} select l_orderkey, l_linenumber, {_CATEGORY} category, case when flag & 64 <> 0 or flag & 1 = 0 then case when flag & 16 <> 0 then '-' else '+' end else case when flag & 16 <> 0 then '+' else '-' end end forward_strand,
  case when flag & 64 <> 0 or flag & 1 = 0 then case when flag & 16 <> 0 then '+' else '-' end else case when flag & 16 <> 0 then '-' else '+' end end reverse_strand, (s + e) // 2 midpoint,
  flag & 1024 <> 0 and not ({_DROPPED}) and flag & 256 = 0 and mapq >= 20 dropped_duplicate from reads""")
def read_category(spark, d):
    return fixtures.reads(spark, d).select("l_orderkey", "l_linenumber", reads.category(CFG).alias("category"), reads.strand("forward").alias("forward_strand"), reads.strand("reverse").alias("reverse_strand"), reads.midpoint().alias("midpoint"), reads.dropped_duplicate(CFG).alias("dropped_duplicate"))


@query(f"""with {READS}, b as (select l_orderkey, l_linenumber, chrom, unnest([s, s + 60]) s, unnest([s + 40, e + 20]) e from reads)
  select l_orderkey, l_linenumber, chrom, s, least(e, 38400) e from b where s < least(e, 38400)""")
def block_clip(spark, d):
    two = F.array(F.struct(F.col("s").alias("start"), (F.col("s") + 40).alias("end")), F.struct((F.col("s") + 60).alias("start"), (F.col("e") + 20).alias("end")))
    sizes = spark.createDataFrame([("chr1", 38400), ("chr2", 38400)], "chrom string, length long")
    rows = fixtures.reads(spark, d).withColumn("blocks", two).drop("s", "e")
    return reads.blocks(rows, sizes).select("l_orderkey", "l_linenumber", "chrom", "s", "e")


# Coverage

_IV = """iv as (select chrom, s, e, (category = 'unique' and strand = '+')::bigint plus, (category = 'unique' and strand = '-')::bigint minus, (category = 'multi')::bigint multi, 0 pmask, 0 mmask, 0 exon from reads
  union all select chrom, s, e, 0, 0, 0, (strand <> '-')::bigint, (strand <> '+')::bigint, 0 from genes union all select chrom, s, e, 0, 0, 0, 0, 0, 1 from exons)"""
_COUNT = ("plus", "minus", "multi", "pmask", "mmask", "exon")
_SEGS = f"""{READS}, {GENES}, {EXONS}, {_IV}, ev as (select chrom, s pos, {', '.join(_COUNT)} from iv where s < e union all select chrom, e, {', '.join('-' + c for c in _COUNT)} from iv where s < e),
  sums as (select chrom, pos s, {', '.join(f'sum({c}) {c}' for c in _COUNT)} from ev group by all),
  run as (select chrom, s, lead(s) over w e, {', '.join(f'(sum({c}) over w)::bigint {c}' for c in _COUNT)} from sums window w as (partition by chrom order by s rows between unbounded preceding and current row)),
  seg as (select chrom, s, lead(s) over (partition by chrom order by s) e, {', '.join(_COUNT)} from run),
  segs as (select * from seg where e is not null and not ({' and '.join(f'{c} = 0' for c in _COUNT)}))"""


def _segs(spark, d):
    parts = [coverage.read_intervals(fixtures.reads(spark, d), KEYS), coverage.mask_intervals(genes(spark, d), KEYS), coverage.mask_intervals(exons(spark, d), KEYS, exons=True)]
    return coverage.sweep(parts, KEYS)


@query(f"with {_SEGS} select chrom, s, e, plus, minus, multi from segs where plus <> 0 or minus <> 0 or multi <> 0")
def coverage_rle(spark, d):
    return _segs(spark, d).select("chrom", "s", "e", "plus", "minus", "multi").filter("plus <> 0 or minus <> 0 or multi <> 0")


@query(f"with {_SEGS} select sum((e - s) * (plus + minus))::bigint unique_total, sum((e - s) * multi)::bigint multi_total from segs")
def coverage_totals(spark, d):
    return coverage.totals(_segs(spark, d))


@query(f"with {_SEGS} select chrom, greatest(s, 3900) s, least(e, 12500) e, plus, minus, multi from segs where chrom = 'chr1' and s < 12500 and e > 3900")
def coverage_window(spark, d):
    return coverage.window(_segs(spark, d), "chr1", 3900, 12_500).select("chrom", "s", "e", "plus", "minus", "multi")


@query(f"""with {_SEGS}, w as (select *, greatest(s, 100) f, least(e, 40100) t from segs where s < 40100 and e > 100),
  b as (select *, unnest(range((f - 100) // 12, (t - 1 - 100) // 12 + 1)) bin from w) select chrom, 100 + bin * 12 x, max(plus) plus, max(minus) minus from b group by all""")
def max_pool(spark, d):
    rows = _segs(spark, d).withColumn("from", F.lit(100)).withColumn("to", F.lit(40_100))
    return coverage.max_pool(rows, ["chrom"], ["plus", "minus"], "from", "to", bins=3500).select("chrom", F.col("x").cast("long").alias("x"), "plus", "minus")


def _regions_sql(stranded: bool) -> str:
    blocked = "pmask > 0 and mmask > 0" if stranded else "pmask > 0 or mmask > 0"
    p, m = ("case when pmask > 0 then 0 else plus end", "case when mmask > 0 then 0 else minus end") if stranded else ("plus", "minus")
    return f"""{_SEGS}, own as (select chrom, s, e, {p} p, {m} m, multi, exon, {blocked} blocked from segs),
  bl as (select *, coalesce(sum(case when blocked then e - s else 0 end) over (partition by chrom order by s rows between unbounded preceding and 1 preceding), 0) b from own),
  cov as (select * from bl where p + m >= 10 and not blocked), gp as (select *, lag(e) over w le, lag(b) over w lb from cov window w as (partition by chrom order by s)),
  isl as (select *, sum(case when le is null or s - le > 50 or (s - le > 0 and b > lb) then 1 else 0 end) over (partition by chrom order by s) i from gp),
  found as (select chrom, min(s) rs, max(e) re from isl group by chrom, i)"""


@query(f"with {_regions_sql(False)} select chrom, rs s, re e from found")
def mask_positional(spark, d):
    return coverage.regions(coverage.masked(_segs(spark, d), False), KEYS, CFG.min_depth, CFG.max_gap)


@query(f"with {_regions_sql(True)} select chrom, rs s, re e from found")
def mask_stranded(spark, d):
    return coverage.regions(coverage.masked(_segs(spark, d), True), KEYS, CFG.min_depth, CFG.max_gap)


_SPREAD = "(n::hugeint * {q} - {s}::hugeint * {s})::double"
_VPP, _VMM = _SPREAD.format(q="pp", s="sp"), _SPREAD.format(q="mm", s="sm")
_METRICS = f"""{_regions_sql(True)}, g as (select chrom, rs s, re e, re - rs n, sum(case when p + m >= 10 then w else 0 end)::bigint cb, max(p + m) md, sum(case when p >= 3 then w else 0 end)::bigint lp, sum(case when m >= 3 then w else 0 end)::bigint lm,
  sum(case when p >= 3 and m >= 3 then w else 0 end)::bigint n_both, sum(case when p >= 3 or m >= 3 then w else 0 end)::bigint n_either, sum(w * p)::bigint sp, sum(w * m)::bigint sm, sum(w * multi)::bigint sx,
  sum(w * p * p)::bigint pp, sum(w * m * m)::bigint mm, sum(w * p * m)::bigint pm, max(exon > 0) exonic from (select *, e - s w from own) o join (select chrom c, rs, re from found) f on o.chrom = f.c and o.s >= rs and o.s < re group by chrom, rs, re),
  mets as (select chrom, s, e, n length, cb covered_bases, cb / n covered_fraction, sp + sm total_coverage, (sp + sm) / n avg_depth, md max_depth, sx multi_total,
  case when sp + sm + sx = 0 then 1.0::double else (sp + sm) / (sp + sm + sx) end unique_fraction, lp plus_covered_len, lm minus_covered_len, sp / n plus_mean_depth, sm / n minus_mean_depth,
  case when greatest(sp, sm) = 0 then 0.0::double else least(sp / n, sm / n) / greatest(sp / n, sm / n) end pm_depth_ratio, case when greatest(lp, lm) = 0 then 0.0::double else least(lp, lm) / greatest(lp, lm) end covered_len_ratio,
  case when greatest(lp, lm) = 0 then 0.0::double else abs(lp - lm) / greatest(lp, lm) end strand_length_ratio_diff, case when sp > sm then '+' when sp < sm then '-' else '.' end dominant_strand,
  case when sp + sm = 0 then 1.0::double else greatest(sp, sm) / (sp + sm) end dominant_strand_fraction, n_both / n dual_strand_fraction, case when n_either = 0 then 0.0::double else n_both / n_either end strand_overlap_jaccard,
  case when n < 2 or {_VPP} <= 0 or {_VMM} <= 0 then 0.0::double else greatest(-1.0::double, least(1.0::double, (n::hugeint * pm - sp::hugeint * sm)::double / (sqrt({_VPP}) * sqrt({_VMM})))) end profile_correlation,
  case when sp = 0 then 0.0::double else sqrt({_VPP}) / sp end plus_cv, case when sm = 0 then 0.0::double else sqrt({_VMM}) / sm end minus_cv,
  case when sp + sm = 0 then 1.0::double when sp = 0 or sm = 0 then 0.0::double else -(sp / (sp + sm) * log2(sp / (sp + sm)) + (1 - sp / (sp + sm)) * log2(1 - sp / (sp + sm))) end strand_balance, exonic from g),
  mt as (select * from mets where length >= 200 and covered_bases >= 100 and covered_fraction >= 0.7)"""
_METRIC_COLUMNS = ["covered_bases", "covered_fraction", "total_coverage", "avg_depth", "max_depth", "multi_total", "unique_fraction", "plus_covered_len", "minus_covered_len", "plus_mean_depth", "minus_mean_depth", "pm_depth_ratio", "covered_len_ratio", "strand_length_ratio_diff", "dominant_strand", "dominant_strand_fraction", "dual_strand_fraction", "strand_overlap_jaccard", "exonic"]


def found(spark, d):
    return coverage.discover(_segs(spark, d), KEYS, CFG, stranded=True)


@query(f"with {_METRICS} select chrom, s, e, length, covered_bases from mt")
def discover_regions(spark, d):
    return found(spark, d).select("chrom", "s", "e", "length", "covered_bases")


@query(f"with {_METRICS} select chrom, s, e, {', '.join(_METRIC_COLUMNS)} from mt")
def region_metrics(spark, d):
    return found(spark, d).select("chrom", "s", "e", *_METRIC_COLUMNS)


@query(f"with {_METRICS} select chrom, s, e, round(profile_correlation, 9) profile_correlation, round(plus_cv, 9) plus_cv, round(minus_cv, 9) minus_cv, round(strand_balance, 9) strand_balance from mt")
def region_shapes(spark, d):
    return found(spark, d).select("chrom", "s", "e", *[F.round(c, 9).alias(c) for c in ("profile_correlation", "plus_cv", "minus_cv", "strand_balance")])


_CLASS = """case when unique_fraction < 0.5 then 'likely_multimapper_artifact' when dominant_strand_fraction >= 0.8 then 'likely_novel_transcript'
  when dual_strand_fraction >= 0.6 and strand_length_ratio_diff <= 0.25 and covered_fraction >= 0.5 and pm_depth_ratio >= 0.5 and (profile_correlation >= 0.7 or (plus_cv <= 0.4 and minus_cv <= 0.4)) then 'likely_gDNA' else 'possible_bidirectional_RNA' end"""
_CLASSED = f"{_METRICS}, cl as (select *, {_CLASS} class from mt), kp as (select *, class not in ('likely_gDNA', 'likely_multimapper_artifact') kept from cl)"


def classed(spark, d):
    return classify.classified(found(spark, d), CFG)


@query(f"with {_CLASSED} select chrom, s, e, class, kept from kp")
def classify_regions(spark, d):
    return classed(spark, d).select("chrom", "s", "e", "class", "kept")


@query(f"with {_CLASSED} select chrom, class, count(*) n_regions, sum(length)::bigint bases from kp group by all")
def class_counts(spark, d):
    return classed(spark, d).groupBy("chrom", "class").agg(F.count("*").alias("n_regions"), F.sum("length").alias("bases"))


@query(f"with {_CLASSED} select chrom, s, e, case when kept then 'unknown_transcript_' || row_number() over (partition by kept order by chrom, s, e) end unknown_transcript_name, chrom || ':' || s || '-' || e region_id from kp")
def kept_named(spark, d):
    rows = classed(spark, d).withColumn("region_id", scalars.region_id(F.col("chrom"), F.col("s"), F.col("e")))
    return consensus.numbered(rows, "kept", ["chrom", "s", "e"], "unknown_transcript", "unknown_transcript_name").select("chrom", "s", "e", "unknown_transcript_name", "region_id")


# Genes

@query(f"with {_METRICS}, {'x as (select 1)'} select m.chrom, m.s, m.e, gene_id from mt m join genes g on m.chrom = g.chrom and m.s < g.e and m.e > g.s")
def gene_overlap(spark, d):
    return overlap_join(found(spark, d).select("chrom", "s", "e"), genes(spark, d).select("chrom", "s", "e", "gene_id"), KEYS).select("chrom", F.col("a_s").alias("s"), F.col("a_e").alias("e"), F.col("b_gene_id").alias("gene_id"))


_NEAREST = """nr as (select c.chrom, c.s, c.e, arg_min(gene_id, (greatest(g.s - c.e, c.s - g.e, 0), g.s, ord)) gene_id, min(greatest(g.s - c.e, c.s - g.e, 0)) distance from {rows} c left join genes g on c.chrom = g.chrom group by all)"""


@query(f"with {CANDIDATES}, {GENES}, c as (select distinct chrom, s, e from cand), {_NEAREST.format(rows='c')} select chrom, s, e, gene_id, coalesce(distance, -1) distance from nr")
def nearest_gene(spark, d):
    rows = candidates(spark, d).select("chrom", "s", "e").distinct()
    return nearest(rows, genes(spark, d).select("chrom", "s", "e", "gene_id", "ord"), KEYS, ["s", "ord"]).select("chrom", "s", "e", F.col("near.gene_id").alias("gene_id"), "distance")


@query(f"""with {_METRICS}, {_NEAREST.format(rows='mt')}, ov as (select m.chrom, m.s, m.e, bool_or(g.strand = dominant_strand or g.strand = '.' or dominant_strand = '.') same from mt m join genes g on m.chrom = g.chrom and m.s < g.e and m.e > g.s group by all)
  select m.chrom, m.s, m.e, gene_id nearest_feature_id, coalesce(distance, -1) nearest_feature_distance, case when same is null then case when distance <= 10000 then 'near_gene' else 'intergenic' end when not same then 'antisense' when exonic then 'sense_genic_unannotated' else 'intronic' end context_label
  from mt m join nr using (chrom, s, e) left join ov using (chrom, s, e)""")
def context_label(spark, d):
    rows = found(spark, d).select("chrom", "s", "e", "dominant_strand", "exonic")
    return context.with_genes(rows, genes(spark, d), CFG.nearest_feature_window).select("chrom", "s", "e", "nearest_feature_id", "nearest_feature_distance", "context_label")


@query(f"with {CANDIDATES}, {GENES}, {EXONS}, c as (select distinct chrom, s, e from cand) select chrom, s, e from c where exists (select 1 from exons x where x.chrom = c.chrom and x.s < c.e and x.e > c.s)")
def exon_semi(spark, d):
    rows = candidates(spark, d).select("chrom", "s", "e").distinct()
    hits = overlap_join(rows, exons(spark, d).select("chrom", "s", "e"), KEYS)
    return hits.select("chrom", F.col("a_s").alias("s"), F.col("a_e").alias("e")).distinct()


# Reads in masks and regions

_MID = f"{READS}, {GENES}, {EXONS}, rp as (select *, (s + e) // 2 pos from reads), an as (select *, exists (select 1 from exons x where x.chrom = rp.chrom and (x.strand = rp.strand or x.strand = '.') and pos >= x.s and pos < x.e) annotated from rp)"


def _annotated(spark, d):
    rows = fixtures.reads(spark, d).withColumn("pos", reads.midpoint())
    return strandedness.midpoint_in_mask(rows, exons(spark, d))


@query(f"with {_MID} select l_orderkey, l_linenumber, annotated from an")
def read_in_mask(spark, d):
    return _annotated(spark, d).select("l_orderkey", "l_linenumber", "annotated")


@query(f"with {_MID} select count(*) filter (category = 'unique') unique_reads, count(*) filter (category = 'unique' and annotated) annotated_reads, count(*) filter (category = 'multi') multi_reads from an")
def read_stats(spark, d):
    return reads.read_stats(_annotated(spark, d))


_AN = "rp as (select *, (s + e) // 2 pos from reads), an as (select *, exists (select 1 from exons x where x.chrom = rp.chrom and (x.strand = rp.strand or x.strand = '.') and pos >= x.s and pos < x.e) annotated from rp)"
_PER = f"{_CLASSED}, {_AN}, per as (select k.chrom, k.s, k.e, k.class, (select count(*) from an where an.chrom = k.chrom and category = 'unique' and not annotated and pos >= k.s and pos < k.e) n_reads from kp k)"


@query(f"with {_PER} select chrom, s, e, n_reads from per")
def reads_per_region(spark, d):
    return strandedness.reads_per_region(_annotated(spark, d).filter("category = 'unique'"), found(spark, d))


@query(f"""with {_PER}, st as (select count(*) filter (category = 'unique') u, count(*) filter (category = 'unique' and annotated) a from an),
  sm as (select {', '.join(f"coalesce(sum(n_reads) filter (class = '{c}'), 0)::bigint {n}" for n, c in (('novel_transcript', 'likely_novel_transcript'), ('bidirectional_RNA', 'possible_bidirectional_RNA'), ('gDNA', 'likely_gDNA'), ('multimapper_artifact', 'likely_multimapper_artifact')))} from per)
  select a annotated, sm.*, greatest(0, u - a - novel_transcript - bidirectional_RNA - gDNA - multimapper_artifact) other_unannotated from sm, st""")
def read_assignment(spark, d):
    rows = classed(spark, d).select("chrom", "s", "e", "class")
    an = _annotated(spark, d)
    per = strandedness.reads_per_region(an.filter("category = 'unique'"), rows).join(rows, ["chrom", "s", "e"])
    return strandedness.assignment(per, reads.read_stats(an))


@query(f"""with {_CLASSED}, t as (select sum((e - s) * (plus + minus))::bigint genome_mapped_unique_coverage, sum((e - s) * multi)::bigint genome_mapped_multi_coverage from segs),
  q as (select coalesce(sum(total_coverage), 0)::bigint candidate_unique_coverage, coalesce(sum(length), 0)::bigint candidate_bases, coalesce(sum(total_coverage) filter (class = 'likely_gDNA'), 0)::bigint gDNA_unique_coverage,
  coalesce(sum(length) filter (class = 'likely_gDNA'), 0)::bigint gDNA_bases, count(*) filter (class = 'likely_gDNA') n_gDNA_regions from cl)
  select t.*, q.*, case when genome_mapped_unique_coverage > 0 then 100.0::double * gDNA_unique_coverage / genome_mapped_unique_coverage else 0.0::double end pct_gDNA_of_mapped_coverage,
  case when candidate_unique_coverage > 0 then 100.0::double * gDNA_unique_coverage / candidate_unique_coverage else 0.0::double end pct_gDNA_of_candidate_coverage, case when candidate_bases > 0 then 100.0::double * gDNA_bases / candidate_bases else 0.0::double end pct_gDNA_of_candidate_bases from q, t""")
def gdna_qc(spark, d):
    return strandedness.gdna_qc(classed(spark, d), coverage.totals(_segs(spark, d)))


@query(f"""with {READS}, {GENES}, x as (select chrom, s, e, strand from genes where strand <> '.' and e - s >= 50), r as (select chrom, s, e, case when flag & 64 <> 0 or flag & 1 = 0 then case when flag & 16 <> 0 then '-' else '+' end else case when flag & 16 <> 0 then '+' else '-' end end strand from reads where mapq >= 20),
  v as (select count(*) filter (r.strand = x.strand) n_forward, count(*) filter (r.strand <> x.strand) n_reverse from r join x on r.chrom = x.chrom and r.s < x.e and r.e > x.s), p as (select *, case when n_forward + n_reverse > 0 then n_forward / (n_forward + n_reverse) end p_forward from v)
  select n_forward, n_reverse, p_forward, case when p_forward is null then 0.0::double when p_forward >= 0.8 then p_forward when p_forward <= 1 - 0.8::double then 1 - p_forward else 1 - 2 * abs(p_forward - 0.5::double) end confidence, case when p_forward >= 0.8 then 'forward' when p_forward <= 1 - 0.8::double then 'reverse' else 'unstranded' end library from p""")
def strandedness_vote(spark, d):
    rows = fixtures.reads(spark, d).filter("mapq >= 20")
    return strandedness.decision(strandedness.votes(rows, strandedness.sampled_exons(genes(spark, d))))


# Generic intervals

@query(f"""with {READS}, m as (select chrom, strand, s, e, max(e) over (partition by chrom, strand order by s, e rows between unbounded preceding and 1 preceding) pe from reads), i as (select *, sum(case when s <= pe then 0 else 1 end) over (partition by chrom, strand order by s, e rows between unbounded preceding and current row) i from m)
  select chrom, strand, min(s) s, max(e) e, count(*) n from i group by chrom, strand, i""")
def interval_union(spark, d):
    return islands(fixtures.reads(spark, d), ["chrom", "strand"])


@query(f"""with {GENES}, m as (select chrom, s, e, max(e) over (partition by chrom order by s, e rows between unbounded preceding and 1 preceding) pe from genes), i as (select *, sum(case when s - pe <= 50 then 0 else 1 end) over (partition by chrom order by s, e rows between unbounded preceding and current row) i from m)
  select chrom, min(s) s, max(e) e, count(*) n from i group by chrom, i""")
def gap_merge(spark, d):
    return islands(genes(spark, d), KEYS, max_gap=50)


@query("""with t as (select user_id, epoch_us(ts) s, epoch_us(ts) + 1800000000 e from events), m as (select *, max(e) over (partition by user_id order by s rows between unbounded preceding and 1 preceding) pe from t), i as (select *, sum(case when s <= pe then 0 else 1 end) over (partition by user_id order by s rows between unbounded preceding and current row) i from m)
  select user_id, min(s) s, max(e) e, count(*) n from i group by user_id, i""")
def event_islands(spark, d):
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return islands(table(spark, d, "events").select("user_id", t.alias("s"), (t + 1_800_000_000).alias("e")), ["user_id"], tile=None)


@query(f"with {_MID} select l_orderkey, l_linenumber from rp where exists (select 1 from genes g where g.chrom = rp.chrom and pos >= g.s and pos < g.e)")
def point_semi(spark, d):
    rows = fixtures.reads(spark, d).withColumn("pos", reads.midpoint())
    return contained_points(rows, genes(spark, d), KEYS).select("l_orderkey", "l_linenumber")


# Consensus

MERGE = MergeConfig()
_RO = "greatest(least(a.e, b.e) - greatest(a.s, b.s), 0) / greatest(a.e - a.s, b.e - b.s)"
_PAIRS = f"{CANDIDATES}, pairs as (select a.chrom, a.dominant_strand, a.id a, b.id b from cand a join cand b on a.chrom = b.chrom and a.dominant_strand = b.dominant_strand and a.s < b.e and a.e > b.s and a.id < b.id where {_RO} >= 0.85)"
_CLUSTERS = f"recursive {_PAIRS}, ed as (select a, b from pairs union select b, a from pairs), reach(id, r) as (select id, id from cand union select reach.id, ed.b from reach join ed on reach.r = ed.a), comp as (select id, min(r) as cluster from reach group by id), mem as (select * from cand join comp using (id))"


@query(f"with {_PAIRS} select * from pairs")
def reciprocal_pairs(spark, d):
    return consensus.reciprocal_pairs(candidates(spark, d), ["chrom", "dominant_strand"], MERGE.min_reciprocal_overlap)


@query(f"with {_CLUSTERS} select id, cluster from mem")
def consensus_clusters(spark, d):
    return consensus.clusters(candidates(spark, d), ["chrom", "dominant_strand"], MERGE.min_reciprocal_overlap).select("id", "cluster")


_PRIO = "case class when 'likely_gDNA' then 0 when 'likely_multimapper_artifact' then 1 when 'possible_bidirectional_RNA' then 2 else 3 end"
_VOTE = f"vt as (select cluster, arg_min(class, (-n, {_PRIO}, class)) majority_class, arg_min(n, (-n, {_PRIO}, class)) votes from (select cluster, class, count(*) n from mem group by all) group by cluster)"


@query(f"with {CANDIDATES}, mem as (select *, s // 1000 as cluster from cand), {_VOTE} select cluster, majority_class, votes majority_class_votes from vt")
def class_vote(spark, d):
    rows = candidates(spark, d).withColumn("cluster", F.floor(F.col("s") / 1000))
    return consensus.vote(rows, ["cluster"], "class", "majority_class")


_TABLE = f"""{_CLUSTERS}, {_VOTE}, cs as (select cluster, any_value(chrom) chrom, min(s) s, max(e) e, any_value(dominant_strand) strand, count(*) n_members, count(distinct sample)::int n_samples, string_agg(distinct sample, ',' order by sample) samples,
  string_agg(class, ',' order by id) member_classes, string_agg(region_id, ';' order by id) member_region_ids from mem group by cluster),
  ct as (select *, votes / n_members class_agreement, case majority_class when 'likely_gDNA' then 'recurrent_gDNA' when 'likely_multimapper_artifact' then 'recurrent_multimapper_artifact' when 'possible_bidirectional_RNA' then 'reproducible_bidirectional' else 'reproducible_novel' end consensus_class,
  n_samples >= 2 passes_min_samples, n_samples >= 2 and majority_class = 'likely_novel_transcript' in_consensus_gtf, chrom || ':' || s || '-' || e consensus_id from cs join vt using (cluster))"""
_COLS = ["consensus_id", "chrom", "s", "e", "strand", "consensus_class", "majority_class", "class_agreement", "n_samples", "n_members", "passes_min_samples", "in_consensus_gtf"]


def merged(spark, d):
    return consensus.consensus(candidates(spark, d), MERGE)


@query(f"with {_TABLE} select {', '.join(_COLS)}, samples, member_classes, member_region_ids from ct")
def consensus_table(spark, d):
    return merged(spark, d).select(*_COLS, F.array_join("samples", ",").alias("samples"), F.array_join("member_classes", ",").alias("member_classes"), F.array_join("member_region_ids", ";").alias("member_region_ids"))


@query(f"with {_TABLE} select consensus_id, strand, case when in_consensus_gtf then 'consensus_transcript_' || row_number() over (partition by in_consensus_gtf order by chrom, s, e, strand) end consensus_transcript_name from ct")
def consensus_named(spark, d):
    rows = consensus.numbered(merged(spark, d), "in_consensus_gtf", ["chrom", "s", "e", "strand"], "consensus_transcript", "consensus_transcript_name")
    return rows.select("consensus_id", "strand", "consensus_transcript_name")


@query("""select o_orderkey, sample, region_id, extra from (select o_orderkey, 'A' sample, 'r' || o_orderkey region_id, null extra from orders where o_orderstatus = 'F' union all select o_orderkey, 'B', 'r' || o_orderkey, o_orderpriority from orders where o_orderstatus <> 'F')""")
def sample_union(spark, d):
    o = table(spark, d, "orders").withColumn("region_id", F.concat(F.lit("r"), F.col("o_orderkey").cast("string")))
    a = o.filter("o_orderstatus = 'F'").select("o_orderkey", F.lit("A").alias("sample"), "region_id")
    b = o.filter("o_orderstatus <> 'F'").select("o_orderkey", F.lit("B").alias("sample"), "region_id", F.col("o_orderpriority").alias("extra"))
    return a.unionByName(b, allowMissingColumns=True)


# Overlay: one region for each distinct place of the candidates

_REG = f"{CANDIDATES}, {FEATURES}, reg as (select distinct substr(chrom, 4) chrom_key, s, e, dominant_strand strand, chrom || ':' || s || '-' || e || dominant_strand consensus_id from cand)"
_HIT = "hit as (select r.consensus_id, r.s rs, r.e re, f.* from reg r join feat f on r.chrom_key = f.chrom_key and r.s < f.e and r.e > f.s)"


def places(spark, d):
    c = candidates(spark, d)
    return c.select(scalars.normalise_chrom(F.col("chrom")).alias("chrom_key"), "s", "e", F.col("dominant_strand").alias("strand"), F.concat("region_id", "dominant_strand").alias("consensus_id")).distinct()


@query(f"with {_REG}, {_HIT} select consensus_id, fid from hit")
def overlay_overlap(spark, d):
    return overlay.overlaps(places(spark, d), features(spark, d)).select(F.col("a_consensus_id").alias("consensus_id"), F.col("b_fid").alias("fid"))


@query(f"with {_REG} select consensus_id, fid from reg r join feat f on r.chrom_key = f.chrom_key and r.s < f.e and r.e > f.s and not (f.strand in ('+', '-') and f.strand <> r.strand)")
def overlay_stranded(spark, d):
    return overlay.overlaps(places(spark, d), features(spark, d), stranded=True).select(F.col("a_consensus_id").alias("consensus_id"), F.col("b_fid").alias("fid"))


@query(f"""with {_REG}, {_HIT}, c as (select consensus_id, greatest(s, rs) s, least(e, re) e from hit), m as (select *, max(e) over (partition by consensus_id order by s, e rows between unbounded preceding and 1 preceding) pe from c), i as (select *, sum(case when s <= pe then 0 else 1 end) over (partition by consensus_id order by s, e rows between unbounded preceding and current row) i from m),
  bp as (select consensus_id, sum(e - s)::bigint bp from (select consensus_id, i, min(s) s, max(e) e from i group by all) group by 1), ty as (select consensus_id, string_agg(ftype || ':' || c, ',' order by ftype) types, sum(c)::bigint n from (select consensus_id, ftype, count(*) c from hit group by all) group by 1),
  ids as (select consensus_id, string_agg(fid, ';' order by s, e, ord) ids, array_to_string(list_sort(list_distinct(flatten(list(genes)))), ',') genes from hit group by 1)
  select consensus_id, coalesce(n, 0) n, coalesce(types, 'NA') types, coalesce(ids, 'NA') ids, coalesce(bp, 0) overlap_bp, coalesce(bp, 0) / (e - s) overlap_frac, coalesce(genes, 'NA') genes from reg left join bp using (consensus_id) left join ty using (consensus_id) left join ids using (consensus_id)""")
def overlay_strings(spark, d):
    return overlay.annotated(places(spark, d), features(spark, d), most_ids=None).select("consensus_id", "n", "types", "ids", "overlap_bp", "overlap_frac", "genes")


@query(f"""with {_REG}, {_HIT}, nn as (select r.consensus_id, arg_min(ftype || ':' || fid, (greatest(f.s - r.e, r.s - f.e, 0), f.s, f.e, ord)) nearest, min(greatest(f.s - r.e, r.s - f.e, 0)) d from reg r join feat f on r.chrom_key = f.chrom_key and r.s - 400 < f.e and r.e + 400 > f.s where r.consensus_id not in (select consensus_id from hit) group by 1)
  select consensus_id, coalesce(nearest, 'NA') nearest, case when consensus_id in (select consensus_id from hit) then 0 else coalesce(d, -1) end nearest_distance from reg left join nn using (consensus_id)""")
def overlay_nearest(spark, d):
    return overlay.annotated(places(spark, d), features(spark, d), window=400).select("consensus_id", "nearest", "nearest_distance")


@query(f"""with {FEATURES}, m as (select chrom_key, ftype, s, e, max(e) over (partition by chrom_key, ftype order by s, e rows between unbounded preceding and 1 preceding) pe from feat), i as (select *, sum(case when s <= pe then 0 else 1 end) over (partition by chrom_key, ftype order by s, e rows between unbounded preceding and current row) i from m)
  select ftype, sum(e - s)::bigint bp from (select chrom_key, ftype, i, min(s) s, max(e) e from i group by all) group by 1""")
def footprint(spark, d):
    return overlay.footprint(features(spark, d))


@query(f"with {FEATURES} select ftype, count(*) n from feat group by 1")
def feature_counts(spark, d):
    return features(spark, d).groupBy("ftype").agg(F.count("*").alias("n"))


_XT = f"{_REG}, {_HIT}, rc as (select consensus_id, case when e - s < 210 then 'short' else 'long' end class from reg), k as (select class, count(*) n_regions from rc group by 1)"


def _labelled(spark, d):
    r = places(spark, d)
    rows = overlay.annotated(r, features(spark, d)).withColumn("label", F.lit("customers"))
    return rows, r.select("consensus_id", F.when(F.col("e") - F.col("s") < 210, "short").otherwise("long").alias("class"))


@query(f"""with {_XT} select 'customers' as label, class, null ftype, n_regions, (select count(distinct h.consensus_id) from hit h join rc using (consensus_id) where rc.class = k.class) n_with from k
  union all select 'customers', class, ftype, n_regions, n from (select rc.class, ftype, count(distinct h.consensus_id) n from hit h join rc using (consensus_id) group by all) join k using (class)""")
def crosstab(spark, d):
    return overlay.crosstab(*_labelled(spark, d))


@query(f"with {_REG}, {_HIT} select 'customers' as label, (select count(*) from reg) n_regions, (select count(distinct consensus_id) from hit) n_with_overlap")
def source_stats(spark, d):
    return overlay.source_stats(_labelled(spark, d)[0])


# Scalars

@query(r"select p_partkey, coalesce(nullif(regexp_replace(regexp_replace(p_type || ' (' || p_name || ')', '[^A-Za-z0-9_.]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g'), ''), 'annotated') token from part")
def name_token(spark, d):
    return table(spark, d, "part").select("p_partkey", scalars.name_token(F.concat("p_type", F.lit(" ("), "p_name", F.lit(")"))).alias("token"))


@query("select p_partkey, 'new' || p_partkey gene_id, p_name gene_name, p_brand brand from part")
def gtf_attributes(spark, d):
    text = F.format_string('gene_id "old%s"; gene_name "%s"; brand "%s"; gene_id "new%s";', F.col("p_partkey").cast("string"), "p_name", "p_brand", F.col("p_partkey").cast("string"))
    m = scalars.attributes(text)
    return table(spark, d, "part").select("p_partkey", *[F.try_element_at(m, F.lit(k)).alias(k) for k in ("gene_id", "gene_name")], F.try_element_at(m, F.lit("brand")).alias("brand"))


@query("select p_partkey, 'x+' || p_partkey as id, p_name || ', ' || p_type note, null missing from part")
def gff3_attributes(spark, d):
    text = F.concat(F.lit("ID = x+"), F.col("p_partkey").cast("string"), F.lit(";Note="), F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("%2C "), F.col("p_type"), F.lit(";;flag"))
    m = scalars.attributes(text)
    return table(spark, d, "part").select("p_partkey", F.try_element_at(m, F.lit("ID")).alias("id"), F.try_element_at(m, F.lit("Note")).alias("note"), F.try_element_at(m, F.lit("gone")).alias("missing"))


@query("select n_nationkey, case when upper(x) in ('M', 'MT') then 'MT' else x end chrom from (select n_nationkey, case n_nationkey % 4 when 0 then cast(n_nationkey as varchar) when 1 then 'X' when 2 then 'MT' else 'm' end x from nation)")
def normalise_chrom(spark, d):
    k = F.col("n_nationkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit(" chr"), k.cast("string"))).when(k % 4 == 1, "CHRX").when(k % 4 == 2, "chrMT ").otherwise("m")
    return table(spark, d, "nation").select("n_nationkey", scalars.normalise_chrom(raw).alias("chrom"))


@query(f"select doc_id, md5(reverse(translate(text, '{scalars.BASES}', '{scalars.PAIRS}'))) rc from documents")
def reverse_complement(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(scalars.reverse_complement(F.col("text")).cast("binary")).alias("rc"))


@query(r"select c_custkey, rtrim(regexp_replace(repeat(c_name, 12), '(.{60})', E'\\1\n', 'g'), E'\n') as lines from customer")
def wrap(spark, d):
    return table(spark, d, "customer").select("c_custkey", scalars.wrap(F.repeat("c_name", F.lit(12))).alias("lines"))


@query(f"""with g as (select 'chr' || (1 + s_suppkey % 2) chrom, string_agg(substr(md5(s_name), 1, 20), '' order by s_suppkey) seq from supplier group by 1), {GENES}
  select gene_id, case when strand = '-' then reverse(translate(q, '{scalars.BASES}', '{scalars.PAIRS}')) else q end seq from (select gene_id, strand, upper(substr(seq, (ord % 300 + 1)::bigint, 25) || substr(seq, (ord % 300 + 41)::bigint, 30)) q from genes join g using (chrom)) where q <> ''""")
def transcript_concat(spark, d):
    k = F.col("s_suppkey")
    whole = table(spark, d, "supplier").groupBy(F.concat(F.lit("chr"), (1 + k % 2).cast("string")).alias("chrom")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, F.substring(F.md5(F.col("s_name").cast("binary")), 1, 20).alias("x")))), lambda v: v["x"]), "").alias("whole"))
    tiles = whole.withColumn("tile", F.explode(F.sequence(F.lit(0), F.floor((F.length("whole") - 1) / 64)))).select("chrom", "tile", F.substring("whole", (F.col("tile") * 64 + 1).cast("int"), F.lit(64)).alias("seq"))
    at = F.col("ord") % 300
    x = F.array(F.struct((at + 40).alias("s"), (at + 70).alias("e")), F.struct(at.alias("s"), (at + 25).alias("e")))
    t = genes(spark, d).select(F.col("gene_id").alias("name"), "chrom", "strand", x.alias("exons"))
    return sequence.extract(t, tiles, 64).select(F.col("name").alias("gene_id"), "seq")


@query("select o_custkey transcript_id, min(o_orderkey) s, max(o_orderkey) e, arg_min(o_orderpriority, o_orderkey) first_chrom, arg_max(o_orderstatus, o_orderkey) last_value from orders group by 1")
def transcript_span(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("transcript_id")).agg(F.min("o_orderkey").alias("s"), F.max("o_orderkey").alias("e"), F.min_by("o_orderpriority", "o_orderkey").alias("first_chrom"), F.max_by("o_orderstatus", "o_orderkey").alias("last_value"))


# Lines of files

@query(f"with {_CLASSED} select concat_ws(E'\\t', chrom, s, e, class, least(1000, floor(avg_depth)::bigint), dominant_strand) line from cl")
def bed_lines(spark, d):
    return classed(spark, d).select(F.concat_ws("\t", "chrom", F.col("s").cast("string"), F.col("e").cast("string"), "class", F.least(F.lit(1000), F.floor("avg_depth")).cast("string"), "dominant_strand").alias("line"))


@query(f"""with {_CLASSED} select chrom || E'\\tstrandwise\\t' || unnest(['transcript', 'exon']) || E'\\t' || (s + 1) || E'\\t' || e || E'\\t.\\t' || case when dominant_strand in ('+', '-') then dominant_strand else '.' end || E'\\t.\\tgene_id "' || chrom || ':' || s || '-' || e || '";' line from kp where kept""")
def gtf_lines(spark, d):
    rows = classed(spark, d).filter("kept").withColumn("kind", F.explode(F.array(F.lit("transcript"), F.lit("exon"))))
    attr = F.concat(F.lit('gene_id "'), scalars.region_id(F.col("chrom"), F.col("s"), F.col("e")), F.lit('";'))
    return rows.select(F.concat_ws("\t", "chrom", F.lit("strandwise"), "kind", (F.col("s") + 1).cast("string"), F.col("e").cast("string"), F.lit("."), F.when(F.col("dominant_strand").isin("+", "-"), F.col("dominant_strand")).otherwise("."), F.lit("."), attr).alias("line"))


@query(f"with {GENES} select gene_id, chrom, s, length, sum(length) over (partition by chrom order by s, ord rows between unbounded preceding and current row)::bigint upto from (select *, e - s length from genes)")
def prefix_sum(spark, d):
    order = Window.partitionBy("chrom").orderBy("s", "ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = genes(spark, d).withColumn("length", F.col("e") - F.col("s"))
    return rows.select("gene_id", "chrom", "s", "length", F.sum("length").over(order).alias("upto"))


@query(f"with {GENES} select chrom, sum(bp)::bigint bp from (select chrom, i, max(e) - min(s) bp from (select *, sum(case when s <= pe then 0 else 1 end) over (partition by chrom order by s, e rows between unbounded preceding and current row) i from (select *, max(e) over (partition by chrom order by s, e rows between unbounded preceding and 1 preceding) pe from genes)) group by all) group by 1")
def union_bases(spark, d):
    return union_length(genes(spark, d), KEYS)
