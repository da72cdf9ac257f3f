"""Registered queries of sources and sinks: each writes a file from the star
tables through ``sinks``, reads it again through ``sources``, and has SQL for
the rows that come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage, sequence
from ..operators.consensus import shared_dir
from ..sources import sinks, text
from . import fixtures
from .fixtures import CANDIDATES, EXONS, FEATURES, GENES, READS, table

Q: dict = {}
SQL: dict[str, str] = {}
TILE = 4096


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _file(spark, rows, name: str, order: list, head: list[str] = ()) -> str:  # type: ignore[assignment]
    """``rows.value`` as a file in a folder of its own."""
    return sinks.write_lines(rows, f"{shared_dir(spark)}/{name}", order, head)


def _line(*fields):
    return F.concat_ws("\t", *[F.col(f) if isinstance(f, str) else f.cast("string") for f in fields]).alias("value")


def _gtf(spark, d) -> str:
    """Genes of two exons each, with a line of every kind a reader has to pass over."""
    g = fixtures.genes(spark, d)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), a.alias("from"), b.alias("to")) for k, a, b in (
        ("gene", F.col("s"), F.col("e")), ("transcript", F.col("s"), F.col("e")), ("exon", F.col("s"), F.col("s") + 5), ("exon", F.col("e") - 4, F.col("e")),
    )])
    rows = g.withColumn("x", F.explode(kinds))
    attrs = F.concat(F.lit('gene_id "'), "gene_id", F.when(F.col("x.kind") == "gene", F.lit('";')).otherwise(F.concat(F.lit('"; transcript_id "t'), F.col("gene_id"), F.lit('";'))))
    rows = rows.select(_line("chrom", F.when(F.col("ord") % 2 == 0, "even").otherwise("odd"), F.col("x.kind"), F.col("x.from") + 1, F.col("x.to"), F.lit("."), F.col("strand"), F.lit("."), attrs), "ord", F.col("x.from").alias("from"), F.col("x.kind").alias("kind"))
    return _file(spark, rows, "a.gtf", ["ord", "from", "kind"], ["# a comment", "too\tshort", 'chr1\tx\texon\tbad\t9\t.\t+\t.\tgene_id "none";'])


_LINES = f"""{GENES}, l as (select chrom, case when ord % 2 = 0 then 'even' else 'odd' end source, gene_id, ord, strand, unnest(['gene', 'transcript', 'exon', 'exon']) ftype, unnest([s, s, s, e - 4]) s, unnest([e, e, s + 5, e]) e from genes)"""


@query(f"with {_LINES} select chrom, source, ftype, s, e, strand, gene_id from l")
def read_gtf_lines(spark, d):
    rows = text.annotation_lines(spark, _gtf(spark, d))
    return rows.select("chrom", "source", "ftype", "s", "e", "strand", F.try_element_at("attrs", F.lit("gene_id")).alias("gene_id"))


@query(f"with {GENES} select chrom, s, e, strand, gene_id from genes")
def read_genes(spark, d):
    return text.genes(text.annotation_lines(spark, _gtf(spark, d))).select("chrom", "s", "e", "strand", "gene_id")


@query(f"with {GENES} select 't' || gene_id transcript_id, chrom, s, e, strand from genes")
def read_transcript_spans(spark, d):
    return text.transcript_spans(text.annotation_lines(spark, _gtf(spark, d))).select("transcript_id", "chrom", "s", "e", "strand")


@query(f"with {_LINES} select chrom, s, e, strand from l where ftype = 'exon'")
def read_exon_masks(spark, d):
    return text.masks(text.annotation_lines(spark, _gtf(spark, d)), "exon")


@query(f"with {_LINES} select 't' || gene_id as name, chrom, strand, string_agg(s || '-' || e, ',' order by s, e) exons from l where ftype = 'exon' and source = 'even' group by all")
def read_transcripts(spark, d):
    got = text.transcripts(spark, _gtf(spark, d), "even")
    return got.select("name", "chrom", "strand", F.array_join(F.transform("exons", lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"))), ",").alias("exons"))


def _gff3(spark, d) -> str:
    """Features with spaces, escapes and linked genes; every seventh interval is empty."""
    f = fixtures.features(spark, d)
    end = F.when(F.col("ord") % 7 == 0, F.col("s")).otherwise(F.col("e"))
    attrs = F.concat(F.lit("ID = "), "fid", F.lit(";gene_name="), F.array_join("genes", ", "), F.lit(";Note=a%3Bb"))
    rows = f.select(_line(F.concat(F.lit("chr"), "chrom_key"), F.lit("src"), F.upper("ftype"), F.col("s") + 1, end, F.lit("."), "strand", F.lit("."), attrs), "ord")
    return _file(spark, rows, "f.gff3", ["ord"])


@query(f"with {FEATURES} select 'own' as label, chrom_key, upper(ftype) ftype, fid, strand, s, e, array_to_string(genes, ',') genes from feat where ord % 7 <> 0 and ftype in ('building', 'household')")
def read_overlay(spark, d):
    got = text.overlay_features(spark, _gff3(spark, d), "own", ("Building", "HOUSEHOLD"))
    return got.select("label", "chrom_key", "ftype", "fid", "strand", "s", "e", F.array_join("genes", ",").alias("genes"))


@query(f"with {FEATURES} select upper(ftype) ftype, count(*) n, (select count(*) from feat where ord % 7 = 0) n_skipped from feat where ord % 7 <> 0 group by 1")
def read_overlay_counts(spark, d):
    got = text.overlay_counts(spark, _gff3(spark, d))
    return spark.createDataFrame([(k, n, got["n_skipped"]) for k, n in got["feature_types"].items()], "ftype string, n long, n_skipped long")


@query("select 'c' || n_nationkey chrom, n_nationkey * 1000 + 1 as length from nation")
def read_chrom_sizes(spark, d):
    """A name that comes twice: the later line counts."""
    n = table(spark, d, "nation").select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("chrom"), F.col("n_nationkey").alias("k"))
    twice = n.withColumn("x", F.explode(F.array(F.lit(0), F.lit(1))))
    path = _file(spark, twice.select(_line("chrom", F.col("k") * 1000 + F.col("x"), F.lit("0")), "x", "k"), "g.fai", ["x", "k"])
    return text.chrom_sizes(spark, path).select("chrom", F.col("length").cast("int").alias("length"))


def _tables(spark, d) -> list[str]:
    """The candidates of each sample as a candidate table; the first has a column less."""
    columns = [("region_id", None), ("chrom", None), ("start", None), ("end", None), ("class", None), ("dominant_strand", None), ("avg_depth", 3)]
    out = []
    for sample in ("S0", "S1", "S2"):
        rows = fixtures.candidates(spark, d).filter(F.col("sample") == sample).withColumn("start", F.col("s") + 1).withColumn("end", F.col("e"))
        own = columns[: 7 - (sample == "S0")]
        out.append(sinks.write_table(rows, own, f"{shared_dir(spark)}/{sample}.candidate_regions.tsv", ["id"]))
    return out


@query(f"with {CANDIDATES} select row_number() over (order by sample, id) id, sample, region_id, chrom, s, e, class, dominant_strand, case when sample <> 'S0' then avg_depth end avg_depth from cand")
def read_candidate_tables(spark, d):
    got = text.candidate_tables(spark, tuple(_tables(spark, d)))
    return got.select("id", "sample", "region_id", "chrom", "s", "e", "class", "dominant_strand", F.col("avg_depth").cast("double").alias("avg_depth"))


@query(f"with {CANDIDATES} select concat_ws(E'\\t', chrom, s, e, class, least(1000, round_even(avg_depth / 400, 0)::bigint), dominant_strand) line from cand")
def write_bed(spark, d):
    rows = fixtures.candidates(spark, d).withColumn("avg_depth", F.col("avg_depth") / 400)
    path = _file(spark, sinks.bed_rows(rows, ["id"]), "x.bed", ["id"])
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(f"with {CANDIDATES} select chrom, s, e, round_even(floor(avg_depth) / 64, 3) depth from cand")
def write_bedgraph(spark, d):
    """Depths are 64ths, so what lies halfway between two roundings does so exactly."""
    rows = fixtures.candidates(spark, d).withColumn("plus_mean_depth", F.floor("avg_depth") / 64)
    path = _file(spark, sinks.bedgraph_rows(rows, "plus_mean_depth", ["id"]), "x.bedgraph", ["id"], ['track type=bedGraph name="x"'])
    f = F.split("value", "\t")
    got = spark.read.text(path).filter("value not like 'track%'")
    return got.select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).cast("long").alias("s"), F.get(f, F.lit(2)).cast("long").alias("e"), F.get(f, F.lit(3)).cast("double").alias("depth"))


@query(f"""with {CANDIDATES}, k as (select *, unnest(['transcript', 'exon']) kind from cand where class = 'likely_novel_transcript')
  select chrom, kind ftype, s, e, dominant_strand strand, region_id gene_id, region_id transcript_id, class classification, case when kind = 'exon' then '1' end exon_number from k""")
def write_gtf(spark, d):
    rows = fixtures.candidates(spark, d).filter("class = 'likely_novel_transcript'").withColumn("strand", F.col("dominant_strand"))
    out = sinks.gtf_rows(rows, "region_id", "strandwise", [sinks.attribute("classification", F.col("class"))], ["id"])
    got = text.annotation_lines(spark, _file(spark, out, "x.gtf", ["id", "kind"]))
    return got.select("chrom", "ftype", "s", "e", "strand", *[F.try_element_at("attrs", F.lit(k)).alias(k) for k in ("gene_id", "transcript_id", "classification", "exon_number")])


@query(f"""with {_LINES}, {CANDIDATES} select 0 part, count(*) n, sum(s)::bigint s from l union all select 1, 2 * count(*), (2 * sum(s))::bigint from cand where class = 'likely_gDNA'""")
def write_merged_gtf(spark, d):
    """Reference lines, the marker, then the new ones: counted on either side of it."""
    rows = fixtures.candidates(spark, d).filter("class = 'likely_gDNA'").withColumn("strand", F.col("dominant_strand"))
    new = sinks.gtf_rows(rows, "region_id", "strandwise", [], ["id"])
    path = sinks.write_merged(_gtf(spark, d), new, f"{shared_dir(spark)}/m.gtf", ["id", "kind"], "# marker")
    numbered = text.lines(spark, path)
    mark = numbered.filter("value = '# marker'").select(F.col("ord").alias("mark"))
    got = text.annotation_lines(spark, path).crossJoin(F.broadcast(mark))  # one row
    return got.groupBy((F.col("ord") > F.col("mark")).cast("int").alias("part")).agg(F.count("*").alias("n"), F.sum("s").alias("s"))


_GENOME = "gen as (select 'chr' || (1 + s_suppkey % 2) chrom, string_agg(md5(s_name), '' order by s_suppkey) seq from supplier group by 1)"


def _fasta(spark, d) -> str:
    """Two chromosomes, a line for each supplier."""
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select((1 + k % 2).alias("c"), k.alias("k"), F.md5(F.col("s_name").cast("binary")).alias("value"))
    heads = rows.select("c").distinct().select("c", F.lit(-1).cast(dict(rows.dtypes)["k"]).alias("k"), F.concat(F.lit(">chr"), F.col("c").cast("string"), F.lit(" a description")).alias("value"))
    return _file(spark, heads.unionByName(rows), "g.fa", ["c", "k"])


@query(f"with {_GENOME} select chrom, length(seq) n, md5(seq) seq from gen")
def read_genome(spark, d):
    tiles = text.genome(spark, _fasta(spark, d), 100)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile", "seq"))), lambda t: t["seq"]), "")
    got = tiles.groupBy("chrom").agg(whole.alias("seq"))
    return got.select("chrom", F.length("seq").cast("long").alias("n"), F.md5(F.col("seq").cast("binary")).alias("seq"))


@query(f"with {_GENOME}, {GENES}, t as (select 't' || gene_id as name, substr(seq, (s + 1)::bigint, 5) || substr(seq, (e - 3)::bigint, 4) q from genes join gen using (chrom)) select name, length(q) n from t where q <> ''")
def write_fasta(spark, d):
    """Transcripts cut from a genome file, as FASTA records read back: name and length."""
    wanted = text.transcripts(spark, _gtf(spark, d))
    got = sequence.extract(wanted, text.genome(spark, _fasta(spark, d), TILE), TILE)
    rows = sequence.fasta_lines(got).join(wanted.select("name", "ord"), "name")
    back = text.genome(spark, _file(spark, rows, "t.fa", ["ord"]), TILE)
    return back.groupBy(F.col("chrom").alias("name")).agg(F.sum(F.length("seq")).alias("n"))


@query(f"with {READS} select l_orderkey || '.' || l_linenumber as name, flag, chrom, s, e, mapq, 2 as n_blocks, s + 10 first_end, e - 20 last_start from reads")
def read_sam(spark, d):
    """Reads with a clip, a gap and an insertion; their blocks are those of the CIGAR string."""
    r = fixtures.reads(spark, d)
    cigar = F.concat(F.lit("3S10M"), (F.col("e") - F.col("s") - 30).cast("string"), F.lit("N2I20M"))
    rows = r.select(_line(F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), F.col("flag"), "chrom", F.col("s") + 1, F.col("mapq"), cigar, F.lit("*"), F.lit(0), F.lit(0), F.lit("*"), F.lit("*")), "chrom", "s")
    head = ["@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:chr1\tLN:40000", "@SQ\tSN:chr2\tLN:40000"]
    got, _ = text.sam(spark, _file(spark, rows, "x.sam", ["chrom", "s"], head))
    return got.select("name", "flag", "chrom", "s", "e", "mapq", F.size("blocks").alias("n_blocks"), F.col("blocks")[0]["end"].alias("first_end"), F.col("blocks")[1]["start"].alias("last_start"))


@query(f"""with {READS}, p as (select chrom, unnest(range(s, e)) pos, (strand = '+')::int plus from reads where category = 'unique'), c as (select chrom, pos, sum(plus)::bigint plus, sum(1 - plus)::bigint minus from p group by all)
  select chrom, count(*) n, sum(plus)::bigint plus, sum(minus)::bigint minus from c where pos >= 5000 and pos < 21000 group by 1""")
def read_coverage_store(spark, d):
    """A written store, its windows' bases and depths; small tiles, so that windows cross them."""
    r = fixtures.reads(spark, d).filter("category = 'unique'")
    one = lambda s: (F.col("strand") == s).cast("long")
    rows = r.select("chrom", "s", "e", one("+").alias("unique_plus"), one("-").alias("unique_minus"))
    segs = coverage.sweep([rows], ["chrom"], TILE, ("unique_plus", "unique_minus")).filter("unique_plus > 0 or unique_minus > 0")
    path = f"{shared_dir(spark)}/coverage"
    coverage.store(segs.select(F.lit("a").alias("sample"), "chrom", "s", "e", "unique_plus", "unique_minus"), path)
    stored = spark.read.parquet(path)
    size = F.col("e") - F.col("s")
    windows = [coverage.window(stored, c, 5000, 21000).withColumn("chrom", F.lit(c)) for c in ("chr1", "chr2")]
    both = windows[0].unionByName(windows[1])
    return both.groupBy("chrom").agg(F.sum(size).alias("n"), F.sum(size * F.col("unique_plus")).alias("plus"), F.sum(size * F.col("unique_minus")).alias("minus"))


@query(f"with {GENES}, {EXONS}, {READS} select count(*) filter ((r.strand = x.strand) = (flag & 64 <> 0 or flag & 1 = 0)) n_forward, count(*) filter ((r.strand = x.strand) <> (flag & 64 <> 0 or flag & 1 = 0)) n_reverse from reads r join exons x on r.chrom = x.chrom and r.s < x.e and r.e > x.s where x.strand in ('+', '-')")
def all_exon_votes(spark, d):
    """Votes over every stranded exon, without sampling."""
    from ..operators import strandedness

    aligned = fixtures.reads(spark, d).withColumn("flag", (F.col("flag") - F.when(F.col("flag").bitwiseAND(16) != 0, 16).otherwise(0) + F.when(F.col("strand") == "-", 16).otherwise(0)).cast("int"))
    return strandedness.votes(aligned, fixtures.exons(spark, d).filter(F.col("strand").isin("+", "-")))
