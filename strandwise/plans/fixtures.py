"""Deterministic projections of the star-schema tables onto genomic rows, and
the same projections as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def reads(spark, d) -> DataFrame:
    """chrom, s, e, strand, mapq, flag, category of a read for each line item."""
    k = F.col("l_partkey") % 20
    off = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 600
    s = k * 2000 + off
    strand = F.when(k % 4 == 0, F.when(F.col("l_linestatus") == "F", "+").otherwise("-")).when((k % 4 == 2) & (off >= 330), "-").otherwise("+")
    mapq = F.when((k % 4 == 3) & F.col("l_returnflag").isin("A", "N"), 1).otherwise(255)
    flag = F.when(strand == "-", 16).otherwise(0) + F.when(F.col("l_linenumber") == 6, 256).otherwise(0) + F.when(F.col("l_quantity") == 50, 1024).otherwise(0) + F.when(F.col("l_quantity") == 49, 512).otherwise(0) + F.when(F.col("l_linenumber") == 5, 1 + 128).otherwise(0)
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("chr"), (1 + F.col("l_suppkey") % 2).cast("string")).alias("chrom"), s.alias("s"), (s + 50 + F.col("l_quantity").cast("long")).alias("e"), strand.alias("strand"), mapq.alias("mapq"), flag.cast("int").alias("flag")
    )
    return rows.withColumn("category", F.when(F.col("mapq") >= 20, "unique").otherwise("multi"))


READS = """reads as (select *, case when mapq >= 20 then 'unique' else 'multi' end category from (
  select l_orderkey, l_linenumber, 'chr' || (1 + l_suppkey % 2) chrom, k * 2000 + off s, k * 2000 + off + 50 + cast(l_quantity as bigint) e, strand,
    case when k % 4 = 3 and l_returnflag in ('A', 'N') then 1 else 255 end mapq,
    cast(case when strand = '-' then 16 else 0 end + case when l_linenumber = 6 then 256 else 0 end + case when l_quantity = 50 then 1024 else 0 end + case when l_quantity = 49 then 512 else 0 end + case when l_linenumber = 5 then 129 else 0 end as int) flag
  from (select *, case when k % 4 = 0 then case when l_linestatus = 'F' then '+' else '-' end when k % 4 = 2 and off >= 330 then '-' else '+' end strand
    from (select *, l_partkey % 20 k, (l_orderkey * 7 + l_linenumber * 13) % 600 off from lineitem))))"""


def genes(spark, d) -> DataFrame:
    p = F.col("p_partkey")
    s = p * 20011 % 400_000
    strand = F.when(p % 3 == 0, "+").when(p % 3 == 1, "-").otherwise(".")
    return table(spark, d, "part").select(F.concat(F.lit("chr"), (1 + p % 2).cast("string")).alias("chrom"), s.alias("s"), (s + 10 + F.col("p_size")).alias("e"), strand.alias("strand"), F.concat(F.lit("g"), p.cast("string")).alias("gene_id"), p.alias("ord"), F.col("p_type").alias("ftype"))


GENES = """genes as (select 'chr' || (1 + p_partkey % 2) chrom, p_partkey * 20011 % 400000 s, p_partkey * 20011 % 400000 + 10 + p_size e,
  case p_partkey % 3 when 0 then '+' when 1 then '-' else '.' end strand, 'g' || p_partkey gene_id, p_partkey ord, p_type ftype from part)"""


def exons(spark, d) -> DataFrame:
    return genes(spark, d).withColumn("e", F.col("s") + F.floor((F.col("e") - F.col("s")) / 2))


EXONS = "exons as (select chrom, s, s + (e - s) // 2 e, strand, gene_id, ord from genes)"


def candidates(spark, d) -> DataFrame:
    """A candidate region of one of three samples for each order."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    s = (o * 13 % 500) * 1000 + (c % 7) * 10
    cls = F.when(F.col("o_orderpriority") == "1-URGENT", "likely_gDNA").when(F.col("o_orderpriority") == "2-HIGH", "likely_multimapper_artifact").when(F.col("o_orderpriority") == "3-MEDIUM", "possible_bidirectional_RNA").otherwise("likely_novel_transcript")
    rows = table(spark, d, "orders").select(o.alias("id"), F.concat(F.lit("S"), (c % 3).cast("string")).alias("sample"), F.concat(F.lit("chr"), (1 + o % 2).cast("string")).alias("chrom"), s.alias("s"), (s + 200 + c % 5 * 5).alias("e"), F.when(o % 3 == 0, "-").otherwise("+").alias("dominant_strand"), cls.alias("class"), F.col("o_totalprice").alias("avg_depth"))
    return rows.withColumn("region_id", F.concat("chrom", F.lit(":"), F.col("s").cast("string"), F.lit("-"), F.col("e").cast("string")))


CANDIDATES = """cand as (select *, chrom || ':' || s || '-' || e region_id from (select o_orderkey id, 'S' || (o_custkey % 3) sample, 'chr' || (1 + o_orderkey % 2) chrom,
  (o_orderkey * 13 % 500) * 1000 + (o_custkey % 7) * 10 s, (o_orderkey * 13 % 500) * 1000 + (o_custkey % 7) * 10 + 200 + o_custkey % 5 * 5 e,
  case when o_orderkey % 3 = 0 then '-' else '+' end dominant_strand,
  case o_orderpriority when '1-URGENT' then 'likely_gDNA' when '2-HIGH' then 'likely_multimapper_artifact' when '3-MEDIUM' then 'possible_bidirectional_RNA' else 'likely_novel_transcript' end class, o_totalprice avg_depth from orders))"""


def features(spark, d) -> DataFrame:
    """An annotation feature for each customer."""
    c = F.col("c_custkey")
    s = c * 331 % 500_000
    return table(spark, d, "customer").select(
        F.concat((1 + c % 2).cast("string")).alias("chrom_key"), s.alias("s"), (s + 150 + c % 100).alias("e"), F.when(c % 3 == 0, "+").when(c % 3 == 1, "-").otherwise(".").alias("strand"),
        F.lower("c_mktsegment").alias("ftype"), F.concat(F.lit("F"), c.cast("string")).alias("fid"), F.array(F.concat(F.lit("G"), (c % 17).cast("string")), F.concat(F.lit("G"), (c % 5).cast("string"))).alias("genes"), c.alias("ord"),
    )


FEATURES = """feat as (select cast(1 + c_custkey % 2 as varchar) chrom_key, c_custkey * 331 % 500000 s, c_custkey * 331 % 500000 + 150 + c_custkey % 100 e,
  case c_custkey % 3 when 0 then '+' when 1 then '-' else '.' end strand, lower(c_mktsegment) ftype, 'F' || c_custkey fid, ['G' || (c_custkey % 17), 'G' || (c_custkey % 5)] genes, c_custkey ord from customer)"""
