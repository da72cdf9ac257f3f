"""Sequence extraction from tiled genomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import reverse_complement, wrap


def exon_tiles(transcripts: DataFrame, tile: int) -> DataFrame:
    """A row for each exon (x) and tile that it touches; ``from`` is its start, 0 at least."""
    parts = transcripts.select("name", "chrom", F.explode(F.array_sort("exons")).alias("x")).filter("x.s < x.e")
    parts = parts.withColumn("from", F.greatest(F.col("x.s"), F.lit(0))).filter("from < x.e")
    return parts.withColumn("tile", F.explode(F.sequence(F.floor(F.col("from") / tile), F.floor((F.col("x.e") - 1) / tile))))


def extract(transcripts: DataFrame, genome: DataFrame, tile: int) -> DataFrame:
    """``transcripts`` (name, chrom, strand, exons array<struct<s,e>>) with seq.

    ``genome`` has chrom, tile and seq, each tile of ``tile`` bases but the last.
    Exons go in order; unknown chromosomes and bases past the end give nothing;
    transcripts with an empty sequence are left out.
    """
    parts = exon_tiles(transcripts, tile)
    a = F.greatest(F.col("from"), F.col("tile") * tile) - F.col("tile") * tile
    b = F.least(F.col("x.e"), (F.col("tile") + 1) * tile) - F.col("tile") * tile
    got = parts.join(genome.select("chrom", "tile", "seq"), ["chrom", "tile"]).withColumn("piece", F.upper(F.substring("seq", (a + 1).cast("int"), (b - a).cast("int"))))
    joined = got.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("x.s").alias("s"), F.col("x.e").alias("e"), "tile", "piece"))), lambda p: p["piece"]), "").alias("seq"))
    out = transcripts.join(joined, "name").withColumn("seq", F.when(F.col("strand") == "-", reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    return out.filter("seq <> ''")


def fasta_lines(transcripts: DataFrame, width: int = 60) -> DataFrame:
    """Records as text: a header of name and fields, then the wrapped sequence."""
    attr = lambda k: F.coalesce(F.try_element_at("attrs", F.lit(k)), F.lit(""))
    first, last = F.array_min(F.transform("exons", lambda x: x["s"])) + 1, F.element_at(F.array_sort("exons"), -1)["e"]
    cls = F.when(attr("classification") != "", attr("classification")).otherwise(attr("consensus_class"))
    text = ">%s gene_id=%s strand=%s loc=%s:%d-%d(%s) class=%s length=%d\n%s"
    return transcripts.select("name", F.format_string(text, "name", attr("gene_id"), "strand", "chrom", first, last, "strand", cls, F.length("seq"), wrap(F.col("seq"), width)).alias("value"))
