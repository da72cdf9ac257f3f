"""extract: transcript sequences of a GTF from a genome."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import sequence
from ..sources import sinks, text

TILE = 65_536


def run(spark: SparkSession, genome: str, gtf: str, out: str, source: str | None = None, width: int = 60) -> int:
    """Writes FASTA records in first-seen order; returns how many were written."""
    if width < 1:
        raise ValueError("line width must be 1 or more")
    wanted = text.transcripts(spark, gtf, source)
    if sinks.exists(f"{genome}.fai") and not genome.endswith((".gz", ".bgz")):
        tiles = text.indexed_genome(spark, genome, sequence.exon_tiles(wanted, TILE), TILE)
    else:
        tiles = text.genome(spark, genome, TILE)
    got = sequence.extract(wanted, tiles, TILE)
    rows = sequence.fasta_lines(got, width).join(wanted.select("name", "ord"), "name")
    sinks.write_lines(rows, out, ["ord"])
    return got.agg(F.count("*")).first()[0]
