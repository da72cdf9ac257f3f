"""Column functions: strings of annotation files, sequence, ratios, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GTF_ATTRIBUTE = r'(?U)(\w+)\s+"([^"]*)"'
#: Which base pairs with which, both cases; others stay.
BASES, PAIRS = "ACGTNRYSWKMacgtnryswkm", "TGCANYRSWMKtgcanyrswmk"


def flip(strand: Column) -> Column:
    return F.when(strand == "+", "-").when(strand == "-", "+").otherwise(strand)


def last_wins(keys: Column, values: Column) -> Column:
    """A map in which the last of equal keys wins, under any dedup policy."""
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    own = F.filter(pairs, lambda p, i: F.array_position(F.slice(keys, i + 2, F.size(keys)), p["k"]) == 0)
    return F.map_from_entries(F.transform(own, lambda p: F.struct(p["k"].alias("key"), p["v"].alias("value"))))


def gtf_attributes(text: Column) -> Column:
    """Map of ``key "value"`` pairs; the last of equal keys wins."""
    return last_wins(F.regexp_extract_all(text, F.lit(GTF_ATTRIBUTE), 1), F.regexp_extract_all(text, F.lit(GTF_ATTRIBUTE), 2))


def gff3_attributes(text: Column) -> Column:
    """Map of ``key=value`` fields, trimmed and percent-decoded; plus signs stay."""
    fields = F.filter(F.transform(F.split(text, ";"), lambda f: F.trim(f)), lambda f: (f != "") & F.contains(f, F.lit("=")))
    keys = F.transform(fields, lambda f: F.trim(F.substring_index(f, "=", 1)))

    def value(f):
        raw = F.trim(F.regexp_replace(f, "^[^=]*=", ""))
        return F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)

    return last_wins(keys, F.transform(fields, value))


def attributes(text: Column) -> Column:
    """GTF pairs where the line has any, GFF3 fields otherwise."""
    return F.when(F.regexp_like(text, F.lit(GTF_ATTRIBUTE)), gtf_attributes(text)).otherwise(gff3_attributes(text))


def normalise_chrom(name: Column) -> Column:
    """Without a leading ``chr`` in any case; M and MT are both MT."""
    bare = F.regexp_replace(F.trim(name), "^(?i)chr", "")
    return F.when(F.upper(bare).isin("M", "MT"), "MT").otherwise(bare)


def name_token(text: Column) -> Column:
    """Letters, digits, underscores and full stops; others become one underscore."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(text), "[^A-Za-z0-9_.]+", "_"), "^[_.]+|[_.]+$", "")
    return F.when(clean == "", "annotated").otherwise(F.coalesce(clean, F.lit("annotated")))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, BASES, PAIRS))


def wrap(seq: Column, width: int = 60) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def region_id(chrom: Column, start0: Column, end: Column) -> Column:
    """The identifier counts from 0, although the start column beside it counts from 1."""
    return F.concat(chrom, F.lit(":"), start0.cast("string"), F.lit("-"), end.cast("string"))


def parse_region_id(text: Column) -> Column:
    part = lambda i: F.regexp_extract(text, r"^(.*):(\d+)-(\d+)$", i)
    return F.struct(part(1).alias("chrom"), part(2).try_cast("long").alias("start"), part(3).try_cast("long").alias("end"))


def ratio(a: Column, b: Column) -> Column:
    """The smaller over the larger, 0 where the larger is 0."""
    return F.when(F.greatest(a, b) == 0, F.lit(0.0)).otherwise(F.least(a, b).cast("double") / F.greatest(a, b))


def share(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(default)).otherwise(a.cast("double") / b)


def binary_entropy(p: Column) -> Column:
    q = 1 - p
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-(p * F.log2(p) + q * F.log2(q)))


def reciprocal_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over the longer of two intervals."""
    shared = F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))
    return share(shared, F.greatest(e1 - s1, e2 - s2))


def gap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Bases between two intervals; 0 where they touch or overlap."""
    return F.greatest(s2 - e1, s1 - e2, F.lit(0))
