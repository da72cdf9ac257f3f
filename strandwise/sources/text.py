"""Text sources: GTF, GFF3, chromosome sizes, candidate tables, SAM, FASTA.

Compressed files open by their extension. Rows carry ``ord``, which sorts as the
lines of a file do: the split's offset, then the row within the split.
"""

from __future__ import annotations

import gzip
import itertools
import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import attributes, normalise_chrom
from ..operators.consensus import shared_dir, written

def ord_column():
    return F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row")).alias("ord")


def _unblocked(batches):
    for b in batches:
        for content in b["content"]:
            rows = gzip.decompress(content).decode().splitlines()
            yield pd.DataFrame({"value": rows, "row": range(len(rows))})


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines without carriage returns, with ord. Hadoop doesn't know ``.bgz``, so
    such a file, gzip by format, is read whole by one task."""
    if path.endswith(".bgz"):
        rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(_unblocked, "value string, row long")
        return rows.select("value", F.struct(F.lit(0).cast("long").alias("at"), "row").alias("ord"))
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), ord_column())


def feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """GTF or GFF3 lines of nine fields as they are, bad coordinates as null."""
    f = F.split("value", "\t")
    rows = lines(spark, path).filter(~F.startswith("value", F.lit("#"))).select(f.alias("f"), "ord").filter(F.size("f") >= 9)
    at = lambda i: F.get("f", F.lit(i))
    return rows.select(at(0).alias("chrom"), at(1).alias("source"), at(2).alias("ftype"), (F.trim(at(3)).try_cast("long") - 1).alias("s"), F.trim(at(4)).try_cast("long").alias("e"), at(6).alias("strand"), at(8).alias("text"), "ord")


def annotation_lines(spark: SparkSession, path: str) -> DataFrame:
    """GTF or GFF3 features from 0, half-open: chrom, source, ftype, s, e, strand,
    attrs, ord. Comments, short lines and bad coordinates are left out."""
    rows = feature_lines(spark, path)
    return rows.filter("s is not null and e is not null").withColumn("attrs", attributes(F.col("text"))).drop("text")


def overlay_counts(spark: SparkSession, path: str, types: tuple[str, ...] = ()) -> dict:
    """n_features, n_skipped (bad or empty intervals among the wanted types) and
    feature_types, the features by type."""
    rows = feature_lines(spark, path)
    if types:
        rows = rows.filter(F.lower("ftype").isin([t.lower() for t in types]))
    good = F.coalesce(F.col("e") > F.col("s"), F.lit(False))
    by = rows.groupBy("ftype").agg(F.count_if(good).alias("n"), F.count_if(~good).alias("skipped")).orderBy("ftype").collect()  # a row for each type
    return {"n_features": sum(r["n"] for r in by), "n_skipped": sum(r["skipped"] for r in by), "feature_types": {r["ftype"]: r["n"] for r in by if r["n"]}}


def _attr(key: str):
    return F.try_element_at("attrs", F.lit(key))


def genes(rows: DataFrame) -> DataFrame:
    """Genes by id: the last line's values at the first line's place. A line
    without an id is a gene of its own place. Without gene lines, spans of
    transcripts stand in for them."""
    g = rows.filter("ftype = 'gene'").withColumn("gene_id", F.coalesce(_attr("gene_id"), F.concat(F.lit("gene@"), "chrom", F.lit(":"), F.col("s").cast("string"))))
    last = F.max_by(F.struct("chrom", "s", "e", "strand"), "ord")
    g = g.groupBy("gene_id").agg(last.alias("x"), F.min("ord").alias("ord")).select("x.*", "gene_id", "ord")
    if g.limit(1).count():
        return g
    return transcript_spans(rows).withColumnRenamed("transcript_id", "gene_id")


def transcript_spans(rows: DataFrame) -> DataFrame:
    """Least start and greatest end of all lines with a transcript_id, by it
    alone; the first line's chromosome and strand."""
    t = rows.withColumn("transcript_id", _attr("transcript_id")).filter("transcript_id <> ''")
    return t.groupBy("transcript_id").agg(F.min_by("chrom", "ord").alias("chrom"), F.min("s").alias("s"), F.max("e").alias("e"), F.min_by("strand", "ord").alias("strand"), F.min("ord").alias("ord"))


def masks(rows: DataFrame, mode: str = "exon") -> DataFrame:
    """Annotated intervals: the lines of the mode's feature, or all lines. Without
    transcript or gene lines these modes take the transcripts' spans instead."""
    own = (rows if mode == "all" else rows.filter(F.col("ftype") == mode)).select("chrom", "s", "e", "strand").filter("s < e")
    if mode in ("transcript", "gene") and not own.limit(1).count():
        return transcript_spans(rows).select("chrom", "s", "e", "strand").filter("s < e")
    return own


def chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    """name and length of a .fai or sizes file; the later of equal names wins."""
    f = F.split("value", "\t")
    rows = lines(spark, path).filter(F.size(f) >= 2).select(F.get(f, F.lit(0)).alias("chrom"), F.trim(F.get(f, F.lit(1))).try_cast("long").alias("length"), "ord").filter("length is not null")
    return rows.groupBy("chrom").agg(F.max_by("length", "ord").alias("length"), F.min("ord").alias("ord"))


#: Attribute keys that name a feature or its genes, in order of preference.
ID_KEYS = ("ID", "Id", "id", "Name", "name", "gene_id", "transcript_id")
GENE_KEYS = ("gene_name", "gene_id")


def overlay_features(spark: SparkSession, path: str, label: str, types: tuple[str, ...] = ()) -> DataFrame:
    """External features: label, chrom_key, ftype, fid, strand, s, e, genes, ord.
    ``types`` keeps these of column 3 alone, in any case; empty intervals go."""
    rows = annotation_lines(spark, path)
    if types:
        rows = rows.filter(F.lower("ftype").isin([t.lower() for t in types]))
    first = lambda keys: F.coalesce(*[F.nullif(_attr(k), F.lit("")) for k in keys], F.lit(""))
    names = F.filter(F.transform(F.split(first(GENE_KEYS), ","), lambda x: F.trim(x)), lambda x: x != "")
    return rows.filter("e > s").select(F.lit(label).alias("label"), normalise_chrom(F.col("chrom")).alias("chrom_key"), "ftype", first(ID_KEYS).alias("fid"), "strand", "s", "e", names.alias("genes"), "ord")


#: Words of file names and the labels they stand for, the first match counts.
LABEL_WORDS = (
    ("regulatory_features", "regulatory"), ("regulatory", "regulatory"), ("emar", "emar"), ("motif_features", "motif"), ("motif", "motif"), ("cage", "cage"),
    ("repeat", "repeat"), ("rmsk", "repeat"), ("enhancer", "enhancer"), ("promoter", "promoter"), ("lncrna", "lncrna"),
)


#: The extensions of annotation files, and those of compression.
FORMATS, PACKED = ("gff3", "gff", "gtf", "bed", "txt", "tsv"), ("gz", "bgz")


def derive_label(path: str, used: set[str]) -> str:
    """A label for a file: what the first of LABEL_WORDS in its name stands for;
    without one, the longest part between its full stops, extensions apart. The
    first of label, label2, label3, ... that isn't used."""
    name = os.path.basename(path).lower()
    label = next((known for word, known in LABEL_WORDS if word in name), None)
    if label is None:
        parts = name.split(".")
        for extensions in (PACKED, FORMATS):
            if len(parts) > 1 and parts[-1] in extensions:
                parts.pop()
        words = re.findall(r"\w+", max(parts, key=len))
        label = "_".join(words).strip("_") or "annotation"
    return next(c for n in itertools.count(1) if (c := label + str(n) * (n > 1)) not in used)


def overlay_paths(specs: tuple[str, ...], labels: tuple[str, ...] = ()) -> dict[str, str]:
    """Label and path of each ``path`` or ``label=path``; explicit labels go first."""
    if labels and len(labels) != len(specs):
        raise ValueError("as many labels as annotation files are needed")
    out: dict[str, str] = {}
    for i, spec in enumerate(specs):
        head, eq, tail = spec.partition("=")
        own, path = (head, tail) if eq and re.fullmatch(r"\w+", head) else ("", spec)
        label = labels[i] if labels else own or derive_label(path, set(out))
        if label in out:
            raise ValueError(f"annotation label {label} is used twice")
        out[label] = path
    return out


def overlay_sources(spark: SparkSession, specs: tuple[str, ...], labels: tuple[str, ...] = (), types: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Features of each annotation file, by label."""
    return {label: overlay_features(spark, path, label, types) for label, path in overlay_paths(specs, labels).items()}


CANDIDATE_TEXT = {"region_id", "chrom", "class", "dominant_strand"}


def sample_names(paths: tuple[str, ...], given: tuple[str, ...] = ()) -> list[str]:
    names = list(given) or [re.sub(r"(\.candidate_regions)?\.tsv(\.gz)?$", "", os.path.basename(p)) for p in paths]
    if len(set(names)) != len(names):
        raise ValueError("sample names must differ")
    return names


def candidate_tables(spark: SparkSession, paths: tuple[str, ...], names: tuple[str, ...] = ()) -> DataFrame:
    """All samples' candidate tables by column name, starts from 0, with sample
    and id (input order). Text columns stay text, whatever they look like."""
    out = None
    for k, (path, name) in enumerate(zip(paths, sample_names(paths, names))):
        rows = spark.read.csv(path, sep="\t", header=True, nullValue="NA")
        lacking = CANDIDATE_TEXT | {"start", "end"}
        lacking -= set(rows.columns)
        if lacking:
            raise ValueError(f"{path} lacks columns: {', '.join(sorted(lacking))}")
        rows = rows.select("*", ord_column(), F.col("_metadata.file_path").alias("_file")).withColumn("sample", F.lit(name)).withColumn("sample_idx", F.lit(k))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    out = out.withColumn("s", F.col("start").try_cast("long") - 1).withColumn("e", F.col("end").try_cast("long"))
    # Ids in input order: a row's place in its split after the rows of earlier splits. As splits can differ between evaluations, the rows are kept first.
    out = written(out, f"{shared_dir(spark)}/candidates")
    split = ["sample_idx", "_file", F.col("ord.at").alias("_at")]
    splits = out.groupBy(*split).agg(F.min("ord.row").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("sample_idx", "_at", "_first")) - F.col("_n")  # a row for each split
    splits = splits.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(("sample_idx", "_file", "_at"))], "_first", before.alias("_before"))
    out = out.join(F.broadcast(splits), (F.col("sample_idx") == F.col("_k0")) & (F.col("_file") == F.col("_k1")) & (F.col("ord.at") == F.col("_k2")))
    return out.withColumn("id", F.col("_before") + F.col("ord.row") - F.col("_first") + 1).drop("ord", "start", "end", "sample_idx", "_file", "_first", "_before", "_k0", "_k1", "_k2")


def sam(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(alignments, chrom_sizes) of a SAM file. Sizes keep the header's order;
    a header that says another sort order than coordinate is an error."""
    rows = lines(spark, path)
    head = rows.filter(F.startswith("value", F.lit("@")))
    so = head.filter("value like '@HD%'").select(F.regexp_extract("value", "\tSO:([^\t]*)", 1).alias("so")).first()
    if so and so["so"] and so["so"] != "coordinate":
        raise ValueError(f"{path} is sorted by {so['so']}, not by coordinate")
    sq = head.filter("value like '@SQ%'").select(F.regexp_extract("value", "\tSN:([^\t]*)", 1).alias("chrom"), F.regexp_extract("value", "\tLN:([0-9]+)", 1).cast("long").alias("length"), "ord")
    sizes = sq.withColumn("ordinal", F.row_number().over(Window.orderBy("ord")) - 1).drop("ord")
    f = F.split("value", "\t")
    at = lambda i: F.get("f", F.lit(i))
    body = rows.filter(~F.startswith("value", F.lit("@"))).select(f.alias("f")).filter(F.size("f") >= 11)
    body = body.select(at(0).alias("name"), at(1).try_cast("int").alias("flag"), at(2).alias("chrom"), (at(3).try_cast("long") - 1).alias("s"), at(4).try_cast("int").alias("mapq"), at(5).alias("cigar"), at(10).alias("qual"))
    return body.withColumn("blocks", cigar_blocks(F.col("cigar"), F.col("s"), F.col("qual"))).withColumn("e", F.coalesce(F.array_max(F.transform("blocks", lambda b: b["end"])), F.col("s") + 1)).drop("cigar", "qual"), sizes


def cigar_blocks(cigar, start, qual):
    """Aligned blocks of a CIGAR string: an entry for each M, = or X, with the
    qualities of its bases (null where the read has none)."""
    sizes = F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHP=X])"), 1)
    kinds = F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHP=X])"), 2)
    kind = "array<struct<start:bigint,end:bigint,quals:array<int>>>"

    def step(acc, op):
        n = op["n"].cast("long")
        here = op["k"].isin("M", "=", "X")
        q = F.when(qual != "*", F.transform(F.split(F.substring(qual, (acc["q"] + 1).cast("int"), n.cast("int")), ""), lambda c: F.ascii(c) - 33))
        block = F.array(F.struct(acc["r"].alias("start"), (acc["r"] + n).alias("end"), F.slice(q, 1, n.cast("int")).alias("quals"))).cast(kind)
        return F.struct(
            (acc["r"] + F.when(here | op["k"].isin("D", "N"), n).otherwise(0)).alias("r"),
            (acc["q"] + F.when(here | op["k"].isin("I", "S"), n).otherwise(0)).alias("q"),
            F.when(here, F.concat(acc["out"], block)).otherwise(acc["out"]).alias("out"),
        )

    first = F.struct(start.cast("long").alias("r"), F.lit(0).cast("long").alias("q"), F.array().cast(kind).alias("out"))
    return F.aggregate(F.arrays_zip(sizes.alias("n"), kinds.alias("k")), first, step, lambda acc: acc["out"])


def genome(spark: SparkSession, path: str, tile: int = 65_536) -> DataFrame:
    """A FASTA file as tiles: chrom, tile, seq. Lines get their place by sums of
    lengths within records; a file's lines are numbered in one task, as FASTA
    files don't say where their records start. ``indexed_genome`` does without."""
    rows = lines(spark, path).filter("value <> ''")
    order = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    head = F.startswith("value", F.lit(">"))
    rows = rows.withColumn("chrom", F.last(F.when(head, F.regexp_extract("value", r"^>\s*(\S*)", 1)), ignorenulls=True).over(order)).filter(~head)
    rows = rows.withColumn("value", F.trim("value"))
    at = F.sum(F.length("value")).over(Window.partitionBy("chrom").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)) - F.length("value")
    rows = rows.withColumn("at", at).withColumn("tile", F.explode(F.sequence(F.floor(F.col("at") / tile), F.floor((F.col("at") + F.length("value") - 1) / tile))))
    cut = F.substring("value", (F.greatest(F.col("tile") * tile - F.col("at"), F.lit(0)) + 1).cast("int"), (F.least(F.col("at") + F.length("value"), (F.col("tile") + 1) * tile) - F.greatest(F.col("at"), F.col("tile") * tile)).cast("int"))
    pieces = rows.select("chrom", "tile", "at", cut.alias("piece"))
    return pieces.groupBy("chrom", "tile").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda p: p["piece"]), "").alias("seq"))


def indexed_genome(spark: SparkSession, path: str, wanted: DataFrame, tile: int = 65_536) -> DataFrame:
    """The tiles of ``wanted`` (chrom, tile) alone, of an uncompressed FASTA file
    with an index ``<path>.fai``: each is read at its place, in any task."""
    f = F.split("value", "\t")
    at = lambda i: F.trim(F.get(f, F.lit(i)))
    index = lines(spark, f"{path}.fai").filter(F.size(f) >= 5).select(at(0).alias("chrom"), *[at(i + 1).try_cast("long").alias(n) for i, n in enumerate(("length", "offset", "bases", "width"))], "ord")
    index = index.filter("length > 0 and offset >= 0 and bases > 0 and width >= bases")
    index = index.groupBy("chrom").agg(F.max_by(F.struct("length", "offset", "bases", "width"), "ord").alias("x")).select("chrom", "x.*")
    a, b = F.col("tile") * tile, F.least((F.col("tile") + 1) * tile, F.col("length"))
    place = lambda p: F.col("offset") + F.floor(p / F.col("bases")) * F.col("width") + p % F.col("bases")
    rows = wanted.select("chrom", "tile").distinct().join(index, "chrom").filter((F.col("tile") >= 0) & (a < F.col("length")))
    rows = rows.select("chrom", "tile", place(a).alias("begin"), (place(b - 1) + 1).alias("end")).sortWithinPartitions("begin")

    def read(batches):
        from .bam import _open

        genome_file, _ = _open(path)
        for batch in batches:
            for k in range(0, len(batch), 64):
                part = batch.iloc[k : k + 64]
                seqs = []
                for begin, end in zip(part["begin"], part["end"]):
                    genome_file.seek(int(begin))
                    seqs.append(genome_file.read(int(end - begin)).translate(None, b"\r\n").decode())
                yield pd.DataFrame({"chrom": part["chrom"].array, "tile": part["tile"].array, "seq": seqs})

    return rows.mapInPandas(read, "chrom string, tile long, seq string")


def transcripts(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Transcripts of a GTF with exons, in first-seen order (ord): name, chrom,
    strand, exons, attrs. Without exon lines the span is the one exon."""
    rows = annotation_lines(spark, path).filter("ftype in ('exon', 'transcript')").withColumn("name", _attr("transcript_id")).filter("name is not null")
    if source is not None:
        rows = rows.filter(F.col("source") == source)
    x = F.filter(F.collect_list(F.when(F.col("ftype") == "exon", F.struct("s", "e"))), lambda v: v.isNotNull())
    g = rows.groupBy("name").agg(F.min_by("chrom", "ord").alias("chrom"), F.min_by("strand", "ord").alias("strand"), F.min_by("attrs", "ord").alias("attrs"), F.min("ord").alias("ord"), x.alias("exons"), F.min("s").alias("s"), F.max("e").alias("e"))
    return g.withColumn("exons", F.when(F.size("exons") > 0, F.array_sort("exons")).otherwise(F.array(F.struct("s", "e")))).drop("s", "e")
