"""File sinks. Rows are sorted and written as parts by many tasks; the parts are
joined into one file as bytes. Numbers are rounded as Python does it."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import lines

#: Columns of the candidate table in order, with digits of rounding.
CANDIDATE_COLUMNS = (
    ("region_id", None), ("chrom", None), ("start", None), ("end", None), ("length", None), ("class", None), ("total_coverage", 3), ("covered_bases", None), ("covered_fraction", 4), ("avg_depth", 3), ("max_depth", 3), ("unique_total", 1), ("multi_total", 1),
    ("unique_fraction", 4), ("plus_covered_len", None), ("minus_covered_len", None), ("plus_mean_depth", 3), ("minus_mean_depth", 3), ("pm_depth_ratio", 4), ("covered_len_ratio", 4), ("strand_length_ratio_diff", 4), ("dominant_strand", None),
    ("dominant_strand_fraction", 4), ("dual_strand_fraction", 4), ("strand_overlap_jaccard", 4), ("profile_correlation", 4), ("plus_cv", 4), ("minus_cv", 4), ("strand_balance", 4), ("nearest_feature_id", None), ("nearest_feature_distance", None),
    ("context_label", None), ("kept_as_unknown_transcript", None), ("unknown_transcript_name", None), ("reason_for_classification", None),
)
CONSENSUS_COLUMNS = (
    ("consensus_id", None), ("chrom", None), ("start", None), ("end", None), ("length", None), ("strand", None), ("consensus_class", None), ("majority_class", None), ("class_agreement", 4), ("n_samples", None), ("n_members", None), ("samples", None),
    ("member_classes", None), ("mean_unique_fraction", 4), ("mean_dual_strand_fraction", 4), ("mean_profile_correlation", 4), ("mean_avg_depth", 4), ("passes_min_samples", None), ("in_consensus_gtf", None), ("consensus_transcript_name", None), ("gene_id", None), ("member_region_ids", None),
)


def python_round(x: Column, digits: int) -> Column:
    """``round`` on exact binary values, as text; whole batches of regions at a time."""

    @F.pandas_udf("string")
    def rounded(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v != v else repr(round(float(v), digits)))

    return rounded(x)


def _text(name: str, digits: int | None, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if digits is not None:
        c = python_round(c.cast("double"), digits)
    elif kind == "boolean":
        c = F.when(c, "yes").otherwise("no")
    return F.coalesce(c.cast("string"), F.lit("NA")).alias(name)


def table_text(rows: DataFrame, columns) -> DataFrame:
    kinds = dict(rows.dtypes)
    return rows.select(*[_text(n, d, kinds[n]) for n, d in columns])


def write_text(path: str, content: str) -> str:
    """One small file, through Hadoop's file system as the tables beside it."""
    spark = SparkSession.getActiveSession()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    return path


def exists(path: str) -> bool:
    spark = SparkSession.getActiveSession()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_lines(rows: DataFrame, path: str, order: list, head: list[str] = ()) -> str:  # type: ignore[assignment]
    """``rows.value`` sorted by ``order`` as the one text file ``path``, after the
    lines of ``head``. Sorting and writing run in the cluster, no task has all rows."""
    return _one_file(rows.sparkSession, [*head, _parts(rows, f"{path}.parts", order)], path)


def _parts(rows: DataFrame, folder: str, order: list) -> tuple[str]:
    rows.orderBy(*order).select("value").write.mode("overwrite").text(folder)
    return (folder,)


def _one_file(spark: SparkSession, pieces: list, path: str) -> str:
    """Lines (text) and folders of part files (in tuples of one) one after the
    other, through Hadoop's file system. Bytes go through a small buffer; a part
    is deleted when it is copied, so the disk holds hardly more than the file."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    target, partial = at(path), at(f"{path}.partial")
    fs = target.getFileSystem(conf)
    out = fs.create(partial, True)
    try:
        for piece in pieces:
            if isinstance(piece, str):
                out.write(bytearray(f"{piece}\n".encode()))
                continue
            found = [s.getPath() for s in fs.listStatus(at(*piece)) if s.getPath().getName().startswith("part-")]
            for part in sorted(found, key=lambda p: int(p.getName().split("-")[1])):
                rows = fs.open(part)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(rows, out, 1 << 20, False)
                finally:
                    rows.close()
                fs.delete(part, False)
            fs.delete(at(*piece), True)
    finally:
        out.close()
    fs.delete(target, True)
    if not fs.rename(partial, target):
        raise RuntimeError(f"{path} could not be written")
    return path


def write_table(rows: DataFrame, columns, path: str, order: list) -> str:
    """Tab-separated, always with a header line."""
    kept = rows.select("*", *[o.alias(f"_o{i}") if isinstance(o, Column) else F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    kinds = dict(rows.dtypes)
    body = kept.select(F.concat_ws("\t", *[_text(n, d, kinds[n]) for n, d in columns]).alias("value"), *[f"_o{i}" for i in range(len(order))])
    return write_lines(body, path, [f"_o{i}" for i in range(len(order))], ["\t".join(n for n, _ in columns)])


def attribute(key: str, value: Column) -> Column:
    return F.concat(F.lit(f'{key} "'), F.replace(value, F.lit('"'), F.lit("")), F.lit('";'))


def gtf_rows(rows: DataFrame, name: str, source: str, extra: list[Column], order: list[str]) -> DataFrame:
    """A transcript and an exon line for each row, with sort columns. Gene,
    transcript and gene name are the same: the loci are intervals, not genes."""
    strand = F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise(".")
    number = F.when(F.col("_kind.k") == 1, F.lit('exon_number "1";'))
    attrs = F.concat_ws(" ", *[attribute(k, F.col(name)) for k in ("gene_id", "transcript_id", "gene_name")], attribute("source", F.lit(source)), *extra, number)
    both = rows.withColumn("_kind", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("transcript").alias("v")), F.struct(F.lit(1).alias("k"), F.lit("exon").alias("v")))))
    line = F.concat_ws("\t", "chrom", F.lit(source), F.col("_kind.v"), (F.col("s") + 1).cast("string"), F.col("e").cast("string"), F.lit("."), strand, F.lit("."), attrs)
    return both.select(line.alias("value"), *order, F.col("_kind.k").alias("kind"))


def write_merged(reference: str, new: DataFrame, path: str, order: list[str], marker: str) -> str:
    """The reference's lines as they are, a marker, then the new lines."""
    spark = new.sparkSession
    old = _parts(lines(spark, reference), f"{path}.reference.parts", ["ord"])
    return _one_file(spark, [old, marker, _parts(new, f"{path}.parts", order)], path)


def bed_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    score = F.least(F.lit(1000), F.bround("avg_depth").cast("long"))
    return rows.select(F.concat_ws("\t", "chrom", F.col("s").cast("string"), F.col("e").cast("string"), "class", score.cast("string"), F.when(F.col("dominant_strand").isin("+", "-"), F.col("dominant_strand")).otherwise(".")).alias("value"), *order)


def bedgraph_rows(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    return rows.select(F.concat_ws("\t", "chrom", F.col("s").cast("string"), F.col("e").cast("string"), python_round(F.col(column), 3)).alias("value"), *order)


def write_json(path: str, content: dict) -> str:
    return write_text(path, json.dumps(content, indent=2, default=float) + "\n")


MULTIQC = ("annotated", "novel_transcript", "bidirectional_RNA", "gDNA", "multimapper_artifact", "other_unannotated")


def write_multiqc(path: str, sample: str, counts: dict) -> str:
    """Configuration comments, a header and the sample's one row."""
    comments = ["# id: 'read_assignment'", "# section_name: 'Read assignment'", "# description: 'Reads by the class of the region they lie in'", "# plot_type: 'bargraph'", "# pconfig:", "#     id: 'read_assignment_plot'", "#     title: 'Read assignment'", "#     ylab: 'Reads'", "#     stacking: 'normal'"]
    return write_text(path, "\n".join([*comments, "\t".join(("Sample", *MULTIQC)), "\t".join((sample, *(str(int(counts[c])) for c in MULTIQC)))]) + "\n")
