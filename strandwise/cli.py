"""Command line: detect, merge, extract. Exit 0: done, 1: bad input, 2: a module is missing."""

from __future__ import annotations

import argparse
import dataclasses
import logging
import sys

from .config import MODES, STRANDEDNESS, DetectConfig, MergeConfig

DETECT_OFF = {"keep_duplicates": "--keep-duplicates", "emit_bedgraph": "--emit-bedgraph", "emit_coverage_store": "--emit-coverage-store"}
DETECT_ON = {"count_secondary": "--no-count-secondary", "stranded_masking": "--no-stranded-masking", "emit_bed": "--no-bed", "emit_multiqc": "--no-multiqc"}

#: Options whose names differ from their fields', numbers without a default, and those with a choice of values.
NAMED = {
    "gdna_max_length_ratio_diff": "--gdna-max-strand-length-ratio-diff", "gdna_min_correlation": "--gdna-min-profile-correlation",
    "gdna_min_depth_ratio": "--gdna-min-depth-balance", "gdna_max_cv": "--gdna-flat-cv-threshold",
}
DETECT_INT = ("strand_infer_max_reads", "strand_infer_max_exons")
CHOICES = {"annotation_mode": MODES, "library_strandedness": STRANDEDNESS}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandwise", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("detect")
    for f in dataclasses.fields(DetectConfig):
        if f.name in DETECT_OFF:
            p.add_argument(DETECT_OFF[f.name], dest=f.name, action="store_true")
        elif f.name in DETECT_ON:
            p.add_argument(DETECT_ON[f.name], dest=f.name, action="store_false")
        else:
            kind = type(f.default) if f.default is not None else int if f.name in DETECT_INT else str
            p.add_argument(NAMED.get(f.name, "--" + f.name.replace("_", "-")), dest=f.name, type=kind, choices=CHOICES.get(f.name), default=f.default, required=f.name in ("bam", "gtf", "out_prefix"))
    p.add_argument("--threads", type=int, default=4)
    p = sub.add_parser("merge")
    p.add_argument("--tsv", dest="tsvs", nargs="+", required=True)
    p.add_argument("--out-prefix", required=True)
    p.add_argument("--sample-names", nargs="+", default=())
    p.add_argument("--reference-gtf")
    p.add_argument("--min-samples", type=int, default=2)
    p.add_argument("--min-reciprocal-overlap", type=float, default=0.85)
    p.add_argument("--ignore-strand", action="store_true")
    p.add_argument("--include-bidirectional", action="store_true")
    p.add_argument("--annotate", nargs="+", default=())
    p.add_argument("--annotate-labels", nargs="+", default=())
    p.add_argument("--annotate-feature-types", nargs="+", default=())
    p.add_argument("--annotate-nearest-window", type=int, default=10_000)
    p.add_argument("--no-annotate-names", dest="annotate_names", action="store_false")
    p.add_argument("--annotate-stranded", action="store_true")
    p.add_argument("--emit-plots", action="store_true")
    p.add_argument("--plot-shoulder", type=int, default=1_000)
    p.add_argument("--plot-all-passing", action="store_true")
    p.add_argument("--coverage-store", dest="coverage_stores", nargs="+", default=())
    p = sub.add_parser("extract")
    p.add_argument("--genome", required=True)
    p.add_argument("--gtf", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--source")
    p.add_argument("--line-width", type=int, default=60)
    for p in sub.choices.values():
        p.add_argument("--verbose", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    command, verbose, threads = args.pop("command"), args.pop("verbose"), args.pop("threads", 4)
    logging.basicConfig(stream=sys.stderr, level=logging.DEBUG if verbose else logging.INFO, format="%(levelname)s %(message)s")
    try:
        from pyspark.sql import SparkSession

        from .plans import detect, extract, merge
    except ImportError as error:
        logging.error("%s", error)
        return 2
    spark = SparkSession.getActiveSession() or SparkSession.builder.master(f"local[{threads}]").appName("strandwise").getOrCreate()
    try:
        if command == "detect":
            detect.run(spark, DetectConfig(**args))
        elif command == "merge":
            merge.run(spark, MergeConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in args.items()}))
        else:
            extract.run(spark, args["genome"], args["gtf"], args["out"], args["source"], args["line_width"])
    except (ValueError, FileNotFoundError, RuntimeError) as error:
        logging.error("%s", error)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
