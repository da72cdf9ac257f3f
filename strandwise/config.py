"""Settings of the three commands, checked before any plan is built."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

STRANDEDNESS = ("auto", "unstranded", "forward", "reverse")
MODES = ("exon", "transcript", "gene", "all")


def _fail_unless(ok: bool, text: str) -> None:
    if not ok:
        raise ValueError(text)


def _share(name: str, x: float) -> None:
    _fail_unless(0.0 <= x <= 1.0, f"{name} must lie in [0, 1], not {x}")


@dataclass(frozen=True)
class DetectConfig:
    bam: str = ""
    gtf: str = ""
    out_prefix: str = ""
    fai: str | None = None
    min_mapq: int = 20
    min_baseq: int = 0
    keep_duplicates: bool = False
    min_unique_fraction: float = 0.5
    count_secondary: bool = True
    min_depth: int = 10
    strand_min_depth: int = 3
    max_gap: int = 50
    min_region_length: int = 200
    min_covered_bases: int = 100
    min_covered_fraction: float = 0.7
    annotation_mode: str = "exon"
    nearest_feature_window: int = 10_000
    stranded_masking: bool = True
    library_strandedness: str = "auto"
    strand_infer_max_reads: int | None = None
    strand_infer_max_exons: int | None = None
    strand_infer_min_confidence: float = 0.8
    gdna_min_dual_strand_fraction: float = 0.6
    gdna_max_length_ratio_diff: float = 0.25
    gdna_min_covered_fraction: float = 0.5
    gdna_min_depth_ratio: float = 0.5
    gdna_min_correlation: float = 0.7
    gdna_max_cv: float = 0.4
    novel_min_dominant_strand_fraction: float = 0.8
    emit_bed: bool = True
    emit_bedgraph: bool = False
    emit_multiqc: bool = True
    emit_coverage_store: bool = False
    sample_name: str | None = None
    tile: int = 1_000_000

    def validate(self, files: bool = True) -> "DetectConfig":
        _fail_unless(self.min_depth >= 1, "min_depth must be 1 or more")
        _fail_unless(self.strand_min_depth >= 1, "strand_min_depth must be 1 or more")
        _fail_unless(self.max_gap >= 0, "max_gap must not be negative")
        _fail_unless(self.min_region_length >= 1, "min_region_length must be 1 or more")
        _fail_unless(self.min_mapq >= 0 and self.min_baseq >= 0, "quality bounds must not be negative")
        _fail_unless(self.tile >= 1, "tile must be 1 or more")
        for name in ("min_unique_fraction", "min_covered_fraction", "strand_infer_min_confidence", "gdna_min_dual_strand_fraction", "gdna_max_length_ratio_diff", "gdna_min_covered_fraction", "gdna_min_depth_ratio", "novel_min_dominant_strand_fraction"):
            _share(name, getattr(self, name))
        _fail_unless(-1.0 <= self.gdna_min_correlation <= 1.0, "gdna_min_correlation must lie in [-1, 1]")
        _fail_unless(self.annotation_mode in MODES, f"annotation_mode must be one of {', '.join(MODES)}")
        _fail_unless(self.library_strandedness in STRANDEDNESS, f"library_strandedness must be one of {', '.join(STRANDEDNESS)}")
        if files:
            _fail_unless(bool(self.out_prefix), "out_prefix is needed")
            for path in filter(None, (self.bam, self.gtf, self.fai)):
                if "://" not in path and not os.path.exists(path):
                    raise FileNotFoundError(path)
        return self


@dataclass(frozen=True)
class MergeConfig:
    tsvs: tuple[str, ...] = ()
    out_prefix: str = ""
    sample_names: tuple[str, ...] = ()
    reference_gtf: str | None = None
    min_samples: int = 2
    min_reciprocal_overlap: float = 0.85
    ignore_strand: bool = False
    include_bidirectional: bool = False
    annotate: tuple[str, ...] = ()
    annotate_labels: tuple[str, ...] = ()
    annotate_feature_types: tuple[str, ...] = ()
    annotate_nearest_window: int = 10_000
    annotate_names: bool = True
    annotate_stranded: bool = False
    emit_plots: bool = False
    plot_shoulder: int = 1_000
    plot_all_passing: bool = False
    coverage_stores: tuple[str, ...] = field(default=())

    def validate(self, files: bool = True) -> "MergeConfig":
        _fail_unless(self.min_samples >= 1, "min_samples must be 1 or more")
        _fail_unless(0.0 < self.min_reciprocal_overlap <= 1.0, "min_reciprocal_overlap must lie in (0, 1]")
        _fail_unless(self.annotate_nearest_window >= 0, "annotate_nearest_window must not be negative")
        if files:
            _fail_unless(bool(self.tsvs), "one candidate table is needed at least")
            _fail_unless(not self.sample_names or len(self.sample_names) == len(self.tsvs), "as many sample names as tables are needed")
            _fail_unless(bool(self.out_prefix), "out_prefix is needed")
            for path in (*self.tsvs, *filter(None, (self.reference_gtf,))):
                if "://" not in path and not os.path.exists(path):
                    raise FileNotFoundError(path)
        return self
