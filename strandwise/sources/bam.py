"""BAM files as a Spark data source, read in pure Python.

``spark.dataSource.register(BamDataSource)``, then ``spark.read.format("bam")
.load(path)``. A file is split at block starts that are found by their magic
bytes and checked by the record chain, so tasks share large files; a split
begins with the first record that starts in its blocks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

SCHEMA = "name string, flag int, chrom string, s bigint, e bigint, mapq int, blocks array<struct<start:bigint,end:bigint,quals:array<int>>>"
MAGIC = b"\x1f\x8b\x08\x04"
#: Records of an Arrow batch, fewer where they hold this many aligned bases' qualities.
BATCH, BATCH_QUALS = 4096, 1 << 22
#: The index's bins by level, the number of the first and the bits of a bin's length; a bin for statistics.
BINS = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))
STATISTICS_BIN = 37450
#: Bytes of tags that a record may have for a place to pass as its start.
MAX_TAGS = 16 << 20


def _open(path: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    fs, p = FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), path)
    return fs.open_input_file(p), fs.get_file_info(p).size


def _block(f, at: int) -> tuple[bytes, int]:
    """(data, place of the next block) of the block at ``at``; its end is (b"", at)."""
    f.seek(at)
    head = f.read(18)
    if len(head) < 18:
        return b"", at
    if head[:4] != MAGIC:
        raise ValueError(f"no block at {at}")
    extra, size, k = head[12:], None, 0
    xlen = struct.unpack_from("<H", head, 10)[0]
    if xlen > 6:
        extra += f.read(xlen - 6)
    while k + 4 <= xlen:
        n = struct.unpack_from("<H", extra, k + 2)[0]
        if extra[k : k + 2] == b"BC":
            size = struct.unpack_from("<H", extra, k + 4)[0] + 1
        k += 4 + n
    if size is None:
        raise ValueError(f"block at {at} has no size")
    body = f.read(size - 12 - xlen)
    return zlib.decompress(body[:-8], -15), at + size


def read_header(path: str) -> tuple[str, list[tuple[str, int]], int, int]:
    """(header text, [(chromosome, length)], block of the first record, its place in the block)."""
    f, _ = _open(path)
    data, at, places = b"", 0, [(0, 0)]

    def need(n: int):
        nonlocal data, at
        while len(data) < n:
            more, to = _block(f, at)
            if to == at:
                raise ValueError(f"{path} ends within its header")
            at = to
            data += more
            places.append((len(data), at))

    need(12)
    if data[:4] != b"BAM\1":
        raise ValueError(f"{path} is not a BAM file")
    n_text = struct.unpack_from("<i", data, 4)[0]
    need(12 + n_text)
    text = data[8 : 8 + n_text].rstrip(b"\0").decode()
    n_ref, k, refs = struct.unpack_from("<i", data, 8 + n_text)[0], 12 + n_text, []
    for _ in range(n_ref):
        need(k + 4)
        n = struct.unpack_from("<i", data, k)[0]
        need(k + 8 + n)
        refs.append((data[k + 4 : k + 3 + n].decode(), struct.unpack_from("<i", data, k + 4 + n)[0]))
        k += 8 + n
    begin, block = max(p for p in places if p[0] <= k)
    return text, refs, block, k - begin


def chrom_sizes(spark, path: str):
    """chrom, length and ordinal in the header's order; raises for a header that
    names another sort order than coordinate."""
    text, refs, _, _ = read_header(path)
    for line in text.splitlines():
        order = [x[3:] for x in line.split("\t") if x.startswith("SO:")] if line.startswith("@HD") else []
        if order and order[0] != "coordinate":
            raise ValueError(f"{path} is sorted by {order[0]}, not by coordinate")
    return spark.createDataFrame([(n, ln, i) for i, (n, ln) in enumerate(refs)], "chrom string, length long, ordinal int")


def read_index(path: str) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """By chromosome (rows of bin, begin and end of a chunk; offsets by 16 kb), or
    None without an index. Offsets are a block's place times 65,536 plus the place in it."""
    for name in (f"{path}.bai", f"{path.removesuffix('.bam')}.bai"):
        try:
            f, size = _open(name)
        except FileNotFoundError:
            continue
        data = f.read(size)
        if data[:4] != b"BAI\1":
            raise ValueError(f"{name} is not an index")
        k, out = 8, []
        for _ in range(struct.unpack_from("<i", data, 4)[0]):
            n_bin, chunks = struct.unpack_from("<i", data, k)[0], []
            k += 4
            for _ in range(n_bin):
                number, n = struct.unpack_from("<Ii", data, k)
                ends = np.frombuffer(data, "<u8", 2 * n, k + 8).reshape(n, 2)
                if number != STATISTICS_BIN:
                    chunks.append(np.column_stack([np.full(n, number, "u8"), ends]))
                k += 8 + 16 * n
            n = struct.unpack_from("<i", data, k)[0]
            out.append((np.concatenate(chunks) if chunks else np.zeros((0, 3), "u8"), np.frombuffer(data, "<u8", n, k + 4)))
            k += 4 + 8 * n
        return out
    return None


def index_span(chunks: np.ndarray, linear: np.ndarray, lo: int, hi: int | None) -> tuple[int, int] | None:
    """The offsets between which all records lie that overlap [lo, hi), or None."""
    level = np.searchsorted([b for b, _ in BINS], chunks[:, 0].astype("i8"), "right") - 1
    first, bits = np.array(BINS, "i8")[level].reshape(-1, 2).T
    at = chunks[:, 0].astype("i8") - first
    near = ((at + 1) << bits > lo) & ((at << bits) < (1 << 62 if hi is None else hi))
    if not near.any():
        return None
    begin, end = int(chunks[near, 1].min()), int(chunks[near, 2].max())
    if lo >> 14 < len(linear):
        begin = max(begin, int(linear[lo >> 14]))
    return (begin, end) if begin < end else None


def parse(rec: bytes, names: list[str], with_quals: bool = True) -> tuple:
    """A row from a record without its size."""
    ref, pos, n_name, mapq, _, n_cigar, flag, n_seq = struct.unpack_from("<iiBBHHHi", rec, 0)
    k = 32 + n_name
    ops = struct.unpack_from(f"<{n_cigar}I", rec, k)
    k += 4 * n_cigar + (n_seq + 1) // 2
    qual = rec[k : k + n_seq]
    quals = None if not with_quals or not n_seq or qual[:1] == b"\xff" else list(qual)
    r, q, out = pos, 0, []
    for op in ops:
        n, kind = op >> 4, op & 15
        if kind in (0, 7, 8):
            out.append((r, r + n, None if quals is None else quals[q : q + n]))
        if kind in (0, 2, 3, 7, 8):
            r += n
        if kind in (0, 1, 4, 7, 8):
            q += n
    return rec[32 : 31 + n_name].decode(), flag, names[ref] if ref >= 0 else None, pos, r if r > pos else pos + 1, mapq, out


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    name, flag, chrom, s, e, mapq, blocks = zip(*rows)
    flat = [b for own in blocks for b in own]
    fields = [pa.array([b[i] for b in flat], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32())))]
    nested = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, blocks)]), pa.int32()), pa.StructArray.from_arrays(fields, ["start", "end", "quals"]))
    plain = [pa.array(v, kind) for v, kind in zip((name, flag, chrom, s, e, mapq), (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()))]
    return pa.RecordBatch.from_arrays([*plain, nested], ["name", "flag", "chrom", "s", "e", "mapq", "blocks"])


class Split(InputPartition):
    """Blocks from ``begin`` to ``end``; with ``skip``, the first record's place in
    the first of them; with ``ref``, records of that chromosome alone."""

    def __init__(self, begin: int, end: int, skip: int | None = None, ref: int | None = None):
        self.begin, self.end, self.skip, self.ref = begin, end, skip, ref


class BamReader(DataSourceReader):
    def __init__(self, path: str, size: int, with_quals: bool = True):
        self.path, self.size, self.with_quals = path, size, with_quals
        self.chroms: set[str] | None = None
        self.lo, self.hi = 0, None  # records end behind lo and start before hi

    def pushFilters(self, filters):
        """Notes what the filters rule out; all go back to Spark, which applies them again."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("chrom",) and isinstance(f, (EqualTo, In)):
                some = {value} if isinstance(f, EqualTo) else set(value)
                self.chroms = some if self.chroms is None else self.chroms & some
            if column in (("s",), ("e",)) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.lo = max(self.lo, value - 1 if column == ("e",) and not isinstance(f, GreaterThan) else value)
            if column == ("s",) and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                bound = value if isinstance(f, LessThan) else value + 1
                self.hi = bound if self.hi is None else min(self.hi, bound)
            yield f

    def partitions(self):
        _, total = _open(self.path)
        spans = [(0, total, None, None)]
        index = None if self.chroms is None else read_index(self.path)
        if index is not None:
            _, refs, _, _ = read_header(self.path)
            spans = []
            for ref, (name, _) in enumerate(refs):
                span = index_span(*index[ref], self.lo, self.hi) if name in self.chroms else None
                if span:
                    spans.append((span[0] >> 16, min(total, (span[1] >> 16) + 1), span[0] & 0xFFFF, ref))
        return [Split(at, min(end, at + self.size), skip if at == begin else None, ref) for begin, end, skip, ref in spans for at in range(begin, end, self.size)] or [Split(0, 0)]

    def read(self, split: Split):
        rows, quals = [], 0
        for r in self._rows(split):
            rows.append(r)
            quals += sum(len(q) for _, _, q in r[6] if q)
            if len(rows) == BATCH or quals >= BATCH_QUALS:
                yield to_batch(rows)
                rows, quals = [], 0
        if rows:
            yield to_batch(rows)

    def _rows(self, split: Split):
        if split.begin == split.end:
            return
        text, refs, first, skip = read_header(self.path)
        names = [n for n, _ in refs]
        wanted = None
        if split.ref is not None:
            wanted = {split.ref}
        elif self.chroms is not None:
            wanted = {i for i, n in enumerate(names) if n in self.chroms}
        if wanted is not None and not wanted:
            return
        ordered = any("SO:coordinate" in line.split("\t") for line in text.splitlines() if line.startswith("@HD"))
        f, _ = _open(self.path)
        if split.skip is not None:
            at, data, skip = split.begin, None, split.skip
        elif split.begin <= first and split.ref is None:
            at, data = first, None
        else:
            at, data, skip = self._start(f, split.begin, split.end, refs)
        if at is None or at >= split.end:
            return
        buf, k = b"", skip if data is None else skip
        own = True
        while True:
            if own and at >= split.end:
                limit, own = len(buf), False  # records that start from here on are the next split's
            if not own and k >= limit:
                return
            if len(buf) - k >= 4 and len(buf) - k >= 4 + struct.unpack_from("<i", buf, k)[0]:
                n = struct.unpack_from("<i", buf, k)[0]
                ref, pos = struct.unpack_from("<ii", buf, k + 4)
                if ordered and wanted is not None and (ref < 0 or ref > max(wanted) or (ref == max(wanted) and self.hi is not None and pos >= self.hi)):
                    return  # all that follow lie behind
                if (wanted is None or ref in wanted) and (self.hi is None or pos < self.hi):
                    row = parse(buf[k + 4 : k + 4 + n], names, self.with_quals)
                    if row[4] > self.lo or not self.lo:
                        yield row
                k += 4 + n
                continue
            more, to = _block(f, at)
            if to == at:
                return
            if k > 1 << 16 and own:
                buf, k = buf[k:], 0
            buf += more
            at = to

    def _start(self, f, begin: int, end: int, refs):
        """The first block from ``begin`` on, before ``end``, in which a record
        starts, and the record's place in it. A long record can cover many blocks."""
        at = self._block_at(f, begin, end)
        while at is not None and at < end:
            data, to = _block(f, at)
            if to == at:
                break
            place = self._record(f, data, to, refs) if data else None
            if place is not None:
                return at, data, place
            at = to
        return None, None, 0

    @staticmethod
    def _block_at(f, begin: int, end: int) -> int | None:
        """The first place in [begin, end) where a block starts that another, or the file's end, follows."""
        window = 1 << 17
        for lo in range(begin, end, window):
            f.seek(lo)
            near = f.read(min(end - lo, window) + len(MAGIC) - 1)
            k = near.find(MAGIC)
            while k >= 0:
                try:
                    _, to = _block(f, lo + k)
                    _block(f, to)
                    return lo + k
                except (ValueError, zlib.error, struct.error):
                    k = near.find(MAGIC, k + 1)
        return None

    @staticmethod
    def _record(f, data: bytes, to: int, refs) -> int | None:
        """The first place in ``data`` from which plausible records follow one
        another: three, or all to the file's end. Bytes behind ``data`` are read
        as far as the records reach."""
        more, nxt, ended = bytearray(data), to, False

        def reach(n: int) -> bool:
            nonlocal nxt, ended
            while len(more) < n and not ended:
                extra, at = _block(f, nxt)
                ended = at == nxt
                more.extend(extra)
                nxt = at
            return len(more) >= n

        def plausible(k: int) -> bool:
            seen = 0
            while seen < 3:
                if not reach(k + 36):
                    return seen > 0 and k == len(more)
                n, ref, pos, n_name, _, _, n_cigar, _, n_seq = struct.unpack_from("<iiiBBHHHi", more, k)
                fixed = 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq
                if not (-1 <= ref < len(refs) and -1 <= pos and (ref < 0 or pos <= refs[ref][1]) and n_name >= 2 and n_seq >= 0 and fixed <= n <= fixed + MAX_TAGS):
                    return False
                if not reach(k + 36 + n_name):
                    return False
                name = more[k + 36 : k + 36 + n_name]
                if name[-1] or min(name[:-1]) < 33 or max(name[:-1]) > 126:
                    return False
                if not reach(k + 4 + n):
                    return False
                k += 4 + n
                seen += 1
            return True

        return next((k for k in range(len(data)) if plausible(k)), None)


class BamDataSource(DataSource):
    """Options: path; split (bytes of a split, 32 MB by default); quals (false: no base qualities)."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BamReader(self.options["path"], int(self.options.get("split", 32 << 20)), str(self.options.get("quals", "true")).lower() == "true")


def alignments(spark, path: str, split: int = 32 << 20, quals: bool = True):
    """All records. Spark hands filters to Python sources only where
    ``spark.sql.python.filterPushdown.enabled`` is set, so it is set here."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamDataSource)
    return spark.read.format("bam").option("path", path).option("split", split).option("quals", quals).load()


def overlapping(spark, path: str, chrom: str, s: int, e: int, **options):
    """Records that overlap [s, e) of a chromosome; of an unknown one, none."""
    return alignments(spark, path, **options).filter((F.col("chrom") == chrom) & (F.col("s") < e) & (F.col("e") > s))
