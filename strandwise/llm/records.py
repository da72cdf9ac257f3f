"""Token ids in length-delimited binary record files with a separate offset index.

File: 8 bytes ``TOKREC01``, 4 bytes item size (2 or 4), then records. Record:
uint64 length, uint32 masked crc32 of those 8 bytes, the ids, uint32 masked
crc32 of the ids. All little-endian; a mask rotates the crc right by 15 bits and
adds a constant, so that a crc stored beside its data doesn't check itself. The
index table has a row for each record (file, offset, length), so a reader can
fetch records in any order.

A task writes files under names of its own, and only the index rows of tasks
that succeed are kept; what a lost or repeated attempt wrote is never listed.

A Python worker keeps its tokenizer and known words from task to task, and lets
go of them when it hasn't written for IDLE_SECONDS: Spark gives the same worker
to whatever runs next.
"""

from __future__ import annotations

import contextlib
import json
import os
import struct
import threading
import uuid
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, trim

MAGIC = b"TOKREC01"
FILE_BYTES = 64 << 20
MEMO_WORDS = 300_000
IDLE_SECONDS = 2.0
INDEX = "id long, file string, part int, roll int, offset long, length long, before long, n_tokens long"


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


#: Normalizers that never look past white space, and pre-tokenizers that drop it before anything else.
_LOCAL = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents"}
_DROPS_SPACE = {"Whitespace", "WhitespaceSplit", "BertPreTokenizer"}
_PROBE = " a  b\nc 's it's D'  LL 1 2 3.4 , ,. \u00e9 \u0301x \n\n <a> _ b\u3000c "


def separable(lib) -> bool:
    """Whether a text's ids are those of its runs between spaces and line feeds,
    joined: by the kinds of its normalizer and pre-tokenizer, and a probe that no
    piece of the latter holds either of the two."""
    file = json.loads(lib.to_str())

    def kinds(part, inner):
        return [] if part is None else part[inner] if part["type"] == "Sequence" else [part]

    def local(n):
        return n["type"] in _LOCAL or (n["type"] == "Replace" and n["pattern"].get("Regex") in (r"\s+", r"\s") and n["content"] == " ")

    steps = kinds(file["pre_tokenizer"], "pretokenizers")
    drops = bool(steps) and (steps[0]["type"] in _DROPS_SPACE or (steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"]))
    if not drops or not all(map(local, kinds(file["normalizer"], "normalizers"))) or any(t.get("add_prefix_space") for t in steps):
        return False
    if any(c in t["content"] for t in file["added_tokens"] for c in " \n"):
        return False
    pieces = [p for p, _ in lib.pre_tokenizer.pre_tokenize_str(_PROBE)]
    return not any(c in p for p in pieces for c in " \n\u0120\u010a")


#: Patterns of pre-tokenizers for which a letter and one of SIGNS are never in one piece.
APART = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
SIGNS = ",.;:!?$%#&*"
#: Letters that no normal form or lower-casing turns into more than one character.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


class Encoder:
    """Ids of whole texts from the tokenizers library.

    Where the tokenizer is ``separable``, each new run between spaces and line
    feeds is encoded once by the library and remembered, up to MEMO_WORDS runs,
    of which those met in several blocks then stay; a block's runs are looked up
    once for each distinct one, and their ids gathered by numpy. To have fewer distinct runs, signs behind a letter are set
    apart and A-Z lowered where that can't change an id: the first by the
    tokenizer's own pattern; the second where it lowers by itself, the block has
    no combining marks, and no special token comes to be. Any other tokenizer
    encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.type = np.dtype("<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4")
        self.separable = separable(self.lib)
        file = json.loads(self.lib.to_str())
        self.special = [t["content"] for t in file["added_tokens"]]
        steps, forms = json.dumps(file["pre_tokenizer"]), json.dumps(file["normalizer"])
        self.lowers = '"Lowercase"' in forms
        self.signs = any(json.dumps({"Regex": p}) in steps for p in APART) and not any(c in t for t in self.special for c in SIGNS)
        self._forget()

    def _plain(self, texts: pa.Array) -> pa.Array:
        """The same ids in fewer distinct runs."""
        texts = pc.replace_substring(texts, "\n", " ")
        if self.lowers and not pc.any(pc.match_substring_regex(texts, r"\pM")).as_py():
            low = pc.ascii_lower(texts)
            met = lambda t: sum(pc.sum(pc.count_substring(t, x)).as_py() or 0 for x in self.special)
            texts = low if met(low) == met(texts) else texts
        return pc.replace_substring_regex(texts, rf"([{LETTERS}])([{SIGNS}]+)", r"\1 \2") if self.signs else texts

    def _forget(self) -> None:
        self.memo: dict[str, int] = {"": 0}
        self.flat, self.used = np.zeros(1 << 12, self.type), 0
        self.ends = np.zeros(1 << 12, np.int64)  # word i has the ids from ends[i] to ends[i + 1]
        self.met = np.zeros(1 << 12, np.int32)  # blocks in which word i was known already

    def _keep_met(self) -> None:
        """Forgets the words that were met in one block only, or all where these are few."""
        known = len(self.memo)
        keep = self.met[:known] > 0
        keep[0] = True
        if keep.sum() > MEMO_WORDS // 2:
            return self._forget()
        at, sizes = np.flatnonzero(keep), np.diff(self.ends[: known + 1])[keep]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        flat = self.flat[np.repeat(self.ends[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        words = [w for w, k in zip(self.memo, keep.tolist()) if k]
        self._forget()
        self.memo = dict(zip(words, range(len(words))))
        self.flat = np.concatenate((flat, self.flat))
        self.ends = np.concatenate((ends, np.zeros(len(ends), np.int64)))
        self.met = np.zeros(len(self.ends), np.int32)
        self.used = len(flat)

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 2000):
            part = new[at : at + 2000]
            got = self.lib.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0, *(len(w) + 1 for w in part)])
            first = np.fromiter((o[0] for o in got.offsets), np.int64, len(got.ids))
            n, known = len(got.ids), len(self.memo)
            while self.used + n > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros(len(self.flat), self.type)))
            while known + len(part) + 1 > len(self.ends):
                self.ends = np.concatenate((self.ends, np.zeros(len(self.ends), np.int64)))
                self.met = np.concatenate((self.met, np.zeros(len(self.ends) - len(self.met), np.int32)))
            self.flat[self.used : self.used + n] = got.ids
            self.ends[known + 1 : known + len(part) + 1] = self.used + np.searchsorted(first, starts[1:])
            self.used += n
            self.memo.update(zip(part, range(known, known + len(part))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, index of each text's first and the end)."""
        texts = texts.fill_null("")
        if not self.separable:
            got = [e.ids for e in self.lib.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.fromiter((i for ids in got for i in ids), self.type), np.cumsum([0, *map(len, got)])
        runs = pc.split_pattern(self._plain(texts), " ")
        coded = runs.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        find = lambda: np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
        place = find()
        new = np.flatnonzero(place < 0)
        if len(self.memo) + len(new) > MEMO_WORDS:
            self._keep_met()
            place = find()
            new = np.flatnonzero(place < 0)
        self.met[place[place >= 0]] += 1
        place[new] = np.arange(len(self.memo), len(self.memo) + len(new))
        self._learn([words[i] for i in new.tolist()])
        begin, size = self.ends[place], self.ends[place + 1] - self.ends[place]
        of = coded.indices.to_numpy()
        sizes = size[of]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(begin[of] - upto[:-1], sizes) + np.arange(upto[-1])
        bounds = runs.offsets.to_numpy() - runs.offsets[0].as_py()
        return self.flat[at], upto[bounds]


_encoders: dict[str, Encoder] = {}
_idle: threading.Timer | None = None


def _release() -> None:
    _encoders.clear()
    trim()


@contextlib.contextmanager
def _encoder(path: str):
    """This worker's encoder for the time of a task."""
    global _idle
    if _idle is not None:
        _idle.cancel()
    coder = _encoders.get(path)
    if coder is None:
        coder = _encoders[path] = Encoder(path)
        trim()  # of what parsing the file took
    try:
        yield coder
    finally:
        _idle = threading.Timer(IDLE_SECONDS, _release)
        _idle.daemon = True
        _idle.start()


def _blocks(texts: pa.Array, size: int = 1 << 22):
    """(begin, end) of runs of texts with about so many bytes."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(upto):
        done = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, done + size, side="right")))
        yield begin, end
        begin = end


def _write(batches, folder: str, tokenizer: str, end_id: int):
    with _encoder(tokenizer) as coder:
        yield from _written(batches, folder, coder, end_id)


def _written(batches, folder: str, coder: Encoder, end_id: int):
    from pyarrow.fs import FileSystem

    fs, root = FileSystem.from_uri(folder)
    end = np.array([end_id], coder.type).tobytes()
    part, own, roll, out, at, before, name, made = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, None, 0, 0, "", []
    try:
        for b in batches:
            rows: list[tuple] = []
            for lo, hi in _blocks(b.column(1)):
                flat, first = coder.encode(b.column(1).slice(lo, hi - lo))
                raw, marks = flat.tobytes(), (first * coder.type.itemsize).tolist()
                for i in range(hi - lo):
                    body = raw[marks[i] : marks[i + 1]] + end
                    if out is None or at > FILE_BYTES:
                        if out is not None:
                            out.close()
                            roll += 1
                        name = f"part-{part:06d}-{roll:04d}-{own}.rec"
                        out = fs.open_output_stream(f"{root}/{name}")
                        made.append(name)
                        out.write(MAGIC + struct.pack("<I", len(end)))
                        at, before = 12, 0
                    size = struct.pack("<Q", len(body))
                    out.write(b"".join((size, struct.pack("<I", masked(zlib.crc32(size))), body, struct.pack("<I", masked(zlib.crc32(body))))))
                    n = len(body) // len(end)
                    rows.append((name, part, roll, at, len(body) + 16, before, n))
                    at += len(body) + 16
                    before += n
            if rows:
                columns = zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in columns)], ["id", "file", "part", "roll", "offset", "length", "before", "n_tokens"])
        if out is not None:
            out.close()
    except BaseException:  # a failed attempt takes its files with it
        if out is not None:
            out.close()
        for f in made:
            fs.delete_file(f"{root}/{f}")
        raise


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``docs`` in ascending id order; gives the index, itself written
    below ``folder`` as ``index``.

    Null texts are empty; null ids come first; rows of one id come by the hash
    of their text, and very many of them are dealt to several tasks. Other columns
    are ignored. An empty table makes no file and no index row.
    """
    spark = docs.sparkSession
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/files")
    files.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(files)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("id", "h", "row").sortWithinPartitions("id", "h", "row").select("id", "t")
    return cut(rows.mapInArrow(lambda it: _write(it, f"{folder}/files", tokenizer, end_id), INDEX), f"{folder}/index")


def _read(batches, folder: str):
    from pyarrow.fs import FileSystem

    fs, root = FileSystem.from_uri(folder)
    name, f, kind = None, None, ""
    for b in batches:
        got = {n: b.column(i).to_pylist() for i, n in enumerate(("id", "file", "offset", "length", "start"))}
        n, crc = [], []
        for file, offset, length in zip(got["file"], got["offset"], got["length"]):
            if file != name:
                name, f = file, fs.open_input_file(f"{root}/{file}")
                head = f.read(12)
                if head[:8] != MAGIC:
                    raise ValueError(f"{file}: not a record file")
                kind = f"<u{struct.unpack('<I', head[8:])[0]}"
            f.seek(offset)
            raw = f.read(length)
            size, mark = struct.unpack("<QI", raw[:12])
            body = raw[12:-4]
            if masked(zlib.crc32(raw[:8])) != mark or size != len(body) or masked(zlib.crc32(body)) != struct.unpack("<I", raw[-4:])[0]:
                raise ValueError(f"{file} at {offset}: checksum differs")
            ids = np.frombuffer(body, kind).astype("<u4")
            n.append(len(ids))
            crc.append(zlib.crc32(ids.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(got["id"], pa.int64()), pa.array(got["start"], pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])


def read_records(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Reads the files back by the index and checks every frame: id, start (ids
    of all documents before it), n_tokens, ids_crc32."""
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    files = index.groupBy("file", "part", "roll").agg(F.sum("n_tokens").alias("n"))
    # One row for each file of 64 MB; the order of parts is that of their ids.
    order = Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    rows = index.join(files, "file").select("id", "file", "offset", "length", (F.col("base") + F.col("before")).alias("start"))
    rows = rows.repartition("file").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(lambda it: _read(it, f"{folder}/files"), f"{id_col} long, start long, n_tokens long, ids_crc32 long")
