r"""Chat formatting by columnar byte assembly.

Template: ``[INST]text[/INST]`` for a user, ``<s>text</s>`` for an assistant,
``<<SYS>>text<</SYS>>`` for the system, ``<<ROLE>>role<<TEXT>>text<</ROLE>>``
for any other role. A control string inside a text or role gets a backslash
after its first character; one that has backslashes there already gets one
more, so taking one away again restores every text.

For a run of turns, numpy computes segment lengths, cumulative offsets and
scatter indices, and copies headers and contents into one buffer, which becomes
the Arrow column without another copy.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD = {"user": b"[INST]", "assistant": b"<s>", "system": b"<<SYS>>"}
TAIL = {"user": b"[/INST]", "assistant": b"</s>", "system": b"<</SYS>>"}
CONTROLS = [*HEAD.values(), *TAIL.values(), b"<<ROLE>>", b"<<TEXT>>", b"<</ROLE>>"]
_REST = b"|".join(re.escape(c[1:]) for c in CONTROLS)
_ESCAPE = re.compile(rb"([<\[])(\\*)(?=" + _REST + rb")")
_UNESCAPE = re.compile(rb"([<\[])\\(\\*)(?=" + _REST + rb")")
_TOKEN = re.compile(b"(" + b"|".join(re.escape(c) for c in CONTROLS) + b")")


def escape(text: bytes) -> bytes:
    return _ESCAPE.sub(rb"\1\\\2", text) if b"<" in text or b"[" in text else text


def unescape(text: bytes) -> bytes:
    return _UNESCAPE.sub(rb"\1\2", text) if b"\\" in text else text


def assemble(conv: list, roles: list[bytes], texts: list[bytes]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Turns in order, those of a conversation together: (conversations, their
    offsets in the buffer, the buffer, offsets in the list of loss spans, loss
    spans as begin and end bytes within the conversation)."""
    new = np.array([i == 0 or conv[i] != conv[i - 1] for i in range(len(conv))], bool)
    first = np.flatnonzero(new)
    pool, at = [], {}

    def piece(b: bytes) -> int:
        if b not in at:
            at[b] = len(pool)
            pool.append(b)
        return at[b]

    heads = [piece(HEAD[r.decode()] if r in (b"user", b"assistant", b"system") else b"<<ROLE>>" + escape(r) + b"<<TEXT>>") for r in roles]
    tails = [piece(TAIL[r.decode()] if r in (b"user", b"assistant", b"system") else b"<</ROLE>>") for r in roles]
    bodies = [escape(t) for t in texts]
    # Segments in the order of the output: head, body, tail of each turn.
    n = len(roles)
    pool_len = np.array([len(p) for p in pool], np.int64)
    pool_at = np.concatenate(([0], np.cumsum(pool_len)))[:-1]
    body_len = np.fromiter((len(b) for b in bodies), np.int64, n)
    source = np.frombuffer(b"".join(pool) + b"".join(bodies), np.uint8)
    body_at = pool_len.sum() + np.concatenate(([0], np.cumsum(body_len)))[:n]
    lengths = np.empty(3 * n, np.int64)
    starts = np.empty(3 * n, np.int64)
    lengths[0::3], lengths[1::3], lengths[2::3] = pool_len[heads], body_len, pool_len[tails]
    starts[0::3], starts[1::3], starts[2::3] = pool_at[heads], body_at, pool_at[tails]
    ends = np.cumsum(lengths)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    for a in range(0, 3 * n, 30_000):  # bounds the index arrays
        part = slice(a, a + 30_000)
        base = int(ends[a] - lengths[a])
        size = int(ends[part][-1]) - base
        shift = np.repeat(starts[part] - (ends[part] - lengths[part]), lengths[part])
        out[base : base + size] = source[np.arange(base, base + size) + shift]
    turn_at = ends[0::3] - lengths[0::3]
    offsets = np.append(turn_at[first], len(out))
    lossy = np.flatnonzero([r == b"assistant" for r in roles])
    of = np.cumsum(new)[lossy] - 1
    begin = ends[1::3][lossy] - body_len[lossy] - offsets[:-1][of]
    spans = np.stack((begin, begin + body_len[lossy]), 1)
    return [conv[i] for i in first], offsets, out, np.searchsorted(of, np.arange(len(first) + 1)), spans


def _batch(conv, roles, texts):
    ids, offsets, out, span_at, spans = assemble(conv, roles, texts)
    turns = np.diff(np.append(np.flatnonzero([i == 0 or conv[i] != conv[i - 1] for i in range(len(conv))]), len(conv)))
    text = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(out)]).cast(pa.binary()).cast(pa.string())
    pairs = pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], ["begin", "end"])
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(turns, pa.int64()), text, pa.ListArray.from_arrays(pa.array(span_at, pa.int32()), pairs)], ["conv_id", "n_turns", "formatted", "loss"])


def _format(batches):
    held: tuple[list, list, list] = ([], [], [])
    for b in batches:
        cols = (b.column(0).to_pylist(), [r or b"" for r in b.column(2).to_pylist()], [t or b"" for t in b.column(3).to_pylist()])
        for h, c in zip(held, cols):
            h.extend(c)
        last = len(held[0])
        while last and held[0][last - 1] == held[0][-1]:
            last -= 1
        if last:  # the last conversation can go on in the next batch
            yield _batch(*(h[:last] for h in held))
            held = tuple(h[last:] for h in held)  # type: ignore[assignment]
    if held[0]:
        yield _batch(*held)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, loss (byte spans of
    assistant texts in ``formatted``).

    Turns go by turn number, null first, ties by role and text. Null roles and
    texts count as empty; rows of a null conversation form one of their own.
    Repeated rows are turns as well. Other columns are ignored.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("n"), F.col(role_col).cast("binary").alias("r"), F.col(text_col).cast("binary").alias("t"))
    rows = rows.repartition("c").sortWithinPartitions("c", "n", "r", "t")
    return rows.mapInArrow(_format, f"{conv_col} long, n_turns long, formatted string, loss array<struct<begin:long,end:long>>")


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn."""
    role_of = {v: k.encode() for k, v in HEAD.items()}
    parts, at, out = _TOKEN.split(formatted), 1, []
    while at < len(parts):
        if parts[at] == b"<<ROLE>>":
            out.append((unescape(parts[at + 1]), unescape(parts[at + 3])))
            at += 6
        else:
            out.append((role_of[parts[at]], unescape(parts[at + 1])))
            at += 4
    return out


def _digest(batches):
    for b in batches:
        cols: list[list] = [[], [], [], [], []]
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            raw = text.encode()
            turns = parse(raw)
            loss = [unescape(raw[s["begin"] : s["end"]]) for s in spans]
            row = (len(turns), hashlib.sha256(b"".join(r + b"\n" + t + b"\n" for r, t in turns)).hexdigest(), sum(len(x.decode()) for x in loss), hashlib.sha256(b"".join(loss)).hexdigest(), len(text))
            for c, v in zip(cols, row):
                c.append(v)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Turns and loss-masked text read back from the formatted text alone."""
    schema = f"{conv_col} long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select(conv_col, "formatted", "loss").mapInArrow(_digest, schema)
