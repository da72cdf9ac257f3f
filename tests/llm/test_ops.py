"""Every operator against a plain version of itself, on documents with nulls,
empty and long texts, copies, ties and columns of clashing names."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.llm import brown, chat, decontam, mixing, neardup, pii, quality, queries, records, suffix, telephony, textvec
from strandwise.llm.common import shared_dir

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").toPandas()
    rng = np.random.default_rng(3)
    passage = " ".join(f"word{i}" for i in rng.integers(0, 900, 70))
    rows = [(int(a), b, c) for a, b, c in d.itertuples(index=False)]
    rows += [
        (9001, None, "srcX"), (9002, "", None), (9003, " \t\n", "srcX"), (9004, "one two", "srcX"), (9005, "one two", None),
        (9006, "x" * 3000, "srcX"), (9007, "The " * 400, "srcX"), (9008, rows[5][1] + " " + passage, "srcX"), (9009, "Start " + passage + " é end", "srcX"),
        (9010, passage, "srcX"), (9010, passage, "srcX"), (9011, ("ab c" * 300)[:700], "srcX"),
        (9012, "mail a.b@c.de, A@b.c..d@e.f 1.2.3.4.5 999.1.1.1 010.0.0.255 card 4111 1111 1111 1111 4111-1111-1111-1112 12  34 +1 (415) 555-2671. +12 3", "srcX"),
        (9013, "a@b.c_d@e.f " + "1" * 5000 + " " + "5 " * 9000 + "z" * 20000 + " q@w" + ".e" * 3000 + " @ +9999999999999999 é x@é.y u@v.wé", "srcX"),
        (9014, "tab\tword\x0bvt\x0cff\rcr <|endoftext|> it's DON'T 12,5  nbsp 　 ideo é ́comb", "srcX"),
        (9015, " ".join(f"w{i}" for i in range(60_000)), "srcY"), (None, "no id here at all " * 3, "srcX"),
    ]
    return rows


@pytest.fixture(scope="module")
def frame(spark, docs):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    # Columns whose names the operators use themselves.
    for name in ("id", "t", "n", "h", "size", "taken", "a", "b", "label", "kept", "score", "spans", "item", "rep", "doc", "text_", "start"):
        d = d.withColumn(name, F.lit("x"))
    return d.repartition(5)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def brute_removed(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + 200] for r in raw for i in range(len(r) - 199))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(r, gone) if not g)
        out.append((len(r), len(r) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in [0, 1, 2, 3, 4, 5, 7, 10, 33, 100, 301, 500]:
        for k in (1, 2, 4, 200):
            t = rng.integers(1, k + 1, n)
            assert suffix.suffix_array(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def test_op1(frame, docs):
    got = rows(suffix.repeated_spans(frame), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(((d[0], *b) for d, b in zip(docs, brute_removed([d[1] for d in docs]))), key=repr)


def test_op1_many_kinds(spark, monkeypatch):
    rng = np.random.default_rng(2)
    word = lambda n: "".join(chr(97 + i) for i in rng.integers(0, 26, n))
    core = word(420)
    texts = [(i, word(200) + core[: rng.integers(150, 421)] + word(200) + core[rng.integers(0, 230) :] + word(90), None) for i in range(80)]
    monkeypatch.setattr(suffix, "LARGE", 3)
    d = spark.createDataFrame(texts, "doc_id long, text string, source string")
    assert rows(suffix.repeated_spans(d), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(((t[0], *b) for t, b in zip(texts, brute_removed([t[1] for t in texts]))), key=repr)


def test_suffix_array_many_names():
    names = np.random.default_rng(4).permutation((1 << 20) + 50) + 1
    assert (suffix.suffix_array(names) == np.argsort(names)).all()


def test_op1_class_beyond_one_sort(spark):
    """25,000 texts around one gram of a small hash: most unlike each other, some alike in pairs, some in all but their ends."""
    rng = np.random.default_rng(5)
    letters = rng.integers(97, 123, 400_000).astype(np.uint8)
    first, count, least, _ = suffix.segments(letters, np.array([0, len(letters)]))
    best = int(np.argmin(least))
    gram = int(first[best]) + suffix._minimizer(letters[first[best] : first[best] + count[best] + 199])
    gram = letters[gram : gram + 32].tobytes()
    own = rng.integers(97, 123, (25_000, 220)).astype(np.uint8)
    texts = [o[:110].tobytes() + gram + o[110:].tobytes() for o in own]
    for i in range(0, 3000, 2):
        texts[i + 1] = texts[i + 1][:20] + texts[i][20:225] + texts[i + 1][225:]
    for i in range(3000, 9000):
        texts[i] = texts[i][:15] + texts[3000][15:225] + texts[i][225:]
    seen = Counter(hash(t[i : i + 200]) for t in texts for i in range(len(t) - 199))
    want = []
    for n, t in enumerate(texts):
        gone = {j for i in range(len(t) - 199) if seen[hash(t[i : i + 200])] > 1 for j in range(i, i + 200)}
        kept = bytes(c for j, c in enumerate(t) if j not in gone)
        want.append((n, len(t), len(gone), sum(j - 1 not in gone for j in gone), hashlib.sha256(kept).hexdigest()))
    d = spark.createDataFrame([(n, t.decode()) for n, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert rows(suffix.repeated_spans(d), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)


def test_op1_large_class(spark, monkeypatch):
    rng = np.random.default_rng(1)
    core = "".join(chr(97 + i) for i in rng.integers(0, 26, 260))
    texts = ["".join(chr(97 + i) for i in rng.integers(0, 26, 150)) + core[rng.integers(0, 60) :] + "".join(chr(97 + i) for i in rng.integers(0, 26, 150)) for _ in range(120)]
    real = suffix.SORT_BYTES
    try:
        suffix.SORT_BYTES = 9000
        found = []
        segs = []
        for i, t in enumerate(texts):
            raw = np.frombuffer(t.encode(), np.uint8)
            for lo, n, c, w in zip(*suffix.segments(raw, np.array([0, len(raw)]))):
                segs.append((int(c), i, int(lo), False, t.encode()[lo : lo + n + 199]))
        import pyarrow as pa

        segs.sort()
        kinds = (pa.uint64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*segs), kinds)], ["class", "text", "lo", "multi", "seg"])
        for b in suffix._sort_classes([batch]):
            found += zip(*(c.to_pylist() for c in b.columns))
    finally:
        suffix.SORT_BYTES = real
    gone = [bytearray(len(t)) for t in texts]
    for t, x, y in found:
        gone[t][x:y] = b"\1" * (y - x)
    assert [sum(g) for g in gone] == [b[1] for b in brute_removed(texts)]


def test_op2(frame, docs):
    got = {r["doc_id"]: r for r in telephony.load_media(telephony.store_texts(frame), with_pcm=True).collect()}
    assert len(got) == len({d[0] for d in docs})
    for i, t, _ in docs:
        raw = (t or "").encode()
        p = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert len(r["pcm"]) % 4 == 0


def test_codecs():
    assert telephony.mulaw_table()[[0x00, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.alaw_table()[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    data = np.random.default_rng(0).integers(0, 256, telephony.BLOCK * 50, dtype=np.uint8)
    for block, got in zip(data.reshape(-1, telephony.BLOCK).tolist(), telephony.decode_adpcm(data).reshape(50, -1).tolist()):
        v, i, want = int.from_bytes(bytes(block[:2]), "little", signed=True), min(block[2], 88), []
        want.append(v)
        for byte in block[4:]:
            for n in (byte & 15, byte >> 4):
                s = int(telephony.STEPS[i])
                d = (s >> 3) + (n & 4 and s) + (n & 2 and s >> 1) + (n & 1 and s >> 2)
                v = max(-32768, min(32767, v - d if n & 8 else v + d))
                i = max(0, min(88, i + int(telephony.MOVES[n & 7])))
                want.append(v)
        assert got == want


def test_op3(frame, docs):
    plan, pieces, slots = mixing.mix(frame)
    got = [r.asDict() for r in plan.collect()]
    size = Counter()
    for _, t, s in docs:
        size[s] += len(WORD.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, stopped, total = {}, set(), sum(size.values())
    while True:
        left = total - sum(3 * size[s] for s in stopped)
        w = sum(weight[s] for s in names if s not in stopped)
        target = {s: 3.0 * size[s] if s in stopped else left * weight[s] / w for s in names}
        over = {s for s in names if target[s] > 3 * size[s] + 1e-6} - stopped
        if not over:
            break
        stopped |= over
    taken = Counter()
    assert len(got) == len(docs)
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * total
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"] if r["doc_id"] != 9010 else r["taken"] / 2
    for s in names:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 3, (s, taken[s], target[s])
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(frame)[0].collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}


def test_op4(spark):
    turns = [
        (1, 0, "user", "hi <s> [INST] \\"), (1, 1, "assistant", "<\\s>[\\\\INST]<<SYS>> é"), (1, 2, "tool<<TEXT>>", None), (1, 2, None, "x</s>"), (2, None, "assistant", ""), (2, 0, "system", "<<SYS>>"),
        (None, 1, "assistant", "n"), (3, 5, "assistant", "b"), (3, 5, "assistant", "a"), (3, 5, "assistant", "a"),
    ] + [(4, i, ("user", "assistant")[i % 2], "y" * (i % 50)) for i in range(3000)]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).repartition(4)
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(d)).collect()}
    by = {}
    for c, n, r, t in sorted(turns, key=lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, (x[2] or "").encode(), x[3] is not None, (x[3] or "").encode())):
        by.setdefault(c, []).append(((r or ""), (t or "")))
    assert set(got) == set(by)
    for c, own in by.items():
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[c]["n_turns"] == len(own) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_op4_escape():
    for t in (b"<s>", b"<\\s>", b"[[INST]", b"<<<SYS>>", b"<</SYS>", b"\\<\\\\/s>", b"[/INST][\\/INST]"):
        assert chat.unescape(chat.escape(t)) == t and not chat._TOKEN.search(chat.escape(t))


def shingles(t):
    w = WORD.findall(lower(t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(docs):
    sets = [(d[0], shingles(d[1])) for d in docs]
    of = {i: i for i, _ in sets}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 85 * len(a | b):
                ri, rj = root(i), root(j)
                of[max(ri, rj)] = min(ri, rj)
    return sorted(((i, len(s), root(i), i is not None and root(i) == i) for i, s in sets), key=repr)


def test_op5(frame, docs):
    assert rows(neardup.near_duplicates(frame), "doc_id", "n_shingles", "component_id", "kept") == brute_components(docs)


def test_op5_cross_component_links(spark):
    rng = np.random.default_rng(5)
    base = [f"t{i}" for i in range(400)]
    texts = []
    for i in range(60):  # a drifting chain: neighbours are close, far ones are not
        base = list(base)
        for p in rng.integers(0, 400, 4):
            base[p] = f"u{i}_{p}"
        texts.append((i, " ".join(base), None))
    d = spark.createDataFrame(texts, "doc_id long, text string, source string")
    assert rows(neardup.near_duplicates(d), "doc_id", "n_shingles", "component_id", "kept") == brute_components(texts)


def test_op5_hot_group(spark):
    rng = np.random.default_rng(8)
    base = [f"t{i}" for i in range(150)]
    texts = []
    for i in range(250):  # copies at many distances of one text: some link with it, some with each other alone
        t = list(base)
        for p in rng.integers(0, 150, rng.integers(0, 9)):
            t[p] = f"e{p}_{rng.integers(0, 2)}"
        texts.append((i, " ".join(t[rng.integers(0, 2) * 12 :]), None))
    d = spark.createDataFrame(texts, "doc_id long, text string, source string")
    want = brute_components(texts)
    assert len({w[2] for w in want}) > 3
    assert rows(neardup.near_duplicates(d), "doc_id", "n_shingles", "component_id", "kept") == want


def test_op6(spark, frame, docs):
    folder = shared_dir(spark)
    records.write_records(frame, folder, queries.vocabulary(), 2)
    got = rows(records.read_records(spark, folder), "doc_id", "start", "n_tokens", "ids_crc32")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.vocabulary())
    want, start = [], 0
    for i, t, _ in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want, key=repr)


def test_op6_damage(spark, tmp_path):
    d = spark.createDataFrame([(1, "hello there")], "doc_id long, text string")
    folder = f"file://{tmp_path}"
    records.write_records(d, folder, queries.vocabulary(), 2)
    f = next((tmp_path / "files").glob("*.rec"))
    raw = bytearray(f.read_bytes())
    raw[-5] ^= 1
    f.write_bytes(raw)
    with pytest.raises(Exception, match="checksum"):
        records.read_records(spark, folder).collect()


def test_op6_workers_let_go(spark, docs):
    """Workers that wrote records give up the tokenizer and the known words soon after, not at their end."""
    from pyarrow import RecordBatch, array

    d = spark.createDataFrame([(r[0], r[1]) for r in docs], "doc_id long, text string").repartition(8)
    assert records.write_records(d, shared_dir(spark), queries.vocabulary(), 2).count() == len(docs)
    held = lambda it: (RecordBatch.from_arrays([array([len(records._encoders)] * b.num_rows)], ["n"]) for b in it)
    time.sleep(4)
    assert {r["n"] for r in spark.range(0, 64, 1, 8).mapInArrow(held, "n long").collect()} == {0}


def test_op6_words_that_recur_stay(docs):
    from pyarrow import array

    coder = records.Encoder(queries.vocabulary())
    texts = [r[1] for r in docs if isinstance(r[1], str)]

    def right(some):
        ids, ends = coder.encode(array(some))
        plain = [e.ids for e in coder.lib.encode_batch(some, add_special_tokens=False)]
        return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == plain

    assert right(texts[:100]) and right(texts[:30])
    known = len(coder.memo)
    coder._keep_met()
    assert 1 < len(coder.memo) < known
    assert right(texts[:30]) and right(texts)


def test_op7(frame, docs):
    train = [d for d in docs if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 10]
    count = Counter(w for d in train for w in [*WORD.findall(lower(d[1] or "")), None])
    n, v = sum(count.values()), len(count)
    got = [r.asDict() for r in brown.score_texts(frame).collect()]
    assert len(got) == len(docs)
    by = {d[0]: d for d in docs}
    gain = 0.0
    for r in got:
        i, t, _ = by[r["doc_id"]]
        tokens = [*WORD.findall(lower(t or "")), None]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(count[w] > 0 for w in tokens), n)
        assert r["held_out"] == (i is None or zlib.crc32(str(i).encode()) % 10 == 0)
        assert abs(r["base_score"] - base) < 1e-6 * (1 + abs(base))
        if r["held_out"] and i is not None and i < 9000:
            gain += r["score"] - r["base_score"]
    assert gain > 0


def test_op7_rare_words_are_joined(frame, monkeypatch):
    whole = rows(brown.score_texts(frame.filter("doc_id < 50")), "doc_id", "n_known", "n_tokens")
    monkeypatch.setattr(brown, "FREQUENT", 200)
    assert rows(brown.score_texts(frame.filter("doc_id < 50")), "doc_id", "n_known", "n_tokens") == whole


def test_exchange_finds_classes():
    rng = np.random.default_rng(0)
    kind = rng.integers(0, 2, 60)
    table = np.zeros((61, 61), np.int64)
    for _ in range(20000):
        a = rng.integers(0, 60)
        b = rng.choice(np.flatnonzero(kind != kind[a]))
        table[a + 1, b + 1] += 1
    of = brown.exchange(table, classes=3)[1:]
    assert len({tuple(sorted(set(of[kind == k]))) for k in (0, 1)}) == 2 and not set(of[kind == 0]) & set(of[kind == 1])


def test_op8(spark):
    big = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    d = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text")
    held = F.xxhash64(F.lit(5), "doc_id") % 5 == 0
    rated = quality.rate(d, labels.filter(~held)).join(labels.filter(held), "doc_id").select("kept", "quality", "toxic", "expected_grade").toPandas()
    clean = (rated.quality == 1) & (rated.toxic == 0)
    assert rated.kept[clean].mean() > 0.97
    assert rated.kept[rated.quality == 0].mean() < 0.05
    # At this size many of the words that mark toxic texts are in a few labelled ones only.
    assert rated.kept[(rated.toxic == 1) & (rated.quality == 1)].mean() < 0.6
    assert rated.expected_grade[clean].mean() > rated.expected_grade[rated.quality == 0].mean() + 1


def test_op8_edges(spark, frame, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.rate(frame, none)
    assert {c for c in frame.columns} <= set(got.columns)
    assert got.count() == len(docs) and got.filter("expected_grade = 0.5").count() == len(docs)


def test_op9(spark, frame, docs):
    items = [(1, docs[7][1]), (2, None), (3, ""), (4, "one two"), (5, " ".join(f"word{i}" for i in range(9))), (6, " ".join(docs[3][1].split()[:14]) + " zz zz"), (6, "repeated id")]
    got = rows(decontam.contained_items(frame, spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1))), "doc_id", "item_id", "n_item", "n_shared")
    item, doc = {}, {}
    for i, t in items:
        item.setdefault(i, set()).update(shingles(t))
    for i, t, _ in docs:
        if i is not None:
            doc.setdefault(i, set()).update(shingles(t))
    want = [(d, i, len(b), len(a & b)) for d, a in doc.items() for i, b in item.items() if b and 100 * len(a & b) >= 80 * len(b)]
    assert got == sorted(want, key=repr)
    assert decontam.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string")).count() == len(docs) - sum(d[0] in {w[0] for w in want} for d in docs)


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(t):
    def ok(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(p) <= 255 for p in v.split("."))
        if kind == "card":
            return 14 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else int(c) * 2 // 10 + int(c) * 2 % 10 for k, c in enumerate(reversed(d))) % 10 == 0
        return 10 <= len(d) <= 15 if kind == "phone" else True

    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, t or "") if ok(kind, m[0])]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def test_op10(spark, frame, docs):
    more = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").toPandas()
    every = [(int(i) + 20_000, t) for i, t in more.itertuples(index=False)]
    d = frame.select("doc_id", "text").unionByName(spark.createDataFrame(every, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in pii.digest(pii.personal_data(d)).collect()}
    for i, t in [*((x[0], x[1]) for x in docs), *every]:
        want = brute_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (i, want, got[i]["spans"])
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))
        assert [got[i][f"n_{k}"] for k in PLAIN] == [len(re.findall(rf"\b{k}:", want)) for k in PLAIN]


def test_op10_terms(spark):
    text = [(i, f"hello there some{i} words secretcode bob{i % 2}@x.yz follow here then more{i}") for i in range(12)] + [(100 + i, f"plain text number {i} hello there follow here then words") for i in range(60)]
    d = spark.createDataFrame(text, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.personal_data(d)).collect()}
    assert all("term:" in got[i] for i in range(12)) and not any(got[100 + i] for i in range(60))
    clean = {r["doc_id"]: r["sanitised"] for r in pii.sanitised(d).collect()}
    assert clean[0] == "hello there some0 words [TERM] [EMAIL] follow here then more0" and clean[100] == text[12][1]


def test_op10_terms_anywhere(spark):
    filler = " ".join(f"filler{i}" for i in range(30))
    text: list = [(i, f"zq {filler} farcode {filler} bob{i}@x.yz, {filler} Zq some{i}") for i in range(20)] + [(2000 + i, f"plain {filler} number{i}") for i in range(400)]
    text += [(500, f"only farcode {filler} zq"), (501, f"farcode zq +1 (415) 555-2671 {filler} FARCODE"), (None, "farcode"), (502, "a farcode"), (502, "two farcode")]
    # 120 documents with the entity, so that a term in 5 others still passes.
    text += [(1000 + i, f"zq farcode {filler} eve{i}@x.yz") for i in range(100)]
    d = spark.createDataFrame(text, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["spans"]) for r in pii.digest(pii.personal_data(d)).collect()), key=repr)

    def want(t):
        found = [(int(s.split(":")[1]), s) for s in brute_spans(t).split(",") if s]
        return ",".join(s for _, s in sorted(found + [(m.start(), f"term:{m.start()}:{m.end()}") for m in WORD.finditer(t) if lower(m[0]) in ("zq", "farcode")]))

    assert got == sorted(((i, want(t)) for i, t in text), key=repr)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    folder = shared_dir(spark)
    records.write_records(none, folder, queries.vocabulary(), 2)
    for df in (
        suffix.repeated_spans(none), telephony.load_media(telephony.store_texts(none)), mixing.mix(none)[0], chat.digests(chat.format_chats(turns)), neardup.near_duplicates(none), records.read_records(spark, folder),
        brown.score_texts(none), quality.rate(none, labels), decontam.contained_items(none, items), pii.digest(pii.personal_data(none)),
    ):
        assert df.count() == 0


def test_word_hashes_follow_words():
    texts = [b"One two  THREE\n\x0bfour", None, b"", b"one TWO three four", b"\xc3\x89 x"]
    h, at = textvec.word_hashes(texts)
    assert np.diff(at).tolist() == [4, 0, 0, 4, 2] and h[:4].tolist() == h[4:8].tolist()
    long = b" ".join(b"w%d" % i for i in range(400_000))
    h, at = textvec.word_hashes([long])
    assert at.tolist() == [0, 400_000] and len(set(h.tolist())) == 400_000


def test_op3_points(spark):
    ids = [0, 1, 2, 12345, 1 << 40, (1 << 41) - 1]
    got = spark.createDataFrame([(i,) for i in ids], "id long").select("id", mixing.points(F.col("id")).alias("x")).collect()
    assert all(r["x"] == (r["id"] * mixing.PHI + mixing.PHI // 2) % mixing.ONE for r in got)


def test_op3_repeated_rows_and_blocks(spark):
    """Rows that repeat share nothing but their id; a tiny source gets its target whatever the block."""
    rows = [(1, "a", "s0"), (1, "a", "s0"), (1, "b c", "s0"), (2, "x " * 30, "s1"), (3, "y " * 4000, "s2"), (4, "z " * 900, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plans = {}
    for block in (1, 128):
        plan, pieces, slots = (x.collect() for x in mixing.mix(d, block=block))
        assert sorted((r["doc_id"], r["size"]) for r in plan) == sorted((i, len(t.split())) for i, t, _ in rows)
        taken = Counter()
        for r in plan:
            assert r["taken"] <= 3 * r["size"]
            taken[r["source"]] += r["taken"]
        for r in plan:
            assert abs(taken[r["source"]] - r["target"]) <= 0.5
        assert taken["s0"] == 12 and taken["s1"] == 90  # both stopped at three times their words
        plans[block] = sorted((r["doc_id"], r["size"], r["taken"]) for r in plan)
        assert len({r["slot"] for r in slots}) == len(slots) and sum(r["n_words"] for r in pieces) == sum(taken.values())
        of = {(r["number"], r["block"]) for r in slots}
        assert len(of) == len(slots) and all(sum(n == m for n, _ in of) == 1 + max(b for n, b in of if n == m) for m in {n for n, _ in of})
        order = sorted(slots, key=lambda r: r["slot"])
        shares = {r["number"]: 0 for r in slots}
        for k, r in enumerate(order[:200], 1):  # the replayed schedule follows the targets
            shares[r["number"]] += 1
            if block == 1:
                total = sum(taken.values())
                names = {1: "s0", 2: "s1", 3: "s2", 4: None}
                assert all(abs(n - k * taken[names[m]] / total) < 4 for m, n in shares.items())
    assert plans[1] == plans[128]


def test_op5_repeated_ids(spark):
    w = [f"w{i}" for i in range(40)]
    rows = [(5, " ".join(w)), (5, "other words than those before in this row"), (7, " ".join(w[:-1] + ["end"])), (8, "other words than those before in this row"), (None, " ".join(w)), (None, "alone with no id at all here")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(d).collect()), key=repr)
    assert got == sorted([(5, 5, True), (5, 5, True), (7, 5, False), (8, 5, False), (None, 5, False), (None, None, False)], key=repr)
    left = sorted(((r["doc_id"], r["text"]) for r in neardup.representatives(d).collect()), key=repr)
    assert left == sorted([rows[0], rows[1], rows[5]], key=repr)


def test_op6_other_tokenizers(spark, tmp_path):
    """A byte-level tokenizer keeps spaces in its pieces, so whole texts are encoded."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    assert not records.separable(lib) and records.separable(Tokenizer.from_file(queries.vocabulary()))
    texts = [(1, "Hello  there\n\n 12"), (2, None), (3, " é ́x")]
    folder = shared_dir(spark)
    records.write_records(spark.createDataFrame(texts, "doc_id long, text string"), folder, path, 2)
    want, start = [], 0
    for i, t in texts:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows(records.read_records(spark, folder), "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_op6_runs_that_look_alike():
    """Letters and forms for which setting signs apart or lowering could change ids."""
    import pyarrow as pa

    texts = ["<|ENDOFTEXT|> a,b", "H\u0331 X", "x<|endoftext|>, K.", "I\u0307s, A.b,C \u0130,x \u2126\u03a3. \u03a3", "\u0958, \u0930\u093c. d'S, 's,'t", "", None, "A,,b..C!?d'll, it's. %5,a"]
    for block in ([t] for t in texts):
        coder = records.Encoder(queries.vocabulary())
        ids, at = coder.encode(pa.array(block, pa.string()))
        assert ids.tolist() == coder.lib.encode(block[0] or "", add_special_tokens=False).ids and at.tolist() == [0, len(ids)]


def test_op8_conflicting_and_null_labels(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, None), (3, None, None), (4, None, 1), (None, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    graded = {r["doc_id"]: r["grade"] for r in quality.grades(labels).filter("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.min("grade").alias("grade")).collect()}
    assert graded == {1: 0, 2: 2, 4: 1, 5: 1}
    d = spark.createDataFrame([(i, f"word{i} text", "x") for i in range(6)] + [(None, None, "x")], "doc_id long, text string, score string")
    first, again = (quality.rate(d.repartition(n), labels.repartition(n)) for n in (1, 4))
    assert rows(first, "doc_id", "score") == rows(again, "doc_id", "score") and first.count() == 7


def test_op8_is_a_cumulative_link_model():
    """fit reaches the likelihood of a plain search over two weights and two thresholds."""
    rng = np.random.default_rng(3)
    x = rng.random((400, 2)) < 0.5
    s = 2.0 * x[:, 0] - 1.5 * x[:, 1] + rng.logistic(size=400)
    grades = (s > -0.5).astype(int) + (s > 1.0)
    feats = [np.flatnonzero(np.append(r, True)).astype(np.int32) for r in x]
    w, t = quality.fit(feats, grades, steps=1500, ridge=0.0, sure=0.0)

    def loss(a, b, t1, t2):
        z = a * x[:, 0] + b * x[:, 1]
        p1, p2 = 1 / (1 + np.exp(t1 - z)), 1 / (1 + np.exp(t2 - z))
        return -np.log(np.choose(grades, (1 - p1, p1 - p2, p2)).clip(1e-12)).mean()

    own = loss(w[0], w[1], t[0] - w[2], t[1] - w[2])
    plain = min(loss(a, b, t1, t1 + g) for a in np.arange(1, 3.1, 0.25) for b in np.arange(-2.5, 0, 0.25) for t1 in np.arange(-1.5, 1, 0.25) for g in np.arange(0.75, 2.6, 0.25))
    assert t[0] < t[1] and own < plain + 0.01


def test_op7_words_beyond_the_seeds_get_classes(spark, monkeypatch):
    """With few seeds the words of two alternating kinds still fall apart, and the model gains by it."""
    rng = np.random.default_rng(9)
    kinds = [[f"a{i}x" for i in range(60)], [f"b{i}x" for i in range(60)]]
    texts = [(i, " ".join(kinds[k % 2][rng.integers(0, 60)] for k in range(60))) for i in range(400)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    monkeypatch.setattr(brown, "SEEDS", 20)
    score = {}
    for n in (0, 2):
        monkeypatch.setattr(brown, "PASSES", n)
        score[n] = brown.score_texts(d).filter("held_out").agg(F.sum("score")).first()[0]
    base = brown.score_texts(d).filter("held_out").agg(F.sum("base_score")).first()[0]
    assert score[2] > score[0] and score[2] > base
