"""Repeated passages: every byte covered by a string of min_bytes that also starts in a document with a smaller id.

The text is indexed in parts that can be told apart beforehand. Each window of min_bytes has an anchor, its gram of least
hash, so equal windows have equal anchors; only windows whose anchor occurs in two documents can repeat. The stretches
of text that such an anchor governs are dealt out by the anchor, equal ones once. Each part then gets a Burrows-Wheeler
transform, and threshold-bounded interval expansion: from the empty string, breadth-first backward extension finds the
ends of all intervals by increasing length of common prefix and stops at min_bytes. Rows that no end parts share a
string of min_bytes, and the smallest document id among them decides what is removed.

An anchor that more than HOT occurrences hold (a common phrase) could fill a part by itself, so its windows are dealt
out one by one, by a hash of the whole window; equal windows meet all the same, and need no transform.

Documents are held in shards (a bucketed table in the shared folder), so their text is shuffled once; anchors,
stretches and decisions travel between shards and parts in packed form. All counts of shards and parts follow the input.
"""

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaquad.llm.common import settle, shared_dir, utf8

MIN_BYTES = 50
GRAM = 24
SHARD_BYTES = 4_000_000
SHARDS_PER_PART = 4
BLOCK_BYTES = 2_000_000  # of stretches in one transform; the stretches of one anchor always stay together
HOT = 20_000  # occurrences beyond which an anchor's windows are dealt out one by one
PIECE = 1 << 20  # window starts that are hashed at a time
END = 255  # no byte of UTF-8 text; stands after each stretch


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places ordered by the depth bytes from them on (zeros after the end), by doubling; ties stay in any order."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.lib.stride_tricks.as_strided(padded[:8].view(">u8"), shape=(n,), strides=(1,)).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    h = 8
    while h < depth:
        # rank: first row of each group of equal keys; only groups of two or more are sorted on.
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, n))
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(first, size)
        rows = np.flatnonzero(np.repeat(size > 1, size))
        if not len(rows):
            break
        places = order[rows]
        after = places + h
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[places] << 32 | second
        within = np.argsort(key, kind="stable")
        order[rows] = places[within]
        s = key[within]
        new[rows] = np.concatenate([[True], s[1:] != s[:-1]])
        h *= 2
    return order


def interval_ends(text: np.ndarray, order: np.ndarray, min_bytes: int) -> np.ndarray:
    """For each row of order, whether it shares less than min_bytes with the row before: breadth-first over intervals."""
    n = len(text)
    bwt = text[order - 1]
    by_byte = np.argsort(bwt, kind="stable")  # radix
    step = np.empty(n, np.int32)  # last-to-first mapping
    step[by_byte] = np.arange(n, dtype=np.int32)
    same = bwt[by_byte[1:]] == bwt[by_byte[:-1]]
    after, before = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    after[by_byte[:-1][same]] = by_byte[1:][same]
    before[by_byte[1:][same]] = by_byte[:-1][same]
    limit = n - int((bwt == END).sum())  # strings with END in them are not extended
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    low, high = np.array([0], np.int32), np.array([n - 1], np.int32)
    for _ in range(min_bytes):
        size = high - low + 1
        one = size == 1
        rights, lefts = [step[low[one]]], [step[low[one]]]
        low, high, size = low[~one], high[~one], size[~one]
        if len(low):
            ends = np.cumsum(size)
            rows = np.arange(ends[-1], dtype=np.int32) + np.repeat((low - (ends - size)).astype(np.int32), size)
            rights.append(step[rows[after[rows] > np.repeat(high, size)]])
            lefts.append(step[rows[before[rows] < np.repeat(low, size)]])
        right, left = np.sort(np.concatenate(rights)), np.sort(np.concatenate(lefts))  # disjoint, so they pair up in order
        new = ~known[right + 1] & (right < limit)
        known[right + 1] |= right < limit
        low, high = left[new], right[new]
        if not len(low):
            break
    # Rows of one byte before END's rows end where END's begin.
    known[limit] = True
    return known[:n]


def anchors_of(text: bytes, ends: np.ndarray, min_bytes: int) -> tuple:
    """Of the documents that make up text (ends ascending): anchor hash, first and last window start, document."""
    width = min_bytes - GRAM + 1
    starts = np.concatenate([[0], ends[:-1]])
    out = []
    for lo in range(0, len(text), PIECE):
        hi = min(lo + PIECE, len(text))
        m = hi - lo + width - 1  # grams that windows from [lo, hi) hold
        raw = np.frombuffer(text[lo : lo + m + GRAM + 8].ljust(m + GRAM + 8, b"\0"), np.uint8)
        w = np.lib.stride_tricks.as_strided(raw[:8].view(np.uint64), shape=(m + GRAM,), strides=(1,)).copy()
        h = w[:m] * np.uint64(0x9E3779B97F4A7C15)
        for at, factor in ((8, 0xD6E8FEB86659FD93), (16, 0x9FB21C651E98DF25)):
            h ^= h >> np.uint64(29)
            h += w[at : at + m]
            h *= np.uint64(factor)
        h ^= h >> np.uint64(32)
        least = h >> np.uint64(24) << np.uint64(24) | np.arange(m, dtype=np.uint64)
        reach = 1
        while reach * 2 <= width:
            least, reach = np.minimum(least[:-reach], least[reach:]), reach * 2
        if reach < width:
            least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
        place = (least[: hi - lo] & np.uint64((1 << 24) - 1)).astype(np.int64)
        a, b = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi, "left")
        valid = np.zeros(hi - lo, bool)
        doc = np.zeros(hi - lo, np.int32)
        for d in range(a, b):
            x, y = max(starts[d], lo) - lo, min(ends[d] - min_bytes + 1, hi) - lo
            if y > x:
                valid[x:y] = True
                doc[x:y] = d
        rows = np.flatnonzero(valid)
        if len(rows):
            p, own = place[rows], doc[rows]
            new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (own[1:] != own[:-1])]))
            last = np.append(new[1:], len(rows)) - 1
            out.append((h[p[new]] >> np.uint64(16), rows[new] + lo, rows[last] + lo, own[new]))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays with their kinds, one after the other, compressed; ascending 64-bit ones as differences by byte planes."""
    out = []
    for x in arrays:
        if x.dtype == np.uint64:
            x = np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.copy()
            out.append(b"p" + x.size.to_bytes(8, "little") + x.tobytes())
        else:
            out.append(x.dtype.char.encode() + x.nbytes.to_bytes(8, "little") + x.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpacked(blob: bytes) -> list:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        kind, size = raw[at : at + 1], int.from_bytes(raw[at + 1 : at + 9], "little")
        data = raw[at + 9 : at + 9 + size]
        if kind == b"p":
            out.append(np.cumsum(np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64))
        else:
            out.append(np.frombuffer(data, np.dtype(kind.decode())))
        at += 9 + size
    return out


class Shard:
    """The documents of a shard in order of id, each once; those that are copies of a smaller id have no anchors."""

    def __init__(self, docs: pa.Table, notes: pa.Table, min_bytes: int):
        texts: dict = {}
        for i, text in zip(docs["id"].to_pylist(), docs["text"].to_pylist(), strict=True):
            texts[i] = min(text, texts.get(i, text))
        self.copies = {x for x in notes["copy"].to_pylist() if x is not None}
        self.ids, self.texts = sorted(texts), texts
        self.own = [i for i in self.ids if i not in self.copies]
        self.text = b"".join(texts[i] for i in self.own)
        self.ends = np.cumsum([len(texts[i]) for i in self.own], dtype=np.int64)
        self.notes = [unpacked(x) for x in notes["blob"].to_pylist() if x is not None]
        self.min_bytes = min_bytes

    def anchors(self) -> tuple:
        return anchors_of(self.text, self.ends, self.min_bytes)

    def stretch(self, first: int, last: int) -> bytes:
        return self.text[first : last + self.min_bytes]


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)  # of 48 bits, in order


def _split(h: np.ndarray, parts: int):
    """(part, slice) of hashes that ascend."""
    part = _part_of(h, parts)
    cut = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(h)]])
    return [(int(part[a]), slice(a, b)) for a, b in zip(cut[:-1], cut[1:], strict=True)] if len(h) else []


def _rows(columns: dict) -> pa.Table:
    kinds = {"blob": pa.binary(), "id": pa.int64(), "copy": pa.int64(), "n_bytes": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
    return pa.table({k: pa.array(v, kinds.get(k, pa.int32())) for k, v in columns.items()})


def _send_anchors(parts: int, min_bytes: int):
    """Each shard's distinct anchors by part, and how often each occurs; the last bit says that two of its documents hold one."""

    def run(key, docs, notes):
        shard = Shard(docs, notes, min_bytes)
        h, _, _, doc = shard.anchors()
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
        several = np.minimum.reduceat(doc, new) != np.maximum.reduceat(doc, new) if len(h) else np.empty(0, bool)
        value, count = h[new] << np.uint64(1) | several.astype(np.uint64), np.diff(new, append=len(h)).astype(np.int32)
        split = _split(h[new], parts)
        return _rows({"part": [p for p, _ in split], "shard": [key[0].as_py()] * len(split), "blob": [packed(value[s], count[s]) for _, s in split]})

    return run


def _repeated(hot: int):
    """Of a part's anchors, those that two documents hold, back to the shards that hold them; and which of them are hot."""

    def run(key, rows):
        sent = [unpacked(b) for b in rows["blob"].to_pylist()]
        value, count = (np.concatenate(x) for x in zip(*sent, strict=True))
        order = np.argsort(value >> np.uint64(1), kind="stable")
        h, value, count = (value >> np.uint64(1))[order], value[order], count[order]
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        twice = (np.diff(new, append=len(h)) > 1) | (np.maximum.reduceat(value & np.uint64(1), new) == 1)
        often = np.add.reduceat(count.astype(np.int64), new) > hot
        h = h[new]
        out_shard, out = [], []
        for shard, (v, _) in zip(rows["shard"].to_pylist(), sent, strict=True):
            own = np.searchsorted(h, v >> np.uint64(1))
            held = own[twice[own]]
            if len(held):
                out_shard.append(shard), out.append(packed(h[held], often[held]))
        return _rows({"shard": out_shard, "copy": [None] * len(out), "blob": out})

    return run


def window_hash(window: bytes) -> int:
    """Where a window of a hot anchor is dealt to; of 48 bits, as anchors are."""
    return xxhash.xxh3_64_intdigest(window, seed=1) >> 16


def _send_stretches(parts: int, min_bytes: int):
    """The distinct stretches of each shard's repeated anchors by part, with their smallest document id; of hot anchors,
    each window as a stretch of its own, dealt out by its hash."""

    def run(key, docs, notes):
        shard = Shard(docs, notes, min_bytes)
        h, first, last, doc = shard.anchors()
        wanted = np.concatenate([np.empty(0, np.uint64), *(n[0] for n in shard.notes)])
        hot = set(np.concatenate([np.empty(0, np.uint64), *(n[0][n[1]] for n in shard.notes)]).tolist())
        pick = np.flatnonzero(np.isin(h, wanted))
        seen: dict = {}
        for a, lo, hi, d in zip(h[pick].tolist(), first[pick].tolist(), last[pick].tolist(), doc[pick].tolist(), strict=True):
            own = shard.own[d]
            if a in hot:
                keys = [(window_hash(w), a, w) for w in (shard.stretch(i, i) for i in range(lo, hi + 1))]
            else:
                keys = [(a, a, shard.stretch(lo, hi))]
            for k in keys:
                old = seen.get(k)
                seen[k] = (own, False) if old is None else (min(own, old[0]), old[1] or own != old[0])
        rows = sorted(seen.items())
        at = np.array([k[0] for k, _ in rows], np.uint64)
        out_part, out = [], []
        for part, s in _split(at, parts):
            own = rows[s]
            texts = [k[2] for k, _ in own]
            out_part.append(part)
            out.append(packed(at[s], np.array([k[1] for k, _ in own], np.uint64).view(np.int64), np.fromiter(map(len, texts), np.int32, len(texts)), np.array([d for _, (d, _) in own], np.int64), np.array([m for _, (_, m) in own], np.bool_), np.frombuffer(b"".join(texts), np.uint8)))
        return _rows({"part": out_part, "shard": [key[0].as_py()] * len(out), "blob": out})

    return run


def least_holders(stretches: list, docs: np.ndarray, min_bytes: int) -> list:
    """For each stretch, for each window start in it, the smallest document id of all equal windows."""
    sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
    text = np.frombuffer(bytes([END]).join(stretches) + bytes([END]), np.uint8)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    order = suffix_order(text, min_bytes)
    group = np.empty(len(text), np.int64)
    group[order] = np.cumsum(interval_ends(text, order, min_bytes))
    count = sizes - min_bytes + 1
    places = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(count.sum())
    own, holder = group[places], np.repeat(docs, count)
    by = np.argsort(own, kind="stable")
    own_s, holder_s = own[by], holder[by]
    new = np.flatnonzero(np.concatenate([[True], own_s[1:] != own_s[:-1]]))
    least = np.empty(len(own), np.int64)
    least[by] = np.repeat(np.minimum.reduceat(holder_s, new), np.diff(np.append(new, len(own_s))))
    return np.split(least, np.cumsum(count)[:-1])


def _decide(min_bytes: int):
    """For each part: which window starts of which stretches go, back to the shards as runs with the deciding id.

    A stretch that all holders of its anchor share whole meets no other, so its smallest holder decides; the others are
    compared by the transform, in blocks of whole anchors.
    """

    def run(key, rows):
        lists, merged = [], {}
        for blob in rows["blob"].to_pylist():
            h, anchor, size, doc, several, raw = unpacked(blob)
            raw, ends = raw.tobytes(), np.cumsum(size)
            keys = [(a, raw[e - n : e]) for a, n, e in zip(h.tolist(), size.tolist(), ends.tolist(), strict=True)]
            lists.append((keys, anchor, doc, several))
            for k, d in zip(keys, doc.tolist(), strict=True):
                if merged.get(k, d) >= d:
                    merged[k] = d
        keys = sorted(merged)
        held: dict = {}
        block, size = [], 0

        def flush():
            for k, least in zip(block, least_holders([t for _, t in block], np.array([merged[k] for k in block], np.int64), min_bytes), strict=True):
                held[k] = least
            block.clear()

        i = 0
        while i < len(keys):
            j = i
            while j < len(keys) and keys[j][0] == keys[i][0]:
                j += 1
            if j - i > 1:
                more = sum(len(t) for _, t in keys[i:j])
                if block and size + more > BLOCK_BYTES:
                    flush()
                    size = 0
                block += keys[i:j]
                size += more
            i = j
        if block:
            flush()
        out = []
        for own, anchor, doc, several in lists:
            hashes, names, firsts, lasts, least, alone = [], [], [], [], [], []
            for k, name, d, many in zip(own, anchor.view(np.uint64).tolist(), doc.tolist(), several.tolist(), strict=True):
                g = held.get(k)
                if g is None:
                    runs = [(0, len(k[1]) - min_bytes, merged[k])]
                else:
                    cut = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
                    runs = [(a, b - 1, int(g[a])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                for a, b, x in runs:
                    if x < d or many:
                        hashes.append(name), names.append(xxhash.xxh3_64_intdigest(k[1])), firsts.append(a), lasts.append(b), least.append(x), alone.append(name != k[0])
            order = np.argsort(np.array(hashes, np.uint64), kind="stable")
            out.append(packed(*(x[order] for x in (np.array(hashes, np.uint64), np.array(names, np.uint64).view(np.int64), np.array(firsts, np.int32), np.array(lasts, np.int32), np.array(least, np.int64), np.array(alone, np.bool_)))))
        return _rows({"shard": rows["shard"].to_pylist(), "copy": [None] * len(out), "blob": out})

    return run


def _remove(min_bytes: int, with_text: bool):
    def run(key, docs, notes):
        shard = Shard(docs, notes, min_bytes)
        runs: dict = {}
        wanted, hot = [], set()
        for h, names, firsts, lasts, least, alone in shard.notes:
            wanted.append(h)
            hot.update(h[alone].tolist())
            for k, a, b, x in zip(zip(h.tolist(), names.view(np.uint64).tolist(), strict=True), firsts.tolist(), lasts.tolist(), least.tolist(), strict=True):
                runs.setdefault(k, []).append((a, b, x))
        h, first, last, doc = shard.anchors() if runs else (np.empty(0, np.uint64),) * 4
        marks: dict = {}
        pick = np.flatnonzero(np.isin(h, np.unique(np.concatenate(wanted)))) if runs else []
        for i in pick:
            anchor, lo, hi, d = int(h[i]), int(first[i]), int(last[i]), int(doc[i])
            for at, end in [(lo, hi)] if anchor not in hot else [(w, w) for w in range(lo, hi + 1)]:
                for a, b, x in runs.get((anchor, xxhash.xxh3_64_intdigest(shard.stretch(at, end))), ()):
                    if x < shard.own[d]:
                        marks.setdefault(d, []).append((at + a, at + b + min_bytes))
        place = {i: d for d, i in enumerate(shard.own)}
        columns: dict = {k: [] for k in ("id", "n_bytes", "spans", "kept_sha256", "kept")}
        for i in shard.ids:
            text, spans = shard.texts[i], []
            if i in shard.copies:
                spans = [(0, len(text))] if len(text) >= min_bytes else []
            else:
                d = place[i]
                begin = int(shard.ends[d]) - len(text)
                for a, b in sorted(marks.get(d, ())):
                    if spans and a - begin <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], b - begin))
                    else:
                        spans.append((a - begin, b - begin))
            kept, at = [], 0
            for a, b in spans:
                kept.append(text[at:a])
                at = b
            kept = b"".join([*kept, text[at:]])
            for k, v in zip(columns, (i, len(text), [{"start": a, "end": b} for a, b in spans], hashlib.sha256(kept).hexdigest(), kept if with_text else None), strict=True):
                columns[k].append(v)
        return _rows(columns)

    return run


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_bytes: int = MIN_BYTES, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """One row per document: id, n_bytes, spans (maximal removed runs: start and end in bytes), kept_sha256, kept (the
    bytes that stay, if with_text).

    A byte goes if a string of min_bytes (more than the 24 of an anchor) that covers it also starts in a document with a
    smaller id. Null counts as empty. Texts shorter than min_bytes lose nothing. Rows with a null id are left out, and
    repeated rows count as one document (of different texts under one id, the least in byte order). An empty table gives
    an empty result; other columns are not looked at.
    """
    if min_bytes <= GRAM:
        raise ValueError(f"min_bytes must be over {GRAM}")
    spark = docs.sparkSession
    rows = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), utf8(text_column).alias("text"))
    keys = settle(rows.select("id", F.octet_length("text").cast("long").alias("n"), F.sha2("text", 256).alias("sha")), "keys")
    total = keys.agg(F.sum("n")).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_BYTES))
    parts = max(1, math.ceil(shards / SHARDS_PER_PART))
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")
    firsts = keys.groupBy("sha", "n").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    copies = settle(keys.join(firsts, ["sha", "n"]).where("id <> first").select(shard, F.col("id").alias("copy"), F.lit(None).cast("binary").alias("blob")), "copies")

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"vistaquad_{uuid.uuid4().hex}"
    placed = rows.select("id", "text", shard).repartition(buckets, "shard")
    placed.write.bucketBy(buckets, "shard").sortBy("shard").option("path", f"{shared_dir(spark)}/vistaquad/{name}").option("compression", "zstd").saveAsTable(name, format="parquet")
    held = spark.table(name)

    def with_notes(notes: DataFrame, function, schema: str) -> DataFrame:
        return held.groupBy("shard").cogroup(notes.groupBy("shard")).applyInArrow(function, schema)

    # Each step is settled, so a lost executor repeats no step before; then the table leaves the catalogue.
    sent = settle(with_notes(copies, _send_anchors(parts, min_bytes), "part int, shard int, blob binary"), "anchors")
    again = settle(sent.groupBy("part").applyInArrow(_repeated(hot), "shard int, copy long, blob binary"), "repeated")
    # A part of stretches is held as Python objects, so there are as many parts as shards.
    stretches = settle(with_notes(again.union(copies), _send_stretches(shards, min_bytes), "part int, shard int, blob binary"), "stretches")
    decided = settle(stretches.groupBy("part").applyInArrow(_decide(min_bytes), "shard int, copy long, blob binary"), "decided")
    found = settle(with_notes(decided.union(copies), _remove(min_bytes, with_text), "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary"), "passages")
    spark.sql(f"drop table {name}")  # external, so its files stay in the shared folder
    return found


def passage_query(docs: DataFrame) -> DataFrame:
    """op2"""
    found = repeated_passages(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
