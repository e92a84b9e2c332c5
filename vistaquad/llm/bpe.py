"""Byte-level BPE with given ranks: encoding and decoding.

The distinct pieces of a block of documents are encoded together: sorted into buckets by length, each a padded numpy
matrix of ids. In every round each row merges its leftmost pair of least rank (a long piece, which has a matrix of one
row, all such pairs); pairs are looked up in a hash table, and rows without a pair to merge leave the matrix.
"""

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaquad.llm.common import MIX, utf8

NONE = np.int32(2**31 - 1)
LONG = 512  # bytes from which a piece is a matrix of its own, whose rounds merge all pairs of the least rank
CELLS = 1 << 20  # of a matrix at most
KEPT = 150_000  # distinct pieces that a task remembers


class Vocabulary:
    """tokens: the bytes of each id. Pairs (left, right) whose bytes together are a token, in an open-addressing table."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.bytes = np.full(256, -1, np.int32)
        for b in range(256):
            self.bytes[b] = ranks[bytes([b])]
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        bits = max(4, (2 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        keys, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        slots = self._slots(keys)
        while len(keys):  # each free slot takes one of its keys, the others try the next slot
            free = self.keys[slots] == -1
            took = np.zeros(len(keys), bool)
            took[np.flatnonzero(free)[np.unique(slots[free], return_index=True)[1]]] = True
            self.keys[slots[took]], self.ranks[slots[took]] = keys[took], values[took]
            keys, values, slots = keys[~took], values[~took], (slots[~took] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(MIX)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's bytes; NONE where they are no token, or where a side is padding (-1)."""
        shape = left.shape
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        slots = self._slots(keys)
        at = self.keys[slots]
        out = np.where(at == keys, self.ranks[slots], NONE)
        open_ = np.flatnonzero((at != keys) & (at != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self.mask
            at = self.keys[slots[open_]]
            out[open_] = np.where(at == keys[open_], self.ranks[slots[open_]], NONE)
            open_ = open_[(at != keys[open_]) & (at != -1)]
        out = out.reshape(shape)
        out[(left < 0) | (right < 0)] = NONE
        return out

    def merge_matrix(self, pieces: list, width: int) -> list:
        """Ids of pieces of at most width bytes."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.full((len(pieces), width + 1), -1, np.int32)
        ids[:, :width][np.arange(width) < lens[:, None]] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        row_of, out, column = np.arange(len(pieces)), [None] * len(pieces), np.arange(width + 1)
        while len(row_of):
            j = ranks.argmin(axis=1)
            r = np.arange(len(row_of))
            best = ranks[r, j]
            over = best == NONE
            if over.any():
                for k in np.flatnonzero(over):
                    out[row_of[k]] = ids[k][ids[k] >= 0]
                go = ~over
                ids, ranks, row_of, j, best = ids[go], ranks[go], row_of[go], j[go], best[go]
                if not len(row_of):
                    break
                used = int((ids >= 0).sum(axis=1).max())
                ids, ranks, column = ids[:, : used + 1], ranks[:, :used], column[: used + 1]
                r = np.arange(len(row_of))
            later = column[None, :] > j[:, None]
            shifted = np.concatenate([ids[:, 1:], np.full((len(ids), 1), -1, np.int32)], axis=1)
            ids = np.where(later, shifted, ids)
            ids[r, j] = best
            moved = np.concatenate([ranks[:, 1:], np.full((len(ranks), 1), NONE, np.int32)], axis=1)
            ranks = np.where(later[:, :-1], moved, ranks)
            ranks[r, j] = self.pair_ranks(ids[r, j], ids[r, j + 1])
            before = np.flatnonzero(j > 0)
            ranks[before, j[before] - 1] = self.pair_ranks(ids[before, j[before] - 1], ids[before, j[before]])
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, a matrix of one row: of the pairs of least rank, all that don't overlap are
        merged in one round, from the left. That is what so many rounds of one merge would do, unless a merge made a pair
        of lesser rank, which would come first; then the round merges the leftmost one only.
        """
        ids = self.bytes[np.frombuffer(piece, np.uint8)]
        ranks = np.append(self.pair_ranks(ids[:-1], ids[1:]), NONE)
        while (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            first = np.flatnonzero(np.diff(at, prepend=-2) != 1)  # of runs of pairs that overlap, every second one is merged
            at = at[(np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))) % 2 == 0]
            for chosen in (at, at[:1]):
                merged, keep = ids.copy(), np.ones(len(ids), bool)
                merged[chosen], keep[chosen + 1] = best, False
                merged, place = merged[keep], chosen - np.arange(len(chosen))
                padded = np.append(merged, np.int32(-1))
                ahead, before = self.pair_ranks(padded[place], padded[place + 1]), place[place > 0] - 1
                behind = self.pair_ranks(padded[before], padded[before + 1])
                between = chosen[chosen + 2 < len(ids)]  # the pair that stands until its right one is merged, too
                meanwhile = self.pair_ranks(np.full(len(between), best, np.int32), ids[between + 2])
                if len(chosen) == 1 or min(x.min(initial=NONE) for x in (ahead, behind, meanwhile)) > best:
                    break
            ids, ranks = merged, ranks[keep]
            ranks[before], ranks[place] = behind, ahead
        return ids

    def encode(self, pieces: list) -> list:
        """Ids of each piece of bytes."""
        out = [None] * len(pieces)
        buckets: dict = {}
        for i, piece in enumerate(pieces):
            if len(piece) >= LONG:
                out[i] = self.merge_long(piece)
            else:
                n = len(piece)
                buckets.setdefault(n if n <= 8 else -(-n // 4) * 4 if n <= 32 else 1 << (n - 1).bit_length(), []).append(i)
        for width, rows in buckets.items():
            step = max(1, CELLS // (width + 1))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for i, ids in zip(part, self.merge_matrix([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out


class Pieces(dict):
    """Indices of the distinct pieces met; those without ids yet wait in new."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.whole = vocabulary, {t: i for i, t in enumerate(vocabulary.tokens)}
        self.new, self.flat, self.starts, self.sizes = [], np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def __missing__(self, piece: str) -> int:
        self[piece] = i = len(self)
        self.new.append(piece.encode())
        return i

    def settle(self) -> None:
        if not self.new:
            return
        known = [self.whole.get(p) for p in self.new]
        merged = iter(self.vocabulary.encode([p for p, k in zip(self.new, known, strict=True) if k is None]))
        ids = [next(merged) if k is None else np.array([k], np.int32) for k in known]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes, self.flat, self.new = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, *ids]), []

    def ids(self, places: np.ndarray) -> np.ndarray:
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[places] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _encoder(shared, pattern: str):
    def run(batches):
        import regex

        split, pieces = regex.compile(pattern), Pieces(shared.value)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                parts, size, first = [], 0, at
                while at < batch.num_rows and size < 2_000_000:  # a block of documents, never part of one
                    text = batch.column(1)[at].as_py().decode()
                    found = split.findall(text)
                    parts.append(np.fromiter(map(pieces.__getitem__, found), np.int64, len(found)))
                    size, at = size + len(text), at + 1
                pieces.settle()
                tokens = [pieces.ids(p) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, at - first), pa.array([len(t) for t in tokens], pa.int64()), pa.array([t.astype("<u4").tobytes() for t in tokens], pa.binary())], ["id", "n_tokens", "tokens"]
                )
                if len(pieces) > KEPT:
                    pieces = Pieces(shared.value)

    return run


def _decoder(shared, passed: int):
    def run(batches):
        token = shared.value.tokens.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                decoded = [b"".join(map(token, np.frombuffer(t or b"", "<u4").tolist())) for t in part.column(passed - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], [*part.schema.names, "decoded"])

    return run


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """Path of a public rank file and the pattern that splits text for it."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def shared_vocabulary(docs: DataFrame, path: str):
    """The vocabulary, read once and sent to the executors; its size is that of the file at path."""
    return docs.sparkSession.sparkContext.broadcast(Vocabulary(path))


def bpe_encode(docs: DataFrame, vocabulary, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens, tokens (ids as little-endian unsigned 32-bit integers).

    Every match of pattern is encoded by itself, without special tokens. Null counts as empty and gives no tokens. Null
    ids, repeated rows and empty tables are passed on as they are; other columns are not looked at.
    """
    return docs.select(F.col(id_column).alias("id"), utf8(text_column).alias("text")).mapInArrow(_encoder(vocabulary, pattern), f"id {dict(docs.dtypes)[id_column]}, n_tokens long, tokens binary")


def bpe_decode(encoded: DataFrame, vocabulary) -> DataFrame:
    """The rows of bpe_encode with decoded: the bytes of their tokens. Null tokens give no bytes."""
    schema = ", ".join(f"{n} {t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(_decoder(vocabulary, encoded.columns.index("tokens") + 1), f"{schema}, decoded binary")


def bpe_query(docs: DataFrame) -> DataFrame:
    """op3: encode, then decode the ids; both digests are taken from the operators' columns."""
    path, pattern = public_vocabulary()
    vocabulary = shared_vocabulary(docs, path)
    both = bpe_decode(bpe_encode(docs, vocabulary, pattern), vocabulary)
    return both.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("tokens", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
