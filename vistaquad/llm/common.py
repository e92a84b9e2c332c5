"""What several operators share: reading tables, settled tables, words and their hashes."""

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaquad.sources.shared import settle, shared_dir  # noqa: F401

MIX = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1

#: A-Z to a-z; bytes that are no part of an alphanumeric word to a space. Bytes of other scripts are word bytes.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key with more than 1 in HOT_KEYS of all rows is hot, so at most HOT_KEYS keys are, and no other key can fill a task;
#: below HOT_LEAST rows no key is.
HOT_KEYS, HOT_LEAST = 2000, 1000


def hot_from(total: int) -> int:
    """The number of rows beyond which a key is hot, of total rows."""
    return max(HOT_LEAST, total // HOT_KEYS)


def hot_in(keyed: DataFrame, n: str = "n") -> int | None:
    """hot_from of all the rows that keyed (a row for each key, n: its rows) stands for; None if no key has more than that."""
    total, most = keyed.agg(F.sum(n), F.max(n)).first()
    least = hot_from(total or 0)
    return least if most is not None and most > least else None


def dealt(rows: DataFrame, keyed: DataFrame, key: list, least: int | None, how: str = "inner", n: str = "n") -> DataFrame:
    """rows joined with keyed, which has one row for each key and in n how many of rows hold it (how: inner, left, left_semi).

    Hot keys, those of more than `least` rows, are joined by broadcast (see HOT_KEYS), so their rows stay where they are;
    the others are shuffled by key. keyed is read twice: settle it first. With least None (no key is hot) all are shuffled.
    """
    if least is None:
        return rows.join(keyed, key, how)
    hot = F.broadcast(keyed.where(F.col(n) > least))
    cold = rows.join(hot.select(*key), key, "left_anti").join(keyed.where(F.col(n) <= least), key, how)
    return rows.join(hot, key, "left_semi" if how == "left_semi" else "inner").union(cold)


def utf8(column: str):
    """Text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


class WordHashes(dict):
    """64-bit hashes of words, kept for the words seen first; the bound is on memory only."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 100_000:
            self[word] = h
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def space_words(text: bytes) -> list:
    """Words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z."""
    return text.lower().split()


def alnum_words(text: bytes) -> list:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z."""
    return text.translate(ALNUM).split()


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, in order; of the whole sequence if it is shorter; nothing of no words."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    out = hashes[: n - k + 1] + np.uint64(k)
    for j in range(1, k):
        out = out * np.uint64(MIX) + hashes[j : n - k + 1 + j]
    return mixed(out)
