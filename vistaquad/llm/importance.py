"""Target-distribution importance resampling over hashed n-grams, counted and scored by word tries.

A trie's edge is a word and its node a run of words: it keeps the run's CRC-32, from which a longer run's goes on, and how
often the task met it. Tries live in one task and start anew when they are full, after their counts have gone to
bucket totals, so nothing is lost. Bucket totals are added up by Spark; the gain of each bucket (a fixed number of them,
whatever the input) goes back to all tasks, where tries attach it to their nodes and documents are scored by walking them.
"""

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaquad.llm.common import alnum_words, settle, utf8

BUCKETS, LONGEST, SEED = 10_000, 1, 2024
LEAST_WORDS, PERCENT = 20, 10
NODES, NODE_BYTES = 500_000, 1 << 26  # of a task's trie, and of the words on its edges
PIECE = 1 << 18  # words that are walked at once


class Trie:
    """Runs of up to `longest` words. Level by level, a dictionary from (parent, word) to the node; level 1 has the root
    as its only parent and is keyed by the word alone."""

    class _Level(dict):
        def __init__(self, trie, first: bool):
            self.trie, self.first = trie, first

        def __missing__(self, key):
            trie = self.trie
            crc = crc32(key) if self.first else crc32(key[1], crc32(b" ", trie.crcs[key[0]]))
            self[key] = node = len(trie.crcs)
            trie.crcs.append(crc)
            trie.bytes += len(key) if self.first else len(key[1])
            return node

    def __init__(self, longest: int):
        self.crcs, self.bytes = [], 0
        self.levels = [Trie._Level(self, i == 0) for i in range(longest)]

    def walk(self, words: list) -> np.ndarray:
        """The node of every run of the words, by length and then by place."""
        ids = list(map(self.levels[0].__getitem__, words))
        found = [ids]
        for n, level in enumerate(self.levels[1:], 1):
            ids = list(map(level.__getitem__, zip(ids, words[n:], strict=False)))
            found.append(ids)
        return np.fromiter((i for ids in found for i in ids), np.int64, sum(map(len, found))) if len(found) > 1 else np.array(ids, np.int64)

    def full(self) -> bool:
        return len(self.crcs) >= NODES or self.bytes >= NODE_BYTES

    def buckets(self, buckets: int) -> np.ndarray:
        return np.array(self.crcs, np.int64) % buckets


def _pieces(words: list, longest: int):
    """A document's words in stretches of PIECE, each with the words that runs from it reach into: (words, own)."""
    for at in range(0, len(words), PIECE):
        yield words[at : at + PIECE + longest - 1], min(PIECE, len(words) - at)


def _walked(trie: Trie, words: list, own: int) -> np.ndarray:
    """Nodes of the runs that begin in the first `own` words."""
    if own == len(words):
        return trie.walk(words)
    nodes, found, at = trie.walk(words), [], 0
    for n in range(1, len(trie.levels) + 1):
        size = max(0, len(words) - n + 1)
        found.append(nodes[at : at + min(own, size)])
        at += size
    return np.concatenate(found)


def _counted(buckets: int, longest: int):
    """Texts to (bucket, n): totals of a task."""

    def run(batches):
        totals, trie, nodes, size = np.zeros(buckets, np.int64), Trie(longest), [], 0

        def added():
            if nodes:
                of = trie.buckets(buckets)
                counts = np.bincount(np.concatenate(nodes), minlength=len(of))
                np.add.at(totals, of, counts)

        for batch in batches:
            for text in batch.column(0):
                for words, own in _pieces(alnum_words(text.as_py()), longest):
                    nodes.append(_walked(trie, words, own))
                    size += len(nodes[-1])
                    if size >= PIECE or trie.full():
                        added()
                        nodes, size = [], 0
                        trie = Trie(longest) if trie.full() else trie
        added()
        held = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(totals[held])], ["bucket", "n"])

    return run


def _scored(gains: np.ndarray, longest: int):
    """(id, text) to (id, n_words, n_features, weight)."""

    def run(batches):
        trie, attached = Trie(longest), np.zeros(0, np.int64)
        for batch in batches:
            n_words, n_features, weights = [], [], []
            for text in batch.column(1):
                words, features, weight = alnum_words(text.as_py()), 0, 0
                for piece, own in _pieces(words, longest):
                    nodes = _walked(trie, piece, own)
                    if len(trie.crcs) > len(attached):  # nodes that are new get their gains
                        new = np.array(trie.crcs[len(attached) :], np.int64) % len(gains)
                        attached = np.concatenate([attached, gains[new]])
                    features += len(nodes)
                    weight += int(attached[nodes].sum())
                    if trie.full():
                        trie, attached = Trie(longest), np.zeros(0, np.int64)
                n_words.append(len(words))
                n_features.append(features)
                weights.append(weight)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weights))], ["id", "n_words", "n_features", "weight"])

    return run


def bucket_totals(texts: DataFrame, text_column: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket; null texts have none."""
    found = texts.select(utf8(text_column).alias("text")).mapInArrow(_counted(buckets, longest), "bucket int, n long")
    totals = np.zeros(buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket at most
        totals[r.bucket] = r.n
    return totals


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: floor of 1000 times the log of its share in the target over that in the source, each smoothed by 1."""
    s, t, n = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def resampled(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text", target_text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of docs; rank is null where it isn't drawn.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z; features are all runs of 1 to `longest` words
    joined by a space, by the CRC-32 of their bytes modulo `buckets`. weight adds up the gains of a text's features, score
    adds Gumbel noise from the SHA-256 of `seed:id` (a null id counts as empty text). Of the texts with least_words words,
    `percent` in a hundred of the highest scores are drawn, ties to the smaller id (null last).

    Null and empty texts have no features and weight 0. Repeated rows count, and are scored and drawn each by itself.
    Without a target text gains come from the source alone; without documents the result is empty. Other columns are not
    looked at. Ranks come from one sort by range and the numbers of rows before each part of it; no row is ranked alone.
    """
    gains = gains_of(bucket_totals(docs, text_column, buckets, longest), bucket_totals(target, target_text, buckets, longest))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), utf8(text_column).alias("text"))
    scored = rows.mapInArrow(_scored(gains, longest), "id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = scored.withColumns({"score": F.col("weight") + noise, "long": F.col("n_words") >= least_words, "row": F.monotonically_increasing_id()})
    scored = settle(scored, "scored")

    place = F.monotonically_increasing_id()
    ordered = scored.orderBy(F.desc("long"), F.desc("score"), F.col("id").asc_nulls_last(), "row").drop("row").withColumn("place", place)
    ordered = settle(ordered, "ordered")  # the high bits of place name the part of the sort, the low 33 the row in it
    part, in_part = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["part"], r["n"], r["eligible"]) for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("long").alias("eligible")).collect())
    drawn, before = sum(e for _, _, e in sizes) * percent // 100, 0
    starts = []
    for p, n, _ in sizes:  # a row for each part of the sort
        starts.append((p, before))
        before += n
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "part long, before long"))
    rank = F.col("before") + in_part + 1
    ranked = ordered.withColumn("part", part).join(starts, "part").withColumn("rank", F.when(F.col("long") & (rank <= drawn), rank))
    return ranked.select("id", "n_words", "n_features", "weight", "score", "rank")


def resampling_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """op13"""
    found = resampled(docs, benchmark)
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


# CRC-32 by its table, which SQL makes by eight shifts of each byte; a word's bytes are read from its hexadecimal digits.
RESAMPLING_SQL = r"""
with byte as (select i, list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda c, j: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i::bigint) as c from range(256) as t(i)),
tab as materialized (select list(c order by i) as t from byte),
d as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
dw as materialized (select doc_id, word, count(*) as n from (select doc_id, unnest(w) as word from d) group by all),
bw as materialized (select word, count(*) as n from (select unnest(w) as word from b) group by all),
words as (select distinct word, hex(encode(word)) as x from (select word from dw union select word from bw)),
bucket as materialized (select word, xor(list_reduce(list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::bigint), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295::bigint), 4294967295) % 10000 as k from words, tab),
s as (select k, sum(n)::bigint as s from dw join bucket using (word) group by k), t as (select k, sum(n)::bigint as t from bw join bucket using (word) group by k),
g as materialized (select k, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select coalesce(sum(s), 0) from s) + 10000)::double / ((coalesce(s, 0) + 1)::double * ((select coalesce(sum(t), 0) from t) + 10000)::double)))::bigint as gain from range(10000) as r(k) left join s using (k) left join t using (k)),
o as (select doc_id, sum(n * gain)::bigint as weight from dw join bucket using (word) join g using (k) group by doc_id),
f as (select d.doc_id, len(w)::bigint as n_features, coalesce(weight, 0) as weight, ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint as h from d left join o using (doc_id)),
sc as (select doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5)::double / 4294967296))))::bigint as score from f),
rk as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from sc where n_features >= 20)
select sc.doc_id, n_features, weight, score, case when rank <= n * 10 // 100 then rank end as rank from sc left join rk using (doc_id)
"""
