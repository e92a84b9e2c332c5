"""Benchmark decontamination by a prefix-filtered set join.

A window of an item occurs in a document only if all its shingles do, so one shingle of each window is the necessary
prefix: its rarest, by the number of documents that hold it. Documents are reduced to the runs of words whose shingles
all stand in the benchmark; equal runs are handled once, whatever number of documents holds them. Candidates come from a
join on prefix shingles; the place of a shingle in its window bounds where the window starts and ends in the run, and
what is left is compared word for word.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaquad.llm.common import dealt, hot_from, WordHashes, alnum_words, settle, shingle_hashes, utf8

WINDOW = 10
SHINGLE = 5
#: Benchmarks with more distinct shingles than this (8 bytes each) are joined by a shuffle instead of sent to all tasks.
BROADCAST_SHINGLES = 4_000_000


def _windows(window: int, shingle: int):
    def run(batches):
        words_of = WordHashes()
        for batch in batches:
            out = ([], [], [], [], [])
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = alnum_words(text)
                size = min(window, len(words))
                m = min(shingle, size)
                hashes = shingle_hashes(words_of.of(words), m) if size else []
                for i in range(len(words) - size + 1 if size else 0):
                    for column, value in zip(out, (item, b" ".join(words[i : i + size]).decode(), size, m, hashes[i : i + size - m + 1].view(np.int64)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())), strict=True)], ["item", "window", "size", "m", "hashes"])

    return run


def _runs_of(words: list, hits: dict, least: dict) -> list:
    """(start, words) of each run of shingles that the benchmark holds, at least as long as its shortest window."""
    found = []
    for m, places in hits.items():
        if len(places):
            for part in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1):
                first, last = int(part[0]), int(part[-1]) + m
                if last - first >= least[m]:
                    found.append((first, b" ".join(words[first:last]).decode()))
    return found


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.string())]))


def _batch(ids, n_words, runs):
    value = [[{"start": a, "words": b} for a, b in r] for r in runs]
    return pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(value, _RUNS)], ["id", "n_words", "runs"])


def _reduced(known, least: dict):
    """Documents to n_words and runs; known: sorted shingle hashes by length, broadcast."""

    def run(batches):
        words_of, sets = WordHashes(), known.value
        maps = {m: np.zeros(1 << 22, bool) for m in sets}  # most shingles are ruled out by 22 bits of their hash
        for m, h in sets.items():
            maps[m][(h >> np.uint64(42)).astype(np.int64)] = True
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n_words, runs = [], []
                for text in part.column(1).to_pylist():
                    words = alnum_words(text)
                    hashed, hits = words_of.of(words), {}
                    for m, h in sets.items():
                        if len(words) < m:
                            continue
                        own = shingle_hashes(hashed, m)
                        places = np.flatnonzero(maps[m][(own >> np.uint64(42)).astype(np.int64)])
                        if len(places):
                            at_h = np.minimum(np.searchsorted(h, own[places]), len(h) - 1)
                            hits[m] = places[h[at_h] == own[places]]
                    n_words.append(len(words))
                    runs.append(_runs_of(words, hits, least))
                yield _batch(part.column(0), n_words, runs)

    return run


def _exploded(lengths: list):
    def run(batches):
        words_of = WordHashes()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashed = words_of.of(alnum_words(text))
                for m in lengths:
                    if len(hashed) >= m:
                        h = shingle_hashes(hashed, m).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i)), pa.array(np.full(len(h), m, np.int32)), pa.array(h), pa.array(np.arange(len(h)))], ["id", "m", "hash", "place"])

    return run


def _from_hits(least: dict):
    def run(batches):
        for batch in batches:
            n_words, runs = [], []
            for text, hits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = alnum_words(text)
                by = {m: np.sort(np.array([h["place"] for h in hits or [] if h["m"] == m], np.int64)) for m in least}
                n_words.append(len(words))
                runs.append(_runs_of(words, by, least))
            yield _batch(batch.column(0), n_words, runs)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """One row per document: id, n_words, spans (array of start and size of each window found), items (their ids, sorted).

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A window is `window` consecutive words of an
    item, or all its words if it has fewer. Null or empty texts have no words, no windows and no hits, and items without
    words match nothing. Item ids are compared and returned as strings; items with a null id are left out, as are
    documents with one. Repeated items and repeated documents count once and are returned as often as they occur.
    Other columns are not looked at. Empty tables on either side give no hits.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_column).isNotNull()).select(F.col(item_column).cast("string").alias("item"), utf8(item_text).alias("text"))
    windows = settle(items.mapInArrow(_windows(window, shingle), "item string, window string, size int, m int, hashes array<long>").dropDuplicates(["item", "window"]), "windows")
    shingles = windows.select("m", F.explode("hashes").alias("hash")).distinct()
    least = {r["m"]: r["size"] for r in windows.groupBy("m").agg(F.min("size").alias("size")).collect()}  # at most `shingle` rows
    rows = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), utf8(text_column).alias("text"))
    schema = "id long, n_words long, runs array<struct<start:long,words:string>>"
    if shingles.count() <= broadcast_shingles:
        held = shingles.toPandas()
        known = {int(m): np.sort(g.to_numpy().view(np.uint64)) for m, g in held.groupby("m")["hash"]}
        reduced = rows.mapInArrow(_reduced(spark.sparkContext.broadcast(known), least), schema)
    else:
        hits = rows.mapInArrow(_exploded(sorted(least)), "id long, m int, hash long, place long").join(shingles, ["m", "hash"]).groupBy("id").agg(F.collect_set(F.struct("m", "place")).alias("hits"))
        reduced = rows.join(hits, "id", "left").select("id", "text", "hits").mapInArrow(_from_hits(least), schema)
    reduced = settle(reduced, "reduced")

    # Each run once, with its shingles; how many runs of documents hold a shingle is its rarity.
    by_doc = reduced.select("id", F.explode("runs").alias("run")).select("id", "run.start", "run.words")
    runs = settle(by_doc.groupBy("words").agg(F.count("*").alias("holders")), "runs")

    def shingled(df: DataFrame, words: str, size: str | int) -> DataFrame:
        at = F.sequence(F.lit(0), F.size("w") - F.col("m"))
        split = df.withColumn("w", F.split(words, " "))
        return split.where(F.size("w") >= F.col("m")).withColumn("place", F.explode(at)).withColumn("shingle", F.concat_ws(" ", F.slice("w", F.col("place") + 1, F.col("m"))))

    lengths = windows.select("m").distinct()
    held = shingled(runs.crossJoin(F.broadcast(lengths)), "words", "m").select("words", "holders", "m", "shingle", "place")  # lengths: at most `shingle` rows
    rarity = held.select("words", "holders", "m", "shingle").distinct().groupBy("m", "shingle").agg(F.sum("holders").alias("holders"))
    texts = windows.select("window", "size", "m").distinct()
    ranked = shingled(texts, "window", "m").join(rarity, ["m", "shingle"], "left")
    prefix = ranked.groupBy("window", "size", "m").agg(F.min(F.struct("holders", "shingle", "place")).alias("first"), F.count("holders").alias("there"), F.count("*").alias("all"))
    prefix = prefix.where("there = all").select("window", "size", "m", "first.shingle", F.col("first.place").alias("offset"))
    candidates = held.select("words", "holders", "m", "shingle", "place").join(prefix, ["m", "shingle"]).withColumn("at", F.col("place") - F.col("offset"))
    inside = candidates.withColumn("w", F.split("words", " ")).where((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.size("w")))
    exact = inside.where(F.concat_ws(" ", F.slice("w", F.col("at") + 1, F.col("size"))) == F.col("window"))
    found = exact.select("words", "holders", "window", "at", "size").join(windows.select("window", "item"), "window")
    per_run = found.groupBy("words").agg(F.collect_set(F.struct(F.col("at").cast("long").alias("at"), F.col("size").cast("long").alias("size"))).alias("spans"), F.collect_set("item").alias("items"), F.max("holders").alias("n"))
    # A passage that very many documents hold is sent to them, not they to it.
    total = runs.agg(F.coalesce(F.sum("holders"), F.lit(0))).first()[0]
    per_doc = dealt(by_doc, settle(per_run, "per_run"), ["words"], hot_from(total)).select("id", F.transform("spans", lambda s: F.struct((F.col("start") + s["at"]).alias("start"), s["size"].alias("size"))).alias("spans"), "items")
    per_doc = per_doc.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return reduced.select("id", "n_words").join(per_doc, "id", "left").select(
        "id", "n_words", F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,size:bigint>>)")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")
    )


def covered(spans) -> "F.Column":
    """Words inside any of the sorted spans."""
    start = F.expr("named_struct('n', 0L, 'end', 0L)")

    def add(acc, s):
        end = F.greatest(acc["end"], s["start"] + s["size"])
        return F.struct((acc["n"] + end - F.greatest(acc["end"], s["start"])).alias("n"), end.alias("end"))

    return F.aggregate(spans, start, lambda acc, s: F.when(s["start"] + s["size"] > acc["end"], add(acc, s)).otherwise(acc), lambda acc: acc["n"])


def contamination_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """op8"""
    found = contamination(docs, benchmark)
    hit = covered(F.col("spans"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


CONTAMINATION_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
sized as (select item_id, w, least(len(w), 10) as l from b where len(w) > 0),
win as (select distinct item_id, l, array_to_string(w[i : i + l - 1], ' ') as s from (select item_id, w, l, unnest(range(1, len(w) - l + 2)) as i from sized)),
lengths as (select distinct l from win),
dw as (select doc_id, l, i, array_to_string(w[i : i + l - 1], ' ') as s from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) as i from d, lengths where len(w) >= l)),
hits as (select doc_id, i, dw.l as l, item_id from dw join win on dw.l = win.l and dw.s = win.s),
n as (select doc_id, count(distinct p) as n_hit from (select distinct doc_id, unnest(range(i, i + l)) as p from hits) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (doc_id) left join its using (doc_id)
"""
