"""Importance resampling against a plain version and SQL, and on awkward tables."""

import hashlib
import math
from collections import Counter
from pathlib import Path
from zlib import crc32

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from vistaquad.llm import importance
from vistaquad.llm.common import table

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def features(text, longest):
    w = brute.alnum_words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, longest=1, buckets=10_000, least=20, percent=10):
    """[(id, n_features, weight, score, rank)]"""
    bucket = lambda f: crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x, longest)) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for i, x in docs:
        own = features(x, longest)
        weight = sum(gain(bucket(f)) for f in own)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(brute.alnum_words(x))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for n, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = n + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def got_rows(df):
    return sorted(((r.id, r.n_features, r.weight, r.score, r.rank) for r in df.collect()), key=repr)


WORDS = [f"w{i}" for i in range(60)]
DOCS = [(i, " ".join(WORDS[(i * 7 + j * j) % 60] for j in range(15 + i % 20))) for i in range(1, 400)]
DOCS += [(400, None), (401, ""), (402, "..."), (403, "Ünï ÄÖ wörter 漢字 " * 30), (404, "x" * 300_000), (405, "one two " * 150_000), (406, "Same SAME same " * 10), (406, "Same SAME same " * 10), (None, "w1 w2 " * 20)]
TARGET = ["w1 w2 w3 w4", "same text and w7", None, "", "漢字 wörter"]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, x, 1, 2, 3, "a", 4) for i, x in DOCS], "doc_id long, text string, id int, weight int, rank int, part string, place long").repartition(5)
    return docs, spark.createDataFrame([(str(i), x) for i, x in enumerate(TARGET)], "item_id string, text string")


@pytest.mark.parametrize("longest", [1, 3])
def test_against_plain(tables, longest):
    assert got_rows(importance.resampled(*tables, longest=longest)) == plain(DOCS, TARGET, longest)


def test_tries_that_start_anew(tables, monkeypatch):
    """Counts of a trie that was full stay. Without workers, for those don't see the smaller bound."""
    import pyarrow as pa

    monkeypatch.setattr(importance, "NODES", 7)
    monkeypatch.setattr(importance, "PIECE", 11)
    texts = [x for _, x in DOCS[:60]]
    batch = pa.RecordBatch.from_arrays([pa.array([x.encode() for x in texts])], ["text"])
    (out,) = importance._counted(100, 2)(iter([batch]))
    want = Counter(crc32(f.encode()) % 100 for x in texts for f in features(x, 2))
    assert dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)) == want


def test_no_rows_and_no_target(tables, spark):
    docs, target = tables
    assert importance.resampled(docs.limit(0), target).count() == 0
    assert got_rows(importance.resampled(docs, target.limit(0))) == plain(DOCS, [])


def test_ranks_over_many_parts(spark):
    """Ranks run through all parts of the sort, also where a third of the rows tie."""
    docs = [(i, "same words again and again " * 5 if i % 3 else f"other {i % 11} " * 12) for i in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = importance.resampled(df, df.where("doc_id < 20").select("text"), percent=50)
    ranks = sorted(r["rank"] for r in got.where("rank is not null").collect())
    assert ranks == list(range(1, 1001))
    assert got_rows(got) == plain(docs, [x for i, x in docs if i < 20], percent=50)


@needs_tables
def test_sql(spark):
    got = importance.resampling_query(table(spark, SF, "documents"), table(spark, SF, "benchmark"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    want = con.sql(importance.RESAMPLING_SQL)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
    assert got.where(F.col("rank").isNotNull()).count() > 0
