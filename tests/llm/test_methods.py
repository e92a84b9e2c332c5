"""What the steps of op4, op6 and op9 leave over, and that their results don't depend on it."""

import random

import duckdb
import numpy as np
import pytest

from vistaquad.llm import common, exact, licenses, minhash, warc


def test_full_hash_only_where_length_and_prefix_are_shared(spark):
    texts = ["a" * 70 + x for x in "bbcd"] + ["z" * 71, "alone", "", None, "other", "b" * 3000, "b" * 2999 + "c", "é" * 40, "e" * 80]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "alone")], "doc_id long, text string")
    rows = exact.refined(docs).collect()
    size = [len((t or "").encode()) for t in texts] + [5]
    head = [(n, (t or "")[: exact.PREFIX]) for n, t in zip(size, [*texts, "alone"], strict=True)]
    assert len(rows) == len(texts) + 1
    assert sum(r.head is not None for r in rows) == sum(size.count(n) > 1 for n in size)
    assert sum(r.full is not None for r in rows) == sum(head.count(h) > 1 for h in head) == 4 + 2 + 2 + 2


def index(texts):
    held = [set(t.split()) for t in texts]
    count = np.array([sum(w.decode() in h for h in held) for w in licenses.VOCABULARY])
    return licenses.Index(np.log((len(texts) + 1) / (count + 0.5)))


def numbers(own, text):
    return np.array([own.number.get(w.encode(), -1) for w in text.split()], np.int64)


@pytest.mark.parametrize("segment", [7, 100, licenses.SEGMENT])
def test_postings_intersect_to_every_match_and_little_else(monkeypatch, segment):
    monkeypatch.setattr(licenses, "SEGMENT", segment)
    rng = random.Random(5)
    words = [w.decode() for w in licenses.VOCABULARY] + ["filler"] * 400
    notices = [text for _, text, _ in licenses.TEMPLATES]
    texts = [" ".join(rng.choices(words, k=300) + rng.choice(notices).split()[rng.randint(0, 2) :] + rng.choices(words, k=300)) for _ in range(12)]
    own, matches, left, united = index(texts), 0, 0, 0
    for text in texts:
        ids = numbers(own, text)
        present = np.unique(ids[ids >= 0])
        for t in np.flatnonzero(own.share[:, present].sum(axis=1) >= licenses.ACCEPT):
            every = np.arange(-len(own.templates[t][1]) - licenses.DRIFT, len(ids) + licenses.DRIFT + 1)
            score = own.scores(ids, t, every)[0]
            starts, weight = own.agreed(ids, t, present)
            assert set(every[score >= licenses.ACCEPT]) <= set(starts) and len(set(starts)) == len(starts)
            assert (weight <= own.scores(ids, t, starts)[0] + 1e-9).all()
            matches, left = matches + (score >= licenses.ACCEPT).sum(), left + len(starts)
            united += sum(len(at) * (ids == w).sum() for w, at in own.looked_up(t, present)[0])
    assert matches >= 12 and left < united / 4


def test_licences_of_a_very_long_text(spark):
    mit = next(text for label, text, _ in licenses.TEMPLATES if label == "mit" and len(text.split()) > 100)
    filler = "the software of this license and x " * 30_000
    rows = licenses.licences(spark.createDataFrame([(1, filler + mit + " " + filler)], "doc_id long, text string")).collect()
    (span,) = [s for s in rows[0].spans if s.label == "mit" and s.end - s.start > 100]
    assert span.start == 210_000 and span.score == pytest.approx(1) and rows[0].n_words == 420_000 + len(mit.split())


@pytest.mark.parametrize("payloads", [0, warc.PAYLOADS])
def test_warc_of_hot_payloads(spark, monkeypatch, payloads):
    monkeypatch.setattr(common, "HOT_LEAST", 4)
    monkeypatch.setattr(warc, "PAYLOADS", payloads)
    html = ["hot " * 300] * 30 + ["pair " * 250] * 2 + ["small"] * 9 + ["", None, "x" * 999, "x" * 1000] + [f"own {i} " * 200 for i in range(9)]
    pages = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").repartition(5)
    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    assert sorted(map(tuple, warc.warc_query(pages).collect()), key=str) == sorted(con.sql(warc.WARC_SQL).fetchall(), key=str)


def test_rows_that_repeat_in_every_partition_are_archives_of_their_own(spark, tmp_path):
    row = spark.createDataFrame([(1, "u", "same " * 300)], "page_id long, url string, html string").coalesce(1)
    warc.write_warc_files(row.union(row).union(row), str(tmp_path / "out"))
    rows = warc.read_warc(spark.read.format("binaryFile").load(str(tmp_path / "out"))).collect()
    assert len(rows) == 3 and all(r.valid and r.record_type == "response" for r in rows)


def test_revisits_are_held_against_their_response(spark):
    page = b"<p>" + b"text " * 300
    made = [warc.record("1", "u", page, None), *(warc.record(str(i), "u", page, "1") for i in range(2, 6)), warc.record("6", "u", b"other", "1"), warc.record("7", "u", page, "9")]
    records = warc.read_warc(spark.createDataFrame([("a", b"".join(made))], "path string, content binary"))
    assert sorted((r.refers_to, r.n) for r in warc.unresolved_revisits(records).collect()) == [("1", 1), ("9", 1)]
    assert warc.unresolved_revisits(records.where("record_id < '6'")).isEmpty()


def test_pairs_of_a_busy_id_are_dealt_in_blocks(spark, monkeypatch):
    """A third of all pairs on one id: its text comes once for each block, and every pair meets it once."""
    monkeypatch.setattr(common, "HOT_LEAST", 50)
    monkeypatch.setattr(minhash, "BLOCK", 20)
    made = [(0, i) for i in range(1, 301)] + [(1, i) for i in range(2, 40)] + [(i, i + 1) for i in range(50, 600)]
    pairs, busy = minhash.spread(spark.createDataFrame(made, "a long, b long"))
    assert {r.a: (r.n, r.blocks) for r in busy.collect()} == {0: (300, 15), 1: (38, 2)}
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(700)], "a long, x string")
    met = minhash.with_first(pairs, busy, rows).collect()
    assert sorted((r.a, r.b) for r in met) == sorted(made) and all(r.x == f"t{r.a}" for r in met)
    blocks = [r.block for r in met if r.a == 0]
    assert set(blocks) == set(range(15)) and max(map(blocks.count, range(15))) <= 40
    assert all(r.block == 0 for r in met if r.a > 1)
