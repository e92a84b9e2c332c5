"""Hot groups on small tables: joins by broadcast, blocks of buckets, and the bands that a pair is left to."""

import brute
import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vistaquad.llm import common, exact, minhash, suffix

SCHEMA = "doc_id long, text string"


def near_rows(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("block", [3, minhash.BLOCK])
def test_near_duplicates_in_blocks(spark, monkeypatch, block):
    """Buckets of several components, which meet in blocks of three, and hot ones."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(common, "HOT_LEAST", 5)
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(60):
        own = list(base)
        for at in rng.choice(60, i % 4, replace=False):
            own[at] = f"x{rng.integers(4)}"
        texts[i] = " ".join(own)
    texts |= {100 + i: " ".join(f"v{j + i}" for j in range(80)) for i in range(12)}
    assert near_rows(minhash.near_duplicate_query(spark.createDataFrame(list(texts.items()), SCHEMA))) == brute.near(texts, 3, 85)


def test_stragglers_that_only_meet_each_other(spark):
    """The smallest text shares buckets with all, but links with few; the others link in a chain that takes every step."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(40):
        own = list(words)
        own[5 * (i % 8) : 5 * (i % 8) + 6] = [f"z{i % 8}{j}" for j in range(6)]
        if i % 5 == 0:
            own[100 + rng.integers(50)] = f"y{i}"
        texts[i] = " ".join(own)
    texts[0] = " ".join(words[:170])
    assert near_rows(minhash.near_duplicate_query(spark.createDataFrame(list(texts.items()), SCHEMA))) == brute.near(texts, 3, 85)


def test_only_those_with_more_partners_ask_again(spark, monkeypatch):
    """Texts a little too far apart to be linked: in the last step stand only those that could not name all their partners,
    and each stands there once for a bucket before it is dealt out."""
    kept = []

    def settle(df, name="table", real=minhash.settle):
        found = real(df, name)
        kept.extend([found] if name == "apart" else [])
        return found

    monkeypatch.setattr(minhash, "settle", settle)
    texts = {}
    for group, size in enumerate((5, 5, 12)):
        for i in range(size):
            own = [f"g{group}w{j}" for j in range(200)]
            own[14 * i : 14 * i + 10] = [f"g{group}own{i}x{j}" for j in range(10)]
            texts[100 * group + i] = " ".join(own)
    got = near_rows(minhash.near_duplicate_query(spark.createDataFrame(list(texts.items()), SCHEMA)))
    assert got == brute.near(texts, 3, 85) and {c for _, c in got.values()} == set(texts)
    first, last = ([r.id for r in df.collect()] for df in kept)
    assert {i // 100 for i in first} == {0, 1, 2} and {i // 100 for i in last} == {2} and len(last) < len(first)


def test_texts_under_one_id(spark):
    """Rows of one id count as linked, the same way every time."""
    rows = [(1, brute.BODY), (1, brute.PASSAGE), (2, brute.BODY + " tail"), (3, brute.PASSAGE), (4, "something else altogether")]
    got = [sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicate_query(spark.createDataFrame(order, SCHEMA)).collect()) for order in (rows, rows[::-1])]
    assert got[0] == got[1] and {c for i, _, c in got[0] if i == 1} == {1} and len(got[0]) == 5


def test_a_pair_is_left_to_the_first_bucket_it_shares():
    """Signatures keep 16 bits of each minimum, so bands may look equal that lie in different buckets."""
    text = "one two three four five six"
    frame = pd.DataFrame({"id": [1, 2, 1, 2], "n": [4] * 4, "component": [1, 2, 1, 2], "straggler": [True, True, False, False], "text": [text.encode()] * 4})
    frame["signature"] = [np.zeros(12, "<u2").tobytes()] * 4
    frame["bands"] = [np.array([7, 9]), np.array([8, 9])] * 2
    judge = minhash._finisher(12, 0.5, 85, 3)
    assert judge((1, 9, 0, 0), frame).drop_duplicates().values.tolist() == [[1, 2]]
    frame["bands"] = [np.array([7, 9])] * 4
    assert judge((1, 9, 0, 0), frame).empty and len(judge((0, 7, 0, 0), frame)) > 0


@pytest.mark.parametrize("lengths", [0, exact.LENGTHS])
def test_exact_duplicates_of_hot_groups(spark, monkeypatch, lengths):
    monkeypatch.setattr(common, "HOT_LEAST", 4)
    monkeypatch.setattr(exact, "LENGTHS", lengths)
    texts = ["same"] * 20 + ["size"] * 3 + ["a" * 70 + x for x in "bbbbbbbcdef"] + ["", None, "alone at this length"]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.sql(exact.EXACT_SQL).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").fetchall()
    assert sorted(map(tuple, exact.exact_query(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == sorted(want)
    plain = exact.exact_duplicates(docs).collect()
    assert sorted((r.id, r.keep_id, r.group_size, r.kept) for r in plain) == sorted(w[:4] for w in want)


def test_no_local_folder_on_a_cluster():
    class Fake:
        def __init__(self, master):
            self.conf, self.sparkContext = {}, type("Context", (), {"master": master})

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Fake("spark://somewhere:7077"))
    assert common.shared_dir(Fake("local[4]"))


@pytest.mark.parametrize("hot", [3, suffix.HOT])
def test_passages_of_hot_anchors(spark, hot):
    """A phrase shorter than a window in many surroundings, and passages in many documents; nothing stays in the catalogue."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 7))
    phrase = "the very common phrase of thirty-eight"
    passage = "a passage that is well over fifty bytes long, and in many documents at once"
    texts = {}
    for i in range(60):
        around = [f"{word()} {rng.choice(['one', 'two'])}" for _ in range(3)]
        texts[i] = f"{around[0]} {phrase} {around[1]} {passage if i % 3 == 0 else ''} {phrase} {rng.choice(['same tail of it all', word()])} {around[2]}"
    found = suffix.repeated_passages(spark.createDataFrame(list(texts.items()), SCHEMA), hot=hot)
    got = {r.id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256) for r in found.collect()}
    assert got == brute.passages(texts, 50)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("vistaquad_")]


def test_contamination_by_a_hot_passage(spark, monkeypatch):
    from vistaquad.llm import decontaminate

    monkeypatch.setattr(common, "HOT_LEAST", 3)
    docs = spark.createDataFrame([(i, f"{i} {brute.PASSAGE}" if i % 4 else f"text {i}" if i % 8 else brute.PASSAGE) for i in range(40)], SCHEMA)
    items = spark.createDataFrame([("i1", brute.PASSAGE), ("i2", "text 4")], "item_id string, text string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("benchmark", items.toArrow())
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = con.sql(decontaminate.CONTAMINATION_SQL).select(*columns).fetchall()
    assert sorted(map(tuple, decontaminate.contamination_query(docs, items).select(columns).collect())) == sorted(want)


def names_settled(monkeypatch):
    names = []

    def settle(df, name="table", real=minhash.settle):
        names.append(name)
        return real(df, name)

    monkeypatch.setattr(minhash, "settle", settle)
    return names


def test_stars_take_one_round(spark, monkeypatch):
    """Links that are stars after one round need no other to see it; chains and merged stars end as before."""
    names = names_settled(monkeypatch)
    star = [(1, b) for b in range(2, 30)] + [(100, b) for b in range(101, 110)] + [(7, 7)]
    found = {(r.id, r.component) for r in minhash.components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert found == {(b, a) for a, b in star if a != b} and names == ["edges"]
    chain = [(i, i + 1) for i in range(40)] + [(50, 40), (50, 60), (61, 60), (70, 71), (71, 70)]
    found = {r.id: r.component for r in minhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 0 for i in (*range(1, 41), 50, 60, 61)} | {71: 70}
    assert minhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_steps_without_members_are_left_out(spark, monkeypatch):
    """Copies that their bucket's smallest id joins: nothing is proposed, named again or split by hot keys."""
    names = names_settled(monkeypatch)
    texts = {10 * group + i: " ".join([*(f"g{group}w{j}" for j in range(100)), *["end"] * i]) for group in range(3) for i in range(3)}
    assert near_rows(minhash.near_duplicate_query(spark.createDataFrame(list(texts.items()), SCHEMA))) == brute.near(texts, 3, 85)
    assert names.count("edges") == 1 and names.count("apart") == 1 and "proposed" not in names


def test_rounds_of_stars_plan_few_exchanges(spark, monkeypatch):
    """A round plans seven exchanges and four scans (eleven and twelve before), and repeated links and chains end right."""
    plans = []

    def settle(df, name="table", real=minhash.settle):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(minhash, "settle", settle)
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] * 2 + [(500 + i, 501 + i) for i in range(20)]
    least = {i: i for link in links for i in link if link[0] != link[1]}
    for _ in least:
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    settled = common.settle(spark.createDataFrame(links, "a long, b long"), "links")
    found = {r.id: r.component for r in minhash.components(settled).collect()}
    assert found == {i: least[i] for i in least if least[i] != i}
    assert len(plans) > 1 and all(plan.count("Exchange hashpartitioning") <= 7 and plan.count("FileScan") <= 4 for plan in plans)


def test_busy_ids_that_are_all_hot_shuffle_no_pair(spark):
    """Pairs of ids of more than BLOCK pairs are told their block where they are; every pair has one, in range."""
    pairs = spark.range(3 * minhash.BLOCK + 7).select((F.col("id") % 3).alias("a"), F.col("id").alias("b")).where("a < 2 or b < 50")
    dealt, busy = minhash.spread(common.settle(pairs.union(pairs.selectExpr("a", "b + 10000")), "met"))
    blocks = {r.a: r.blocks for r in busy.collect()}
    rows = dealt.collect()
    assert blocks == {0: 3, 1: 3} and len({(r.a, r.b) for r in rows}) == len(rows) == 2 * pairs.count()
    assert all({r.block for r in rows if r.a == a} == set(range(blocks.get(a, 1))) for a in (0, 1, 2))
    assert "Exchange hashpartitioning" not in dealt._jdf.queryExecution().executedPlan().toString()
