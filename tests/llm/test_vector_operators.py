"""Vector codes and nearest neighbours against plain versions and SQL, and on awkward tables."""

from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaquad.llm import codes, neighbours
from vistaquad.llm.common import table
from vistaquad.llm.vectors import whole_vectors

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.1"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
SCHEMA = "vec_id long, embedding array<double>, label int, id string, vector int, code int, n long, shard int, q long"
MORE = ("x", 1, 2, 3, 4, 5)


def rows_of(spark, vectors, labels=None):
    """A table of vectors by id, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, labels[i % len(labels)] if labels else None, *MORE) for i, v in vectors], SCHEMA)


def random_vectors(n, dim=16, seed=1):
    return [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(seed).normal(size=(n, dim)))]


def plain_lloyd(vectors, parts=4, entries=256, rounds=4):
    """{id: (code, error)} and codebooks, one part after the other."""
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in vectors}
    width, out, books = len(vectors[0][1]) // parts, {i: ["", 0] for i in whole}, []
    for p in range(parts):
        own = {i: v[p * width : (p + 1) * width] for i, v in whole.items()}
        book = [own[i] for i in sorted(own)[:entries]]

        def nearest(v, book=book):
            return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))

        for _ in range(rounds):
            got = {}
            for v in own.values():
                got.setdefault(nearest(v)[1], []).append(v)
            for e, mine in got.items():
                book[e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
        for i, v in own.items():
            d, e = nearest(v)
            out[i][0] += f"{e:02x}"
            out[i][1] += d
        books.append(book)
    return {i: tuple(v) for i, v in out.items()}, books


def test_codes_against_plain(spark):
    vectors = random_vectors(600)
    got, books = codes.compressed(rows_of(spark, vectors), label_column="label", entries=40)
    want, plain = plain_lloyd(vectors, entries=40)
    assert {r.id: (r.code, r.error) for r in got.collect()} == want
    assert books.astype(int).tolist() == plain


def test_codes_with_clusters_ties_and_copies(spark):
    """Close clusters, for which whole subtrees are given away, copies that share a code, and equal first entries."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-3, 4, size=(5, 8))
    vectors = [(i, [float(x) for x in centres[i % 5] + (rng.integers(-1, 2, size=8) / 1024 if i > 400 else 0)]) for i in range(3000)]
    got, books = codes.compressed(rows_of(spark, vectors), entries=16)
    want, plain = plain_lloyd(vectors, entries=16)
    assert {r.id: (r.code, r.error) for r in got.collect()} == want
    assert books.astype(int).tolist() == plain


def test_boxes_eliminate_and_whole_subtrees_are_assigned():
    rng = np.random.default_rng(5)
    centres = rng.integers(-2000, 2000, size=(20, 16))
    points = (centres[rng.integers(0, 20, 4096)] + rng.integers(-20, 20, size=(4096, 16))).astype(float)
    seen, tree = {}, codes.tree(points)
    owner, sums, counts = codes.assigned(tree, centres.astype(float), seen)
    want = ((tree["points"][:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (owner == want).all() and counts.sum() == 4096 and (sums.sum(axis=0) == points.sum(axis=0)).all()
    assert seen["whole"] > 0 and seen.get("compared", 0) < 0.25 * points.shape[0] * 20


@pytest.mark.parametrize("n", [1, 2, 31, 32, 33, 65, 4096])
def test_trees_of_any_size(n):
    points = np.random.default_rng(n).integers(-9, 9, size=(n, 3)).astype(float)
    entries = points[: min(n, 7)]
    tree = codes.tree(points)
    owner, _, counts = codes.assigned(tree, entries)
    assert sorted(tree["order"]) == list(range(n)) and counts.sum() == n
    assert (owner == ((tree["points"][:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


AWKWARD = [(1, None), (2, []), (3, [1.0, None, 2.0, 3.0]), (4, [1.0, float("nan"), 0.0, 0.0]), (5, [float("inf"), 0.0, 0.0, 0.0]), (6, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0]), (20, [0.0, 0.0, 0.0, 0.0]), (40, [0.5, -0.5, 0.25, 1.0]), (40, [0.5, -0.5, 0.25, 1.0]), (60, [0.5, -0.5, 0.25, 1.0])]


def test_codes_of_awkward_rows(spark):
    got, _ = codes.compressed(rows_of(spark, AWKWARD))
    assert sorted((r.id is None, r.id or 0, r.error) for r in got.collect()) == [(False, 20, 0), (False, 40, 0), (False, 40, 0), (False, 60, 0), (True, 0, 0)]
    back = {tuple(r.vector) for r in codes.restored(*codes.compressed(rows_of(spark, AWKWARD))).where("id = 40").collect()}
    assert back == {(0.5, -0.5, 0.25, 1.0)}
    for none in (rows_of(spark, AWKWARD[:2]), rows_of(spark, []), rows_of(spark, [(1, [1.0, 2.0, 3.0])])):
        assert codes.compression_query(none).count() == 0
        assert codes.compression_query(none).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(Exception, match="exact"):
        codes.compressed(rows_of(spark, [(1, [1e9] * 4)]))


def test_label_errors_with_hot_and_null_labels(spark):
    vectors = random_vectors(2400, dim=8, seed=2)
    got = codes.compression_query(rows_of(spark, vectors, [1, None, 1, 1, 7])).toPandas()
    labels = [[1, None, 1, 1, 7][i % 5] for i in got.vec_id]
    for name in (1, None, 7):
        own = got[[x == name for x in labels]]
        assert set(own.label_error) == {own.error.sum()}


@needs_tables
def test_codes_sql(spark):
    got = codes.compression_query(table(spark, SF, "embeddings"))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.sql(codes.COMPRESSION_SQL)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


# nearest neighbours


def plain_neighbours(vectors, nearest=20):
    """{(query id, its place): [(id, product)]}"""
    out = {}
    for at, (i, q) in enumerate(vectors):
        if i % 20 == 0:
            found = sorted((-float((np.array(v) * np.array(q)).sum()), j) for j, v in vectors if j != i)
            out[i, at] = [(j, -s) for s, j in found[:nearest]]
    return out


def got_neighbours(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {i: [x[1:] for x in sorted(v)] for i, v in out.items()}


def recall(got, want):
    hits = [len({j for j, _ in got.get(i, [])} & {j for j, _ in w}) / len(w) for (i, _), w in want.items()]
    return float(np.mean(hits))


def test_whole_radius_is_exact(spark):
    vectors = random_vectors(500)
    assert got_neighbours(neighbours.neighbours(rows_of(spark, vectors), F.col("id") % 20 == 0, radius=128)) == {i: w for (i, _), w in plain_neighbours(vectors).items()}


def test_recall_with_norms_that_differ(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [x * (0.2 + 3 * rng.random()) for x in v]) for i, v in random_vectors(3000)]
    want = plain_neighbours(vectors)
    got = got_neighbours(neighbours.neighbour_query(rows_of(spark, vectors)))
    assert all(len(v) == 20 for v in got.values()) and len(got) == 150
    assert recall(got, want) >= 0.9


def test_hot_vector_and_ties(spark):
    """A third of all rows hold one vector: ties go to the smaller ids."""
    vectors = [(i, [1.0, 0.5, 0.0, 0.25] if i % 3 == 0 else v) for i, v in random_vectors(900, dim=4)]
    got = got_neighbours(neighbours.neighbour_query(rows_of(spark, vectors)))
    want = plain_neighbours(vectors)
    assert recall(got, want) >= 0.9
    assert [j for j, _ in got[0]] == [j for j, _ in want[0, 0]]


def test_neighbours_of_awkward_rows(spark):
    got = neighbours.neighbour_query(rows_of(spark, AWKWARD)).collect()
    by = sorted((r.query_id, r.rank, r.vec_id) for r in got)  # the two rows of id 40 are two queries with the one of 60, which has both
    assert by == [(40, 1, 60), (40, 1, 60), (60, 1, 40), (60, 2, 40)]
    for none in (rows_of(spark, AWKWARD[:6]), rows_of(spark, [])):
        assert neighbours.neighbour_query(none).count() == 0
    assert neighbours.neighbour_query(rows_of(spark, [(20, [1.0, 2.0])])).count() == 0


def test_short_queries_are_asked_again(spark):
    """With a radius that holds next to nothing, every query still gets its 20."""
    vectors = random_vectors(300)
    got = got_neighbours(neighbours.neighbours(rows_of(spark, vectors), F.col("id") % 20 == 0, radius=2))
    assert got == {i: w for (i, _), w in plain_neighbours(vectors).items()}


def test_pigeonhole_loses_no_code():
    rng = np.random.default_rng(6)
    found = rng.integers(0, 1 << 16, size=(2000, 8), dtype=np.uint16)
    asked = found[:50] ^ np.where(rng.random((50, 8)) < 0.5, 0, 1 << rng.integers(0, 16, size=(50, 8))).astype(np.uint16)
    places = np.argsort(found, axis=0, kind="stable").T
    for radius in (0, 3, 8, 40, 60):
        near = neighbours.probed(asked, found, places, radius)
        inside = neighbours.distances(asked[:, None], found[None]) <= radius
        assert not (inside & ~near).any()
        assert sum(s + 1 for s in neighbours.shares(radius, 8)) == radius + 1
    assert neighbours.probed(asked, found, places, 8).mean() < 0.01


@needs_tables
def test_recall_on_table(spark):
    df = table(spark, LARGER, "embeddings")
    vectors = [(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()]
    assert recall(got_neighbours(neighbours.neighbour_query(df)), plain_neighbours(vectors)) >= 0.9


def test_whole_vectors_takes_the_common_length(spark):
    kept, length = whole_vectors(rows_of(spark, AWKWARD), "vec_id", "embedding")
    assert length == 4 and kept.count() == 5
