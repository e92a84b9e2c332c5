"""Approximate nearest neighbours by largest inner product: multi-index hashing over learned rotated binary codes.

Vectors are lengthened by one component so that the largest inner product is the smallest angle, turned by rotations that
are learned on a bounded sample (alternating signs and orthogonal fits), and cut to their signs. Codes fall into
substrings of 16 bits, and each block of vectors has an index for each substring: its vectors in order of the substring.
If two codes differ in r bits, some substring differs in no more than its share of r (pigeonhole), so the buckets within
those shares hold every code within r. What they hold is checked by the whole code and reranked by the exact products.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaquad.llm.common import settle
from vistaquad.llm.vectors import whole_vectors

BITS, SUB = 128, 16  # of a code, of a substring
SAMPLE, PROBES = 4096, 512  # vectors that rotations are learned from, and of them those whose neighbours give the radius
REACHED = 0.98  # share of the sample's neighbours that lie within the radius
BLOCK, ASKED = 8192, 1024  # vectors of an index block, queries of a block
SHARDS = 64  # groups of index blocks that each block of queries is sent to, at most


def lengthened(vectors: np.ndarray, most: float) -> np.ndarray:
    """Vectors over the largest norm with a last component that makes each of length 1."""
    scaled = vectors / most
    return np.column_stack([scaled, np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(axis=1)))])


def turned_only(vectors: np.ndarray) -> np.ndarray:
    """Queries: of length 1, nothing in the last component."""
    return np.column_stack([vectors / np.linalg.norm(vectors, axis=1, keepdims=True), np.zeros(len(vectors))])


def learned_rotations(points: np.ndarray, bits: int = BITS, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """(components x bits): main axes turned so that signs lose least, from several random turns until there are `bits`."""
    rng, axes = np.random.default_rng(seed), np.linalg.eigh(points.T @ points)[1][:, ::-1][:, :bits]
    flat, found = points @ axes, []
    while sum(x.shape[1] for x in found) < bits:
        turn = np.linalg.qr(rng.normal(size=(flat.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (u @ v).T
        found.append(axes @ turn)
    return np.concatenate(found, axis=1)[:, :bits]


def codes_of(points: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Signs as substrings: (n x bits / 16) of 16 bits each."""
    return np.packbits(points @ rotations > 0, axis=1).view(np.uint16)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def shares(radius: int, substrings: int) -> np.ndarray:
    """How many bits each substring may differ in so that none within radius is lost; -1: it needn't be looked at."""
    each, rest = divmod(radius, substrings)
    return np.where(np.arange(substrings) <= rest, each, each - 1)


def learned_radius(sample: np.ndarray, rotations: np.ndarray, most: float, nearest: int, total: int) -> int:
    """The radius that holds REACHED of the neighbours of PROBES vectors; of a sample, the nearest by its share of all."""
    probes = sample[:PROBES]
    products = probes @ sample.T
    products[np.arange(len(probes)), np.arange(len(probes))] = -np.inf
    t = min(max(1, -(-nearest * len(sample) // total)), len(sample) - 1)
    if t < 1:
        return rotations.shape[1]
    near = np.argpartition(-products, t - 1, axis=1)[:, :t]
    asked, found = codes_of(turned_only(probes), rotations), codes_of(lengthened(sample, most), rotations)
    return int(np.ceil(np.quantile(distances(asked[:, None], found[near]), REACHED)))


def _matrix(column, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _indexed(rotations: np.ndarray, most: float, length: int):
    """Rows (id, vector) to one row for each BLOCK: ids, vectors, codes, and their order by each substring."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                own = batch.slice(at, BLOCK)
                vectors = _matrix(own.column(1), length)
                codes = codes_of(lengthened(vectors, most), rotations)
                order = np.argsort(codes, axis=0, kind="stable").T.astype(np.uint16)
                ids = own.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, vectors, codes, np.ascontiguousarray(order))], ["ids", "vectors", "codes", "places"])

    return run


def _asked(rotations: np.ndarray, length: int):
    """Rows (query, id, vector) to one row for each ASKED of them."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ASKED):
                own = batch.slice(at, ASKED)
                vectors = _matrix(own.column(2), length)
                q, ids = (own.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (q, ids, vectors, codes_of(turned_only(vectors), rotations))], ["q", "q_ids", "q_vectors", "q_codes"])

    return run


def probed(asked: np.ndarray, codes: np.ndarray, places: np.ndarray, radius: int) -> np.ndarray:
    """(queries x vectors): whether some substring's bucket lies within its share of the radius."""
    near = np.zeros((len(asked), len(codes)), bool)
    for j, share in enumerate(shares(radius, codes.shape[1])):
        if share < 0:
            continue
        order, values = places[j], codes[places[j], j]
        begins = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        sizes = np.diff(np.append(begins, len(values)))
        wanted, of = np.unique(asked[:, j], return_inverse=True)
        by = np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of, minlength=len(wanted)))[:-1])
        for value, queries in zip(wanted, by, strict=True):
            inside = order[np.repeat(np.bitwise_count(values[begins] ^ value) <= share, sizes)]
            if len(inside):
                near[np.ix_(queries, inside)] = True
    return near


def best(query: np.ndarray, ids: np.ndarray, vectors: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and products of the nearest vectors; each product is summed the same way wherever its row stands."""
    products = (vectors * query).sum(axis=1)
    if len(ids) > nearest:
        keep = products >= np.partition(products, -nearest)[-nearest]
        ids, products = ids[keep], products[keep]
    order = np.lexsort((ids, -products))[:nearest]
    return ids[order], products[order]


def _searched(radius: int, nearest: int, length: int, substrings: int):
    """Pairs of a block of queries and a block of the index to (q, query_id, vec_id, score)."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                q, q_ids, q_vectors, q_codes, ids, vectors, codes, places = (batch.column(i)[row].as_py() for i in range(8))
                q, q_ids, ids = (np.frombuffer(x, np.int64) for x in (q, q_ids, ids))
                q_vectors, vectors = (np.frombuffer(x).reshape(-1, length) for x in (q_vectors, vectors))
                q_codes, codes = (np.frombuffer(x, np.uint16).reshape(-1, substrings) for x in (q_codes, codes))
                near = probed(q_codes, codes, np.frombuffer(places, np.uint16).reshape(substrings, -1), radius)
                found = []
                for i in range(len(q)):
                    c = np.flatnonzero(near[i])
                    c = c[(distances(codes[c], q_codes[i]) <= radius) & (ids[c] != q_ids[i])]
                    if len(c):
                        found.append((np.full(min(len(c), nearest), i), *best(q_vectors[i], ids[c], vectors[c], nearest)))
                if found:
                    at, own, score = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q[at], q_ids[at], own, score)], ["q", "query_id", "vec_id", "score"])

    return run


def neighbours(rows: DataFrame, asked, id_column: str = "vec_id", vector_column: str = "embedding", nearest: int = 20, bits: int = BITS, sample: int = SAMPLE, radius: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which the condition `asked` (of the column id) holds, the nearest
    rows of another id by inner product in double precision, ties to the smaller id; all of them, if there are fewer.

    Rotations and radius are learned on at most `sample` vectors; every row is indexed. `radius` sets it; at `bits` every
    code is within it and the result is exact. A query that finds fewer than `nearest` is asked again with that radius,
    so none comes back short. Blocks of queries meet blocks of the index, one pair at a time.

    Null, empty and zero vectors, those with null or non-finite components, those of another length than most have and
    rows with a null id take no part. Rows of one id with equal or different vectors are each candidates, and each of
    them is a query of its own. An empty table has no rows. Other columns are not looked at.
    """
    if bits % SUB:
        raise ValueError(f"codes are made of substrings of {SUB} bits")
    kept, length = whole_vectors(rows, id_column, vector_column)
    kept = kept.where(F.col("id").isNotNull() & F.exists("vector", lambda x: x != 0))
    schema = "q long, query_id long, vec_id long, score double"
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    total, most = kept.agg(F.count("*"), F.max(norm)).first()
    if not total:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = kept.orderBy(F.xxhash64("id"), "id", "vector").limit(sample).select("vector").collect()  # at most `sample` rows
    drawn = np.array([r[0] for r in drawn])
    rotations = learned_rotations(lengthened(drawn, most), bits)
    if radius is None:
        radius = learned_radius(drawn, rotations, most, nearest, total)
    kept = settle(kept.withColumn("q", F.monotonically_increasing_id()), "vectors")
    index = settle(kept.select("id", "vector").mapInArrow(_indexed(rotations, most, length), "ids binary, vectors binary, codes binary, places binary").withColumn("block", F.monotonically_increasing_id()), "index")
    shards = max(1, min(SHARDS, index.count()))
    index = index.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)))

    def search(queries: DataFrame, radius: int) -> DataFrame:
        blocks = queries.select("q", "id", "vector").mapInArrow(_asked(rotations, length), "q binary, q_ids binary, q_vectors binary, q_codes binary")
        pairs = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(index, "shard")
        found = pairs.select("q", "q_ids", "q_vectors", "q_codes", "ids", "vectors", "codes", "places").mapInArrow(_searched(radius, nearest, length, bits // SUB), schema)
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")))
        return settle(ranked.where(F.col("rank") <= nearest), "found")

    queries = kept.where(asked)
    found = search(queries, radius)
    if radius < bits:
        full = found.where(F.col("rank") == min(nearest, total - 1)).select("q")
        short = settle(queries.join(full, "q", "left_anti"), "short")
        if short.take(1):
            again = search(short, bits)
            found = found.join(short.select("q"), "q", "left_anti").union(again)
    return found.select("query_id", "rank", "vec_id", "score")


def neighbour_query(embeddings: DataFrame) -> DataFrame:
    """op12"""
    return neighbours(embeddings, F.col("id") % 20 == 0)
