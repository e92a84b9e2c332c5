"""Vector code compression: a codebook for each part of the vectors, learned by filtering Lloyd rounds in whole numbers.

Every task builds a kd-tree for each part of its vectors once, with the bounding box, sum and count of each node; the
trees are settled. A round walks them from the root with the entries that may still be nearest: an entry goes where the
whole box is nearer to another, a node left with one entry gives it its cached sum and count at once, and only leaves
that are left with several compare points. Sums by entry are added up by Spark; the codebooks (parts x entries x part
length whole numbers, whatever the input) go through the driver.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaquad.llm.common import dealt, hot_from, settle
from vistaquad.llm.vectors import whole_vectors

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK, LEAF = 4096, 32  # vectors of a tree, points of a leaf
LIMIT = 1 << 22  # whole numbers beyond it could leave the range in which doubles add up exactly
WIDEST = 64  # components of a part


def _cuts(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin and end: node i covers places n*i >> level to n*(i+1) >> level."""
    return (np.arange((1 << level) + 1, dtype=np.int64) * n) >> level


def depth_of(n: int) -> int:
    return max(0, (max(n, 1) - 1).bit_length() - LEAF.bit_length() + 1)


def tree(points: np.ndarray) -> dict:
    """A kd-tree over points: their order, and low, high and sum of each node, level by level.

    Each node is halved at the median of its widest component, so where it begins follows from its number alone.
    """
    n, order = len(points), np.arange(len(points))
    for level in range(depth_of(n)):
        cuts, sorted_points = _cuts(n, level), points[order]
        widest = np.argmax(np.maximum.reduceat(sorted_points, cuts[:-1]) - np.minimum.reduceat(sorted_points, cuts[:-1]), axis=1)
        node = np.repeat(np.arange(1 << level), np.diff(cuts))
        order = order[np.lexsort((sorted_points[np.arange(n), widest[node]], node))]
    sorted_points, made = points[order], {"low": [], "high": [], "sums": []}
    for level in range(depth_of(n) + 1):
        at = _cuts(n, level)[:-1]
        for name, kind in (("low", np.minimum), ("high", np.maximum), ("sums", np.add)):
            made[name].append(kind.reduceat(sorted_points, at))
    return {"order": order, "points": sorted_points} | {k: np.concatenate(v) for k, v in made.items()}


def still_nearest(low: np.ndarray, high: np.ndarray, entries: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries may be nearest to a point of each box, of those alive, and the one nearest to the box's middle.

    An entry goes if all of the box is nearer to that one, or as near and that one's index is lower: the corner that is
    most in the entry's favour decides. All numbers are whole and below 2^53.
    """
    norms, doubled = (entries**2).sum(axis=1), low + high
    to_middle = np.where(alive, norms - doubled @ entries.T, np.inf)
    best = to_middle.argmin(axis=1)
    apart = entries[None] - entries[best][:, None]
    reach = (doubled[:, None] * apart).sum(axis=2) + ((high - low)[:, None] * np.abs(apart)).sum(axis=2)
    behind, index = norms[None] - norms[best][:, None], np.arange(len(entries))
    return alive & ((behind < reach) | ((behind == reach) & (index <= best[:, None]))), best


def assigned(tree: dict, entries: np.ndarray, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry of each point in the tree's order, sum and count by entry). seen counts whole nodes, and points compared."""
    n, k = len(tree["points"]), len(entries)
    owner, sums, counts = np.zeros(n, np.int64), np.zeros(entries.shape), np.zeros(k, np.int64)
    norms = (entries**2).sum(axis=1)
    nodes, alive, seen = np.array([0]), np.ones((1, k), bool), {} if seen is None else seen
    for level in range(depth_of(n) + 1):
        at, cuts = (1 << level) - 1 + nodes, _cuts(n, level)
        alive, best = still_nearest(tree["low"][at], tree["high"][at], entries, alive)
        one = alive.sum(axis=1) == 1
        np.add.at(sums, best[one], tree["sums"][at[one]])
        np.add.at(counts, best[one], (cuts[nodes + 1] - cuts[nodes])[one])
        for node, entry in zip(nodes[one], best[one], strict=True):
            owner[cuts[node] : cuts[node + 1]] = entry
        seen["whole"] = seen.get("whole", 0) + int(one.sum())
        nodes, alive = nodes[~one], alive[~one]
        if level == depth_of(n):
            for node, left in zip(nodes, alive, strict=True):
                own, left = slice(cuts[node], cuts[node + 1]), np.flatnonzero(left)
                points = tree["points"][own]
                owner[own] = pick = left[(norms[left] - 2 * points @ entries[left].T).argmin(axis=1)]
                np.add.at(sums, pick, points)
                np.add.at(counts, pick, 1)
                seen["compared"] = seen.get("compared", 0) + len(points) * len(left)
        nodes, alive = np.concatenate([2 * nodes, 2 * nodes + 1]), np.concatenate([alive, alive])
        if not len(nodes):
            break
    return owner, sums, counts


_TREE = {"order": np.int32, "points": np.int32, "low": np.int32, "high": np.int32, "sums": np.float64}
_TREES = "array<struct<" + ",".join(f"{k}:binary" for k in _TREE) + ">>"


def _matrix(column, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _blocks(parts: int, length: int, scale: int):
    """Rows (id, vector, label) to one row for each BLOCK of them: ids, labels and a tree for each part."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                own = batch.slice(at, BLOCK)
                whole = np.floor(_matrix(own.column(1), length) * scale)
                if np.abs(whole).max() > LIMIT:
                    raise ValueError(f"a component times {scale} is beyond {LIMIT}: errors would not be exact")
                trees = [{k: np.ascontiguousarray(v, _TREE[k]).tobytes() for k, v in tree(part).items()} for part in np.split(whole, parts, axis=1)]
                lists = [pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), own.column(i)) for i in (0, 2)]
                kind = pa.list_(pa.struct([(k, pa.binary()) for k in _TREE]))
                yield pa.RecordBatch.from_arrays([*lists, pa.array([trees], kind)], ["ids", "labels", "trees"])

    return run


def _read(trees: list, width: int) -> list:
    kept = lambda k, v: np.frombuffer(v, _TREE[k]) if k == "order" else np.frombuffer(v, _TREE[k]).astype(float).reshape(-1, width)
    return [{k: kept(k, v) for k, v in t.items()} for t in trees]


def _totals(codebooks: np.ndarray):
    """Sums and counts by part and entry over all trees of a task."""

    def run(batches):
        parts, k, width = codebooks.shape
        sums, counts = np.zeros(codebooks.shape), np.zeros((parts, k), np.int64)
        for batch in batches:
            for trees in batch.column(0):
                for p, one in enumerate(_read(trees.as_py(), width)):
                    _, s, n = assigned(one, codebooks[p])
                    sums[p] += s
                    counts[p] += n
        for p, e in zip(*np.nonzero(counts), strict=True):
            yield pa.RecordBatch.from_pylist([{"part": int(p), "entry": int(e), "n": int(counts[p, e]), "sums": [int(x) for x in sums[p, e]]}], pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    return run


def _coded(codebooks: np.ndarray):
    """id, label, code and error of each vector."""

    def run(batches):
        parts, _, width = codebooks.shape
        for batch in batches:
            for ids, labels, trees in zip(*batch.columns, strict=True):
                codes, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids))
                for p, one in enumerate(_read(trees.as_py(), width)):
                    owner = assigned(one, codebooks[p])[0]
                    codes[one["order"], p] = owner
                    error[one["order"]] += ((one["points"] - codebooks[p][owner]) ** 2).sum(axis=1)
                text = codes.tobytes().hex()
                shown = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(shown, pa.string()), pa.array(error.astype(np.int64))], ["id", "label", "code", "error"])

    return run


def compressed(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) of each whole vector (settled), and the codebooks as an array parts x entries x components.

    A component x counts as floor(scale * x); vectors are cut into equal consecutive parts. A part's codebook begins as
    that part of the vectors of the smallest ids (ties: by vector; null ids come last), fewer than `entries` if there are
    fewer vectors. Each round gives every part to the nearest entry (squared distance, ties to the lower index) and
    replaces an entry by the floor of its parts' mean; an entry without parts stays. code has two hex digits a part, error
    is the sum of squared distances.

    Left out: vectors that are null or hold null or non-finite components, and those not of the length that most have
    (see whole_vectors; it must be a multiple of parts). Repeated rows count and are returned as often as they occur. Null
    ids are kept. An empty table has no rows and codebooks without entries. A scaled component beyond 2^22 or a part of
    more than 64 components is an error, for sums would not be exact. Other columns are not looked at.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code holds up to 256 entries")
    spark = rows.sparkSession
    label = F.col(label_column) if label_column else F.lit(None).cast("int")
    kept, length = whole_vectors(rows.withColumn("_label", label), id_column, vector_column, F.col("_label").alias("label"), multiple=parts)
    kind, width = kept.schema["label"].dataType.simpleString(), length // parts
    if width > WIDEST:
        raise ValueError(f"a part has {width} components, {WIDEST} at most")
    if not length:
        return kept.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()  # at most 256 rows
    codebooks = np.stack(np.split(np.floor(np.array([r[0] for r in first]) * scale), parts, axis=1))
    blocks = settle(kept.select("id", "vector", "label").mapInArrow(_blocks(parts, length, scale), f"ids array<long>, labels array<{kind}>, trees {_TREES}"), "trees")
    for _ in range(rounds):
        sums = blocks.select("trees").mapInArrow(_totals(codebooks), "part int, entry int, n long, sums array<long>")
        total = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)))
        codebooks = codebooks.copy()
        for r in total.collect():  # a row for each entry at most
            codebooks[r.part, r.entry] = [r[f"s{i}"] // r.n for i in range(width)]
    coded = blocks.mapInArrow(_coded(codebooks), f"id long, label {kind}, code string, error long")
    return settle(coded, "codes"), codebooks


def restored(codes: DataFrame, codebooks: np.ndarray, scale: int = SCALE) -> DataFrame:
    """(id, vector) from (id, code): the entries that the code names, over scale."""
    parts = codebooks.shape[0]

    def run(batches):
        for batch in batches:
            named = np.frombuffer(bytes.fromhex("".join(batch.column(1).to_pylist())), np.uint8).reshape(-1, parts)
            found = np.concatenate([codebooks[p][named[:, p]] for p in range(parts)], axis=1) / scale
            offsets = pa.array(np.arange(0, found.size + 1, max(found.shape[1], 1), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], ["id", "vector"])

    return codes.select("id", "code").mapInArrow(run, "id long, vector array<double>")


def compression_query(embeddings: DataFrame) -> DataFrame:
    """op11: the error of equal labels is summed by label; labels of many rows are joined by broadcast."""
    codes, codebooks = compressed(embeddings, label_column="label")
    text = ",".join(str(int(x)) for x in codebooks.ravel())
    keyed = codes.select("*", F.coalesce(F.col("label").cast("string"), F.lit("")).alias("of"), F.col("label").isNull().alias("none"))
    sums = settle(keyed.groupBy("of", "none").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "errors")
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = dealt(keyed, sums, ["of", "none"], hot_from(total))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def _compression_sql() -> str:
    """Rounds written out: g0 is the first codebook, a<i> the assignments, g<i + 1> the next codebook."""
    steps = [
        "kept as (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings where embedding is not null and len(embedding) > 0 and len(embedding) % 4 = 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        "parts as materialized (select vec_id, label, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] as w from kept, unnest(range(4)) as t(p))",
        "g0 as materialized (select p, e, w as c, list_dot_product(w, w) as cc from (select p, w, row_number() over (partition by p order by vec_id, w) - 1 as e from parts) where e < 256)",
    ]
    for i in range(5):
        steps.append(f"a{i} as materialized (select vec_id, label, parts.p as p, w, list_dot_product(w, w) as ww, min({{'d': cc - 2 * list_dot_product(w, c), 'e': e}}) as s from parts join g{i} on parts.p = g{i}.p group by all)")
        if i < 4:
            steps.append(f"m{i} as (select p, e, list(floor(m) order by k) as c from (select p, s.e as e, k, sum(w[k]) / count(*) as m from a{i}, unnest(range(1, len(w) + 1)) as t(k) group by all) group by p, e)")
            steps.append(f"g{i + 1} as materialized (select p, e, c, list_dot_product(c, c) as cc from (select g{i}.p as p, g{i}.e as e, coalesce(m{i}.c, g{i}.c) as c from g{i} left join m{i} on g{i}.p = m{i}.p and g{i}.e = m{i}.e))")
    steps.append("coded as (select vec_id, label, string_agg(printf('%02x', s.e), '' order by p) as code, sum(ww + s.d)::bigint as error from a4 group by all)")
    steps.append("book as (select sha256(string_agg(array_to_string(list_transform(c, lambda x: x::bigint), ','), ',' order by p, e)) as h from g4)")
    return f"with {', '.join(steps)} select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, h as codebooks_sha256 from coded, book"


COMPRESSION_SQL = _compression_sql()
