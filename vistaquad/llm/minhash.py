"""Near duplicates by MinHash: universal hash minima, banding, signature verification, confirmation on full sets,
and connected components by alternating large-star and small-star.

Which links matter. Documents with equal shingle sets are one class, represented by its smallest id. Between classes a
link is needed only where it joins two components, so no step emits all pairs of a bucket:

1. each bucket's smallest id is compared with its members (as many pairs as rows);
2. of buckets that still span components, each member outside the largest one proposes its best partners elsewhere;
3. of buckets that still span components, each member that had more such partners than it proposed asks again: every pair
   across components whose signatures agree well enough is judged on full sets inside the bucket, until its components are
   joined. Members that had no more have had all their pairs judged.

Signatures only rule pairs out, by a margin of MARGIN standard deviations; every link is confirmed on full sets.
In 2 the members outside a bucket's largest component, in 3 those that ask again, meet all its members, both dealt out in
blocks of at most BLOCK, so no task holds an unbounded group, and a bucket with few stragglers costs little however many it
holds. What is known of a member is joined to it once, before it is dealt out.

The driver plans and schedules every exchange, so none is made for nothing: a step that nobody takes part in is left out,
joins are split by hot keys only where there are some, and components grow from those that are known.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaquad.llm.common import WordHashes, dealt, hot_from, hot_in, settle, shingle_hashes, space_words, utf8

ROWS = 6  # hash minima in a band
MARGIN = 4.5
BLOCK = 1000  # members of a bucket that meet as many stragglers in one group
BLOCK_SHINGLES = 4_000_000  # or their shingles, if those are more


def bands_for(similarity: float, rows: int = ROWS, miss: float = 1e-7) -> int:
    """As many bands as make a pair at the threshold share none with probability below miss."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def coefficients(count: int) -> tuple:
    rng = np.random.default_rng(20_240_501)
    a = rng.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], rng.integers(0, 1 << 63, count, dtype=np.uint64)[:, None]


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each universal hash a * x + b mod 2^64 over the shingles, in blocks; its upper bits."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        x = a * shingles[None, at : at + 1024]
        x += b
        np.minimum(least, x.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _signer(k: int, bands: int, rows: int):
    def run(batches):
        words, (a, b) = WordHashes(), coefficients(bands * rows)
        salt = np.arange(bands, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n, keys, values, signatures = [], [], [], []
                for text in part.column(1).to_pylist():
                    own = np.unique(shingle_hashes(words.of(space_words(text)), k))
                    n.append(len(own))
                    if not len(own):
                        keys.append(None), values.append([]), signatures.append(b"")
                        continue
                    keys.append(xxhash.xxh3_128_digest(own))
                    m = minima(own, a, b)
                    h = salt.copy()
                    for j in m.reshape(bands, rows).T.astype(np.uint64):
                        h = (h ^ j) * np.uint64(0x9FB21C651E98DF25)
                        h ^= h >> np.uint64(31)
                    values.append(h.view(np.int64))
                    signatures.append(m.astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(values, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
                    ["id", "text_key", "n", "set_key", "bands", "signature"],
                )

    return run


def signatures(docs: DataFrame, id_column: str, text_column: str, k: int, bands: int, rows: int = ROWS) -> DataFrame:
    """id, text_key (a hash of the text), n (distinct shingles), set_key (equal for equal sets; null for none), bands (a
    hash of each), signature."""
    rows_in = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), utf8(text_column).alias("text"), F.xxhash64(utf8(text_column)).alias("text_key"))
    return rows_in.mapInArrow(_signer(k, bands, rows), "id long, text_key long, n long, set_key binary, bands array<long>, signature binary")


def _agreement(count: int):
    """Share of equal minima of two signatures, as a column."""

    @F.pandas_udf("double")
    def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        x = np.frombuffer(b"".join(a), "<u2").reshape(-1, count)
        y = np.frombuffer(b"".join(b), "<u2").reshape(-1, count)
        return pd.Series((x == y).mean(axis=1))

    return agreement


def _confirmer(k: int, percent: int):
    """Pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches):
        words = WordHashes()
        recent: dict = {}

        def own(i, text):
            if i not in recent:
                if len(recent) >= 256:
                    recent.clear()
                recent[i] = np.unique(shingle_hashes(words.of(space_words(text)), k))
            return recent[i]

        for batch in batches:
            linked = []
            a, b, ta, tb = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                x, y = own(a[i].as_py(), ta[i].as_py()), own(b[i].as_py(), tb[i].as_py())
                common = len(x) + len(y) - len(np.union1d(x, y))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def spread(pairs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """pairs (a, b), settled, with a block (by b) of the pairs of one a; and busy: of each a of more than BLOCK pairs, n (how
    many) and blocks, of about BLOCK pairs; None if there is none. So no task has to hold all pairs of an id that very many
    others meet."""
    count = pairs.groupBy("a").agg(F.count("*").alias("n"))
    busy = settle(count.where(F.col("n") > BLOCK).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "busy")
    total = busy.agg(F.sum("n")).first()[0]
    if total is None:
        return pairs.select("a", "b", F.lit(0).alias("block")), None
    hot = hot_from(total)
    block = F.pmod(F.xxhash64("b"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block")
    if hot <= BLOCK:  # every busy id is hot, so they are few (see HOT_KEYS), and no pair is shuffled
        return pairs.select("a", "b").join(F.broadcast(busy), "a", "left").select("a", "b", block), busy
    return dealt(pairs.select("a", "b"), busy, ["a"], hot, "left").select("a", "b", block), busy


def with_first(pairs: DataFrame, busy: DataFrame | None, rows: DataFrame) -> DataFrame:
    """pairs (a, b, block) joined with what rows (a, more) hold of a, of which there is a copy for each block."""
    if busy is None:
        return pairs.join(rows, "a")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block")
    return pairs.join(rows.join(busy.select("a", "blocks"), "a", "left").select(*rows.columns, copies), ["a", "block"])


def confirmed(pairs: DataFrame, busy: DataFrame | None, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that hold on full sets. pairs, busy: see spread; texts: id, text."""
    one, other = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return with_first(pairs.join(other, "b"), busy, one).select("a", "b", "ta", "tb").mapInArrow(_confirmer(k, percent), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b), settled: id and component, its smallest id, for every id that has a link.

    Large-star joins each node's larger neighbours to its smallest one, small-star its smaller ones; in turn, until nothing
    but stars is left. Both aggregate before they shuffle, and each round is settled. Small-star reads large-star twice, so
    that has as few exchanges and scans as can be: both ways of a link come from one row, and links that it repeats are
    left to small-star.
    """

    def star(edges: DataFrame, larger: bool) -> DataFrame:
        both = lambda *ends: F.explode(F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in ends))).alias("e")
        around = edges.select(both(("u", "v"), ("v", "u"))).select("e.*") if larger else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        joined = around.join(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "u")
        if larger:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return joined.select(both(("v", "m"), ("u", "m"))).select("e.*").where("u <> v").distinct()

    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    while True:
        edges = settle(star(star(edges, True), False), "edges")
        # Each link leads from the larger id to the smaller: stars, if nobody has two links down, or one down and one up.
        end = lambda name, down: F.struct(F.col(name).alias("id"), F.lit(down).alias("down"), F.lit(1 - down).alias("up"))
        ends = edges.select(F.explode(F.array(end("u", 1), end("v", 0))).alias("e")).select("e.*")
        if not ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up")).agg(F.count_if(F.expr("down > 1 or down > 0 and up > 0"))).first()[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _sides(frame: pd.DataFrame, count: int) -> tuple:
    """Of one bucket's pair of blocks: ids, components, sizes and signatures, which rows are stragglers (those that look for
    partners), and which rows they meet. A straggler may stand in both."""
    ids, sizes = (frame[c].to_numpy() for c in ("id", "n"))
    _, comps = np.unique(frame["component"].to_numpy(), return_inverse=True)
    sig = np.frombuffer(b"".join(frame["signature"]), "<u2").reshape(-1, count)
    straggler = frame["straggler"].to_numpy()
    return ids, comps, sizes, sig, np.flatnonzero(straggler), np.flatnonzero(~straggler)


def _proposer(count: int, cut: float, percent: int, best: int):
    """For one bucket's pair of blocks: the pairs (a, b) of each straggler with its `best` likeliest partners in other
    components; and a row with the bucket's band and value, and in a the id, of each that has more partners than that."""

    def run(key, frame):
        ids, comps, sizes, sig, a_side, b_side = _sides(frame, count)
        out, more = [], []
        for i in a_side:
            to = b_side[comps[b_side] != comps[i]]
            to = to[100 * np.minimum(sizes[to], sizes[i]) >= percent * np.maximum(sizes[to], sizes[i])]
            share = (sig[to] == sig[i]).mean(axis=1)
            ok = np.flatnonzero(share >= cut)
            hit = ids[to[ok[np.argsort(-share[ok], kind="stable")[:best]]]]
            out.append(np.stack([np.minimum(hit, ids[i]), np.maximum(hit, ids[i])]))
            if len(ok) > best:
                more.append(ids[i])
        a, b = np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)
        pairs = pd.DataFrame({"a": a, "b": b, "band": None, "value": None})
        return pd.concat([pairs, pd.DataFrame({"a": more, "b": None, "band": key[0], "value": key[1]})]).astype({"a": "Int64", "b": "Int64", "band": "Int32", "value": "Int64"})

    return run


def _finisher(count: int, cut: float, percent: int, k: int):
    """For one bucket's pair of blocks: links on full sets that join components; all pairs across components are judged.

    A pair is left to the first band whose bucket it shares, and passed over once its components are joined here.
    """

    def run(key, frame):
        band = int(key[0])
        ids, comps, sizes, sig, a_side, b_side = _sides(frame, count)
        values = np.stack(frame["bands"].to_list())
        words, texts, sets = WordHashes(), frame["text"].to_list(), {}

        def own(i):
            if i not in sets:
                sets[i] = np.unique(shingle_hashes(words.of(space_words(texts[i])), k))
            return sets[i]

        a_out, b_out = [], []
        for i in a_side:
            to = b_side[comps[b_side] != comps[i]]
            to = to[100 * np.minimum(sizes[to], sizes[i]) >= percent * np.maximum(sizes[to], sizes[i])]
            if not len(to):
                continue
            share = (sig[to] == sig[i]).mean(axis=1)
            ok = np.flatnonzero((share >= cut) & ((values[to] == values[i]).argmax(axis=1) == band))
            for j in to[ok[np.argsort(-share[ok], kind="stable")]]:
                if comps[i] != comps[j]:
                    x, y = own(i), own(j)
                    common = len(x) + len(y) - len(np.union1d(x, y))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        comps[comps == comps[j]] = comps[i]
                        a_out.append(min(ids[i], ids[j])), b_out.append(max(ids[i], ids[j]))
        return pd.DataFrame({"a": np.array(a_out, np.int64), "b": np.array(b_out, np.int64)})

    return run


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n (distinct k-word shingles), component (the smallest id that links reach), all long.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a text of fewer than k words is one shingle. Documents are
    linked if 100 * intersection >= percent * union of their sets. Null or empty texts and texts of white space have no
    shingles and no links. Rows with a null id are left out; a repeated row gives a repeated result. Rows of one id are
    one document, so they count as linked; of different texts, the one of least hash is held against those of other ids.
    Other columns are not looked at. An empty table gives an empty result.
    """
    similarity, rows = percent / 100, ROWS
    bands = bands_for(similarity)
    cut = similarity - MARGIN * math.sqrt(similarity * (1 - similarity) / (bands * rows))
    signed = settle(signatures(docs, id_column, text_column, k, bands), "signed")
    classes = settle(signed.where("set_key is not null").groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    own = signed.join(classes, (F.col("id") == F.col("rep")) & (signed.set_key == classes.set_key), "left_semi")
    least = F.min_by(F.struct("text_key", "n", "bands", "signature"), F.struct("text_key", "set_key")).alias("r")
    reps = settle(own.groupBy("id").agg(least).select("id", "r.*"), "reps")

    # Buckets that hold two classes or more.
    rows_of = reps.select("id", "n", F.posexplode("bands").alias("band", "value"))
    bucket = ["band", "value"]
    shared = settle(rows_of.groupBy(*bucket).agg(F.count("*").alias("members"), F.min(F.struct("id", "n")).alias("pivot")).where("members > 1"), "shared")
    hot = hot_in(shared, "members")
    buckets = settle(dealt(rows_of, shared, bucket, hot, n="members").select(*bucket, "members", "id", "n", F.col("pivot.id").alias("pivot"), F.col("pivot.n").alias("pivot_n")), "buckets")
    sigs = settle(reps.select("id", "text_key", "signature", "bands").join(buckets.select("id").distinct(), "id", "left_semi"), "signatures")
    texts = docs.select(F.col(id_column).cast("long").alias("id"), utf8(text_column).alias("text"), F.xxhash64(utf8(text_column)).alias("text_key"))
    texts = settle(texts.join(sigs.select("id", "text_key"), ["id", "text_key"], "left_semi").select("id", "text").dropDuplicates(["id"]), "texts")
    sigs = sigs.drop("text_key")

    # 1. Each bucket's smallest id against its members.
    fits = F.least("n", "pivot_n") * 100 >= F.greatest("n", "pivot_n") * percent
    stars, busy = spread(settle(buckets.where((F.col("id") != F.col("pivot")) & fits).select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "met"))
    agreement = _agreement(bands * rows)
    stars = with_first(stars.join(sigs.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b"), busy, sigs.select(F.col("id").alias("a"), F.col("signature").alias("sa")))
    tested = settle(stars.where(agreement("sa", "sb") >= cut).select("a", "b", "block"), "stars")
    links = settle(confirmed(tested, busy, texts, k, percent), "links")
    reached = components(links)

    # 2 and 3. What the stars left apart; the smallest id has met all the others of its bucket.
    def apart(among: DataFrame, asking: DataFrame | None = None) -> DataFrame:
        """The rows of among (band, value, id, n) in buckets that still span components, settled, with straggler and the
        number of blocks of stragglers and of all members. Stragglers are the rows of asking (band, value, id), else those
        outside a bucket's largest component; a bucket without any is left out."""
        named = among.select(*bucket, "id", "n").join(reached, "id", "left").select(*bucket, "id", "n", F.coalesce("component", "id").alias("component"))
        asks = F.lit(False) if asking is None else F.coalesce("asks", F.lit(False))
        if asking is not None:
            named = named.join(asking.withColumn("asks", F.lit(True)), [*bucket, "id"], "left")
        named = settle(named.withColumn("asks", asks), "named")
        by_component = named.groupBy(*bucket, "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.count_if("asks").alias("q"), F.sum(F.when(F.col("asks"), F.col("n")).otherwise(0)).alias("t"))
        held = by_component.groupBy(*bucket).agg(F.count("*").alias("k"), F.sum("c").alias("members"), F.sum("s").alias("size"), F.sum("q").alias("q"), F.sum("t").alias("t"), F.max(F.struct("c", "s", "component")).alias("main"))
        blocks = lambda c, s: F.ceil(F.greatest(c / F.lit(BLOCK), s / F.lit(BLOCK_SHINGLES))).cast("int")
        members, size, main = F.col("members"), F.col("size"), F.col("main")
        few = (members - main["c"], size - main["s"]) if asking is None else (F.col("q"), F.col("t"))
        open_ = held.where((F.col("k") > 1) & (few[0] > 0)).select(*bucket, "members", main["component"].alias("largest"), blocks(*few).alias("l_blocks"), blocks(members, size).alias("r_blocks"))
        found = dealt(named, settle(open_, "open"), bucket, hot, n="members")
        return settle(found.withColumn("straggler", F.col("component") != F.col("largest") if asking is None else F.col("asks")).drop("asks", "largest"), "apart")

    def meetings(placed: DataFrame, known: DataFrame) -> DataFrame:
        """A row for each pair of blocks (l of stragglers, r of all members) that a member takes part in, with what is known
        (id and more) of it."""
        at = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        every = lambda n, place: F.transform(F.sequence(F.lit(0), F.col(n) - 1), place)
        place = lambda l, r, straggler: F.struct(l.alias("l"), r.alias("r"), F.lit(straggler).alias("straggler"))  # noqa: E731, E741
        one, other = every("r_blocks", lambda r: place(at("l_blocks"), r, True)), every("l_blocks", lambda l: place(l, at("r_blocks"), False))  # noqa: E741
        dealt_out = F.when(F.col("straggler"), F.concat(one, other)).otherwise(other)
        met = placed.join(known, "id").withColumn("place", F.explode(dealt_out))
        return met.select(*bucket, "place.*", "id", "n", "component", *(c for c in known.columns if c != "id"))

    group, count = [*bucket, "l", "r"], bands * rows
    left = apart(buckets.where("members > 2 and id <> pivot"))
    more = lambda new: components(reached.select(F.col("id").alias("a"), F.col("component").alias("b")).union(new)) if not new.isEmpty() else reached
    naming = asks = 0
    if not left.isEmpty():
        proposed = meetings(left, sigs.drop("bands")).groupBy(*group).applyInPandas(_proposer(count, cut, percent, 4), "a long, b long, band int, value long")
        proposed = settle(proposed.distinct(), "proposed")
        naming, asks = proposed.agg(F.count_if(F.col("band").isNull()), F.count_if(F.col("band").isNotNull())).first()
    if naming:
        pairs = settle(proposed.where("band is null").select("a", "b").join(tested, ["a", "b"], "left_anti"), "proposed")
        reached = more(settle(confirmed(*spread(pairs), texts, k, percent), "links"))
    if asks:
        # Components only grow, so no other bucket spans several; and every pair not judged yet has an end that asks again.
        asking = proposed.where("band is not null").select(*bucket, F.col("a").alias("id"))
        finished = meetings(apart(left, asking), sigs.join(texts, "id")).groupBy(*group).applyInPandas(_finisher(count, cut, percent, k), "a long, b long")
        reached = more(settle(finished.distinct(), "links"))

    by_rep = settle(classes.join(reached, F.col("rep") == F.col("id"), "left").select("set_key", "copies", F.coalesce("component", "rep").alias("component")), "by_rep")
    return dealt(signed.select("id", "n", "set_key"), by_rep, ["set_key"], hot_in(by_rep, "copies"), "left", n="copies").select("id", "n", F.coalesce("component", "id").alias("component"))


def near_duplicate_query(docs: DataFrame) -> DataFrame:
    """op1: three-word shingles, 85 in 100."""
    found = near_duplicates(docs, k=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
