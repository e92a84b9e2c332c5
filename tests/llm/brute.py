"""Plain versions of what the corpus operators compute, and small tables with the awkward cases."""

import hashlib
import re

PLAIN = "abcdefghijklmnopqrstuvwxyz"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(CAPITALS, PLAIN)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def space_words(text) -> list:
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def alnum_words(text) -> list:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def shingles(text, k: int) -> set:
    w = space_words(text)
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)} if w else set()


def near(docs: dict, k: int, percent: int) -> dict:
    """id: (set size, smallest id reachable)."""
    sets = {i: shingles(t, k) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= percent * (len(a) + len(b) - common):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def passages(docs: dict, size: int) -> dict:
    """id: (bytes, removed, runs, digest of what stays)."""
    first, out = {}, {}
    data = {i: (t or "").encode() for i, t in docs.items()}
    for i in sorted(data):
        for p in range(len(data[i]) - size + 1):
            first.setdefault(data[i][p : p + size], i)
    for i, d in data.items():
        gone = bytearray(len(d))
        for p in range(len(d) - size + 1):
            if first[d[p : p + size]] < i:
                gone[p : p + size] = b"\1" * size
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out[i] = (len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept))
    return out


def windows(text, size: int = 10) -> set:
    w = alnum_words(text)
    n = min(size, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def contaminated(text, items: dict) -> tuple:
    """Words, words hit, ids of items that occur."""
    w, hit, found = alnum_words(text), set(), set()
    for item, own in items.items():
        for n in {len(x) for x in own}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in own:
                    hit.update(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


LONG = " ".join(f"wort{i * 7919 % 5003} licence {i % 17}" for i in range(20_000))
PASSAGE = "The quick brown fox jumps over the lazy dog while seven wizards quietly box the jugs of liquor again."
BODY = " ".join(f"alpha{i} beta{i % 7} gamma{i}" for i in range(60))
#: Nulls, empty and white texts, ties, near copies, a very long text, other scripts, a shared passage.
TEXTS = [None, "", " \t\n ", "one", "One", "two words", PASSAGE, f"Before it. {PASSAGE} After it.", f"{PASSAGE}{PASSAGE}", BODY, BODY.replace("alpha3 ", "Alpha3 "), BODY + " tail", BODY + " another longer tail of words", LONG, LONG + " end", "Grüße, 東京! ééé — naïve", "Grüße, 東京! ééé — naïve", "This code is licensed under the MIT License. All rights reserved.", "licensed under the GNU General Public License version 3; cc by", "a" * 3000, "ab" * 900]


def tables(spark):
    """documents of TEXTS with ids (the last one null), extra columns named like the operators' own, and an empty copy."""
    names = ["n", "len", "head", "full", "id", "words", "shard", "part", "bands", "component", "signature", "spans", "runs", "items", "score", "label", "tokens", "kept", "row", "found"]
    rows = [(i * 3 + 1, t, None, f"s{i % 2}", None) + ("x",) * len(names) for i, t in enumerate(TEXTS)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema).repartition(3)
    return docs, docs.where("false")


def by_id() -> dict:
    return {i * 3 + 1: t for i, t in enumerate(TEXTS)}
