"""The toxicity model: both kinds of error at 0.5 over samples and seeds, and scores against a plain version."""

import math
import zlib
from pathlib import Path

import brute
import numpy as np
import pytest
import xxhash

from vistaquad.llm import toxicity
from vistaquad.llm.common import MIX, table

LARGER = "/root/testdata/sf0.1"
M = (1 << 64) - 1


@pytest.fixture(scope="module")
def bags(spark):
    rows = table(spark, LARGER, "labels").join(table(spark, LARGER, "documents"), "doc_id").select("doc_id", "toxic", "text").orderBy("doc_id").collect()
    held = np.array([zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows])
    return [toxicity.bag((r.text or "").encode()) for r in rows], np.array([r.toxic for r in rows]), held


@pytest.mark.skipif(not Path(LARGER).exists(), reason="no test tables")
@pytest.mark.parametrize(("size", "seed", "caught", "clean"), [(1000, 1, 0.6, 0.8), (1000, 2, 0.6, 0.8), (2500, 3, 0.8, 0.9), (4000, 7, 0.8, 0.9)])
def test_both_errors_at_one_half(bags, size, seed, caught, clean):
    found, labels, held = bags
    own = np.sort(np.random.default_rng(seed).permutation(np.flatnonzero(~held))[:size])
    model = toxicity.train([found[i] for i in own], labels[own], seed)
    toxic = np.array([model.margin(*found[i]) >= 0 for i in np.flatnonzero(held)])
    assert toxic[labels[held] == 1].mean() >= caught and (~toxic[labels[held] == 0]).mean() >= clean


def plain_score(model, text: bytes) -> float:
    """The model's formula, word by word and n-gram by n-gram."""
    words = brute.alnum_words(text.decode())
    total: dict = {}
    for word in set(words):
        share = words.count(word) / len(words)
        share = share if share <= toxicity.SHARE else math.sqrt(share * toxicity.SHARE)
        marked = f"<{word}>"
        own = [xxhash.xxh3_64_intdigest(word.encode()) >> (64 - toxicity.BITS)]
        for n in range(toxicity.NGRAMS[0], toxicity.NGRAMS[1] + 1):
            for i in range(len(marked) - n + 1):
                h = 0
                for c in marked[i : i + n]:
                    h = (h * MIX + ord(c)) & M
                h = (h + n - 1) & M
                h ^= h >> 32
                h = h * 0xD6E8FEB86659FD93 & M
                own.append((h ^ h >> 29) >> (64 - toxicity.BITS))
        for b in own:
            total[b] = total.get(b, 0) + share / len(own)
    x = {b: v * float(model.rarity[b]) for b, v in total.items()}
    size = math.sqrt(sum(v * v for v in x.values())) or 1
    vector = sum((v / size * model.table[b].astype(float) for b, v in x.items()), np.zeros(model.table.shape[1]))
    logits = vector @ model.softmax + model.bias
    return 1 / (1 + math.exp(logits[0] - logits[1]))


def test_scores_equal_the_plain_version():
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["plain", "words", "Grüße", "東京", "nasty" if i % 3 == 0 else "nice", f"w{i % 40}"], 30)) for i in range(200)]
    model = toxicity.train([toxicity.bag(t.encode()) for t in texts], np.array([int("nasty" in t) for t in texts]))
    for text in [*texts[:20], "", "nastily", "ONE one One", brute.BODY]:
        assert abs(model.score([text.encode()])[0] - plain_score(model, text.encode())) < 1e-5
