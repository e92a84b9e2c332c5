"""Whole words and quoted keys: nothing is cut before it is scored."""

import numpy as np
from pyspark.sql import functions as F

from vistaquad.llm import secrets, toxicity


def grams(word):
    found = list(toxicity.gram_blocks([word]))
    assert not any(w.any() for _, w in found)
    return np.concatenate([b for b, _ in found])


def test_grams_cover_the_whole_word():
    word = "".join(map(chr, range(0x4E00, 0x4E00 + 298))).encode()
    assert len(grams(word)) == 1 + 298 + 297 + 296
    assert not np.array_equal(grams(word), grams(word[:-3] + b"abc"))


def test_blocks_change_nothing(monkeypatch):
    text = b"abcdefghij" * 30 + b" some words some " + "Grüße, 東京".encode()
    whole = toxicity.bag(text)
    for block in (7, 400):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        found, weights = toxicity.bag(text)
        assert np.array_equal(found, whole[0]) and np.allclose(weights, whole[1])


def test_toxic_end_of_unspaced_text_counts():
    rng = np.random.default_rng(1)
    texts, labels = [], []
    for i in range(400):
        own = [f"plain{x}" for x in rng.integers(0, 200, 20)]
        if i % 4 == 0:
            own[3] = "scoundrelish"
        texts.append(" ".join(own).encode())
        labels.append(int(i % 4 == 0))
    model = toxicity.train([toxicity.bag(t) for t in texts], np.array(labels))
    start = "字" * 250
    plain, toxic = model.score([(start + "ordinary" * 20).encode(), (start + "scoundrelish" * 20).encode()])
    assert toxic > plain


def test_secrets_after_quoted_keys_and_all_names(spark):
    forms = ['{{"{0}": "hunter2xyz"}}', "'{0}' : 'hunter2xyz'", '"{0}":"hunter2xyz"', "{0}: hunter2xyz", "{0} = 'hunter2xyz'", "{0} := hunter2xyz", '"{1}": "hunter2xyz"']
    names = [n.replace("[_-]?", mark) for n in secrets.NAMES for mark in ("_", "-", "")]
    texts = [f.format(n, n.upper()) for n in names for f in forms] + ["Authorization: Bearer hunter2xyz"]
    found = secrets.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    starts = {r.id: r.start for r in found.where(F.col("candidate") == "hunter2xyz").collect()}
    assert {i: texts[i].index("hunter2xyz") for i in range(len(texts))} == starts
