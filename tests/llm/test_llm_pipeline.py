"""The pipeline, stage by stage and as a whole, against plain versions of its stages."""

from pathlib import Path

import brute
import pytest

import corpus_pipeline
from vistaquad.llm import bpe, toxicity
from vistaquad.llm.common import settle, table

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_pipeline_equals_plain_stages(spark):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.fit_toxicity(docs, table(spark, SF, "labels"))
    kept = {i: t for i, t in texts.items() if model.score([(t or "").encode()])[0] < 0.5}
    last = {}
    for i, t in kept.items():
        last[t or ""] = max(i, last.get(t or "", i))
    kept = {i: t for i, t in kept.items() if last[t or ""] == i}
    kept = {i: kept[i] for i, (_, component) in brute.near(kept, 5, 80).items() if i == component}
    items = {r.item_id: brute.windows(r.text) for r in table(spark, SF, "benchmark").collect()}
    kept = {i: t for i, t in kept.items() if not brute.contaminated(t, items)[1]}
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(rows) == set(kept)
    assert all(rows[i].decoded_sha256 == brute.sha((t or "").encode()) and len(rows[i].tokens) == 4 * rows[i].n_tokens for i, t in kept.items())


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_stages_on_awkward_tables(spark):
    docs, empty = brute.tables(spark)
    again = docs.where("doc_id = 22")
    docs = docs.union(again)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, SF).count() == 0
        out = settle(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count() > 0
    assert bpe.public_vocabulary()[0]
