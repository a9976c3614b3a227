"""The corpus pipeline against its stages done by hand on a small table."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from test_llm import check_packing, components, shingle_set

import corpus_pipeline
from kinmer.llm import quality

SF_DIR = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    forest = quality.fit_quality(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    good = [(r.doc_id, r.text) for r in docs.collect() if forest.score(np.array([quality.statistics(r.text)]))[0] >= 0.7]
    last = defaultdict(int)
    for i, t in good:
        last[t or ""] = max(last[t or ""], i)
    unique = [(i, t) for t, i in last.items()]
    sets = {i: shingle_set(t) for i, t in unique}

    def linked(a, b):
        return len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8

    ids = sorted(sets)
    root = components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if linked(a, b)])
    kept = [(i, t) for i, t in unique if root[i] == i]
    assert 0 < len(kept) < len(good) < docs.count()
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in kept}
    check_packing(kept, rows)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).columns == docs.columns
