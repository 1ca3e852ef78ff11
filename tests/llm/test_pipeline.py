"""The pipeline on the smallest tables, stage by stage, against brute force."""

from collections import defaultdict

import corpus_pipeline
from gradeloom.llm import toxicity
from tests.llm.test_dedup import brute_classes
from tests.llm.test_rows import VOCABULARY, brute_hits

SF = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert k == 4 or out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.collect())
    first, exact, near, clean, packed = kept

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before = spark.read.parquet(f"{SF}/documents.parquet")
    scores = {r.record.doc_id: r.score for r in toxicity.scored(before, toxicity.train(before, labels)).collect()}
    assert {r.doc_id for r in first} == {i for i, s in scores.items() if s < 0.5}
    known = {r.doc_id: r.toxic for r in labels.collect()}
    assert sum(known.get(r.doc_id) == 0 for r in first) >= 0.9 * sum(y == 0 for y in known.values())

    groups = defaultdict(list)
    for r in first:
        groups[r.text].append(r.doc_id)
    assert {r.doc_id for r in exact} == {max(g) for g in groups.values()}
    classes = brute_classes([(r.doc_id, r.text) for r in exact])
    assert {r.doc_id for r in near} == {c for _, c in classes.values()}
    hits = {r.doc_id: brute_hits(r.text, bench) for r in near}
    assert {r.doc_id for r in clean} == {i for i, (n, h, _) in hits.items() if not (h and 20 * h >= n)}
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean}
    tokens = defaultdict(int)
    for r in packed:
        tokens[r.sequence_id] += r.length
    assert VOCABULARY and max(tokens.values()) <= 2048
