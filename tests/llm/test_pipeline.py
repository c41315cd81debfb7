"""The pipeline's stages, each against what it must do to its own input."""

from collections import Counter

import corpus_pipeline
from loomery.llm import pii, quality
from loomery.llm.common import written


def firsts_of_near_copies(rows):
    """The least id of each group of texts that share 0.8 of their runs of five words, by comparing all with all."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return [min(rows[i][0] for i in range(len(rows)) if label[i] == g) for g in set(label)]


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kinds = [name for name, _ in corpus_pipeline.STAGES]
    assert kinds == ["quality_rules", "near_dedup", "personal_data", "source_mix", "sequences"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, small))
        seen[name] = docs
        if name != "sequences":
            assert docs.columns == before.columns
        if name == "quality_rules":
            kept = {r.doc_id for r in quality.verdicts(quality.ledger(before)).where("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == kept
        if name == "near_dedup":
            assert sorted(r.doc_id for r in docs.collect()) == sorted(firsts_of_near_copies([(r.doc_id, r.text) for r in before.collect()]))
        if name == "personal_data":
            assert docs.count() == before.count() and all(r.base_list == "" for r in pii.find(docs).collect())
        if name == "source_mix":
            counts = Counter(r.doc_id for r in docs.collect())
            assert max(counts.values()) <= 2 and set(counts) <= {r.doc_id for r in before.collect()}
    words = sum(len(r.text.encode().split()) for r in seen["source_mix"].collect())
    assert seen["sequences"].agg({"n_words": "sum"}).first()[0] == words
    assert corpus_pipeline.run(spark, small).count() == seen["sequences"].count()


def test_odd_rows_pass_through(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, "unused"))
        assert name == "sequences" or docs.columns == odd.columns
    assert docs.count() > 0


def test_empty_table(spark, none):
    docs = none
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, "unused"))
        assert name == "sequences" or docs.columns == none.columns
    assert docs.count() == 0
