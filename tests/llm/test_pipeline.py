"""The pipeline's stages, each against a plain reading of its input."""

from collections import Counter

import corpus_pipeline
from quillon.llm import mixing, queries, quality_model, quality_rules
from quillon.llm.common import shared_folder, table

from .helpers import ODD, no_docs, odd_docs
from .test_duplicates import kept_ids
from .test_quality import plain_counts
from .test_tokens import check_packing


def test_stages(spark, small):
    docs = table(spark, small, "documents")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        folder = shared_folder(spark)
        stage(spark, frames[-1], small).write.parquet(folder)
        frames.append(spark.read.parquet(folder))
    start, good, ruled, single, mixed, packed = frames
    assert all(f.columns == docs.columns for f in frames[:-1])
    ids = lambda f: Counter(r.doc_id for r in f.select("doc_id").collect())
    scores = quality_model.quality_scores(docs, quality_model.fit(docs, table(spark, small, "labels")))
    assert ids(good) == Counter(r.doc_id for r in scores.where("predicted = 1").collect())
    assert ids(ruled) == Counter(r.doc_id for r in quality_rules.quality_rules(good).where("kept").collect())
    assert not any(plain_counts(r.text)[5] for r in ruled.collect())
    assert ids(single) == kept_ids([(r.doc_id, r.text) for r in ruled.collect()])
    assert ids(mixed) == Counter({r.doc_id: r.taken // r.size for r in mixing.mix(single).collect() if r.taken})
    check_packing([(r.doc_id, r.text) for r in mixed.collect()], packed.collect())
    assert Counter(map(tuple, corpus_pipeline.run(spark, small).collect())) == Counter(map(tuple, packed.collect()))


def test_stages_take_odd_and_no_documents(spark, small):
    odd = odd_docs(spark)
    good, ruled, single, mixed = (stage(spark, odd, small) for _, stage in corpus_pipeline.STAGES[:-1])
    assert all(f.columns == odd.columns for f in (good, ruled, single, mixed))
    ids = lambda f: Counter(r.doc_id for r in f.select("doc_id").collect())
    scores = {r.doc_id: r.predicted for r in quality_model.quality_scores(odd, quality_model.fit(odd, table(spark, small, "labels"))).collect()}
    assert ids(good) == Counter(r[0] for r in ODD if scores[r[0]])
    kept = quality_rules.quality_rules(odd).where("kept").collect()
    assert ids(ruled) == Counter(r.doc_id for r in kept) and {4, 5} <= set(ids(ruled)) and not {1, 2, 3, 6, 9} & set(ids(ruled))
    assert ids(single) == kept_ids([(r[0], r[1]) for r in ODD])
    taken = mixing.mix(odd).collect()
    want = Counter()
    for r in taken:
        want[r.doc_id] += r.taken // r.size if r.size else 0
    assert Counter(r.doc_id for r in mixed.collect() if (r.text or "").split()) == +want
    packed = corpus_pipeline.STAGES[-1][1](spark, odd, small)
    check_packing([(r[0], r[1]) for r in ODD], packed.collect())
    none = no_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, small).count() == 0, name


def test_every_query_is_registered(spark, small):
    import re

    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names
    assert all(re.fullmatch(r"op\d+_[a-z0-9_]+|pipeline", n) for n in names) and set(queries.oracle_sql()) <= set(names)
