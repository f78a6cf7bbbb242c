"""License scan, mixing and top-k against SQL and plain Python."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from quillon.llm import licenses, maxscore, mixing

from .helpers import ODD, no_docs, odd_docs, ordered, sql_rows

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_base(text):
    words = WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    hits = [(k, label) for phrase, label in licenses.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def odd_frame():
    return pd.DataFrame([(r[0], r[1], r[3]) for r in ODD], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})


def test_licenses_equal_sql(spark, small):
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = licenses.license_scan(spark.read.parquet(f"{small}/documents.parquet")).select(names).collect()
    assert ordered(got) == ordered(sql_rows(small, licenses.oracle(), names))
    got = licenses.license_scan(odd_docs(spark)).select(names).collect()
    assert ordered(got) == ordered(sql_rows("", licenses.oracle(), names, documents=odd_frame()))
    assert licenses.license_scan(no_docs(spark)).count() == 0


def test_base_phrases_are_found_in_every_place(spark, small):
    rows = [(r[0], r[1]) for r in ODD] + [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows += [(900, "general public general public license"), (901, "mit license mit license"), (902, "MIT License mit-license")]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert ordered((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == ordered((k, *plain_base(t)) for k, t in rows)


def test_spans_of_templates_with_changed_words(spark):
    whole = dict(licenses.TEMPLATES)["mit-text"].split()
    changed = [*"some words before".split(), *whole[:20], "extra", *whole[20:31], *whole[32:], "after"]
    half = whole[: len(whole) // 2]
    docs = spark.createDataFrame([(1, " ".join(changed)), (2, " ".join(half)), (3, "nothing of the kind here")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert got[1].labels == "mit-text" and got[1].spans[0].first_word == 3 and got[1].spans[0].words == len(whole) and 0.7 <= got[1].score < 1
    assert got[2].labels == got[3].labels == "" and got[3].score == 0


def test_mix_equals_sql(spark, small):
    names = ["doc_id", "size", "source_size", "target", "taken"]
    for docs, folder, extra in ((spark.read.parquet(f"{small}/documents.parquet"), small, {}), (odd_docs(spark), "", {"documents": odd_frame()})):
        got = mixing.mix(docs).select(names).collect()
        want = sql_rows(folder, mixing.oracle(), names, **extra)
        assert ordered((*r[:3], round(r[3], 6), r[4]) for r in got) == ordered((*r[:3], round(r[3], 6), r[4]) for r in want)


def plain_targets(sizes):
    """By clamping and sharing again. sizes: source -> words."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, free, left = {}, list(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        free = [s for s in free if s not in over]
    return target


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 10, "c": 10, None: 500}, {"a": 1}, {"a": 0, "b": 5}, {c: 3 ** (k % 7) for k, c in enumerate("abcdefghijk")}])
def test_water_level(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.water_fill(df).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in got)


def test_taken_words_come_near_the_target(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    target = {r.source: r.target for r in rows}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    again = mixing.mix(docs.repartition(3)).collect()
    assert ordered((r.doc_id, r.taken) for r in rows) == ordered((r.doc_id, r.taken) for r in again)


def test_a_source_with_nearly_all_rows_is_dealt_out(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('w ', repeat('x ', int(id % 7)))  AS text", "CASE WHEN id % 10 > 0 THEN 'hot' WHEN id % 20 = 0 THEN null ELSE 'cold' END AS source", "id AS _salt")
    want, mixed = ordered(mixing.mix(docs).collect()), Counter(map(tuple, mixing.mixed_documents(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert ordered(mixing.mix(docs).collect()) == want and Counter(map(tuple, mixing.mixed_documents(docs).collect())) == mixed


def test_mixed_documents_are_the_taken_ones(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix(docs).collect() if r.size}
    got = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert {k: v for k, v in got.items() if k in taken} == {k: v for k, v in taken.items() if v}
    odd = odd_docs(spark)
    assert mixing.mixed_documents(odd).columns == odd.columns and all(r._mix_whole == 4 for r in mixing.mixed_documents(odd).collect())
    assert mixing.mix(no_docs(spark)).count() == 0 and mixing.mixed_documents(no_docs(spark)).count() == 0


# ------------------------------------------------------------------ top k


def plain_top_k(rows, k=10):
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in usable if i % 100 == 0}:
        query = min(v for i, v in usable if i == q)
        scored = sorted((-sum(a * b for a, b in zip(query, v, strict=False)), i) for i, v in usable if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return out


NAMES = ["query_id", "rank", "vec_id", "score"]


@pytest.mark.parametrize("shard", [7, 4096])
def test_top_k_equals_brute_force(spark, small, shard, monkeypatch):
    monkeypatch.setattr(maxscore, "CELLS", shard * 64)  # packed rows of 7 vectors too
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()]
    assert ordered(maxscore.top_k(df).select(NAMES).collect()) == ordered(plain_top_k(rows))
    assert ordered(maxscore.top_k(df).select(NAMES).collect()) == ordered(sql_rows(small, maxscore.oracle(), NAMES))


def test_top_k_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(k * 25, rng.normal(size=6).astype(np.float32).tolist()) for k in range(40)]
    rows += [(7, None), (8, [None, 1.0, 2.0, 3.0, 4.0, 5.0]), (9, [math.nan] * 6), (10, [math.inf] * 6), (None, [1.0] * 6), (11, [1.0, 1.0]), (12, []), (300, rows[3][1]), (300, rows[3][1]), (13, rows[0][1]), (14, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score long")
    assert ordered(maxscore.top_k(df).select(NAMES).collect()) == ordered(plain_top_k(rows))
    assert maxscore.top_k(df.limit(0)).count() == 0
    few = spark.createDataFrame([(100, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in maxscore.top_k(few).select(NAMES).orderBy("rank").collect()] == [(100, 1, 1, 2 << 20), (100, 2, 2, 2 << 20)]
