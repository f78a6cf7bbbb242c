"""The compression classifier by held-out accuracy, the quality rules against plain counts."""

import random
import re
import zlib
from collections import Counter

from quillon.llm import quality_model, quality_rules

from .helpers import ODD, no_docs, odd_docs, ordered, texts

WORD = re.compile("[^ \t-\r]+")


def auc(pairs) -> float:
    good, bad = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_scores_tell_held_out_labels_apart(spark, middle):
    docs, labels = (spark.read.parquet(f"{middle}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_model.quality_scores(docs, quality_model.fit(docs, labels)).collect()
    quality = {r.doc_id: r.quality for r in labels.collect()}
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(r.score, quality[r.doc_id]) for r in rows if r.held_out and r.doc_id in quality]
    assert auc(held) > 0.85
    assert sum((s >= 0.3) == (y == 1) for s, y in held) / len(held) > 0.9


def test_scores_do_not_depend_on_held_out_labels(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", quality_model.F.when(quality_model.held_out(quality_model.F.col("doc_id")), 1 - quality_model.F.col("quality")).otherwise(quality_model.F.col("quality")))
    a, b = quality_model.fit(docs, labels), quality_model.fit(docs, flipped)
    assert (a.good, a.bad, a.curve) == (b.good, b.bad, b.curve)


def test_long_texts_are_scored_as_their_parts(spark, middle):
    docs, labels = (spark.read.parquet(f"{middle}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.fit(docs, labels)
    texts_ = {q: [r.text for r in docs.join(labels.where(f"quality = {q}"), "doc_id").where("text is not null").orderBy("doc_id").collect()] for q in (0, 1)}
    compressors = model.compressors()
    for n in (10, 100, 400):
        good, bad = (model.score(model.measure([" ".join((texts_[q] * n)[:n])], compressors))[0] for q in (1, 0))
        assert good > 0.9 and bad < 0.1


def test_odd_documents_are_scored(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    docs = odd_docs(spark)
    model = quality_model.fit(docs, labels)  # too few texts for dictionaries
    rows = quality_model.quality_scores(docs, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert quality_model.good_documents(docs, model).columns == docs.columns
    assert quality_model.quality_scores(no_docs(spark), quality_model.fit(no_docs(spark), labels.limit(0))).count() == 0


def test_all_of_a_long_labelled_text_is_learned(spark):
    """What only stands deep inside labelled texts of over 32 KB tells the classes apart; rows beyond the bytes do not."""
    r = random.Random(1)
    filler = lambda n: " ".join(f"f{r.randrange(10**5)}" for _ in range(n))
    mark = {q: [f"{'good' if q else 'bad'}{r.randrange(10**6)}" for _ in range(600)] for q in (0, 1)}
    deep = lambda q: " ".join([filler(3500), *r.choices(mark[q], k=1500), filler(3500)])
    rows = [(k, deep(k % 2)) for k in range(80)]
    assert min(len(t) for _, t in rows) > 32_000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k, _ in rows], "doc_id long, quality int, toxic int")
    model = quality_model.fit(docs, labels)
    assert b"good" in model.good and b"bad" in model.bad
    scores = {r.doc_id: (r.held_out, r.score) for r in quality_model.quality_scores(docs, model).collect()}
    held = [(s, k % 2) for k, (out, s) in scores.items() if out]
    assert auc(held) > 0.95
    short = quality_model.fit(docs, labels, class_bytes=200_000)  # a few whole rows only, fewer than a dictionary takes
    assert len(short.good) < len(model.good)


def test_a_repeated_key_does_not_swell_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(2, "good text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_model.quality_scores(docs, quality_model.fit(docs, labels)).count() == 501


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    inside = set()
    for k, w in enumerate(windows):
        if often[w] > 1:
            inside |= set(range(k, k + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, dup, len(inside), len(words) < 10 or 100 * len(inside) > 20 * len(words)


def test_rules_count_what_the_contract_says(spark, small):
    rows = [(r[0], r[1]) for r in ODD] + texts(spark, small) + [(99, "a b c d e f a b c d e f g h i j k l m n o p"), (98, "# a|b <c> $5 100% & * " * 3)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(k, *plain_counts(x)) for k, x in rows]
    assert ordered((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == ordered(want)
    assert not any(r.kept and r.base_failed for r in got)


def test_windows_of_very_many_words():
    words = [str(k).encode() for k in range(9000)] * 2
    assert quality_rules.repeat_words(words) == len(words)
    assert quality_rules.repeat_words([str(k).encode() for k in range(20_000)]) == 0


def test_bands_reject_repeats_and_noise_and_keep_prose(spark, middle):
    import random

    r = random.Random(1)
    bands = quality_rules.Bands()
    assert not bands.verdict(b"buy now " * 400)[0]
    assert not bands.verdict(bytes(r.randrange(33, 127) for _ in range(6000)))[0]
    docs, labels = (spark.read.parquet(f"{middle}/{t}.parquet") for t in ("documents", "labels"))
    good = {x.doc_id for x in labels.where("quality = 1").collect()}
    rows = [x for x in quality_rules.quality_rules(docs).collect() if x.doc_id in good and not x.base_failed]
    assert sum(x.kept for x in rows) / len(rows) > 0.99


def test_noise_of_letters_is_rejected():
    import base64
    import random

    r = random.Random(2)
    bands = quality_rules.Bands()
    of = lambda word, n: " ".join(word() for _ in range(n)).encode()[:n]
    lines = lambda: base64.b64encode(r.randbytes(57)).decode()
    letters = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 10)))
    assert not any(bands.verdict(of(lines, n))[0] for n in (300, 600, 1100, 5000, 20_000))
    assert not any(bands.verdict(of(letters, n))[0] for n in (4096, 5000, 20_000))


def test_kept_rows_come_back_whole(spark):
    docs = odd_docs(spark)
    kept = quality_rules.quality_rules(docs, keep_columns=True)
    assert kept.columns == docs.columns
    want = Counter(r.doc_id for r in quality_rules.quality_rules(docs).where("kept").collect())
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert quality_rules.quality_rules(no_docs(spark)).count() == 0


def test_chunks_reach_every_byte():
    import random

    r = random.Random(5)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9))) for _ in range(3000)]
    prose = " ".join(r.choice(words) for _ in range(40_000)).encode()
    bands = quality_rules.Bands()
    for size in (4096, 8191, 8192, 12_287, 50_001):
        assert bands.verdict(prose[:size])[2] == 0
    for good, junk in ((4096, 4095), (4096, 4096), (1000, 4096), (8192, 4095), (8192, 4097), (20_000, 11_000)):
        for noise in (b"=" * junk, bytes(r.randrange(256) for _ in range(junk))):
            for raw in (prose[:good] + noise, noise + prose[:good]):
                kept, _, share = bands.verdict(raw)
                assert share > 0.2 and not (kept and share > 1 / 3)
    assert not bands.verdict(prose[:4096] + b"=" * 4095)[0] and abs(bands.verdict(prose[:8192] + b"=" * 4095)[2] - 4095 / 12_287) < 1e-12
    assert bands.verdict(prose[:4095] + b"=" * 0)[2] == 0
