"""SimHash classes against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from quillon.llm import simhash
from quillon.llm.components import connected_components

from .helpers import ODD, no_docs, odd_docs, texts


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(values, distance=2):
    """Component number of each value over all pairs."""
    values = np.array(values, np.uint64)
    parent = list(range(len(values)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= distance):
            a, b = root(i), root(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(values))]


def plain_result(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    part = classes(prints)
    least = {}
    for (k, _), c in zip(rows, part, strict=True):
        if k is not None:
            least[c] = min(least.get(c, k), k)
    return Counter((k, f"{p:016x}", least.get(c)) for (k, _), p, c in zip(rows, prints, part, strict=True))


def test_classes_of_documents(spark, small):
    got = simhash.near_duplicates(spark.read.parquet(f"{small}/documents.parquet")).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == plain_result(texts(spark, small))


def test_classes_of_odd_documents(spark):
    got = simhash.near_duplicates(odd_docs(spark)).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == plain_result([(r[0], r[1]) for r in ODD])
    assert simhash.near_duplicates(no_docs(spark)).count() == 0


def test_links_lose_no_component(spark):
    r = random.Random(7)
    values = set()
    for _ in range(120):
        v = r.getrandbits(64)
        for _ in range(r.randrange(1, 6)):
            values.add(v)
            for b in r.sample(range(64), r.randrange(1, 4)):
                v ^= 1 << b
    hub = r.getrandbits(64)
    values |= {hub ^ (1 << b) for b in range(64)} | {hub}  # a large group that is divided
    values = sorted(values)
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "bits long")
    want = classes(values)
    for most in (4, 2048):
        found = connected_components(simhash.links(df, most=most)).collect()
        component = {np.int64(x.node).view(np.uint64).item(): x.component for x in found}
        groups = [component.get(v, ("alone", v)) for v in values]
        assert len(set(groups)) == len(set(want)) == len(set(zip(groups, want, strict=True)))


def test_thresholds_satisfy_the_pigeonhole():
    for n, seed in ((10, 1), (10**5, 2), (10**9, 3)):
        rng = np.random.default_rng(seed)
        p = rng.uniform(0.3, 0.7, 64)
        both = np.outer(p, p) * n
        np.fill_diagonal(both, p * n)
        for distance in (1, 2, 3):
            plan = simhash.allocate(n, both, distance)
            used = [b for bits, _ in plan for b in bits]
            assert len(used) == len(set(used))
            # whatever bits differ, some part has no more of them than its threshold
            for _ in range(300):
                wrong = set(rng.choice(64, distance, replace=False).tolist())
                assert any(len(wrong & set(bits)) <= t for bits, t in plan)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(1, k) for k in range(2, 30)] + [(5, 5), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 141)}, **{k: 1 for k in range(1, 30)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return frozenset(" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def plain_similar(rows):
    """Class number of each row over all pairs."""
    sets, parent = [plain_shingles(t) for _, t in rows], list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) > 0:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(rows))]


def kept_ids(rows):
    least = {}
    for (k, _), c in zip(rows, plain_similar(rows), strict=True):
        least[c] = min(least.get(c, (True, 0)), (k is None, k or 0))
    return Counter(None if none else k for none, k in least.values())


def test_stage_drops_near_copies(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = simhash.one_of_each(docs)
    want = kept_ids(texts(spark, small))
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == want
    assert want[1] and not want[177] and want[6] and not want[145]  # 7 and 11 bits apart in SimHash


def test_classes_of_chains_and_large_groups(spark):
    r = random.Random(3)
    word = lambda: f"w{r.randrange(10**6)}"
    rows, line = [], [word() for _ in range(12)]
    for _ in range(6):  # chains of small changes, further and further from their start
        words = [word() for _ in range(80)]
        for _ in range(8):
            rows.append(" ".join(words))
            words = list(words)
            words[r.randrange(80)] = word()
    base = [word() for _ in range(60)]
    for _ in range(60):  # one group of near copies, some a little too far away
        words = list(base)
        for k in r.sample(range(60), r.choice([0, 1, 1, 2, 3])):
            words[k] = word()
        rows.append(" ".join(words))
    rows += [" ".join([*line, *(word() for _ in range(r.choice([2, 3, 4, 40])))]) for _ in range(40)]  # a common line
    rows = list(enumerate(rows))
    want = plain_similar(rows)
    assert 10 < len(set(want)) < 100
    for most in (1 << 14, 16):  # all in one piece, and large groups in blocks
        got = {x.k: x["class"] for x in simhash.similar_texts(spark.createDataFrame(rows, "k long, text string"), "k", most=most).collect()}
        assert len(got) == len(rows)
        assert len(set(got.values())) == len(set(want)) == len({(got[k], want[k]) for k, _ in rows})


def family(r, texts_, words, changes):
    """Near copies of one text that is not among them."""
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(texts_):
        own = list(base)
        for k in r.sample(range(words), r.randint(*changes)):
            own[k] = f"w{r.randrange(10**6)}"
        out.append(" ".join(own))
    return out


FAMILIES = [(300, 100, (1, 3)), (300, 300, (4, 7)), (60, 100, (1, 3)), (200, 200, (2, 5)), (150, 60, (1, 2)), (120, 500, (8, 14)), (200, 80, (1, 3)), (100, 1000, (15, 30))]


@pytest.mark.parametrize("block", [simhash.BLOCK, 64])
def test_dense_families_without_a_centre(spark, block):
    """Only links between the copies themselves hold their classes together: what is found connects as all exact links do."""
    r = random.Random(5)
    rows = list(enumerate(t for f in FAMILIES for t in family(r, *f)))
    want = plain_similar(rows)
    got = {x.k: x["class"] for x in simhash.similar_texts(spark.createDataFrame(rows, "k long, text string"), "k", block=block).collect()}
    at = 0
    for n, _, _ in FAMILIES:
        exact, found = len(set(want[at : at + n])), len({got[k] for k in range(at, at + n)})
        assert len({(got[k], want[k]) for k in range(at, at + n)}) == found  # no link that is none
        assert n - found >= 0.9 * (n - exact)
        at += n
    copies = len(rows) - len(set(want))
    assert len(rows) - len(set(got.values())) >= 0.98 * copies > 500


def test_shared_shingles_and_forests():
    draw = np.random.default_rng(2)
    sets = [np.unique(draw.integers(0, 400, n).astype(np.uint64)) for n in (0, 1, 30, 200, 200, 390)] + [np.arange(100, dtype=np.uint64), np.arange(80, dtype=np.uint64), np.arange(20, 100, dtype=np.uint64)]
    shared = simhash.shared_shingles(sets)
    assert all(shared[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(len(sets)) for j in range(len(sets)) if i != j)
    everyone = np.full(len(sets), -1)
    assert {frozenset(e) for e in zip(*(x.tolist() for x in simhash.exact_forest(sets, everyone, 0.8)), strict=True)} == {frozenset((6, 7)), frozenset((6, 8))}  # just 0.8
    assert simhash.exact_forest(sets, everyone * 0 + 1, 0.8)[0].size == 0


def test_one_of_odd_documents(spark):
    docs = odd_docs(spark)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == kept_ids([(r[0], r[1]) for r in ODD])
    assert all(r._row == 3 for r in kept.collect())
    assert simhash.one_of_each(no_docs(spark)).count() == 0


def test_links_of_documents_that_are_found(spark, middle):
    """Every link that stands is exact; of the exact links hardly any is missed."""
    rows = [(k, t) for k, t in texts(spark, middle) if t]
    got = {x.k: x["class"] for x in simhash.similar_texts(spark.createDataFrame(rows, "k long, text string"), "k").collect()}
    want = plain_similar(rows)
    by_exact, by_found = {}, {}
    for (k, _), c in zip(rows, want, strict=True):
        by_exact.setdefault(c, set()).add(got[k])
        by_found.setdefault(got[k], set()).add(c)
    assert all(len(c) == 1 for c in by_found.values())
    copies = len(rows) - len(by_exact)
    assert copies > 50 and len(rows) - len(by_found) >= 0.95 * copies
