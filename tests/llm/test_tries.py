"""Prefix tries against a plain dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillon.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, ka long, heavy int, _range int, label string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children, out = defaultdict(list), Counter()
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = Counter(), Counter()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not children[p]
        saved[p] += (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1] if p else ""))
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    for p, m in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out[min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], digest] += 1
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "x") for r in rows], SCHEMA)


def rows_of(df):
    return Counter(tuple(r[n] for n in NAMES) for r in df.collect())


def branching(seed=1, convs=90, long=3):
    draw, rows = random.Random(seed), []
    for c in range(convs):
        first = ["hello there", "good day", ""][min(2, int(draw.expovariate(1.5)))]
        for turn in range(draw.choice([1, 2, 3, 5, 8]) if c % 30 else 40 * long):
            rows.append((c, turn, ["user", "assistant"][turn % 2], first if turn == 0 else f"{draw.choice(['yes', 'no'])} turn {turn}"))
    copies = [r for r in rows if r[0] == 7]
    rows += [(200 + k, t, role, text) for k in range(40) for _, t, role, text in copies]  # a third are one conversation
    draw.shuffle(rows)
    return rows


ODD = [
    (3, 0, None, None), (3, 1, "", ""), (23, None, "user", "nulls first"), (23, 1, "user", "then one"),
    (None, 0, "user", "no conversation"), (40, 0, "user", "a b  c"), (41, 0, "user", "own"), (41, 1, "user", "own two"),
    (42, 5, "user", "word " * 30_000), (42, 5, "user", "word " * 30_000), (42, 7, "x", "é ü"), (100, 0, "user", None),
    (81, 0, "u", "gone, for its base is absent"), (82, 0, "u", "a"), (83, 0, "u", "a"), (84, 0, "u", "a"), (85, 0, "u", "a"),
]


@pytest.mark.parametrize("most", [prefix_trie.MOST, 60, 5])
def test_branching_conversations(spark, most):
    """Shards of all sizes: with few turns each, upper levels are cut again and again."""
    assert rows_of(prefix_trie.prefix_trie(frame(spark, branching()), most=most)) == plain(branching())


def test_odd_conversations(spark):
    assert rows_of(prefix_trie.prefix_trie(frame(spark, ODD))) == plain(ODD)
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in plain(ODD))  # some are left without turns


def test_only_turnless_and_empty(spark):
    rows = next([(c, 0, "u", "a")] for c in range(1, 40) if c % 20 and zlib.crc32(str(c).encode()) % 4)
    assert rows_of(prefix_trie.prefix_trie(frame(spark, rows))) == plain(rows)
    assert prefix_trie.prefix_trie(frame(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(frame(spark, [(None, 1, "a", "b")])).count() == 0


def test_stored_tries_find_every_prefix(spark):
    turns = prefix_trie.materialise(prefix_trie.placed(prefix_trie.turn_rows(frame(spark, branching(4)))))
    own, _ = prefix_trie.rebuilt(turns)
    rows = prefix_trie.materialise(prefix_trie.keyed(own))
    found = [prefix_trie.opened(r) for r in prefix_trie.tries(rows, 50).collect()]
    paths = defaultdict(list)
    for r in rows.orderBy("conv_id", "depth").collect():
        paths[r.conv_id].append((r.ka, r.kb))
    members, tops = Counter(tuple(p[: d + 1]) for p in paths.values() for d in range(len(p))), 0
    for trie, depths, counts in found:
        parent = trie.parents()
        for path, n in members.items():
            for start in range(len(path)):
                node = trie.find(np.array(path[start:]))
                if node is not None:
                    tops += 1
                    assert (depths[node], counts[node]) == (len(path), n)
        assert all(list(trie.children(k)) == np.flatnonzero(parent == k).tolist() for k in range(-1, len(parent)))
    assert tops >= sum(len(d) for _, d, _ in found)


def test_given_table(spark, small):
    table = spark.read.parquet(f"{small}/conversations.parquet")
    assert rows_of(prefix_trie.prefix_trie(table)) == plain([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])
