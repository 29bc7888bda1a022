"""The prefix trie against a plain one, cut into partitions of a few rows and stitched in small groups."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from grainmill.llm import trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
TURNS = "conv_id bigint, turn bigint, role string, text string, token string, unit int, node string"


def plain(rows, grafted=True):
    """The nodes by dictionaries of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = dict(own)
    if grafted:
        for c in own:
            h = zlib.crc32(str(c).encode()) % 4
            built[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, t in sorted(built.items()):
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
        ends[tuple(t)].append(str(c))
    sums = defaultdict(lambda: [0, 0, 0])
    for p, members in nodes.items():
        if p:
            sums[p[:-1]][0] += 1
    for p, members in nodes.items():
        saved = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            sums[p[:d]][1] += not sums[p][0]
            sums[p[:d]][2] += saved
    return Counter((m[0], len(p), nodes[p[:-1]][0] if p else None, len(m), *sums[p], hashlib.sha256(",".join(ends[p]).encode()).hexdigest()) for p, m in nodes.items())


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], TURNS)


def built(spark, rows, grafted=True):
    arrays = trie.turn_arrays(table(spark, rows))
    return Counter(tuple(r) for r in trie.prefix_trie(trie.graft(arrays) if grafted else arrays).select(*COLUMNS).collect())


def random_turns(seed, convs, most=6, texts=3):
    rng = np.random.default_rng(seed)
    return [(int(c) * 3, k, "user", "word " * int(rng.integers(texts))) for c in range(convs) for k in range(int(rng.integers(1, most)))]


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    rows = random_turns(seed, 150)
    assert built(spark, rows, False) == plain(rows, False)
    assert built(spark, rows) == plain(rows)


@pytest.mark.parametrize("fan", [2, 3])
def test_many_partitions_in_small_groups(spark, monkeypatch, fan):
    """Spines that span several partitions and levels, pieces of ids cut in numbers, one sequence that fills many partitions."""
    monkeypatch.setattr(trie, "FAN", fan)
    monkeypatch.setattr(trie, "PIECE", 7)
    monkeypatch.setattr(trie, "ROWS", 5)
    monkeypatch.setattr(trie, "shuffle_partitions", lambda spark: 11)
    rows = random_turns(7, 90) + [(1000 + 20 * c, k, "user", f"hot {k}") for c in range(60) for k in range(3)]
    assert built(spark, rows) == plain(rows)
    assert built(spark, rows, False) == plain(rows, False)


def test_odd_rows(spark):
    """Nulls, turnless results, ties, repeated rows, roles that look like a part of the text, long texts and long conversations."""
    rows = [(None, 1, "user", "nobody"), (0, None, None, None), (0, 1, "user", "a"), (1, 1, "user", "a b"), (1, 1, "user", "a b"), (1, None, "user", ""), (25, 1, "ab", "c"), (25, 2, "a", "bc"),
            (26, 1, "a", "bc"), (-3, 5, "user", "naïve Straße 日本語 \x1c 😀"), (-3, 4, None, " \t\n"), (47, 1, "user", "word " * 30000), (48, 1, "user", "word " * 30000), (65, 9, "x", "y")]
    rows += [(2, k, "user", str(k % 3)) for k in range(150)] + [(3, k, "user", str(k % 3)) for k in range(120)]
    got = built(spark, rows, False)
    assert got == plain(rows, False)
    positive = [r for r in rows if r[0] is None or r[0] >= 0]
    assert built(spark, positive) == plain(positive)


def test_no_rows(spark):
    assert not built(spark, []) and not built(spark, [(None, 1, "user", "x")])


def test_only_turnless(spark):
    """Conversations whose turns are all replaced by those of an absent one."""
    few = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4]
    rows = [(c, 1, "user", "gone") for c in few]
    assert built(spark, rows) == plain(rows)
    assert sum(built(spark, rows).values()) == 1
