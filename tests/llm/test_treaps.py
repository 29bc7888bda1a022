"""Treap search against a plain scan of all documents for all queries."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from grainmill.llm import treaps
from grainmill.llm.common import read_table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items, k=20):
    own = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = Counter()
    for item, text in set(items):
        found = []
        for i, c in own:
            m = 75 + 25 * sum(c.values()) * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(found)[:k], 1):
            out[item, rank, i, -score] += 1
    return out


def searched(spark, docs, rows, items, k=20):
    queries = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id bigint, text string, doc_id int, score string")
    found = treaps.search(docs(rows), queries, k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return Counter(tuple(r) for r in found.collect())


@pytest.mark.parametrize("seed", range(3))
def test_random_documents_in_small_shards(spark, docs, monkeypatch, seed):
    monkeypatch.setattr(treaps, "SHARD_DOCS", 17)
    monkeypatch.setattr(treaps, "LIVE", 40)
    monkeypatch.setattr(treaps, "CELLS", 60)
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(12)]
    rows = [(int(i), " ".join(rng.choice(words, int(rng.integers(0, 9)), p=np.arange(1, 13) / 78))) for i in rng.permutation(200)]
    items = [(i, " ".join(rng.choice(words, int(rng.integers(0, 7))))) for i in range(14)]
    assert searched(spark, docs, rows, items, 5) == plain(rows, items, 5)


def test_queries_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(treaps, "BLOCK_BYTES", 40)
    rows = [(i, f"a{i % 3} b{i % 5} c") for i in range(40)]
    items = [(i, f"a{i % 3} b{i % 4}") for i in range(6)]
    assert searched(spark, docs, rows, items, 4) == plain(rows, items, 4)


def test_odd_rows(spark, docs, odd):
    """Nulls, empty and long texts, ties, repeated rows and queries, other letters; case folds in ASCII only."""
    rows = [*odd, (8, "ONE Two-three_four İI ÉCOLE"), (9, "word"), (-4, "one one two")]
    items = [(1, "one two three"), (1, "one two three"), (1, "word id"), (2, None), (3, ""), (4, "日本語 naïve 😀 straße Straße"), (None, "one école École İi"), (5, "word word word absent")]
    assert searched(spark, docs, rows, items) == plain(rows, items)
    assert searched(spark, docs, rows, items, 1) == plain(rows, items, 1)


def test_empty_tables(spark, docs):
    assert not searched(spark, docs, [], [(1, "a")]) and not searched(spark, docs, [(1, "a")], []) and not searched(spark, docs, [(1, None), (2, "!")], [(1, "a")])


def test_a_treap_is_a_search_tree_by_document_and_a_heap_by_impact():
    rng = np.random.default_rng(4)
    held = [np.sort(rng.choice(7, int(rng.integers(0, 7)), replace=False)) for _ in range(300)]
    starts, terms_ = np.cumsum([0, *map(len, held)]), np.concatenate(held).astype(np.int32)
    t = treaps.Treaps(starts, terms_, rng.integers(1, 5, len(terms_)), 7)
    for term in range(7):
        def walk(node, lo, hi, most):
            if node == t.none:
                return []
            assert lo <= t.doc[node] < hi and t.impact[node] <= most
            return [*walk(t.left[node], lo, t.doc[node], t.impact[node]), int(t.doc[node]), *walk(t.right[node], t.doc[node] + 1, hi, t.impact[node])]
        assert walk(t.root[term], 0, 300, 9) == [d for d in range(300) if term in held[d]]


def test_most_documents_are_never_scored(spark, sf_dir):
    """On the given documents the bounds leave most pairs of query and document out."""
    rows = sorted((r["doc_id"], r["text"]) for r in read_table(spark, "/root/testdata/sf0.01", "documents").collect())
    items = [Counter(treaps.terms_of(r["text"])) for r in read_table(spark, "/root/testdata/sf0.01", "benchmark").collect()]
    number = {t: i for i, t in enumerate(sorted(set().union(*items)))}
    own = [Counter(x for x in treaps.terms_of(t) if x in number) for _, t in rows]
    starts = np.cumsum([0, *map(len, own)])
    at = np.concatenate([sorted(number[t] for t in c) for c in own]).astype(np.int32)
    impacts = np.concatenate([[1000 * c[t] for t in sorted(c)] for c in own]).astype(np.int64)
    queries = [(np.array(sorted(number[t] for t in c)), np.array([c[t] for t in sorted(c)])) for c in items]
    _, scored = treaps.traverse(treaps.Treaps(starts, at, impacts, len(number)), starts, at, impacts, queries, len(number), 20)
    assert scored < 0.5 * len(rows) * len(items)
