"""The quality classifier: held-out accuracy, its features and gradients against plain versions, and what its attention points at."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from grainmill.llm import quality, queries
from grainmill.llm.common import read_table

SF = "/root/testdata/sf0.01"


def test_held_out_rows(spark):
    got = queries.op13_attention_quality(spark, SF).join(read_table(spark, SF, "labels"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)
    held = [(r["score"], r["quality"]) for r in got if r["held_out"]]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) > 0.95 and np.mean([s >= 0.7 for s in pos]) > 0.95


def test_features_of_a_text():
    text = "One two two, THREE ## one\nföur 55 x" * 9
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    low = [w.encode().lower() for w in words]
    got = quality.encode_text(text, 10)
    assert got.shape == (-(-len(words) // 10), quality.FEATURES)
    for k, row in enumerate(got[:, quality._N :]):
        own = range(10 * k, min(10 * k + 10, len(words)))
        shares = [np.mean([x not in y for x, y in z]) for z in ([(low[i], low[:i]) for i in own], [(low[i], low[10 * k : i]) for i in own])]
        shares += [np.mean([i > 0 and low[i] == low[i - 1] for i in own]), np.mean([words[i][0] in "OTWHRE" and words[i][0].isupper() for i in own]),
                   np.mean([sum("A" <= c <= "Z" for c in words[i]) > 1 for i in own]), np.mean([words[i][-1] == "#" for i in own]), np.mean([np.log1p(len(low[i])) for i in own])]
        assert np.allclose(row[:9], [*shares, np.log1p(max(len(low[i]) for i in own)), np.log1p(len(own))], atol=1e-5)
        assert abs((row[9:] ** 2).sum() - 1) < 1e-5
    assert np.allclose(got[:, : quality._N].sum(axis=1), 1)
    assert not quality.encode_text(None).any() and quality.encode_text(" \n\t").shape == (1, quality.FEATURES)
    assert np.isfinite(quality.encode_text("x" * 300_000)).all() and np.isfinite(quality.encode_text("a")).all()


def test_gradients_against_differences():
    rng = np.random.default_rng(2)
    x, begin, y = rng.normal(size=(9, 5)), np.array([0, 1, 5]), np.array([1.0, 0.0, 1.0])
    model = quality.Model.fresh(np.zeros(5), np.ones(5), 4, 3)
    loss = lambda: -np.mean(y * np.log(p := model.forward(x, begin)[0]) + (1 - y) * np.log(1 - p))
    for part, grad in zip(model.parts, model.gradients(x, begin, y), strict=True):
        for at in np.ndindex(part.shape):
            kept = part[at]
            part[at] = kept + 1e-6
            up = loss()
            part[at] = kept - 1e-6
            assert abs((up - loss()) / 2e-6 - grad[at]) < 1e-6
            part[at] = kept


def test_a_document_counts_by_its_weighted_passages():
    rng = np.random.default_rng(3)
    bags, model = [rng.normal(size=(n, quality.FEATURES)) for n in (1, 4, 2)], quality.Model.fresh(np.zeros(quality.FEATURES), np.ones(quality.FEATURES))
    p, a, _ = model.forward(np.concatenate(bags), np.array([0, 1, 5]))
    w1, b1, v, bv, u, bu, w, c, b = model.parts
    for k, bag in enumerate(bags):
        h = np.tanh(bag @ w1 + b1)
        e = np.exp(np.array([(np.tanh(r @ v + bv) / (1 + np.exp(-(r @ u + bu)))) @ w for r in h]))
        e /= e.sum()
        assert np.allclose(a[[0, 1, 5][k] :][: len(bag)], e) and np.isclose(p[k], 1 / (1 + np.exp(-((e[:, None] * h).sum(axis=0) @ c + b[0]))))
        alone = model.forward(bag, np.array([0]))
        assert np.isclose(alone[0][0], p[k])
    again = quality.Model.from_bytes(model.to_bytes())
    assert np.array_equal(again.forward(np.concatenate(bags), np.array([0, 1, 5]))[0], p)


def test_attention_finds_the_passage_that_decides(spark):
    """Labels belong to documents, but one passage in five alone makes the difference."""
    texts = [r["text"].split() for r in read_table(spark, SF, "documents").where("n_chars between 2500 and 9000").orderBy("doc_id").collect()]
    texts = [t[:320] for t in texts if len(t) >= 320]
    rng = np.random.default_rng(8)
    bags, labels, places = [], [], []
    for k, t in enumerate(texts):
        at = int(rng.integers(5))
        if k % 2:
            t[64 * at : 64 * at + 64 : 4] = ["%%%"] * 16
        bags.append(quality.encode_text(" ".join(t)))
        labels.append(1 - k % 2)
        places.append(at)
    half = len(bags) * 3 // 4
    assert half > 80
    model = quality.fit(bags[:half], labels[:half])
    scores = [model.forward(b, np.array([0])) for b in bags]
    assert np.mean([(p[0] >= 0.5) == y for (p, _, _), y in zip(scores[half:], labels[half:], strict=True)]) > 0.9
    assert np.mean([int(np.argmax(a)) == at for (_, a, _), y, at in zip(scores, labels, places, strict=True) if not y]) > 0.8


def test_attention_is_returned(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    got = quality.score(docs.limit(40), quality.learn(docs, labels, F.lit(True), rows=60), attention="weights").collect()
    assert all(abs(sum(r["weights"]) - 1) < 1e-9 and len(r["weights"]) == len(quality.encode_text(r["text"])) for r in got)


def test_odd_rows(spark, docs, odd):
    labels = spark.createDataFrame([(4, 1), (4, 1), (6, 0), (None, 1), (99, 1), (7, None)], "doc_id bigint, quality int")
    model = quality.learn(docs(odd), labels, F.lit(True))
    got = [r.asDict() for r in quality.score(docs(odd), model).collect()]
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got) == sorted((str(i), t or "") for i, t in odd)
    assert all(0 <= r["score"] <= 1 and r["node"] == 7 for r in got)
    by_text = {r["text"] or "": r["score"] for r in got}
    assert all(by_text[r["text"] or ""] == r["score"] for r in got) and by_text["one two three"] > 0.5 > by_text["word " * 30000]
    assert quality.score(docs([]), model).count() == 0
    none = quality.learn(docs(odd), labels, F.lit(False))
    assert none is None and {r["score"] for r in quality.score(docs(odd), none, attention="a").collect()} == {0.5}
