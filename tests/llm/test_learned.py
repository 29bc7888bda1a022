"""Learned operators by held-out accuracy, and the pipeline against its parts."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from grainmill.llm import bpe, langid, queries, toxicity  # noqa: E402
from grainmill.llm.common import read_table  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_rows(spark):
    got = queries.op5_toxicity(spark, SF).join(read_table(spark, SF, "labels"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [(r["score"], r["toxic"]) for r in got if r["held_out"]]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.9 and np.mean([s >= 0.7 for s in neg]) < 0.05


def test_toxicity_on_odd_rows(spark, docs, odd):
    labels = spark.createDataFrame([(4, 1), (4, 1), (6, 0), (None, 1), (99, 1), (7, None)], "doc_id bigint, toxic int")
    model = toxicity.learn(docs(odd), labels, F.lit(True))
    scored = toxicity.score(docs(odd), model)
    assert scored.count() == len(odd) and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(docs([]), model).count() == 0
    assert toxicity.score(docs(odd), toxicity.learn(docs(odd), labels, F.lit(False))).first()["score"] == 0.5


def test_ftrl_against_the_plain_formulas():
    rng = np.random.default_rng(9)
    how = toxicity.Ftrl(alpha=0.7, beta=0.5, l1=0.8, l2=0.3, epochs=3)
    rows = [rng.integers(0, 32, int(rng.integers(0, 12))) for _ in range(120)]
    labels = [int(3 in r or (5 in r and 7 in r)) for r in rows]
    z, n, zb, nb = [0.0] * 32, [0.0] * 32, 0.0, 0.0
    weight = lambda i: 0.0 if abs(z[i]) <= how.l1 else -(z[i] - (1 if z[i] > 0 else -1) * how.l1) / ((how.beta + n[i] ** 0.5) / how.alpha + how.l2)
    bias = lambda: -zb / ((how.beta + nb**0.5) / how.alpha)
    for _ in range(how.epochs):
        for r, y in zip(rows, labels, strict=True):
            own = {int(i): weight(i) for i in set(r.tolist())}
            b = bias()
            g = 1 / (1 + np.exp(-(sum(own.values()) + b))) - y
            for i, w in own.items():
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / how.alpha * w
                n[i] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / how.alpha * b
            nb += g * g
    at, w, got = toxicity.fit(rows, labels, how, 32)
    want = {i: weight(i) for i in range(32) if weight(i)}
    assert at.tolist() == sorted(want) and np.allclose(w, [want[i] for i in at]) and abs(got - bias()) < 1e-9 and 0 < len(want) < 32


def test_toxicity_of_repeated_ids_is_repeatable(spark, docs):
    rows = [(1, "bad words here"), (1, "good words here"), (2, "fine day"), (3, None)]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id bigint, toxic int")
    models = [toxicity.learn(docs(r).repartition(n), labels, F.lit(True)) for r, n in ((rows, 1), (rows[::-1], 3))]
    assert all((a == b).all() if hasattr(a, "all") else a == b for a, b in zip(*models, strict=True))


def test_languages_on_held_out_rows(spark):
    got = queries.op7_language_id(spark, SF).join(read_table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95


def test_languages_on_odd_rows(spark, docs, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    df = docs(odd, langs={4: "en", 6: "xx", 7: "de"})
    got = {r["doc_id"]: r for r in langid.predict(df, langid.learn(df, F.lit(True), path)).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[6]["lang_pred"] == "xx"
    assert {r["lang_pred"] for r in langid.predict(df, langid.learn(df, F.lit(False), path)).collect()} == {"und"}
    assert langid.predict(docs([]), langid.learn(df, F.lit(True), path)).count() == 0


def test_letters_are_those_of_unicode():
    assert [langid.has_letter(t) for t in ("½", "² 12 _", "", "a", "1 ñ", "日", "!!", "ª")] == [False, False, False, True, True, True, False, True]


def test_rare_languages_are_learned_and_the_sample_is_bounded(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(i, "the house and the garden are here" if i % 50 else "das haus und der garten sind hier") for i in range(400)]
    df = docs(rows, langs={i: "en" if i % 50 else "de" for i, _ in rows})
    langs, pieces, p = langid.learn(df, F.lit(True), path, rows=10)
    assert langs == ["de", "en"] and p.shape == (len(pieces) + 1, 2)
    assert {r["doc_id"] % 50 == 0: r["lang_pred"] for r in langid.predict(df, (langs, pieces, p)).collect()} == {True: "de", False: "en"}
    assert langid.learn(df, F.lit(True), path, rows=1)[0] == ["de"]
    with pytest.raises(ValueError):
        langid.predict(df.withColumnRenamed("key", "score"), (langs, pieces, p), keep=("score",))


def test_expectation_and_prediction_by_brute_force(spark, docs):
    """EM and the likeliest language against sums over all segmentations, on words that allow few."""
    pieces = langid.Pieces(["a", "b", "ab", "ba", "▁", "▁a", "bab"])
    size = len(pieces.pieces)

    def cuts(s):
        return [[]] if not s else [[s[:k], *rest] for k in range(1, len(s) + 1) if s[:k] in pieces.pieces for rest in cuts(s[k:])]

    def em(counts):
        p = np.full(size, 1 / size)
        for _ in range(3):
            want = np.full(size, langid.PSEUDO)
            for w, n in counts.items():
                ways = [[pieces.pieces.index(x) for x in c] for c in cuts("▁" + w)]
                odds = np.array([np.prod(p[c]) for c in ways])
                for c, x in zip(ways, odds / odds.sum(), strict=True):
                    np.add.at(want, c, n * x)
            p = want / want.sum()
        return p

    words = {"x": {"ab": 5, "abab": 2, "bab": 1}, "y": {"ba": 4, "bba": 3, "b": 2}}
    learned = {k: langid.learn_pieces(v, pieces) for k, v in words.items()}
    assert all(np.allclose(learned[k][:-1], em(v)) for k, v in words.items())
    model = (["x", "y"], pieces.pieces, np.stack([learned["x"], learned["y"]], axis=1))
    texts = ["ab bab", "bba b ba", "abab b", "a", "bb ab"]
    got = {r["doc_id"]: r for r in langid.predict(docs(list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        logs = [sum(np.log(sum(np.prod([learned[k][pieces.pieces.index(x)] for x in c]) for c in cuts("▁" + w))) for w in t.split()) for k in "xy"]
        assert got[i]["lang_pred"] == "xy"[int(np.argmax(logs))] and abs(got[i]["score"] - 1 / (1 + np.exp(min(logs) - max(logs)))) < 1e-9


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(["a", "b", "ab", "ba", "aba", "▁"])
    p = np.append(np.linspace(0.05, 0.3, len(pieces.pieces)), langid.FLOOR)[:, None]
    prob = {s: p[i, 0] for i, s in enumerate(pieces.pieces)}

    def total(s):
        if not s:
            return 1.0
        return sum((prob.get(s[:k]) or (langid.FLOOR if k == 1 else 0)) * total(s[k:]) for k in range(1, min(5, len(s)) + 1))

    words = ["aba", "abba", "bbbaab", "axb", ""]
    assert np.allclose(np.exp(langid.log_probabilities(words, pieces, p))[:, 0], [total("▁" + w) for w in words])


def test_forward_takes_whole_pieces_and_whole_words():
    pieces = langid.Pieces(["a", "b", "▁", "ab", "▁abbab", "abbabbaab", "b" * 16])
    assert pieces.longest == 16
    p = np.append(np.linspace(0.05, 0.3, len(pieces.pieces)), langid.FLOOR)
    prob = dict(zip(pieces.pieces, p))

    def total(s):  # logarithm, by the plain recursion
        sums, scale = [1.0], 0.0
        for i in range(1, len(s) + 1):
            sums.append(sum(sums[-k] * (prob.get(s[i - k : i]) or (langid.FLOOR if k == 1 else 0)) for k in range(1, min(16, i) + 1)))
            scale, sums = scale + np.log(sums[-1]), [x / sums[-1] for x in sums[-16:]]
        return scale

    words = ["abbab", "abbabbaab", "b" * 16, "a" * 15 + "b" * 16 + "abbabbaab", "x" * 100, "ab" * 60, "abbabbaab" * 1000, "b" * 33, "b" * 40]
    got = langid.log_probabilities(words, pieces, np.stack([p, p / 2], axis=1))
    assert np.allclose(got[:, 0], [total("▁" + w) for w in words], rtol=1e-9)


def test_expected_pieces_of_whole_words():
    pieces = langid.Pieces(["a", "b", "▁", "ab", "▁abbab", "bbabba"])
    q = np.append(np.linspace(0.05, 0.3, len(pieces.pieces)), langid.FLOOR)

    def cuts(s):
        return [[]] if not s else [[s[:k], *rest] for k in range(1, len(s) + 1) if s[:k] in pieces.pieces for rest in cuts(s[k:])]

    words = ["▁abbabba", "▁ab", "▁" + "abbab" * 2]
    want = np.zeros(len(pieces.pieces))
    for w in words:
        ways = [([pieces.pieces.index(x) for x in c]) for c in cuts(w)]
        weights = [np.prod(q[c]) for c in ways]
        for c, x in zip(ways, weights):
            np.add.at(want, c, 3 * x / sum(weights))
    got = sum(langid._expected(codes, ends, np.full(len(own), 3.0), pieces, q) for own, codes, ends in langid._by_length(words))
    assert np.allclose(got, want)
    padded = np.array([[ord(c) for c in w.ljust(11, "\0")] for w in words], dtype=np.uint64)
    assert np.allclose(langid._expected(padded, np.array([len(w) for w in words]), np.full(3, 3.0), pieces, q), want)
    assert np.isfinite(langid.learn_pieces({"ab" * 500: 2, "xyz" * 300: 1}, pieces)).all()


def test_pipeline_stages(spark):
    docs = read_table(spark, SF, "documents")
    names = docs.columns
    before = {r["doc_id"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == names, name
        rows = out.collect()
        if name == "toxicity":
            bad = {r["doc_id"] for r in queries.op5_toxicity(spark, SF).where("predicted = 1").collect()}
            assert {r["doc_id"] for r in rows} == before - bad
        elif name == "ngram_jaccard_join":
            groups = queries.ngramjoin.similar_sets(docs).collect()
            assert sorted(r["doc_id"] for r in rows) == sorted({r["component_id"] for r in groups})
        elif name == "personal_data":
            assert len(rows) == docs.count() and not any("@mail" in (r["text"] or "") for r in rows) and all(r["n_chars"] == len(r["text"]) for r in rows)
        docs = spark.createDataFrame(rows, out.schema) if k + 1 < len(corpus_pipeline.STAGES) else docs
    assert sum(r["n_tokens"] for r in rows) > 0 and sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.collect())
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def plain_pipeline(rows, labels):
    """The five stages in plain Python: rows (doc_id, text, lang, source, n_chars), labels {doc_id: toxic}."""
    import hashlib
    import re

    import tiktoken
    from test_exact import base, components

    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    # toxicity: the rows to learn from are in the order of a hash of their ids
    order = lambda k: int(toxicity.mix(np.array([k], np.int64).view(np.uint64))[0])
    text = {}
    for i, t, *_ in rows:
        if i in labels and zlib.crc32(str(i).encode()) % 3 != 1:
            text[i] = t if i not in text or text[i] is None or (t is not None and t < text[i]) else text[i]
    own = sorted((order(i), i, labels[i], np.unique(toxicity.features(t)).astype(np.int32)) for i, t in text.items())
    at, w, bias = toxicity.fit([f for *_, f in own], [y for _, _, y, _ in own])
    weight = dict(zip(at.tolist(), w.tolist(), strict=True))
    score = lambda t: 1 / (1 + np.exp(-(sum(weight.get(f, 0.0) for f in set(toxicity.features(t).tolist())) + bias)))
    rows = [r for r in rows if score(r[1]) < toxicity.THRESHOLD]
    # near copies: of each component the row with the least id, null last
    rank = {k: (r[0] is None, r[0] or 0, k) for k, r in enumerate(rows)}
    found = components([(k, r[1]) for k, r in enumerate(rows)])
    component = {k: c for k, _, c in found}
    least = {}
    for k, c in component.items():
        least[c] = min(least.get(c, rank[k]), rank[k])
    rows = [r for k, r in enumerate(rows) if not words(r[1]) or least[component[k]] == rank[k]]
    # personal data: base spans, overlapping ones as one
    names = ("email", "ip", "card", "phone")
    clean = []
    for i, t, lang, source, n in rows:
        if t is not None:
            parts, end = [], 0
            for a, k, b in base(t):
                if a >= end:
                    parts += [t[end:a], f"<{names[k]}>"]
                end = max(end, b)
            t = "".join(parts) + t[end:]
        clean.append((i, t, lang, source, None if t is None else len(t)))
    # the last two stages are compared by totals of sources and by rows
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.merge_table(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).ranks, special_tokens={})
    ids = lambda t: np.array(enc.encode_ordinary(t or ""), "<u4")
    digest = lambda t: (len(ids(t)), hashlib.sha256(ids(t).tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    return clean, {r[:2]: digest(r[1]) for r in clean}, words


def test_pipeline_against_a_plain_version(spark, tmp_path):
    from collections import Counter

    rng = np.random.default_rng(21)
    word = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 4000, n))
    rows = []
    for i in range(60):
        bad = i % 4 == 0
        t = word(25) + (" vile hateful filth vile slur" * 3 if bad else " kind")
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
    for i in range(60, 75):
        t = rows[i - 59][1] + " tail"
        rows.append((i, t, "en", "s1", len(t)))
    rows += [(80, word(12) + " call +1 (555) 010-2030 or a.b@c.example", "en", "s0", 1), (81, word(9) + " 10.0.0.1 4111 1111 1111 1111", None, None, 1), (82, None, None, None, None), (83, "", "en", "s2", 0), (84, " \n", "en", "s2", 2),
             (85, rows[5][1], "de", "s0", 1), (85, word(30), "de", "s0", 1), (None, word(14), None, "s1", 1), (86, word(700), "en", "s1", 1)]
    labels = {i: int(i % 4 == 0) for i in range(60)}
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(labels.items()), "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    clean, digests, words = plain_pipeline(rows, labels)
    docs = read_table(spark, str(tmp_path), "documents")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
    assert Counter(tuple(r) for r in docs.collect()) == Counter(clean) and 0 < len(clean) < len(rows)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    size = Counter()
    for i, t, _, source, _ in clean:
        size[source] += len(words(t))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    target, open_ = {}, set(size)
    while open_:  # shares by weight, none above three times its source
        rest = (sum(size.values()) - sum(v for s, v in target.items() if s not in open_)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * rest > 3 * size[s]}
        target |= {s: 3.0 * size[s] if s in over else weight[s] * rest for s in (over or open_)}
        open_ = open_ - over if over else set()
    by = {digests[r[:2]]: r for r in clean}
    taken, often = Counter(), Counter()
    for r in got:
        d = (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
        assert d in by and len(r["ids"]) == r["n_tokens"]
        often[r["doc_id"], d] += 1
        taken[r["source"]] += len(words(by[d][1]))
    assert all(n <= 3 for n in often.values()) and all(abs(taken[s] - target[s]) <= 30 + max(len(words(r[1])) for r in clean if r[3] == s) for s in target if size[s])


def test_pipeline_on_odd_rows(spark, docs, odd, tmp_path):
    labels = spark.createDataFrame([(4, 0), (6, 0)], "doc_id bigint, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs(odd).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    kept = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert set(kept) <= {i for i, _ in odd}
