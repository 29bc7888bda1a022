"""Quality: multiple-instance learning. Passages are encoded, gated attention weighs them, and the weighted whole is scored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, mix, word_hashes

#: Bound on the labelled rows that the model is fitted on.
TRAIN_ROWS = 4000
THRESHOLD = 0.7
#: Words of a passage, buckets of its byte pairs, and widths of its encoding and of the attention.
PASSAGE, PAIRS, ENCODED, GATED = 64, 96, 24, 12
EPOCHS, BATCH, RATE, DECAY, SEED = 24, 32, 0.004, 1e-4, 13
#: Passages that a scoring task encodes at a time, one document aside.
AT_ONCE = 4096

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:!?", b"\n", bytes(range(128, 256))]
_KIND = np.full(256, len(_CLASSES), np.uint8)  # the last one: other symbols
for _i, _c in enumerate(_CLASSES):
    _KIND[np.frombuffer(_c, np.uint8)] = _i
_KIND[[32, 9, 11, 12, 13]] = len(_CLASSES) + 1
_N = len(_CLASSES) + 1
#: Shares of the byte classes, of words new to the text, new to the passage, equal to the one before, capitalised and in capitals,
#: ending in a symbol; mean and largest word length and number of words, as logarithms; then byte pairs.
FEATURES = _N + 9 + PAIRS


def encode_text(text: str | None, words: int = PASSAGE) -> np.ndarray:
    """One row of ``FEATURES`` numbers for each ``words`` words of a whole text, the last row for what remains; a text without
    words is one row of zeros."""
    data = b"" if text is None else text.encode("utf-8", "surrogatepass")
    hashes = word_hashes(lower_ascii(text))
    n = len(hashes)
    if not n:
        return np.zeros((1, FEATURES), np.float32)
    buf = np.frombuffer(data, np.uint8)
    kind = _KIND[buf]
    blank = (kind == _N) | (buf == 10)
    edge = np.diff(np.concatenate(([True], blank, [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    own = np.arange(0, n, words)
    passage = np.arange(n) // words
    size = np.diff(np.append(own, n))
    begin = np.append(starts[own], len(buf))
    begin[0] = 0
    of_byte = np.repeat(np.arange(len(own)), np.diff(begin))
    by_kind = np.bincount(of_byte * (_N + 1) + kind, minlength=len(own) * (_N + 1)).reshape(-1, _N + 1)[:, :_N]
    order = np.argsort(hashes, kind="stable")
    same = np.zeros(n, bool)
    same[order[1:]] = hashes[order[1:]] == hashes[order[:-1]]
    near = np.zeros(n, bool)
    near[order[1:]] = same[order[1:]] & (passage[order[1:]] == passage[order[:-1]])
    first, last = kind[starts], kind[ends - 1]
    upper = np.concatenate(([0], np.cumsum(kind == 0)))
    length = ends - starts
    flags = np.stack([~same, ~near, np.concatenate(([False], hashes[1:] == hashes[:-1])), first == 0, (upper[ends] - upper[starts] > 1), last == _N - 1, np.zeros(n, bool)]).astype(np.float32)
    flags[-1] = np.log1p(length)
    shares = np.add.reduceat(flags, own, axis=1).T / size[:, None]
    out = np.empty((len(own), FEATURES), np.float32)
    out[:, :_N] = by_kind / np.maximum(by_kind.sum(axis=1, keepdims=True), 1)
    out[:, _N : _N + 7] = shares
    out[:, _N + 7] = np.log1p(np.maximum.reduceat(length, own))
    out[:, _N + 8] = np.log1p(size)
    if len(buf) > 1:
        pair = (mix(buf[:-1].astype(np.uint64) * np.uint64(257) + buf[1:]) % np.uint64(PAIRS)).astype(np.int64)
        pairs = np.bincount(of_byte[:-1] * PAIRS + pair, minlength=len(own) * PAIRS).reshape(-1, PAIRS)
        out[:, _N + 9 :] = np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1))
    else:
        out[:, _N + 9 :] = 0
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Model:
    """Encoder, gate and classifier; ``parts`` are their weights in order, ``mean`` and ``scale`` those of the features."""

    NAMES = ("encoder", "encoder_bias", "tanh", "tanh_bias", "gate", "gate_bias", "weigh", "judge", "judge_bias")

    def __init__(self, mean: np.ndarray, scale: np.ndarray, parts: list[np.ndarray]):
        self.mean, self.scale, self.parts = mean, scale, parts

    @classmethod
    def fresh(cls, mean: np.ndarray, scale: np.ndarray, encoded: int = ENCODED, gated: int = GATED, seed: int = SEED) -> Model:
        rng, n = np.random.default_rng(seed), len(mean)
        made = lambda a, b: rng.normal(0, a**-0.5, (a, b))
        return cls(mean, scale, [made(n, encoded), np.zeros(encoded), made(encoded, gated), np.zeros(gated), made(encoded, gated), np.zeros(gated), made(gated, 1)[:, 0], made(encoded, 1)[:, 0], np.zeros(1)])

    def forward(self, x: np.ndarray, begin: np.ndarray) -> tuple:
        """Probability of each document, whose passages begin at ``begin`` in ``x``, the attention of each passage, and what the
        gradients need."""
        w1, b1, v, bv, u, bu, w, c, b = self.parts
        x = (x - self.mean) / self.scale
        of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(x))))
        h = np.tanh(x @ w1 + b1)
        t, s = np.tanh(h @ v + bv), _sigmoid(h @ u + bu)
        e = (t * s) @ w
        a = np.exp(e - np.maximum.reduceat(e, begin)[of])
        a /= np.add.reduceat(a, begin)[of]
        z = np.add.reduceat(a[:, None] * h, begin, axis=0)
        return _sigmoid(z @ c + b[0]), a, (x, of, h, t, s, z)

    def gradients(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean logistic loss."""
        _, _, v, _, u, _, w, c, _ = self.parts
        p, a, (x, of, h, t, s, z) = self.forward(x, begin)
        dl = (p - y) / len(y)
        dz = (dl[:, None] * c)[of]
        da = (h * dz).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, begin)[of])
        dg = de[:, None] * w
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dp = (a[:, None] * dz + dt @ v.T + ds @ u.T) * (1 - h * h)
        return [x.T @ dp, dp.sum(axis=0), h.T @ dt, dt.sum(axis=0), h.T @ ds, ds.sum(axis=0), (t * s).T @ de, z.T @ dl, dl.sum(keepdims=True)]

    def to_bytes(self) -> bytes:
        return np.concatenate([x.ravel() for x in (self.mean, self.scale, *self.parts)]).astype("<f8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, encoded: int = ENCODED, gated: int = GATED) -> Model:
        shapes = [(FEATURES,), (FEATURES,), (FEATURES, encoded), (encoded,), (encoded, gated), (gated,), (encoded, gated), (gated,), (gated,), (encoded,), (1,)]
        flat, at, parts = np.frombuffer(data, "<f8"), 0, []
        for shape in shapes:
            n = int(np.prod(shape))
            parts.append(flat[at : at + n].reshape(shape))
            at += n
        return cls(parts[0], parts[1], parts[2:])


def fit(bags: list[np.ndarray], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Adam over batches of whole documents, in an order drawn anew each epoch; weights decay."""
    every = np.concatenate(bags)
    model = Model.fresh(every.mean(axis=0, dtype=np.float64), every.std(axis=0, dtype=np.float64) + 1e-3, seed=seed)
    rng, y = np.random.default_rng(seed), np.array(labels, float)
    m, s = [np.zeros_like(p) for p in model.parts], [np.zeros_like(p) for p in model.parts]
    step, steps = 0, epochs * -(-len(bags) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), BATCH):
            own = order[k : k + BATCH]
            sizes = np.array([len(bags[i]) for i in own])
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for i, g in enumerate(model.gradients(np.concatenate([bags[i] for i in own]), np.cumsum(sizes) - sizes, y[own])):
                g = g + DECAY * model.parts[i]
                m[i], s[i] = 0.9 * m[i] + 0.1 * g, 0.99 * s[i] + 0.01 * g * g
                model.parts[i] = model.parts[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-8)
    return model


def learn(docs: DataFrame, labels: DataFrame, usable: Column, text_col: str = "text", label_col: str = "quality", key: str = "doc_id", rows: int = TRAIN_ROWS, seed: int = SEED) -> Model | None:
    """Fit on the ``rows`` labelled documents with the smallest seeded hashes among those that ``usable`` allows; None without any.

    ``usable`` is an expression over the labels. Rows without key or label are passed over; of repeated labels the highest holds;
    of different texts with one key the least; labels without documents add nothing. Texts are encoded whole, by all tasks, null as
    the empty one; one task fits on the passages of at most ``rows`` documents.
    """
    known = labels.where(usable & F.col(key).isNotNull() & F.col(label_col).isNotNull()).groupBy(key).agg(F.max(label_col).cast("int").alias("_label"))
    few = known.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(rows).withColumnRenamed(key, "_key")
    chosen = docs.select(docs[key].alias("_key"), docs[text_col].alias("_text")).join(F.broadcast(few), "_key")  # at most ``rows`` labels
    chosen = chosen.groupBy("_key").agg(F.min("_text").alias("text"), F.max("_label").alias("label"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t, y in zip(*(batch.column(i) for i in range(3)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], pa.int64()), pa.array([y.as_py()], pa.int32()), pa.array([encode_text(t.as_py()).astype("<f4").tobytes()])], names=["key", "label", "passages"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[:2])
        if len(found) > rows:
            raise ValueError(f"more than {rows} rows to fit on")
        if found:
            model = fit([np.frombuffer(p, "<f4").reshape(-1, FEATURES) for _, _, p in found], [y for _, y, _ in found], seed=seed)
            yield pa.RecordBatch.from_arrays([pa.array([model.to_bytes()])], names=["model"])

    encoded = chosen.select(F.col("_key").cast("bigint"), "text", "label").mapInArrow(encode, "key bigint, label int, passages binary")
    got = encoded.repartition(1).mapInArrow(run, "model binary").first()  # a few tens of kilobytes
    return Model.from_bytes(got["model"]) if got else None


def score(df: DataFrame, model: Model | None, text_col: str = "text", name: str = "score", attention: str | None = None) -> DataFrame:
    """All columns of ``df`` and the probability that each whole text is of quality; with ``attention`` also the weights of its
    passages, an array of that name. Rows are independent of each other.

    Null and empty texts are one passage of zeros. Without a model every score is 0.5 and passages weigh the same. Columns that
    have the names of the results are replaced.
    """
    made = [name] if attention is None else [name, attention]
    kept = [c for c in df.columns if c not in made]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in made] + [f"`{name}` double"] + [f"`{attention}` array<double>"] * (attention is not None))
    data = model.to_bytes() if model else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.from_bytes(data) if data else None
        for batch in batches:
            scores: list[float] = []
            weights: list[np.ndarray] = []
            waiting: list[np.ndarray] = []

            def flush() -> None:
                if waiting:
                    sizes = np.array([len(x) for x in waiting])
                    begin = np.cumsum(sizes) - sizes
                    p, a = own.forward(np.concatenate(waiting), begin)[:2] if own else (np.full(len(sizes), 0.5), np.repeat(1 / sizes, sizes))
                    scores.extend(p.tolist())
                    weights.extend(np.split(a, begin[1:]) if attention else [])
                    waiting.clear()

            held = 0
            for text in batch.column(len(kept)):
                waiting.append(encode_text(text.as_py()))
                held += len(waiting[-1])
                if held >= AT_ONCE:
                    flush()
                    held = 0
            flush()
            columns = [*batch.columns[: len(kept)], pa.array(scores, pa.float64())] + ([pa.array(weights, pa.list_(pa.float64()))] if attention else [])
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *made])

    return df.select(*[df[c] for c in kept], df[text_col].alias("_text_")).mapInArrow(run, schema)
