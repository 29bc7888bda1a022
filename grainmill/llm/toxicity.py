"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _C1, lower_ascii, mix, tidy, word_hashes

#: Buckets of the hashed features, a power of two.
BUCKETS = 1 << 20
#: Bound on the labelled rows that the classifier is fitted on.
TRAIN_ROWS = 12000
THRESHOLD = 0.7
#: ASCII characters that aren't letters or digits separate words.
_LETTERS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_A, _B, _C, _D = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5))


@dataclass(frozen=True)
class Ftrl:
    """Learning rates (alpha, beta), penalties (l1, l2) and passes over the rows."""

    alpha: float = 1.5
    beta: float = 1.0
    l1: float = 12.0
    l2: float = 0.0
    epochs: int = 6


def features(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the words, word pairs and pairs with one word skipped of a whole text, as often as they come."""
    w = word_hashes(lower_ascii(text).translate(_LETTERS))
    parts = [mix(w ^ _C1)]
    if len(w) > 1:
        parts.append(mix(w[:-1] * _A + w[1:] * _B))
    if len(w) > 2:
        parts.append(mix(w[:-2] * _C + w[2:] * _D))
    return (np.concatenate(parts) & np.uint64(buckets - 1)).astype(np.int64)


def fit(rows: list[np.ndarray], labels: list[int], how: Ftrl = Ftrl(), buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets and weights that L1 leaves, and the bias. A feature counts once in a text."""
    z, n = np.zeros(buckets), np.zeros(buckets)
    zb, nb = 0.0, 0.0
    rows = [np.unique(r).astype(np.int32) for r in rows]

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= how.l1, 0.0, -(z - np.sign(z) * how.l1) / ((how.beta + np.sqrt(n)) / how.alpha + how.l2))

    for _ in range(how.epochs):
        for at, y in zip(rows, labels, strict=True):
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            wb = -zb / ((how.beta + nb**0.5) / how.alpha)
            g = 1 / (1 + np.exp(-min(max(w.sum() + wb, -35), 35))) - y
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / how.alpha * w
            n[at] = ni + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / how.alpha * wb
            nb += g * g
    w = weights(z, n)
    kept = np.flatnonzero(w)
    return kept, w[kept], -zb / ((how.beta + nb**0.5) / how.alpha)


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "label", key: str = "doc_id", rows: int = TRAIN_ROWS,
          how: Ftrl = Ftrl(), buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on ``labelled``, which holds ``rows`` rows at most, in one task; the sparse weights come back to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            ids, texts, labels = (c.to_pylist() for c in batch.columns)
            found += [(int(mix(np.array([k or 0], np.int64).view(np.uint64))[0]), k or 0, y, np.unique(features(t, buckets)).astype(np.int32)) for k, t, y in zip(ids, texts, labels, strict=True)]
            if len(found) > rows:
                raise ValueError(f"more than {rows} rows to fit on")
        found.sort(key=lambda x: x[:3])
        at, w, bias = fit([f for *_, f in found], [y for _, _, y, _ in found], how, buckets)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int64()), pa.array([*w.tolist(), bias], pa.float64())], names=["bucket", "weight"])

    got = labelled.select(key, text_col, F.col(label_col).cast("int")).repartition(1).mapInArrow(tidy(run), "bucket bigint, weight double").toPandas()
    bias = float(got.loc[got["bucket"] < 0, "weight"].sum())
    got = got[got["bucket"] >= 0].sort_values("bucket")
    return got["bucket"].to_numpy(), got["weight"].to_numpy(), bias


def learn(docs: DataFrame, labels: DataFrame, usable: Column, text_col: str = "text", label_col: str = "toxic", key: str = "doc_id",
          rows: int = TRAIN_ROWS, how: Ftrl = Ftrl(), seed: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on the ``rows`` labelled documents with the smallest seeded hashes among those that ``usable`` allows.

    ``usable`` is an expression over the labels. Rows without key or label are passed over; of repeated labels the highest
    holds; of different texts with one key the least; labels without documents add nothing. Texts count whole, null as the empty
    one. Without any label every score is the bias of 0, that is 0.5.
    """
    known = labels.where(usable & F.col(key).isNotNull() & F.col(label_col).isNotNull()).groupBy(key).agg(F.max(label_col).alias("_label_"))
    few = known.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(rows)
    chosen = docs.select(docs[key].alias("_key_"), docs[text_col].alias("_text_")).join(F.broadcast(few.withColumnRenamed(key, "_key_")), "_key_")  # at most ``rows`` labels
    chosen = chosen.groupBy("_key_").agg(F.min("_text_").alias("text"), F.max("_label_").alias("label"))
    return train(chosen.withColumnRenamed("_key_", "key"), "text", "label", "key", rows, how)


def score(df: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", name: str = "score", buckets: int = BUCKETS) -> DataFrame:
    """All columns of ``df`` and the probability that each whole text is toxic. Null is the empty text, scored by the bias.

    Rows are independent of each other. A column that has the name of the score is replaced.
    """
    at, w, bias = model
    kept = [c for c in df.columns if c != name]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != name] + [f"`{name}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(buckets)
        dense[at] = w
        for batch in batches:
            scores = []
            for text in batch.column(len(kept)).to_pylist():
                f = features(text, buckets)
                f = f[dense[f] != 0]
                scores.append(1 / (1 + np.exp(-min(max(dense[np.unique(f)].sum() + bias, -35), 35))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(scores, pa.float64())], names=[*kept, name])

    return df.select(*[df[c] for c in kept], df[text_col].alias("_text_")).mapInArrow(tidy(run), schema)
