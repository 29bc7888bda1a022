"""Language identification by unigram pieces: a word's probability is summed over all its segmentations.

Each language has a probability for each piece of a fixed public vocabulary. The forward algorithm sums over every way
to cut a word into pieces; expectation maximisation with the backward algorithm learns the probabilities.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _C1, mix

#: Bound on the documents that the probabilities are learned from, shared out evenly among the languages.
TRAIN_ROWS = 3000
#: Words at most so long are scored with others of the same length only; longer ones are padded to a common length.
SAME = 32
#: Code points of words that are looked up at once, and places of a word; both bound memory and nothing else.
CELLS, PLACES = 480_000, 4096
#: Places after which sums are rescaled; so many floors do not underflow together with the longest piece.
RESCALE = 8
#: Characters of text that a worker scores together; bounds its memory and nothing else.
BLOCK_CHARS = 12_000_000
#: Probability of a single character that is no piece, and pseudo-count of each piece.
FLOOR, PSEUDO = 1e-7, 0.05
_MARK = "▁"
_BREAKS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_LETTER, _ALPHANUMERIC = re.compile(r"[A-Za-z]"), re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether any character is a letter by its Unicode category; numbers such as one half or superscripts are none."""
    return bool(_LETTER.search(text)) or any(m.group().isalpha() for m in _ALPHANUMERIC.finditer(text))


def split_words(text: str) -> list[str]:
    """Lower-case words between white space and ASCII characters that aren't letters, marked at their start."""
    out = []
    for w in text.lower().encode("utf-8", "surrogatepass").translate(_BREAKS).decode("utf-8", "surrogatepass").split():
        out.append(w)
    return out


class Pieces:
    """Looks up all substrings of words, up to the longest piece, in the vocabulary."""

    def __init__(self, pieces: list[str]):
        self.pieces = sorted({p for p in pieces if p})
        self.longest = max(map(len, self.pieces), default=1)
        codes = [np.array([ord(c) for c in p], dtype=np.uint64) for p in self.pieces]
        keys = np.array([self._key(c) for c in codes], dtype=np.uint64)
        self.order = np.argsort(keys)
        self.keys = np.append(keys[self.order], np.uint64((1 << 64) - 1))

    @staticmethod
    def _key(codes: np.ndarray) -> int:
        h = np.zeros(1, dtype=np.uint64)
        for c in codes:
            h = mix(h * _C1 + np.uint64(c) + np.uint64(1))
        return int(h[0])

    def find(self, words: np.ndarray) -> list[np.ndarray]:
        """For words of one length, as rows of code points: by length k, the piece that ends before each place, or -1."""
        rows, n = words.shape
        out, h = [], np.zeros((rows, n), dtype=np.uint64)
        for k in range(1, min(self.longest, n) + 1):
            h = mix(h[:, : n - k + 1] * _C1 + words[:, k - 1 :] + np.uint64(1))
            at = np.searchsorted(self.keys, h.ravel()).reshape(h.shape)
            hit = self.keys[at] == h
            out.append(np.where(hit, self.order[np.minimum(at, len(self.order) - 1)], -1).astype(np.int32))
        return out


def forward(words: np.ndarray, ends: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Rows x languages: the logarithm of the sum over all segmentations of each row up to its end.

    ``p``: pieces x languages, last row the floor. Only the sums of the last places are held, under one scale.
    """
    (rows, n), longest = words.shape, pieces.longest
    window = np.zeros((longest, rows, p.shape[1]))  # of place i at i modulo the longest piece
    window[0] = 1
    scale, out = np.zeros((2, rows, p.shape[1]))
    stops = set(ends.tolist())
    for begin in range(0, n, PLACES):
        end, left = min(n, begin + PLACES), max(0, begin - longest + 1)
        found = pieces.find(words[:, left:end])
        some = [(at >= 0).any(axis=0) for at in found]
        for i in range(begin + 1, end + 1):
            new = window[(i - 1) % longest] * p[found[0][:, i - 1 - left]]
            for k in range(2, min(longest, i) + 1):
                if some[k - 1][i - k - left]:
                    own = found[k - 1][:, i - k - left]
                    hit = np.flatnonzero(own >= 0)
                    new[hit] += window[(i - k) % longest, hit] * p[own[hit]]
            window[i % longest] = new
            if i in stops:
                at = np.flatnonzero(ends == i)
                out[at] = np.log(new[at]) + scale[at]
            if i % RESCALE == 0:
                top = window.max(axis=0)
                window /= top
                scale += np.log(top)
    return out


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``words``, code points by row and lengths, of words of one length or of long ones padded by a quarter at most."""
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(lens, kind="stable")
    sizes, at = lens[order], 0
    while at < len(order):
        most = sizes[at] if sizes[at] <= SAME else sizes[at] * 5 // 4
        stop = min(int(np.searchsorted(sizes, most, "right")), at + max(1, CELLS // int(most)))
        own, n = order[at:stop], int(sizes[stop - 1])
        data = "".join([words[i].ljust(n, "\0") for i in own]).encode("utf-32-le", "surrogatepass")
        yield own, np.frombuffer(data, dtype="<u4").reshape(len(own), n).astype(np.uint64), sizes[at:stop]
        at = stop


def log_probabilities(words: list[str], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Words x languages: the logarithm of each whole word's probability, all segmentations summed."""
    out = np.zeros((len(words), p.shape[1]))
    for own, codes, ends in _by_length([_MARK + w for w in words]):
        out[own] = forward(codes, ends, pieces, p)
    return out


def _expected(codes: np.ndarray, ends: np.ndarray, often: np.ndarray, pieces: Pieces, q: np.ndarray) -> np.ndarray:
    """How often each piece is expected in rows that stand for ``often`` words each; sums are held as logarithms."""
    (rows, n), longest = codes.shape, pieces.longest
    found = pieces.find(codes)
    a = np.zeros((n + 1, rows))
    for i in range(1, n + 1):
        top = a[max(0, i - longest) : i].max(axis=0)
        total = np.exp(a[i - 1] - top) * q[found[0][:, i - 1]]
        for k in range(2, min(longest, i) + 1):
            own = found[k - 1][:, i - k]
            hit = np.flatnonzero(own >= 0)
            total[hit] += np.exp(a[i - k, hit] - top[hit]) * q[own[hit]]
        a[i] = top + np.log(total)
    b = np.full((n + 1, rows), -np.inf)
    b[ends, np.arange(rows)] = 0
    for i in range(n - 1, -1, -1):
        live = np.flatnonzero(ends > i)
        top = b[i + 1 : i + 1 + longest, live].max(axis=0)
        total = np.exp(b[i + 1, live] - top) * q[found[0][live, i]]
        for k in range(2, min(longest, n - i) + 1):
            own = found[k - 1][live, i]
            hit = np.flatnonzero(own >= 0)
            total[hit] += np.exp(b[i + k, live[hit]] - top[hit]) * q[own[hit]]
        b[i, live] = top + np.log(total)
    whole = a[ends, np.arange(rows)]
    out = np.zeros(len(pieces.pieces))
    for k, at in enumerate(found, 1):
        row, i = np.nonzero(at >= 0)
        ids = at[row, i]
        out += np.bincount(ids, weights=np.exp(a[i, row] + b[i + k, row] - whole[row]) * q[ids] * often[row], minlength=len(out))
    return out


def learn_pieces(counts: Counter, pieces: Pieces, rounds: int = 3) -> np.ndarray:
    """Piece probabilities of a language from its words, by expectation maximisation."""
    size = len(pieces.pieces)
    words = sorted(counts)
    often = np.array([counts[w] for w in words], dtype=float)
    marked = [_MARK + w for w in words]
    p = np.append(np.full(size, 1 / size), FLOOR)
    for _ in range(rounds):
        expected = np.full(size, PSEUDO)
        for own, codes, ends in _by_length(marked):
            expected += _expected(codes, ends, often[own], pieces, p)
        p = np.append(expected / expected.sum(), FLOOR)
    return p


def vocabulary(model_path: str) -> list[str]:
    """The ordinary pieces of a public sentencepiece model."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]


def learn(docs: DataFrame, usable: Column, model_path: str, text_col: str = "text", lang_col: str = "lang", key: str = "doc_id",
          rows: int = TRAIN_ROWS, seed: int = 7) -> tuple[list[str], list[str], np.ndarray]:
    """Languages, pieces and probabilities (pieces x languages) from at most ``rows`` documents, the same number of each language.

    Of each language those with the smallest seeded hashes are taken, so that rare languages are learned as well; where there are
    more languages than ``rows``, the first in alphabetical order. The sample is drawn by key first, so only its texts are moved.
    Rows without text or language teach nothing; repeated rows count each. One task learns; the driver gets pieces x languages
    numbers.
    """
    known = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    number = F.xxhash64(F.lit(seed), F.col(key))
    sizes = known.groupBy(F.col(lang_col).alias("_lang")).agg(F.count(F.lit(1)).alias("_n")).orderBy("_lang").limit(rows)  # at most ``rows`` languages
    each = max(1, rows // max(1, sizes.count()))
    # hashes are uniform: half as many again fall below this share, of which the smallest are taken
    share = F.least(F.lit(1.0), (1.5 * each + 20) / F.col("_n"))
    edge = F.when(share >= 1, F.lit((1 << 63) - 1)).otherwise(((2 * share - 1) * float(1 << 63)).cast("long"))
    few = known.select(F.col(lang_col).alias("_lang"), number.alias("_h")).join(F.broadcast(sizes.select("_lang", edge.alias("_edge"))), "_lang").where("_h <= _edge")
    nth = F.row_number().over(Window.partitionBy("_lang").orderBy("_h"))
    ends = few.withColumn("_nth", nth).where(F.col("_nth") <= each).groupBy("_lang").agg(F.max("_h").alias("_end"))
    chosen = known.select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"), number.alias("_h")).join(F.broadcast(ends), "_lang").where("_h <= _end").select("_lang", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts[lang].update(split_words(text))
        pieces = Pieces(vocabulary(model_path))
        langs = sorted(x for x in counts if counts[x])
        learned = [learn_pieces(counts[x], pieces).astype(np.float64).tobytes() for x in langs]
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(learned, pa.binary())], names=["lang", "p"])

    got = sorted(chosen.repartition(1).mapInArrow(run, "lang string, p binary").collect())
    if not got:
        return [], [], np.zeros((1, 0))
    pieces = Pieces(vocabulary(model_path)).pieces
    return [r["lang"] for r in got], pieces, np.stack([np.frombuffer(r["p"]) for r in got], axis=1)


def predict(df: DataFrame, model: tuple[list[str], list[str], np.ndarray], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The likeliest language of each whole text and its probability among those learned.

    ``und`` with score 0 for texts that are null or have no letter, and for all if no language was learned. Of equally likely
    languages the first in alphabetical order holds. Rows are independent of each other: repeated rows and null keys change
    nothing, texts count whole, an empty table gives an empty result. ``keep`` names the columns passed on; those with the name of
    a result are an error.
    """
    langs, names, p = model
    if clash := set(keep) & {"lang_pred", "score"}:
        raise ValueError(f"kept columns clash with results: {sorted(clash)}")
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["lang_pred string", "score double"])
    shared = df.sparkSession.sparkContext.broadcast((names, p))  # at most pieces x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, p = shared.value
        pieces = Pieces(names)

        def block(held: list[pa.RecordBatch], texts: list) -> Iterator[pa.RecordBatch]:
            seen: defaultdict[str, int] = defaultdict()
            seen.default_factory = seen.__len__
            spots = []
            for t in texts:
                words = split_words(t) if t is not None and langs and has_letter(t) else None
                spots.append(None if words is None else np.fromiter(map(seen.__getitem__, words), dtype=np.int32, count=len(words)))
            logs = log_probabilities(list(seen), pieces, p)
            best, scores = [], []
            for spot in spots:
                if spot is None or not len(spot):
                    best.append("und")
                    scores.append(0.0)
                    continue
                total = logs[spot].sum(axis=0)
                share = np.exp(total - total.max())
                best.append(langs[int(total.argmax())])
                scores.append(float(share.max() / share.sum()))
            rows = pa.Table.from_batches(held)
            table = pa.table([*[rows.column(c) for c in keep], pa.array(best, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])
            yield from table.combine_chunks().to_batches(max_chunksize=5000)

        held, texts, chars = [], [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                own = part.column(len(keep)).to_pylist()
                held.append(part)
                texts += own
                chars += sum(len(t or "") for t in own)
                if chars >= block_chars:
                    yield from block(held, texts)
                    held, texts, chars = [], [], 0
        if held:
            yield from block(held, texts)

    return df.select(*[df[c] for c in keep], df[text_col].alias("_text_")).mapInArrow(run, schema)
