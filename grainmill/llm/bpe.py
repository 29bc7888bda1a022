"""Byte-level BPE encoding and decoding by merge replay.

The distinct pre-tokens of a block of texts are laid out as one array of symbols. An inverted index maps each merge
rank (the token that a pair makes, so that all pairs which make it are together) to the positions of the pair; merges are
applied in rank order to all their positions at once, and only the neighbours touched by a merge are looked up again and enter
the index anew. Merges never leave a word, so a replay of blocks gives what one over the whole corpus gives.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import tidy

#: Characters of text that one replay takes together; bounds a worker's memory and nothing else.
BLOCK_CHARS = 12_000_000


class MergeTable:
    """The merges that a rank file implies: any adjacent pair whose bytes are a token, lowest rank first."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.token_bytes: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.token_bytes[rank] = token
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        keys, merged = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a = ranks.get(token[:i])
                if a is not None and (b := ranks.get(token[i:])) is not None:
                    keys.append(a * self.size + b)
                    merged.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.append(np.array(keys, dtype=np.int64)[order], np.iinfo(np.int64).max)
        self.merged = np.append(np.array(merged, dtype=np.int64)[order], -1)
        # A rank is plain if no pair that its token takes part in has a lower rank.
        self.plain = np.ones(self.size, dtype=bool)
        for part in (self.keys[:-1] // self.size, self.keys[:-1] % self.size):
            self.plain[part[self.merged[:-1] < part]] = False
        everything = np.arange(256)
        self.first = self.lookup(np.repeat(self.byte_id, 256), np.tile(self.byte_id[everything], 256)).reshape(256, 256)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it makes no token."""
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def _makes_earlier(self, rank: int, at: np.ndarray, symbol: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Of places merged from left to right: whether the merge makes a pair of a lower rank with its left or right neighbour."""
        left, right = before[at], after[after[at]]
        merged = np.concatenate(([False], after[after[at[:-1]]] == at[1:]))  # the left neighbour has just become this token
        a = np.where(merged, rank, np.where(left >= 0, symbol[left], 0))
        made_left = np.where(left >= 0, self.lookup(a, np.full(len(at), rank)), -1)
        made_right = np.where(right >= 0, self.lookup(np.full(len(at), rank), symbol[right]), -1)
        return ((made_left >= 0) & (made_left < rank)) | ((made_right >= 0) & (made_right < rank))

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and the number of ids of each.

        All places of a pair are merged at once, from left to right, up to the first in each word whose merge makes a pair of a
        lower rank: that pair comes next, and the places after it wait. Few merges do, so that long words, too, take a number of
        steps that grows with the ranks that occur in them and not with their length.
        """
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        buf = np.frombuffer(b"".join(words), dtype=np.uint8)
        n = len(buf)
        word = np.repeat(np.arange(len(words)), lens)
        symbol = self.byte_id[buf]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(lens)
        after[ends - 1] = -1
        before[ends - lens] = -1
        pair = np.full(n, -1, dtype=np.int64)
        inner = np.flatnonzero(after >= 0)
        pair[inner] = self.first[buf[inner], buf[inner + 1]]
        whole = np.fromiter(map(self.ranks.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        pair[(whole >= 0)[word]] = -1  # a word that is a token needs no merges
        index: dict[int, list[np.ndarray]] = {}

        def enter(at: np.ndarray) -> list[int]:
            rank = pair[at]
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            fresh = []
            for r, part in zip(rank[np.concatenate(([0], cuts))].tolist() if len(rank) else [], np.split(at, cuts), strict=False):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    fresh.append(r)
            return fresh

        heap = enter(np.flatnonzero(pair >= 0))
        heapify(heap)
        while heap:
            rank = heappop(heap)
            parts = index.pop(rank)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[pair[at] == rank]
            if not len(at):
                continue
            chained = np.concatenate(([False], at[1:] == after[at[:-1]]))
            if chained.any():  # overlapping pairs: every second one of a chain, from its left end
                spot = np.arange(len(at))
                start = np.maximum.accumulate(np.where(chained, 0, spot))
                at = at[(spot - start) % 2 == 0]
            if not self.plain[rank]:
                early = self._makes_earlier(rank, at, symbol, after, before)
                if early.any():
                    passed = np.cumsum(early) - early  # hits before each place, of all words
                    head_at = np.concatenate(([True], word[at[1:]] != word[at[:-1]]))
                    at_head = np.maximum.accumulate(np.where(head_at, np.arange(len(at)), 0))
                    wait = passed > passed[at_head]
                    if wait.any():
                        index[rank] = [at[wait]]
                        heappush(heap, rank)
                        at = at[~wait]
            gone = after[at]
            then = after[gone]
            symbol[at], symbol[gone], pair[gone] = rank, -1, -1
            after[at] = then
            more = then >= 0
            before[then[more]] = at[more]
            pair[at] = -1
            left = before[at]
            left = left[left >= 0]
            touched = np.concatenate((at[more], left))
            pair[touched] = self.lookup(symbol[touched], symbol[after[touched]])
            touched = touched[pair[touched] >= 0]
            if len(touched):
                for r in enter(np.unique(touched)):
                    heappush(heap, r)
        # words that are tokens as a whole
        single = (whole >= 0)[word]
        head = np.zeros(n, dtype=bool)
        head[ends - lens] = True
        symbol[single & head] = whole[word[single & head]]
        symbol[single & ~head] = -1
        live = symbol >= 0
        return symbol[live], np.bincount(word[live], minlength=len(words))


_TABLES: dict[str, MergeTable] = {}


def merge_table(path: str) -> MergeTable:
    if path not in _TABLES:
        _TABLES[path] = MergeTable(path)
    return _TABLES[path]


def encode_block(texts: list[str], table: MergeTable, pattern: regex.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and the offsets of each text in them (one more than texts)."""
    seen: defaultdict[str, int] = defaultdict()
    seen.default_factory = seen.__len__  # the next number for a word not seen yet
    number = seen.__getitem__
    spots = []
    for t in texts:
        found = pattern.findall(t)
        spots.append(np.fromiter(map(number, found), dtype=np.int32, count=len(found)))
    if not seen:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    ids, count = table.encode_words([w.encode("utf-8", "surrogatepass") for w in seen])
    start = np.cumsum(count) - count
    out, offsets = [], np.zeros(len(texts) + 1, np.int64)
    for i, spot in enumerate(spots):
        c = count[spot]
        total = int(c.sum())
        offsets[i + 1] = offsets[i] + total
        if total:
            out.append(ids[np.repeat(start[spot] - (np.cumsum(c) - c), c) + np.arange(total)])
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), offsets


#: What ``tokenize`` can return, and its Arrow type.
OUTPUTS = {
    "n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.binary(),
    "ids_sha256": pa.string(), "decoded_sha256": pa.string(),
}
_SQL = {"n_tokens": "bigint", "ids": "array<int>", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}


def tokenize(
    df: DataFrame, vocab_path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
    outputs: tuple[str, ...] = ("n_tokens", "ids"), block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Encode whole texts and decode the ids again.

    ``keep`` names the columns passed on; ``outputs`` the results wanted, of ``OUTPUTS``: the ids, the bytes that they
    decode to, their number, and digests of both. A null text counts as the empty one and has no ids. Rows are
    independent of each other: ties, repeated rows and any further columns change nothing. A column of ``keep`` that
    has the name of an output is an error. Memory is bounded by ``block_chars``, or by the longest single text.
    """
    if clash := set(keep) & set(outputs):
        raise ValueError(f"kept columns clash with outputs: {sorted(clash)}")
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} {_SQL[c]}" for c in outputs])

    def block(rows: pa.Table, texts: list[str]) -> Iterator[pa.RecordBatch]:
        table = merge_table(vocab_path)
        ids, offsets = encode_block(texts, table, regex.compile(pattern))
        got: dict[str, list] = {c: [] for c in outputs}
        decode = {"decoded", "decoded_sha256"} & set(outputs)
        for i in range(len(texts)):
            own = ids[offsets[i] : offsets[i + 1]]
            if "n_tokens" in got:
                got["n_tokens"].append(len(own))
            if "ids" in got:
                got["ids"].append(own.astype(np.int32))
            if "ids_sha256" in got:
                got["ids_sha256"].append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
            if decode:
                data = b"".join(map(table.token_bytes.__getitem__, own.tolist()))
                if "decoded" in got:
                    got["decoded"].append(data)
                if "decoded_sha256" in got:
                    got["decoded_sha256"].append(hashlib.sha256(data).hexdigest())
        columns = [rows.column(c) for c in keep] + [pa.array(got[c], type=OUTPUTS[c]) for c in outputs]
        yield from pa.table(columns, names=[*keep, *outputs]).combine_chunks().to_batches(max_chunksize=2000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, chars = [], [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                own = [t or "" for t in part.column(len(keep)).to_pylist()]
                held.append(part)
                texts += own
                chars += sum(map(len, own))
                if chars >= block_chars:
                    yield from block(pa.Table.from_batches(held), texts)
                    held, texts, chars = [], [], 0
        if held:
            yield from block(pa.Table.from_batches(held), texts)

    return df.select(*[df[c] for c in keep], df[text_col].alias("_text_")).mapInArrow(tidy(run), schema)
