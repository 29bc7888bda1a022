"""N-gram Jaccard self-join by partitions of the universe of tokens.

Two sets with a Jaccard similarity of ``similarity`` per cent differ in at most H tokens, a bound that grows with their
sizes. For each band of sizes the universe of tokens is hashed into segments. With H + 1 + slack of them, similar sets
have more than ``slack`` segments in common (pigeonhole); with H // 2 + 1 + slack, they have more than ``slack`` that
differ in one token at most, which the one-deletion neighbourhoods of a segment find. A cost model allots one of the two
schemes to each band. Sets meet through the segments they share; the pairs are then verified on whole sets.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _C1, _C2, _C3, cut_lineage, cut_small, lower_ascii, mix, release, shingle_hashes, shingle_set, shuffle_partitions, tidy
from .components import connected_components

WIDTH, SIMILARITY = 5, 80
#: Ratio of the ends of a band of sizes.
RATIO = 1.4
#: A shared signature of more sets than this is hot: not all its pairs are listed, but each of its sets with the first one.
#: Results do not depend on it: what may be hidden by that is counted for each set (see ``similar_sets``).
HOT = 12
#: Sets, and bytes of their texts, whose tokens are counted to order those of prefixes; bounds what is broadcast, changes no result.
COMMON_ROWS, COMMON_BYTES = 10_000, 1 << 24
#: Sets of one prefix token that meet in one task at least; longer lists are cut into stretches, each of which meets in a task.
CELL = 128
#: Stretches of a list, however long, until one would have more than ``LONGEST`` sets (168 bytes each); so a set is sent to so many
#: tasks for a token at most, and what a round shuffles grows with its sets alone.
STRETCHES, LONGEST = 8, 1 << 16
#: Pairs of sets whose sizes are compared at once.
_MET = 1 << 16
#: Bits of the outline of a set; more tell larger sets apart, results do not depend on it.
OUTLINE = 1024
#: Rows of a table of pairs, labels or names that is broadcast (16 bytes or so each); more meet in shuffles of both sides.
FEW = 50_000
#: Sets whose outlines are broadcast (152 bytes each).
FEW_OUTLINES = 20_000
#: Members of a hot signature in a row; more make more rows.
BLOCK = 4096
#: Signatures that a scanning task holds before it hands them on; bounds its memory and nothing else.
_HELD = 600_000
#: Weight of an unrelated meeting against a signature, in the cost model.
_MEETING = 50.0


@lru_cache(maxsize=None)
def band(i: int) -> tuple[int, int]:
    """The least and greatest size of a band."""
    low = 1 if i == 0 else band(i - 1)[1] + 1
    return low, max(low, int(low * RATIO))


@lru_cache(maxsize=1 << 16)
def bands_of(n: int, similarity: int) -> tuple[int, ...]:
    """The band of a set of ``n`` tokens and those of larger sets that may be similar to it."""
    i = 0
    while band(i)[1] < n:
        i += 1
    out = [i]
    while band(i + 1)[0] * similarity <= 100 * n:
        i += 1
        out.append(i)
    return tuple(out)


@lru_cache(maxsize=None)
def allocate(i: int, similarity: int) -> tuple[int, int, int, bool]:
    """Of a band: H, segments, slack, and whether one-deletion neighbourhoods are used; the cheaper of the two schemes."""
    high = band(i)[1]
    h = 2 * high * (100 - similarity) // (100 + similarity)
    slack = max(4, h // 4)
    plain, near, spare = h + 1 + slack, h // 2 + 1 + slack // 4, slack // 4
    cost = lambda count, tokens: count * (1 + _MEETING * exp(-tokens))
    if cost(plain, high / plain) <= cost(high + near, high / near - 1):
        return h, plain, slack, False
    return h, near, spare, True


def signatures(tokens: np.ndarray, i: int, similarity: int) -> tuple[np.ndarray, int]:
    """Keys of a set in a band, and how many of its segments are too weak to have any.

    A set needs as many segments as its own largest partner in the band asks for, which are the first ones of the band; two
    similar sets both have those that the pair needs. A set with more weak segments than the slack of its band also gets
    the band's own key, shared by all such sets.
    """
    h, m, slack, near = allocate(i, similarity)
    if not h:
        return np.zeros(0, np.uint64), 0  # similar sets are equal here
    n = len(tokens)
    own = (n + min(band(i)[1], 100 * n // similarity)) * (100 - similarity) // (100 + similarity)
    used_segments = min(m, own // 2 + 1 + slack if near else own + 1 + slack)
    segment = (mix(tokens * _C1 + np.uint64(i)) % np.uint64(m)).astype(np.int64)
    tokens, segment, m = tokens[segment < used_segments], segment[segment < used_segments], used_segments
    if not len(tokens):
        return mix(np.array([i + 1 << 40], np.uint64)), m
    order = np.argsort(segment, kind="stable")
    segment, share = segment[order], mix(tokens[order] ^ _C2)
    start = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    total = np.add.reduceat(share, start)
    used = segment[start]
    tag = mix(used.astype(np.uint64) * _C2 + np.uint64(i + 1))
    if not near:
        keys, weak = mix(total + tag), m - len(used)
    else:
        size = np.diff(np.append(start, len(tokens)))
        weak = m - int((size > 2).sum())
        of = np.repeat(np.arange(len(used)), size)
        lone = size[of] > 1
        less = mix(total[of] - share + tag[of])[lone & (size[of] > 2)]
        keys = np.unique(np.concatenate((mix(total + tag)[size > 1], less)))
    if weak > slack:
        keys = np.append(keys, mix(np.array([i + 1 << 40], np.uint64)))
    return keys, weak


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set. The first names it as a node of the graph, unless two sets share it."""
    size = np.array([len(tokens)], np.uint64)
    first, second = mix(mix(tokens).sum(keepdims=True) + mix(size)), mix(mix(tokens * _C3 + _C1).sum(keepdims=True) + size)
    return int(first.view(np.int64)[0]), int(second.view(np.int64)[0])


@dataclass(frozen=True)
class Names:
    """Nodes of sets: the first digest, its low ``bits`` (fewer than 64 in tests only), and another number for the few sets that
    would share theirs with another one."""

    others: dict[tuple[int, int], int]
    bits: int = 64

    def plain(self, tokens: np.ndarray) -> tuple[int, int]:
        first, second = digest(tokens)
        return first if self.bits == 64 else first & (1 << self.bits) - 1, second

    def __call__(self, tokens: np.ndarray) -> int:
        if not self.others and self.bits == 64:
            return int((mix(mix(tokens).sum(keepdims=True) + mix(np.array([len(tokens)], np.uint64)))).view(np.int64)[0])
        pair = self.plain(tokens)
        return self.others.get(pair, pair[0])


def sets_of(df: DataFrame, text_col: str, key: str, width: int, names: Names) -> DataFrame:
    """(key, n, node, first, second, md5) of each row; the node is the identity of the set, null where that is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                s = shingle_set(lower_ascii(text), width)
                pair = names.plain(s)
                rows.append((len(s), names.others.get(pair, pair[0]), *pair) if len(s) else (0, None, None, None))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], batch.column(2)], names=["key", "n", "node", "first", "second", "md5"])

    return df.select(df[key], df[text_col], F.md5(df[text_col].cast("binary")).alias("md5")).mapInArrow(tidy(run), f"key {df.schema[key].dataType.simpleString()}, n bigint, node bigint, first bigint, second bigint, md5 string")


def named_sets(df: DataFrame, text_col: str, key: str, width: int, bits: int = 64) -> tuple[DataFrame, Names]:
    """``sets_of`` under names that no two different sets share, as far as 128 bits tell them apart.

    Sets that share the first digest are looked for and get other names, until there are none; at 25 billion documents about
    seventeen are expected, which are all that the driver gets.
    """
    names = Names({}, bits)
    while True:
        docs = cut_lineage(sets_of(df, text_col, key, width, names))
        shared = cut_lineage(docs.where("node is not null").groupBy("node").agg(F.min(F.struct("first", "second")).alias("a"), F.max(F.struct("first", "second")).alias("b")).where("a != b"))
        if shared.isEmpty():
            return docs, names
        clashes = docs.join(shared.select(F.col("node").alias("_node"), "a"), F.col("node") == F.col("_node")).select("first", "second", "a").distinct().where("struct(first, second) != a").collect()
        others = dict(names.others)
        for r in clashes:
            before = others.get((r["first"], r["second"]), r["first"])
            others[r["first"], r["second"]] = int(mix(np.array([r["second"] ^ before], np.int64).view(np.uint64)).view(np.int64)[0])
        names = Names(others, bits)


_LISTS = "id bigint, block int, hot boolean, times bigint, band int, nodes array<bigint>, sizes array<bigint>, weak array<int>"


def shared_signatures(df: DataFrame, text_col: str, width: int, similarity: int, names: Names) -> DataFrame:
    """The different lists of sets that share a signature: id, block, hot, times (signatures with that list), members.

    A scanning task packs its signatures by hash range into a few binary rows, which is all that is shuffled. A signature that
    is hot within a pack is settled there, as lists of block -1: only HOT + 1 of its sets go on with it, enough to make it hot for
    the sets of other packs. So no task gets more than that of a signature from each pack, however many sets have it.
    """
    buckets = 16 * shuffle_partitions(df.sparkSession)

    def settled(key: np.ndarray, of: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Which signatures go on, and packed lists of the others: pivot, and the sets that have as many hot signatures with it."""
        order = np.lexsort((of, key))
        start = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        size = np.diff(np.append(start, len(order)))
        place = np.arange(len(order)) - np.repeat(start, size)
        late = (place > HOT) & np.repeat(size > HOT + 1, size)
        if not late.any():
            return np.ones(len(key), dtype=bool), []
        pivot = of[order][np.repeat(start, size)][late].astype(np.int64)
        pair, times = np.unique(pivot << 32 | of[order][late].astype(np.int64), return_counts=True)
        go = np.ones(len(key), dtype=bool)
        go[order[late]] = False
        pivot, member = pair >> 32, pair & 0xFFFFFFFF
        order = np.lexsort((member, times, pivot))
        pivot, member, times = pivot[order], member[order], times[order]
        cuts = np.flatnonzero((pivot[1:] != pivot[:-1]) | (times[1:] != times[:-1])) + 1
        out = []
        for m, p, t in zip(np.split(member, cuts), pivot[np.append(0, cuts)].tolist(), times[np.append(0, cuts)].tolist(), strict=True):
            for k in range(0, len(m), BLOCK):
                out.append(np.array([t], np.int64).tobytes() + entry[np.append(p, m[k : k + BLOCK])].tobytes())
        return go, out

    def pack(entries: list[tuple[int, int]], keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        of = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(k) for k in keys])
        key, entry = np.concatenate(keys), np.array(entries, dtype=np.int64).reshape(-1, 2)
        go, own_lists = settled(key, of, entry)
        if own_lists:
            spread = [buckets + k % buckets for k in range(len(own_lists))]
            yield pa.RecordBatch.from_arrays([pa.array(spread, pa.int32()), pa.array(own_lists, pa.binary())], names=["bucket", "blob"])
            key, of = key[go], of[go]
        bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        numbers, blobs = [], []
        for b in range(buckets):
            own = order[edges[b] : edges[b + 1]]
            if len(own):
                used, at = np.unique(of[own], return_inverse=True)
                blobs.append(b"".join((np.array([len(used), len(own)], np.int64).tobytes(), entry[used].tobytes(), key[own].tobytes(), at.astype(np.uint32).tobytes())))
                numbers.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[tuple[int, int]] = []
        keys: list[np.ndarray] = []
        count, seen = 0, set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                s = shingle_set(lower_ascii(text), width)
                if not len(s) or (node := names(s)) in seen:
                    continue
                seen.add(node)
                for i in bands_of(len(s), similarity):
                    own, weak = signatures(s, i, similarity)
                    if len(own):
                        entries.append((node, len(s) << 32 | i << 20 | min(weak, (1 << 20) - 1)))
                        keys.append(own)
                        count += len(own)
                if count >= _HELD:
                    yield from pack(entries, keys)
                    entries, keys, count = [], [], 0
        if keys:
            yield from pack(entries, keys)

    def settle(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        keys, nodes, metas = [], [], []
        for blob in blobs:
            e, n = np.frombuffer(blob, np.int64, 2).tolist()
            entry = np.frombuffer(blob, np.int64, 2 * e, 16).reshape(-1, 2)
            at = 16 + 16 * e
            keys.append(np.frombuffer(blob, np.uint64, n, at))
            of = np.frombuffer(blob, np.uint32, n, at + 8 * n)
            nodes.append(entry[of, 0])
            metas.append(entry[of, 1])
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = key[1:] == key[:-1]
        shared = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        key, order = key[shared], order[shared]
        node, meta = np.concatenate(nodes)[order], np.concatenate(metas)[order]
        order = np.lexsort((node, key))
        key, node, meta = key[order], node[order], meta[order]
        if len(key):  # a set once for each signature
            fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
            key, node, meta = key[fresh], node[fresh], meta[fresh]
        if not len(key):
            return
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        ident = mix(np.add.reduceat(mix(node.view(np.uint64) ^ _C1), start) + size.astype(np.uint64) * _C2 + (meta[start] >> 20 & 0xFFF).astype(np.uint64))
        many = np.flatnonzero(size > 1)
        if not len(many):
            return
        _, first, times = np.unique(ident[many], return_index=True, return_counts=True)
        rows: list[tuple] = []
        for f, t in zip(many[first].tolist(), times.tolist(), strict=True):
            a, n = int(start[f]), int(size[f])
            for k in range(0 if n <= HOT else 1, n, n if n <= HOT else BLOCK):
                at = np.arange(k, min(n, k + BLOCK)) + a
                if n > HOT:
                    at = np.append(a, at)  # the pivot stands first in every block
                rows.append((int(ident[f].view(np.int64)), k // BLOCK, n > HOT, t, int(meta[a] >> 20 & 0xFFF), node[at], meta[at] >> 32, (meta[at] & (1 << 20) - 1).astype(np.int32)))
        yield from listed(rows)

    def listed(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(rows), 5000):
            kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[k : k + 5000], strict=True), kinds, strict=True)], names=["id", "block", "hot", "times", "band", "nodes", "sizes", "weak"])

    def ready(blob: bytes) -> tuple:
        """A list that was settled in a pack; its number is that of its contents."""
        times, entry = int(np.frombuffer(blob, np.int64, 1)[0]), np.frombuffer(blob, np.int64, offset=8).reshape(-1, 2)
        node, meta = entry[:, 0], entry[:, 1]
        place = mix(np.arange(1, len(node) + 1, dtype=np.uint64) * _C3)
        ident = mix((mix(node.view(np.uint64) + place) + mix(meta.view(np.uint64) ^ place)).sum(keepdims=True)).view(np.int64)[0]
        return int(ident), -1, True, times, int(meta[0] >> 20 & 0xFFF), node, meta >> 32, (meta & (1 << 20) - 1).astype(np.int32)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b >= buckets:
                    yield from listed([ready(blob.as_py())])
                    continue
                if b != now and blobs:
                    yield from settle(blobs)
                    blobs = []
                now = b
                blobs.append(blob.as_py())
        if blobs:
            yield from settle(blobs)

    packed = df.select(df[text_col]).mapInArrow(tidy(scan), "bucket int, blob binary")
    lists = packed.repartition(shuffle_partitions(df.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(group), _LISTS)
    one = F.first(F.struct("hot", "band", "nodes", "sizes", "weak")).alias("one")
    return lists.groupBy("id", "block").agg(F.sum("times").alias("times"), one).select("id", "block", "times", "one.*")


class Shingles:
    """The shingles of a text: their hashes, each once, where each stands first, and the words themselves."""

    def __init__(self, data: bytes, width: int):
        words = data.split()
        self.data, self.width, self.count = b" ".join(words), width, len(words)
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.stop = np.cumsum(lens + 1) - 1
        self.start = self.stop - lens
        self.hashes, self.at = np.unique(shingle_hashes(self.data, width), return_index=True)

    def tuples(self) -> set[bytes]:
        last = max(1, self.count - self.width + 1) if self.count else 0
        return {self.data[self.start[i] : self.stop[min(i + self.width, self.count) - 1]] for i in range(last)}


def shared_shingles(s: Shingles, t: Shingles) -> tuple[int, int, int]:
    """Sizes of two sets of shingles and of their intersection. Shingles with equal hashes are compared word by word, in stretches
    that run on in both texts; if any differ, all are counted anew as strings."""
    common, i, j = np.intersect1d(s.hashes, t.hashes, assume_unique=True, return_indices=True)
    if len(common):
        a, b = s.at[i], t.at[j]
        order = np.argsort(a)
        a, b = a[order], b[order]
        cut = np.flatnonzero((a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1)) + 1
        first, last = np.append(0, cut), np.append(cut, len(a)) - 1
        ends = [x.stop[np.minimum(y[last] + s.width, x.count) - 1].tolist() for x, y in ((s, a), (t, b))]
        for x, x_end, y, y_end in zip(s.start[a[first]].tolist(), ends[0], t.start[b[first]].tolist(), ends[1], strict=True):
            if s.data[x:x_end] != t.data[y:y_end]:
                p, q = s.tuples(), t.tuples()
                return len(p), len(q), len(p & q)
    return len(s.hashes), len(t.hashes), len(common)


def verify(pairs: DataFrame, texts: DataFrame, width: int, few: bool = False) -> DataFrame:
    """(a, b, n_a, n_b, shared) of pairs of nodes, counted on whole sets. ``a``, the commoner end, is joined last. The ends of a
    ``few`` pairs are broadcast, so that no other texts are shuffled for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Shingles] = {}

        def tokens(node: int, text: pa.StringScalar) -> Shingles:
            if node not in known:
                if len(known) > 64:
                    known.clear()
                known[node] = Shingles(lower_ascii(text.as_py()), width)
            return known[node]

        for batch in batches:
            out = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                out.append((a, b, *shared_shingles(tokens(a, x), Shingles(lower_ascii(y.as_py()), width))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b", "n_a", "n_b", "shared"])

    # the names of nodes pass through an expression, so that both joins have exchanges on both sides and a common end can be split
    own = F.col("node").bitwiseXOR(F.lit(0))
    x, y = texts.select(own.alias("a"), F.col("text").alias("x")), texts.select(own.alias("b"), F.col("text").alias("y"))
    if few:
        x, y = (t.join(F.broadcast(pairs.select(F.col(c).alias("_end"))), F.col(c) == F.col("_end"), "left_semi") for t, c in ((x, "a"), (y, "b")))
    return pairs.select("a", "b").join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(tidy(run), "a bigint, b bigint, n_a bigint, n_b bigint, shared bigint")


def outline(tokens: np.ndarray) -> bytes:
    """Bits of a set: of each, whether an odd number of tokens falls on it. Two outlines differ in no more bits than their sets in
    tokens."""
    return np.packbits(np.bincount((mix(tokens ^ _C3) % np.uint64(OUTLINE)).astype(np.int64), minlength=OUTLINE) & 1).tobytes()


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def _rows_of(outlines: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(outlines), np.uint64).reshape(-1, OUTLINE // 64)


def outlines_of(texts: DataFrame, width: int) -> DataFrame:
    """(node, n, outline) of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingle_set(lower_ascii(t.as_py()), width) for t in batch.column(1))
            sizes, bits = zip(*[(len(s), outline(s)) for s in sets], strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())], names=["node", "n", "outline"])

    return texts.select("node", "text").mapInArrow(tidy(run), "node bigint, n bigint, outline binary")


def plausible(pairs: DataFrame, outlines: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b, star) whose outlines differ in no more bits than those of similar sets may; the others need no texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                total = batch.column(3).to_numpy() + batch.column(5).to_numpy()
                differ = _differ(_rows_of(batch.column(4).to_pylist()), _rows_of(batch.column(6).to_pylist()))
                yield batch.select([0, 1, 2]).filter(pa.array(differ * (100 + similarity) <= total * (100 - similarity)))

    own = F.col("node").bitwiseXOR(F.lit(0))  # as in ``verify``
    x, y = outlines.select(own.alias("a"), F.col("n").alias("n_a"), F.col("outline").alias("x")), outlines.select(own.alias("b"), F.col("n").alias("n_b"), F.col("outline").alias("y"))
    both = pairs.select("a", "b", "star").join(y, "b").join(x, "a").select("a", "b", "star", "n_a", "x", "n_b", "y")
    return both.mapInArrow(run, "a bigint, b bigint, star boolean")


def common_tokens(texts: DataFrame, width: int, rows: int = COMMON_ROWS, most: int = COMMON_BYTES, count: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of several of about ``rows`` sets, and in how many they are. They only order the tokens of prefixes.

    The sets are those with the least names, which are as good as random; at most ``most`` bytes of their texts are counted.
    ``count`` is the number of texts, where it is known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, size = [], 0
        for batch in batches:
            for t in batch.column(0):
                data = lower_ascii(t.as_py()) if size < most else b""
                size += len(data)
                if data and size <= most:
                    sets.append(shingle_set(data, width))
        token, count = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([token[count > 2].tobytes()], pa.binary()), pa.array([count[count > 2].astype(np.int32).tobytes()], pa.binary())], names=["token", "count"])

    share = min(1.0, rows / max(1, texts.count() if count is None else count))
    few = texts if share == 1 else texts.where(F.col("node") < int((2 * share - 1) * (1 << 63)))
    one = few.select("text").repartition(1).mapInArrow(run, "token binary, count binary").collect()
    return (np.frombuffer(one[0]["token"], np.uint64), np.frombuffer(one[0]["count"], np.int32)) if one else (np.zeros(0, np.uint64), np.zeros(0, np.int32))


def prefixes(texts: DataFrame, width: int, similarity: int, count: int | None = None) -> DataFrame:
    """(token, node, n, place) of the first tokens of each set, common ones last: similar sets share one of them."""
    shared = texts.sparkSession.sparkContext.broadcast(common_tokens(texts, width, count=count))  # COMMON_ROWS sets' tokens at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, count = shared.value
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingle_set(lower_ascii(text.as_py()), width)
                n = len(s)
                often = np.zeros(n, np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    often = np.where(common[at] == s, count[at], 0)
                first = s[np.lexsort((s, often))][: n - -(-n * similarity // 100) + 1]
                k = len(first)
                yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(np.full(k, node)), pa.array(np.full(k, n)), pa.array(np.arange(k))], names=["token", "node", "n", "place"])

    return texts.select("node", "text").mapInArrow(tidy(run), "token bigint, node bigint, n bigint, place bigint")


def _may(similarity: int, left: str, right: str):
    """Whether two sets with a common prefix token may be similar: their sizes, and what both have left after it, allow it."""
    num, den = similarity, 100 + similarity
    a, b = (lambda c, of=of: F.col(f"{of}{c}") for of in (left, right))
    rest = F.least(a("n") - a("place"), b("n") - b("place"))
    return (a("label") != b("label")) & (rest * den >= (a("n") + b("n")) * num) & (F.least(a("n"), b("n")) * 100 >= F.greatest(a("n"), b("n")) * similarity)


def star_pairs(members: DataFrame, similarity: int, rows: int) -> DataFrame:
    """Of each set, the pair with the set that is the smallest of most of its prefix tokens, among those that may be similar to it
    and are in another component.

    The smallest set of a token is found by an aggregation, so that no task gathers a list. ``members`` has at most ``rows``.
    """
    least = members.groupBy(F.col("token").alias("_token")).agg(F.min(F.struct("n", "node", "place", "label")).alias("p"))
    least = cut_small(least.select("_token", *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("n", "node", "place", "label")]), rows).withColumn("_token", F.col("_token").bitwiseXOR(F.lit(0)))
    own = members.select("token", *[F.col(c).alias(f"m_{c}") for c in ("n", "node", "place", "label")])
    met = own.join(least, F.col("token") == F.col("_token")).where(_may(similarity, "p_", "m_"))
    best = met.groupBy("m_node", "p_node").agg(F.count(F.lit(1)).alias("c")).groupBy(F.col("m_node").alias("a")).agg(F.max_by("p_node", F.struct("c", "p_node")).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def open_pairs(members: DataFrame, similarity: int, most: int, rows: int) -> DataFrame:
    """Pairs of sets with a common prefix token that are in different components so far and may be similar.

    Of each token, the sets outside the component that has most of its sets meet its sets. Long lists are cut into stretches: every
    set stands in one of them, which its task holds, and those outside go to ``most`` stretches of a token and find ``most``
    partners in each, the same ones for different tokens as far as possible. They pass through the task one block after
    another, so they need no stretches of their own, and no set is repeated for those that come to meet it. Returns (a, b, c): the set, the
    partner, and in how many stretches they met; pairs whose outlines differ too much are none. A row with ``a`` null says that some
    pairs were left for a later round. ``members`` has at most ``rows``, all of tokens whose sets are in several components.
    """
    num, den = similarity, 100 + similarity

    def pairs(stretch: tuple[np.ndarray, ...], open_: tuple[np.ndarray, ...]) -> Iterator[tuple[list[tuple[int, int]], bool]]:
        """Partners of open sets in a stretch, a block at a time, and whether any were left; both come in the order of sizes."""
        step = max(1, _MET // len(stretch[0]))
        for k in range(0, len(open_[0]), step):
            own_n, own, own_place, own_label, own_bits = (c[k : k + step] for c in open_)
            low, high = np.searchsorted(stretch[0], -(-own_n[0] * num // 100)), np.searchsorted(stretch[0], own_n[-1] * 100 // num, "right")
            n, node, place, label, bits = (c[low:high] for c in stretch)
            # a shared token at these places leaves so many that both may have: enough for the union's share?
            x, y = own_n[:, None], own_place[:, None]
            may = (label != own_label[:, None]) & (np.minimum(n - place, x - y) * den >= (n + x) * num) & (np.minimum(n, x) * 100 >= np.maximum(n, x) * similarity)
            who, at = np.nonzero(may)
            near = _differ(bits[at], own_bits[who]) * den <= (n[at] + own_n[who]) * (100 - num)
            who, at = who[near], at[near]
            order = np.lexsort((mix(node[at].view(np.uint64) ^ own[who].view(np.uint64)), who))
            who, at = who[order], at[order]
            taken = np.arange(len(who)) - np.searchsorted(who, who) < most
            yield list(zip(own[who[taken]].tolist(), node[at[taken]].tolist(), strict=True)), not taken.all()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(out: Counter, left: bool) -> pa.RecordBatch:
            rows = [*((a, b, c) for (a, b), c in out.items()), *[(None, None, None)] * left]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["a", "b", "c"])

        now, held, out, left = None, [], Counter(), False
        for batch in batches:
            if not batch.num_rows:
                continue
            token, cell, open_, *sets = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1])
            sets.append(_rows_of(batch.column(len(sets) + 3).to_pylist()))
            cuts = np.flatnonzero((token[1:] != token[:-1]) | (cell[1:] != cell[:-1]) | (open_[1:] != open_[:-1])) + 1
            for start, end in zip(np.append(0, cuts).tolist(), np.append(cuts, len(token)).tolist(), strict=True):
                if (token[start], cell[start]) != now:
                    now, held = (token[start], cell[start]), []
                some = tuple(c[start:end] for c in sets)
                if not open_[start]:  # the sets of a stretch come before those that meet them
                    held.append(some)
                elif held:
                    held = [tuple(np.concatenate(c) for c in zip(*held, strict=True))] if len(held) > 1 else held
                    for more, rest in pairs(held[0], some):
                        out.update(more)
                        left |= rest
                        if len(out) > 50_000:
                            yield give(out, False)
                            out = Counter()
        if out or left:
            yield give(out, left)

    counts = cut_small(members.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c")), rows)
    main = counts.groupBy(F.col("token").alias("_token")).agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("all"))
    parts = lambda size: F.ceil(F.col("all") / size).cast("int")
    main = cut_small(main.select("_token", "main", F.greatest(F.least(parts(CELL), F.lit(STRETCHES)), parts(LONGEST)).alias("across")), rows)
    later = main.where(F.col("across") > most).limit(1).select(F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b"), F.lit(None).cast("bigint").alias("c"))
    main = main.withColumn("_token", F.col("_token").bitwiseXOR(F.lit(0)))
    dealt = members.join(main, F.col("token") == F.col("_token"))
    turn = lambda k: F.pmod(F.xxhash64("node", F.lit(k)), F.col("across"))
    cell = lambda j, open_: F.struct(j.cast("int").alias("j"), F.lit(open_).alias("open"))
    listed = F.array(cell(turn(0), False))
    opened = F.transform(F.sequence(F.lit(0), F.least(F.col("across"), F.lit(most)) - 1), lambda t: cell((turn(1) + t) % F.col("across"), True))
    every = F.explode(F.when(F.col("label") != F.col("main"), F.concat(listed, opened)).otherwise(listed)).alias("cell")
    shown = ["n", "node", "place", "label", "outline"]
    cells = dealt.select("token", every, *shown).select("token", "cell.j", "cell.open", *shown)
    found = cells.repartition(shuffle_partitions(members.sparkSession), "token", "j").sortWithinPartitions("token", "j", "open", "n").mapInArrow(run, "a bigint, b bigint, c bigint")
    return found.union(later).groupBy("a", "b").agg(F.sum("c").alias("c"))


def sent(df: DataFrame, rows: int, most: int | None = None) -> DataFrame:
    """``df`` of so many rows, for joins: broadcast if they are few."""
    return F.broadcast(df) if rows <= (FEW if most is None else most) else df


def in_few(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """``df``, which is at hand already, read in one partition for every ``each`` rows."""
    return df.coalesce(max(1, min(-(-rows // each), shuffle_partitions(df.sparkSession))))


def _labelled(df: DataFrame, labels: DataFrame) -> DataFrame:
    own = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    return df.join(own, df["node"] == own["_node"], "left").withColumn("label", F.coalesce("_label", "node")).drop("_node", "_label")


def similar_sets(df: DataFrame, text_col: str = "text", key: str = "doc_id", width: int = WIDTH, similarity: int = SIMILARITY, bits: int = 64) -> DataFrame:
    """Components of documents whose sets of shingles have a Jaccard similarity of ``similarity`` per cent or more.

    Returns key, n_shingles and component_id, the least key that links reach. Equal sets are one node of the graph from the
    start, so groups of copies are no pairs. Similar sets share more than the slack of segments: a pair of a short list counts only
    if the lists with both, and the segments where either may meet others unlisted, make up that many. Of hot signatures each set
    is paired with the first one only. Why nothing is lost: for each set the hot and the weak segments are counted. A similar pair
    shares more than the slack of segments; those that are in no short list are hot or weak, for both sets. So unless both sets
    have more hot and weak segments than the slack, a short list has the pair, as often as the rule above asks for. Pairs whose
    outlines differ in more bits than similar sets may in tokens are left out before texts are joined. The sets with
    more, which are the members of large groups of near copies and a few small sets, meet once more by the first tokens of their
    sets in an order that puts common ones last (similar sets share one of these), and only with other components. Rounds go on
    until no pair of different components is open, so no link between components is lost.

    Null and empty texts have no shingles and are linked with nothing. Rows without a key count as members but name no
    component. Repeated rows are copies; rows with one key and different texts are different members. Texts count whole, however
    long. An empty table gives an empty result; further columns are not passed on, whatever their names. ``bits`` is for tests.
    """
    docs, names = named_sets(df, text_col, key, width, bits)
    lists = cut_lineage(shared_signatures(df, text_col, width, similarity, names))
    release(df.sparkSession)  # the signatures, the largest shuffle of all
    member = F.col("m")
    hot = lists.where("hot").select("block", "band", "times", F.element_at("nodes", 1).alias("pivot"), F.element_at("sizes", 1).alias("p_n"), F.posexplode(F.arrays_zip("nodes", "sizes", "weak")).alias("place", "m"))
    hot = hot.select("block", "band", "times", "pivot", "p_n", "place", member["nodes"].alias("node"), member["sizes"].alias("n"), member["weak"].alias("weak"))
    named = hot.where("place > 0 or block = 0")
    every = named.select("node", "band", "weak", "times").union(lists.where("not hot").select("band", F.explode(F.arrays_zip("nodes", "weak")).alias("m")).select(member["nodes"], "band", member["weak"], F.lit(0)))
    # segments of a set in which it may meet a similar one without a listed pair
    spare = cut_lineage(every.groupBy("node", "band").agg((F.max("weak") + F.sum("times")).alias("h")))
    slack = F.element_at(F.create_map(*[F.lit(x) for i in range(64) for x in (i, allocate(i, similarity)[2])]), F.col("band"))

    # pairs of short lists: similar sets share more than ``slack`` segments, of which all but h of either must be listed
    at = lambda name, k: F.element_at(name, k.cast("int"))
    two = lambda i, j: F.struct(at("nodes", i).alias("a"), at("nodes", j).alias("b"), at("sizes", i).alias("x"), at("sizes", j).alias("y"))
    size = F.size("nodes")
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.transform(F.sequence(i + 1, size), lambda j: two(i, j))))
    listed = lists.where("not hot").select("band", "times", F.explode(pairs).alias("p")).where(f"least(p.x, p.y) * 100 >= greatest(p.x, p.y) * {similarity}")
    listed = listed.groupBy("band", "p.a", "p.b").agg(F.sum("times").alias("met"))
    ends = [spare.select(F.col("node").alias(c), "band", F.col("h").alias(f"h_{c}")) for c in ("a", "b")]
    near = listed.join(ends[0], ["a", "band"]).join(ends[1], ["b", "band"]).where(F.col("met") > slack - F.least("h_a", "h_b"))
    near = cut_lineage(near.select("a", "b").distinct())
    # sets with more hot and weak segments than the slack; of hot signatures each goes with the set that it shares most of them with
    heavy = cut_lineage(spare.where(F.col("h") > slack).select("node").distinct())
    stars = hot.where(f"place > 0 and node != pivot and least(n, p_n) * 100 >= greatest(n, p_n) * {similarity}").groupBy("pivot", "node").agg(F.sum("times").alias("met"))
    stars = stars.groupBy("node").agg(F.max_by("pivot", F.struct("met", "pivot")).alias("pivot")).join(heavy, "node", "left_semi")
    stars = cut_lineage(stars.select(F.col("pivot").alias("a"), F.col("node").alias("b")))

    met = near.union(stars).select(F.explode(F.array("a", "b")).alias("node")).union(heavy).distinct()
    pick = docs.where("node is not null").groupBy("node").agg(F.min("md5").alias("_md5")).join(met, "node", "left_semi")
    source = df.select(F.md5(df[text_col].cast("binary")).alias("md5"), df[text_col].alias("text")).groupBy("md5").agg(F.first("text").alias("text"))  # copies are one from each task
    texts = cut_lineage(source.join(pick, F.col("md5") == F.col("_md5")).select("node", "text"))
    release(df.sparkSession)

    # of both, those that their outlines do not exclude
    outlines = cut_lineage(outlines_of(texts, width))
    pairs = cut_lineage(plausible(near.withColumn("star", F.lit(False)).union(stars.withColumn("star", F.lit(True))), outlines, similarity))
    maybe = pairs.count()
    pairs = in_few(pairs, maybe)
    near, stars = pairs.where("not star").select("a", "b"), pairs.where("star").select("a", "b")

    # first a tree's worth of pairs: each set with the least one that it may be similar to, and with its pivot
    first = near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(stars)
    known = cut_lineage(verify(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), texts, width))
    linked = F.expr(f"shared * 100 >= (n_a + n_b - shared) * {similarity}")
    total = known.count()
    known = in_few(known, total)
    labels = connected_components(known.where(linked), most=total)
    many = heavy.count()
    heavy = sent(heavy, many)
    members = cut_lineage(prefixes(texts.join(heavy, "node", "left_semi"), width, similarity, many))
    rows = members.count()
    members = in_few(members, rows)
    drawn_from = sent(cut_small(outlines.join(heavy, "node", "left_semi").select(F.col("node").alias("_node"), "outline"), many), many, FEW_OUTLINES)
    most = 0
    while True:
        # what is known to be small is kept in few partitions or sent to all, so that a round over little takes few tasks
        labels = sent(labels, total)
        open_ = _labelled(members, labels)
        mixed = cut_small(open_.groupBy(F.col("token").alias("_token")).agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("_token"), rows)
        mixed = mixed.withColumn("_token", F.col("_token").bitwiseXOR(F.lit(0)))
        open_ = cut_small(open_.join(mixed, F.col("token") == F.col("_token"), "left_semi"), rows)
        release(df.sparkSession)
        tried = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        if not most:
            stars = star_pairs(open_, similarity, rows).withColumn("star", F.lit(True))
            more, left = plausible(stars, outlines, similarity).select("a", "b"), not open_.isEmpty()
        else:
            # of each set, ``most`` partners that it has not been compared with, those met in most cells first
            drawn = open_.join(drawn_from, F.col("node") == F.col("_node"))
            met = cut_small(open_pairs(drawn, similarity, most, rows), rows * most)
            release(df.sparkSession)
            both = sent(tried.union(tried.select(F.col("b").alias("a"), F.col("a").alias("b"))), total)
            nth = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("c"), F.xxhash64("a", "b")))
            ranked = cut_small(met.where("a is not null").join(both, ["a", "b"], "left_anti").withColumn("nth", nth), rows * most)
            more = ranked.where(F.col("nth") <= most).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            left = not met.where("a is null").isEmpty() or not ranked.where(F.col("nth") > most).isEmpty()
        tried = sent(tried, total)
        rest = near.join(tried, ["a", "b"], "left_anti")
        of = lambda c: sent(labels.select(F.col("node").alias(c), F.col("label").alias(f"l_{c}")), total)  # noqa: E731, B023
        rest = rest.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("l_a", "a") != F.coalesce("l_b", "b"))
        new = cut_small(more.join(tried, ["a", "b"], "left_anti").union(rest.select("a", "b")).distinct(), maybe + rows * max(1, most))
        count = new.count()
        if not count and not left:
            break
        if count:
            total += count
            known = cut_small(known.union(cut_small(verify(new, texts, width, count <= FEW), count, 500)), total)
            labels = connected_components(known.where(linked), most=total)
        release(df.sparkSession)
        most = most * 8 or 1

    whole = _labelled(docs, sent(labels, total))
    first = whole.where("node is not null").groupBy("label").agg(F.min("key").alias("component_id"))
    return whole.join(first, "label", "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))
