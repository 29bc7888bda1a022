"""Suffix-array deduplication: maximal repeats of byte strings, by stack scans of common-prefix interval trees.

Two equal stretches of ``width`` bytes choose the same anchor, the least of their ``GRAM``-byte hashes at the same place in
them. Only anchors that occur more than once can be in a repeat. Anchors whose whole surroundings are equal (128 bits of
BLAKE2) are one; where there are different surroundings, the suffixes from the anchor are sorted, and so are the reversed
prefixes before it. A scan with a stack over the common prefixes of neighbours gives the tree of common-prefix intervals;
an interval whose occurrences have different bytes before them is a maximal repeat with all its occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _powers, cut_lineage, fresh, mix, release, shuffle_partitions

WIDTH, GRAM = 200, 100
_SEGMENT = 1 << 19
#: All windows of an anchor are repeated; an edge; a model of equal surroundings, which edges are compared with.
_FULL, _EDGE, _MODEL = 0, 1, 2
#: Edges and models of an anchor with more than CROWD different surroundings: their windows are counted one by one instead, which
#: gives the same and needs no task to hold them.
_CROWDED_EDGE, _CROWDED_MODEL = 3, 4
CROWD = 256
#: Anchors that a scanning task holds before it hands them on; bounds its memory and nothing else.
_HELD = 1_000_000
_ENTRY = np.dtype([("number", "<i4"), ("state", "i1"), ("hash", "<i8")])


def anchors(data: bytes, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: its place, the first and last start of the windows that chose it, and its hash."""
    n = len(data)
    if n < width:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64)
    buf = np.frombuffer(data, np.uint8)
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buf] * power[:n], out=sums[1:])
    h = mix((sums[gram:] - sums[: n - gram + 1]) * inverse[: n - gram + 1])
    w, windows = width - gram + 1, n - width + 1
    chosen = np.empty(windows, np.int64)
    for a in range(0, windows, _SEGMENT):
        b = min(a + _SEGMENT, windows)
        part = h[a : b + w - 1]
        key = part & ~np.uint64((1 << 20) - 1) | np.arange(len(part), dtype=np.uint64)
        padded = np.full(-(-len(key) // w) * w, np.uint64((1 << 64) - 1))
        padded[: len(key)] = key
        blocks = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[: b - a], ahead[w - 1 : w - 1 + b - a])
        chosen[a:b] = (least & np.uint64((1 << 20) - 1)).astype(np.int64) + a
    cut = np.flatnonzero(np.diff(chosen)) + 1
    low = np.concatenate(([0], cut))
    high = np.concatenate((cut - 1, [windows - 1]))
    place = chosen[low]
    return place, low, high, h[place]


def surroundings(data: bytes, low: np.ndarray, high: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """128-bit digests of all bytes that each anchor speaks for, as two columns."""
    digest = hashlib.blake2b
    out = b"".join([digest(data[a:b], digest_size=16).digest() for a, b in zip(low.tolist(), (high + width).tolist(), strict=True)])
    return np.frombuffer(out, "<u8").reshape(-1, 2)


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    m = min(len(a), len(b))
    if a[:m] == b[:m]:
        return m
    low, high = 0, m
    while low < high - 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def intervals(prefixes: list[int]) -> Iterator[tuple[int, int, int]]:
    """The interval tree of the common prefixes of neighbours in a sorted list, by one scan with a stack, children before parents.

    Each is (length, first, last): the largest stretches of the list whose members have so much in common, and no more.
    """
    stack: list[tuple[int, int]] = []
    for i, length in enumerate([*prefixes, 0]):
        first = i
        while stack and stack[-1][0] > length:
            depth, first = stack.pop()
            yield depth, first, i
        if length and (not stack or stack[-1][0] < length):
            stack.append((length, first))


def maximal_groups(contexts: list[tuple[bytes, int]], width: int = WIDTH) -> Iterator[tuple[int, int, list[int]]]:
    """For different surroundings (bytes, place of the anchor) of one anchor: the maximal repeats of ``width`` bytes or more that
    hold the anchor's first byte, as (bytes before the anchor, length, members).

    The suffixes from the anchor make one interval tree, the reversed prefixes before it another. Members of a node of the
    second have a left context in common that no other string has; of them, an interval of the first is a maximal repeat if they
    are not all in the same child, for then their next bytes to the left differ.
    """
    if len(contexts) < 2:
        return
    right, left = [c[a:] for c, a in contexts], [c[:a][::-1] for c, a in contexts]
    by_right = sorted(range(len(contexts)), key=right.__getitem__)
    common = [common_prefix(right[x], right[y]) for x, y in zip(by_right, by_right[1:], strict=False)]
    rank = np.empty(len(contexts), dtype=np.int64)
    rank[by_right] = np.arange(len(contexts))
    by_left = sorted(range(len(contexts)), key=left.__getitem__)
    before = [common_prefix(left[x], left[y]) for x, y in zip(by_left, by_left[1:], strict=False)]
    nodes = list(intervals(before))
    if not nodes or nodes[-1][1:] != (0, len(contexts) - 1):
        nodes.append((0, 0, len(contexts) - 1))
    for back, first, last in nodes:
        child = np.cumsum([0] + [before[k] == back for k in range(first, last)])  # a child ends where no more is in common
        order = sorted(zip(by_left[first : last + 1], child.tolist(), strict=True), key=lambda m: rank[m[0]])
        shared = [min(common[rank[x] : rank[y]]) for (x, _), (y, _) in zip(order, order[1:], strict=False)]
        for ahead, i, j in intervals(shared):
            if back + ahead >= width and len({c for _, c in order[i : j + 1]}) > 1:
                yield back, back + ahead, [m for m, _ in order[i : j + 1]]


def repeated_ranges(contexts: list[tuple[bytes, int]], width: int = WIDTH) -> list[list[tuple[int, int]]]:
    """For surroundings (bytes, place of the anchor) of one anchor: the ranges of each that are repeated in another."""
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    for back, length, members in maximal_groups(contexts, width):
        for m in members:
            start = contexts[m][1] - back
            out[m].append((start, start + length))
    return [_merge(ranges) for ranges in out]


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    out = np.zeros(len(columns[0]), dtype=bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def shared_anchors(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """``_shared`` of the anchors of all texts, by their hashes and the digests of their surroundings."""

    def items(batch: pa.RecordBatch) -> Iterator[tuple]:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = _bytes(text)
            _, low, high, h = anchors(data, width, gram)
            if len(h):
                yield bytes.fromhex(row), np.arange(len(h), dtype=np.uint32), h, surroundings(data, low, high, width)

    return _shared(rows.select("row", "text"), items, 16 * shuffle_partitions(rows.sparkSession))


def shared_windows(around: DataFrame, width: int) -> DataFrame:
    """``_shared`` of the windows of crowded anchors, numbered by their starts in their texts; those that stand at more than one
    place are ``_FULL``."""

    def items(batch: pa.RecordBatch) -> Iterator[tuple]:
        for row, low, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            starts = np.arange(len(data) - width + 1)
            u = surroundings(data, starts, starts, width)
            yield bytes.fromhex(row), (starts + low).astype(np.uint32), u[:, 0], u

    return _shared(around.where(f"state >= {_CROWDED_EDGE}").select("row", "low", "bytes"), items, shuffle_partitions(around.sparkSession))


def _shared(rows: DataFrame, items, buckets: int) -> DataFrame:
    """(row, part, open): the items of each text that occur more than once, packed as number, state and hash; ``open`` if any of
    them is not ``_FULL``. ``items`` gives those of a batch as (text, numbers, hashes, digests).

    A scanning task packs the items of many texts into a few binary rows by hash range, which is all that is shuffled. Equal
    digests within a pack go on as one, so that a hot passage comes once from each task; the others are known to be
    repeated already and are sent to where their texts are put together. ``buckets`` is the number of hash ranges.
    """

    def pack(held: list) -> Iterator[pa.RecordBatch]:
        counts = [len(h) for _, _, h, _ in held]
        texts = np.frombuffer(b"".join([k for k, *_ in held]), "<u8").reshape(-1, 2)
        h, u = np.concatenate([x for _, _, x, _ in held]), np.concatenate([x for *_, x in held])
        text = np.repeat(np.arange(len(held), dtype=np.uint32), counts)
        number = np.concatenate([x for _, x, _, _ in held])
        order = np.lexsort((u[:, 1], u[:, 0], h))
        h, u, text, number = h[order], u[order], text[order], number[order]
        head = _runs(h, u[:, 0], u[:, 1])
        start = np.flatnonzero(head)
        twice = (np.diff(np.append(start, len(h))) > 1).astype(np.uint8)
        numbers, blobs = [], []
        bucket = ((h[start] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            own = order[edges[b] : edges[b + 1]]
            if len(own):
                at = start[own]
                used, of = np.unique(text[at], return_inverse=True)
                sizes = np.array([len(used), len(own)], dtype=np.int64)
                blobs.append(b"".join(np.ascontiguousarray(x).tobytes() for x in (sizes, texts[used], h[at], u[at], of.astype(np.uint32), number[at], twice[own])))
                numbers.append(b)
        text, number = text[~head], number[~head]  # known to be repeated
        bucket = (texts[text, 0] % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((text, bucket))
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            own = order[edges[b] : edges[b + 1]]
            if len(own):
                used, of = np.unique(text[own], return_inverse=True)
                blobs.append(b"".join(np.ascontiguousarray(x).tobytes() for x in (np.array([len(used), len(own)], dtype=np.int64), texts[used], of.astype(np.uint32), number[own])))
                numbers.append(buckets + b)
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for item in items(batch):
                held.append(item)
                count += len(item[2])
                if count >= _HELD:
                    yield from pack(held)
                    held, count = [], 0
        if held:
            yield from pack(held)

    def give(texts: np.ndarray, number: np.ndarray, state: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Entries, each place of a text once, as one part for each text."""
        order = np.lexsort((state != _MODEL, number, texts[:, 1], texts[:, 0]))
        texts, number, state, h = texts[order], number[order], state[order], h[order]
        once = _runs(texts[:, 0], texts[:, 1], number)
        texts, number, state, h = texts[once], number[once], state[once], h[once]
        entry = np.empty(len(number), dtype=_ENTRY)
        entry["number"], entry["state"], entry["hash"] = number, state, h.view(np.int64)
        start = np.flatnonzero(_runs(texts[:, 0], texts[:, 1]))
        stop = np.append(start[1:], len(entry))
        open_ = np.add.reduceat(state != _FULL, start) > 0
        for k in range(0, len(start), 5000):
            names = [texts[i].tobytes().hex() for i in start[k : k + 5000]]
            parts = [entry[a:b].tobytes() for a, b in zip(start[k : k + 5000], stop[k : k + 5000], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.binary()), pa.array(open_[k : k + 5000])], names=["row", "part", "open"])

    def settle(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        found: list[list[np.ndarray]] = [[] for _ in range(5)]
        for blob in blobs:
            m, n = np.frombuffer(blob, np.int64, 2).tolist()
            texts, at = np.frombuffer(blob, "<u8", 2 * m, 16).reshape(-1, 2), 16 + 16 * m
            of = np.frombuffer(blob, np.uint32, n, at + 24 * n)
            for into, x in zip(found, (texts[of], np.frombuffer(blob, "<u8", n, at), np.frombuffer(blob, "<u8", 2 * n, at + 8 * n).reshape(-1, 2), np.frombuffer(blob, np.uint32, n, at + 28 * n), np.frombuffer(blob, np.uint8, n, at + 32 * n)), strict=True):
                into.append(x)
        texts, h, u, number, twice = map(np.concatenate, found)
        order = np.lexsort((number, texts[:, 1], texts[:, 0], u[:, 1], u[:, 0], h))
        texts, h, u, number, twice = texts[order], h[order], u[order], number[order], twice[order]
        new_h = _runs(h)
        new_u = new_h | _runs(u[:, 0], u[:, 1])
        of_h, of_u = np.cumsum(new_h) - 1, np.cumsum(new_u) - 1
        often = np.bincount(of_u, weights=1 + twice)[of_u] > 1
        kinds = np.bincount(of_h[new_u])[of_h]  # different surroundings of each anchor
        state = np.where(~often, _EDGE, np.where(new_u & (kinds > 1), _MODEL, _FULL))
        state = np.where((kinds > CROWD) & (state != _FULL), state + (_CROWDED_EDGE - _EDGE), state)
        shared = often | (kinds > 1)
        if shared.any():
            yield from give(texts[shared], number[shared], state[shared], h[shared])

    def known(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        texts, numbers = [], []
        for blob in blobs:
            m, n = np.frombuffer(blob, np.int64, 2).tolist()
            texts.append(np.frombuffer(blob, "<u8", 2 * m, 16).reshape(-1, 2)[np.frombuffer(blob, np.uint32, n, 16 + 16 * m)])
            numbers.append(np.frombuffer(blob, np.uint32, n, 16 + 16 * m + 4 * n))
        number = np.concatenate(numbers)
        yield from give(np.concatenate(texts), number, np.full(len(number), _FULL), np.zeros(len(number), np.uint64))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != now and blobs:
                    yield from (settle if now < buckets else known)(blobs)
                    blobs = []
                now = b
                blobs.append(blob.as_py())
        if blobs:
            yield from (settle if now < buckets else known)(blobs)

    packed = rows.mapInArrow(scan, "bucket int, blob binary")
    return packed.repartition(shuffle_partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(group, "row string, part binary, open boolean")


def _entries(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), dtype=_ENTRY)


def _rows(df: DataFrame, text_col: str, key: str) -> DataFrame:
    """Rows by the digest of their text: equal texts have equal repeats, whatever their keys."""
    return df.select(F.md5(F.coalesce(df[text_col], F.lit("")).cast("binary")).alias("row"), df[key].alias("key"), df[text_col].alias("text"))


def _around(rows: DataFrame, listed: DataFrame, width: int, gram: int, everything: bool = False) -> DataFrame:
    """(hash, row, number, at, low, state, bytes) of anchors that are to be compared, with their surroundings. With ``everything``
    those of all shared anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int8(), pa.binary())
        for batch in batches:
            done: set[str] = set()
            out: list[tuple] = []
            for row, text, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row in done:
                    continue
                done.add(row)
                data = _bytes(text)
                place, low, high, hashes = anchors(data, width, gram)
                for number, state, h in _entries(parts).tolist():
                    if state == _FULL and not everything:
                        continue
                    a, b, at = int(low[number]), int(high[number]), int(place[number] - low[number])
                    out.append((int(hashes[number].view(np.int64)), row, number, at, a, min(state, _MODEL) if everything else state, data[a : b + width]))
            for k in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 20_000], strict=True), kinds, strict=True)], names=["hash", "row", "number", "at", "low", "state", "bytes"])

    ask = listed.where("open or " + str(everything).lower()).select(fresh("row").alias("_row"), "parts")
    return rows.join(ask, rows["row"] == F.col("_row")).select("row", "text", "parts").mapInArrow(run, "hash bigint, row string, number int, at int, low int, state tinyint, bytes binary")


def _by_anchor(around: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on the different surroundings of each anchor that is not crowded: (row, number, at, low, state, bytes) of each."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        now, group, out = None, {}, []
        for batch in batches:
            for g in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g[0] != now and group:
                    out += work(now, sorted(group.values()))
                    group = {}
                    if len(out) > 20_000:
                        yield give(out)
                        out = []
                now = g[0]
                group[g[1], g[2]] = g[1:]  # a text that is repeated gives its surroundings once
        out += work(now, sorted(group.values())) if group else []
        if out:
            yield give(out)

    few = around.where(f"state < {_CROWDED_EDGE}").select("hash", "row", "number", "at", "low", "state", "bytes")
    return few.repartition(shuffle_partitions(around.sparkSession), "hash").sortWithinPartitions("hash").mapInArrow(run, schema)


def find_repeats(df: DataFrame, text_col: str = "text", key: str = "doc_id", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Spans of bytes of each whole text that are covered by a string of ``width`` bytes which also starts anywhere else.

    Returns key, text and ``spans``: an array of (start, stop) in bytes of UTF-8, ascending, apart from each other. Other
    places are those in any document, the same one included, overlaps too; matches never cross documents, and strings are
    judged on the input. A null text is empty. Equal texts are each other's copies and have equal spans, whatever their keys, so
    that repeated rows and null keys need no care; texts are taken whole, however long. An empty table gives an empty result;
    further columns are not passed on, whatever their names. Surroundings count as equal if 128 bits of BLAKE2 are; those that
    differ are compared byte by byte. A task holds the surroundings of one anchor at a time, at most ``CROWD`` of 300 bytes;
    beyond that windows are counted one by one.
    """
    rows = _rows(df, text_col, key)
    listed = cut_lineage(shared_anchors(rows, width, gram).groupBy("row").agg(F.collect_list("part").alias("parts"), F.max("open").alias("open")))
    release(df.sparkSession)
    around = cut_lineage(_around(rows, listed, width, gram))
    release(df.sparkSession)

    def ranges(_: int, group: list[tuple]) -> list[tuple]:
        found = repeated_ranges([(g[5], g[2]) for g in group], width)
        return [(g[0], g[3] + a, g[3] + b) for g, own in zip(group, found, strict=True) if g[4] == _EDGE for a, b in own]

    edges = _by_anchor(around, ranges, "row string, a int, b int")
    edges = edges.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("edges"))
    windows = shared_windows(around, width).groupBy("row").agg(F.collect_list("part").alias("windows"))
    beside = edges.withColumnRenamed("row", "_edge").join(windows.withColumnRenamed("row", "_window"), F.col("_edge") == F.col("_window"), "full").select(F.coalesce("_edge", "_window").alias("_beside"), "edges", "windows")
    info = listed.select(F.col("row").alias("_row"), "parts").join(beside, F.col("_row") == F.col("_beside"), "left").select(fresh("_row").alias("_row"), "parts", "edges", "windows")
    joined = rows.join(info, rows["row"] == F.col("_row"), "left").select("key", "text", "parts", "edges", "windows")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            out = []
            for text, parts, some, windows in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                spans: list[tuple[int, int]] = []
                if parts:
                    found = _entries(parts)
                    full = found["number"][~np.isin(found["state"], (_EDGE, _CROWDED_EDGE))]
                    if len(full):
                        _, low, high, _ = anchors(_bytes(text), width, gram)
                        spans += zip(low[full].tolist(), (high[full] + width).tolist(), strict=True)
                    spans += [(e["a"], e["b"]) for e in some or []]
                    more = _entries(windows or [])
                    spans += [(w, w + width) for w in more["number"][more["state"] != _EDGE].tolist()]
                out.append([{"start": a, "stop": b} for a, b in _merge(spans)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["key", "text", "spans"])

    marked = joined.mapInArrow(mark, f"key {df.schema[key].dataType.simpleString()}, text string, spans array<struct<start:bigint,stop:bigint>>")
    return marked.select(F.col("key").alias(key), F.col("text").alias(text_col), "spans")


def repeat_groups(df: DataFrame, text_col: str = "text", key: str = "doc_id", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """The maximal repeats at each anchor with all their occurrences: (group, n_bytes, key, start), a row for each occurrence.

    A repeat is maximal within what its anchor speaks for, at most 2 * width - gram bytes; a longer one shows as a chain of
    groups, one at each of its anchors. Equal texts each have their occurrences. This is the listing of groups for tables where
    they are wanted; ``find_repeats`` needs less: here all surroundings of shared anchors move, and a task holds those of one
    anchor, once for each text. Nulls and empty tables are as there.
    """
    rows = _rows(df, text_col, key)
    listed = cut_lineage(shared_anchors(rows, width, gram).groupBy("row").agg(F.collect_list("part").alias("parts"), F.max("open").alias("open")))
    around = cut_lineage(_around(rows, listed, width, gram, everything=True))

    def groups(h: int, group: list[tuple]) -> list[tuple]:
        places: dict[tuple[bytes, int], list[tuple]] = {}
        for row, _, at, low, _, data in group:
            places.setdefault((data, at), []).append((row, low))
        kinds = list(places)
        found = [(back, n, members) for back, n, members in maximal_groups(kinds, width)]
        found += [(at, len(data), [i]) for i, (data, at) in enumerate(kinds)]  # equal surroundings
        return [(f"{h}:{n}:{k}", n, row, low + kinds[m][1] - back) for k, (back, n, members) in enumerate(found) for m in members for row, low in places[kinds[m]]]

    found = _by_anchor(around, groups, "group string, n_bytes int, row string, start int")
    placed = found.join(rows.select(F.col("row").alias("_row"), "key"), F.col("row") == F.col("_row"))
    several = placed.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(fresh("group").alias("_group"))
    return placed.join(several, F.col("group") == F.col("_group"), "left_semi").select("group", F.col("n_bytes").cast("long").alias("n_bytes"), F.col("key").alias(key), F.col("start").cast("long").alias("start"))


def remove_repeats(found: DataFrame, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """What is left of each text without its spans: key, n_bytes, n_removed, n_spans, kept (binary) and its SHA-256. Null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, at, parts = _bytes(text), 0, []
                for s in spans:
                    parts.append(data[at : s["start"]])
                    at = s["stop"]
                kept = b"".join(parts) + data[at:]
                rows.append((len(data), len(data) - len(kept), len(spans), kept, hashlib.sha256(kept).hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    kind = found.schema[key].dataType.simpleString()
    return found.select(key, text_col, "spans").mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")
