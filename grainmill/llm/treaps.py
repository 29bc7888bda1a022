"""Ranked lexical search with inverted treaps: for each term its postings in document order, in a heap by impact."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut_lineage
from .common import mix

#: Bytes of query text that are searched at a time; what the driver holds and tasks receive grows with them.
BLOCK_BYTES = 4 << 20
#: Documents and postings of a shard at most, one document aside.
SHARD_DOCS, SHARD_POSTINGS = 32_768, 4_000_000
#: Cells of query weights and live treap nodes that a searching task handles at a time.
CELLS, LIVE = 4_000_000, 400_000
#: UTF-8 bytes of terms, A-Z lower-cased; all that isn't ASCII belongs to a term, other ASCII characters separate them.
_TERM = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else c if c >= 128 else 32 for c in range(256))
_INDEX = "docs array<bigint>, sizes array<bigint>, starts array<bigint>, terms array<int>, counts array<bigint>, held array<int>, holders array<bigint>"
_FOUND = "query int, doc_id bigint, score bigint"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text in order: maximal runs of ASCII letters, digits and all other non-ASCII characters, A-Z lower-cased."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_TERM).split()


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each shard of neighbouring rows: documents in order of id, their sizes, and the postings of the terms in ``vocabulary``.

    Every row is a document of its own, one without terms as well; a row without an id is kept and comes last. ``held`` and
    ``holders`` say how many documents of the shard hold each term. Nothing is shuffled. ``vocabulary`` goes to every task.
    """

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
        starts = np.cumsum([0, *(len(r[2]) for r in rows)])
        terms = np.concatenate([r[2] for r in rows])
        held, holders = np.unique(terms, return_counts=True)
        row = ([r[0] for r in rows], [r[1] for r in rows], starts, terms, np.concatenate([r[3] for r in rows]), held, holders)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([x], pa.list_(t)) for x, t in zip(row, kinds, strict=True)], names=[f.split()[0] for f in _INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, known = 0, vocabulary.keys()
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms_of(t.as_py())
                count = Counter(found)
                own = sorted((vocabulary[x], count[x]) for x in known & count.keys())
                rows.append((k, len(found), np.array([x for x, _ in own], np.int32), np.array([c for _, c in own], np.int64)))
                held += len(own)
                if len(rows) >= SHARD_DOCS or held >= SHARD_POSTINGS:
                    yield shard(rows)
                    rows, held = [], 0
        if rows:
            yield shard(rows)

    return docs.select(F.col(key).cast("bigint"), text).mapInArrow(run, _INDEX)


class Treaps:
    """The treaps of a shard: posting arrays sorted by (term, document), with the children of each node and each term's root.

    A node's impact is the largest of its subtree; equal ones are ordered by a hash, which keeps the trees flat. The last node
    stands for none: it has no impact.
    """

    def __init__(self, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int):
        docs = np.repeat(np.arange(len(starts) - 1, dtype=np.int64), np.diff(starts))
        order = np.argsort(terms, kind="stable")
        self.none = len(order)
        self.doc, self.impact = np.append(docs[order], -1), np.append(impacts[order], 0)
        rank = (self.impact[:-1] << 32) | (mix(self.doc[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64)
        bounds = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.left, self.right, self.root = self._trees(rank.tolist(), bounds.tolist())

    def _trees(self, rank: list[int], bounds: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = self.none
        left, right, root = [none] * (none + 1), [none] * (none + 1), [none] * (len(bounds) - 1)
        for t in range(len(bounds) - 1):
            path: list[int] = []  # the right spine so far
            for i in range(bounds[t], bounds[t + 1]):
                r, below = rank[i], none
                while path and rank[path[-1]] < r:
                    below = path.pop()
                left[i] = below
                if path:
                    right[path[-1]] = i
                path.append(i)
            if path:
                root[t] = path[0]
        return tuple(np.array(x, np.int64) for x in (left, right, root))

    def below(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each node the highest of its subtree whose document is in [low, high), or none."""
        node = node.copy()
        at = np.flatnonzero(node != self.none)
        while len(at):
            here = node[at]
            doc = self.doc[here]
            over, under = doc >= high[at], doc < low[at]
            out = over | under
            at, here, over = at[out], here[out], over[out]
            node[at] = here = np.where(over, self.left[here], self.right[here])
            at = at[here != self.none]
        return node


class _Top:
    """The best ``k`` (score, document) of each query; documents are places in order of id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query = self.score = self.doc = np.zeros(0, np.int64)
        self.least, self.last = np.zeros(queries, np.int64), np.full(queries, -1, np.int64)  # score and document to beat

    def may_enter(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a score in a document not before ``doc`` may still enter."""
        return (score > self.least[query]) | ((score == self.least[query]) & (doc < self.last[query]))

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        good = self.may_enter(query, score, doc)
        if not good.any():
            return
        query, score, doc = (np.concatenate(x) for x in ((self.query, query[good]), (self.score, score[good]), (self.doc, doc[good])))
        order = np.lexsort((doc, -score, query))
        query, score, doc = query[order], score[order], doc[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        full = rank == self.k - 1
        self.least[query[full]], self.last[query[full]] = score[full], doc[full]
        kept = rank < self.k
        self.query, self.score, self.doc = query[kept], score[kept], doc[kept]


def _gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches that begin at ``starts``, one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def traverse(treaps: Treaps, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, queries: list[tuple[np.ndarray, np.ndarray]],
             n_terms: int, k: int, low: np.ndarray | None = None) -> tuple[_Top, int]:
    """The best ``k`` documents of each query (its terms and their weights), and how many documents were scored.

    A state is a range of documents with, for each term of the query, the highest node of its treap there. The sum of weight
    times impact of these nodes bounds every score in the range; ranges that cannot enter the best are dropped. Of the others
    the node that adds most names the next document: it is scored, and the range is split there. Many states go at once.
    ``low`` holds scores that are known to be reached by ``k`` documents elsewhere.
    """
    top, scored = _Top(len(queries), k), 0
    if low is not None:
        top.least[:], top.last[:] = low, len(starts)  # equal scores may still enter
    weights = np.zeros((len(queries), n_terms), np.int64)
    for q, (t, w) in enumerate(queries):
        weights[q, t] = w

    def states(query: np.ndarray, lo: np.ndarray, hi: np.ndarray, row: np.ndarray, node: np.ndarray, weight: np.ndarray) -> list[np.ndarray] | None:
        """Drops nodes that are none, then ranges that cannot enter; row: the state of each node, ascending."""
        live = node != treaps.none
        row, node, weight = row[live], node[live], weight[live]
        if not len(row):
            return None
        sizes = np.bincount(row, minlength=len(query))
        own = np.flatnonzero(sizes)
        sizes = sizes[own]
        begin = np.cumsum(sizes) - sizes
        adds = weight * treaps.impact[node]
        bound = np.add.reduceat(adds, begin)
        good = top.may_enter(query[own], bound, lo[own])
        own, sizes = own[good], sizes[good]
        if not len(own):
            return None
        at = _gathered(begin[good], sizes)
        begin, adds, node, weight = np.cumsum(sizes) - sizes, adds[at], node[at], weight[at]
        most = np.flatnonzero(adds == np.repeat(np.maximum.reduceat(adds, begin), sizes))
        first = most[np.searchsorted(most, begin)]
        return [query[own], lo[own], hi[own], bound[good], treaps.doc[node[first]], sizes, node, weight]

    def part(s: list[np.ndarray], rows: np.ndarray) -> list[np.ndarray]:
        begin = np.cumsum(s[5]) - s[5]
        at = _gathered(begin[rows], s[5][rows])
        return [*(x[rows] for x in s[:6]), s[6][at], s[7][at]]

    sizes = np.array([len(t) for t, _ in queries])
    if not sizes.sum() or len(starts) < 2:
        return top, 0
    whole = np.zeros(len(queries), np.int64)
    began = states(np.arange(len(queries)), whole, whole + len(starts) - 1, np.repeat(np.arange(len(queries)), sizes), treaps.root[np.concatenate([t for t, _ in queries])], np.concatenate([w for _, w in queries]))
    waiting = [began] if began else []
    while waiting:
        now = waiting.pop()
        good = np.flatnonzero(top.may_enter(now[0], now[3], now[1]))
        if not len(good):
            continue
        if len(now[6]) > LIVE and len(good) > 1:  # the ranges with the highest bounds first
            good = good[np.argsort(top.least[now[0][good]] - now[3][good], kind="stable")]
            half = np.searchsorted(np.cumsum(now[5][good]), LIVE) + 1
            if half < len(good):
                waiting.append(part(now, np.sort(good[half:])))
                good = np.sort(good[:half])
            else:
                good = np.sort(good)
        if len(good) < len(now[0]):
            now = part(now, good)
        query, lo, hi, _, doc, sizes, node, weight = now
        held = starts[doc + 1] - starts[doc]  # at least the posting of the node that named the document
        at = _gathered(starts[doc], held)
        top.add(query, np.add.reduceat(weights[np.repeat(query, held), terms[at]] * impacts[at], np.cumsum(held) - held), doc)
        scored += len(doc)
        row = np.repeat(np.arange(len(query)), sizes)
        low_side, high_side = treaps.below(node, lo[row], doc[row]), treaps.below(node, doc[row] + 1, hi[row])
        children = states(np.tile(query, 2), np.concatenate([lo, doc + 1]), np.concatenate([doc, hi]), np.concatenate([row, row + len(query)]),
                          np.concatenate([low_side, high_side]), np.tile(weight, 2))
        if children:
            if waiting and len(waiting[-1][6]) + len(children[6]) < LIVE:
                children = [np.concatenate(x) for x in zip(children, waiting.pop(), strict=True)]
            waiting.append(children)
    return top, scored


def _groups(queries: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Neighbouring queries with ``CELLS`` cells of query times term at most, one query aside."""
    at = 0
    while at < len(queries):
        stop, held = at, set()
        while stop < len(queries) and (stop == at or (stop + 1 - at) * len(held | set(queries[stop][0].tolist())) <= CELLS):
            held |= set(queries[stop][0].tolist())
            stop += 1
        yield at, queries[at:stop]
        at = stop


def _search_block(docs: DataFrame, texts: list[str | None], k: int, key: str, text: str) -> DataFrame:
    """(query, doc_id, score): the best ``k`` documents of each shard for the queries, numbered as in ``texts``."""
    spark = docs.sparkSession
    asked = [Counter(terms_of(t)) for t in texts]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*asked)))}
    index = cut_lineage(build_index(docs, vocabulary, key, text))
    n, total = index.select(F.explode("sizes").alias("n")).where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    holders = index.select(F.explode(F.arrays_zip("held", "holders")).alias("h")).groupBy("h.held").agg(F.sum("h.holders")).collect()  # a row for each term of the block at most
    if not n or not holders:
        return spark.createDataFrame([], _FOUND)
    weight = np.zeros(len(vocabulary), np.int64)
    for t, df in holders:
        weight[t] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
    wanted = []
    for counts in asked:
        own = sorted((vocabulary[t], c) for t, c in counts.items() if weight[vocabulary[t]])
        wanted.append((np.array([t for t, _ in own], np.int64), np.array([c * int(weight[t]) for t, c in own], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column(0)[r].values
                sizes, starts, terms, counts = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in range(1, 5))
                m = 75 + 25 * sizes * n // total
                impacts = 1_000_000_000 * counts // (1000 * counts + 12 * np.repeat(m, np.diff(starts)))
                treaps = Treaps(starts, terms, impacts, len(vocabulary))
                for first, group in _groups(wanted):
                    used = np.unique(np.concatenate([t for t, _ in group]))
                    local = np.full(len(vocabulary), len(used), np.int64)  # the last column has no weight
                    local[used] = np.arange(len(used))
                    own = Treaps.__new__(Treaps)
                    own.__dict__ = treaps.__dict__ | {"root": treaps.root[used]}
                    top, _ = traverse(own, starts, local[terms], impacts, [(local[t], w) for t, w in group], len(used) + 1, k)
                    yield pa.RecordBatch.from_arrays([pa.array(top.query + first, pa.int32()), ids.take(pa.array(top.doc)), pa.array(top.score)], names=["query", "doc_id", "score"])

    return index.mapInArrow(run, _FOUND)


def search(docs: DataFrame, queries: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", query_key: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query_key, rank, doc_id, score): the ``k`` best documents of each query with a score above 0, equal scores by document.

    A score sums, over the query's terms with repeats, floor(1000 ln((2N+2) / (2df+1))) times 10^9 tf div (1000 tf + 12 m), where
    m = 75 + 25 n N div L, in 64-bit integers. Every row of ``docs`` is a document, whole texts count; repeated rows are ranked
    one by one, rows without an id after all with one. Null and empty texts, documents or queries, have no terms and no results.
    Queries that are equal as rows are one. Columns of other names play no part.

    Documents are split into shards where they lie, each with treaps of its own, so that no term's postings meet in a task; a
    shard gives ``k`` rows for a query, of which each task passes on its best ``k``. Queries go to all tasks in blocks of about
    ``BLOCK_BYTES``, cut by hash; a block of more than twice that is an error.
    """
    spark = docs.sparkSession
    queries = queries.select(F.col(query_key).alias("_item"), F.col(query_text).alias("_text")).distinct()
    size = queries.agg(F.sum(F.octet_length("_text") + 16)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    found = None
    for b in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == b)
        block = sorted(map(tuple, own.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))  # a bounded block of the queries
        if blocks > 1 and sum(len((t or "").encode()) for _, t in block) > 2 * BLOCK_BYTES:
            raise ValueError(f"more than {2 * BLOCK_BYTES} bytes of queries have one hash")
        items = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"query int, `{query_key}` {queries.schema['_item'].dataType.simpleString()}")
        best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        ranked = _search_block(docs, [t for _, t in block], k, key, text).withColumn("rank", best).where(F.col("rank") <= k)
        ranked = ranked.join(F.broadcast(items), "query").select(query_key, F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(key), "score")  # a row for each query of the block
        found = ranked if found is None else found.union(ranked)
    return found if found is not None else spark.createDataFrame([], f"`{query_key}` {queries.schema['_item'].dataType.simpleString()}, rank int, `{key}` bigint, score bigint")


_SPLIT = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH word AS (SELECT doc_id, unnest({_SPLIT}) AS t FROM documents),
size AS (SELECT doc_id, count(*) AS n FROM word GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM size),
posting AS (SELECT doc_id, t, count(*) AS tf FROM word GROUP BY ALL),
term AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM posting, total GROUP BY t),
asked AS (SELECT item_id, unnest({_SPLIT}) AS t FROM benchmark),
wanted AS (SELECT item_id, t, count(*) AS qf FROM asked GROUP BY ALL),
score AS (SELECT item_id, doc_id, sum(qf * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // words)))))::BIGINT AS score
    FROM wanted JOIN term USING (t) JOIN posting USING (t) JOIN size USING (doc_id), total GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM score WHERE score > 0
QUALIFY rank <= 20"""
