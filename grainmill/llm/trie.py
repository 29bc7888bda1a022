"""Conversation prefix trie: sorted turn arrays, adjacent common prefixes, one stack sweep for each partition, stitched spines."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut_lineage
from .common import shuffle_partitions
from .mixing import word_count

#: Summaries that one stitching task joins.
FAN = 64
#: Bytes of joined ids in one row, and rows of an Arrow batch.
PIECE, ROWS = 4096, 8192
#: Turns that a grafted conversation may take from the first one of its family, and conversations of a family.
GRAFT, FAMILY = 4, 20
_EMPTY = hashlib.sha256(b"").hexdigest()
_COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
_TOTALS = "depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_EXTRA = "kind string, unit int, seq int, node binary, parent binary, token binary, words bigint, piece binary"


def turn_arrays(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as structs of a 128-bit digest of (role, text) and the text's words.

    Turns without a number come first, equal numbers in the order of their digests; repeated rows are turns of their own. Null
    roles and texts are empty ones. Rows without a conversation belong to none. Whole texts are hashed, however long.
    """
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(by), F.lit(":"), by, said).cast("binary"), 256), 1, 32))
    one = F.struct(F.col(turn).isNotNull().alias("numbered"), F.col(turn).cast("bigint").alias("number"), digest.alias("token"), word_count(said).alias("words"))
    own = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("bigint").alias("conv_id"), one.alias("one"))
    ordered = F.transform(F.array_sort(F.collect_list("one")), lambda t: F.struct(t["token"].alias("token"), t["words"].alias("words")))
    return own.groupBy("conv_id").agg(ordered.alias("turns"))


def graft(arrays: DataFrame, family: int = FAMILY, most: int = GRAFT) -> DataFrame:
    """Each conversation with its first turns replaced by as many of the first one of its family: crc32(id) modulo ``most`` of
    them, all if that one has fewer, none if it is absent. Remainders of negative ids are negative, as in SQL."""
    arrays = cut_lineage(arrays)
    heads = arrays.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("_first"), F.slice("turns", 1, most - 1).alias("_head"))
    joined = arrays.withColumn("_first", F.col("conv_id") - F.col("conv_id") % family).join(heads, "_first", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = F.slice("turns", h + 1, F.size("turns"))
    return joined.select("conv_id", F.when(F.col("_head").isNull(), own).otherwise(F.concat(F.slice("_head", F.lit(1), h), own)).alias("turns"))


class _Node:
    """An open node; counts are its own and those of its closed children."""

    __slots__ = ("token", "words", "id", "convs", "least", "children", "leaves", "saved", "ends", "kids")

    def __init__(self, token: bytes, words: int):
        self.token, self.words, self.id = token, words, None
        self.convs = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends, self.kids = bytearray(), []

    def add(self, convs: int, least: int | None, children: int, leaves: int, saved: int) -> None:
        self.convs, self.children, self.leaves, self.saved = self.convs + convs, self.children + children, self.leaves + leaves, self.saved + saved
        if least is not None and (self.least is None or least < self.least):
            self.least = least

    def total(self) -> tuple[int, int | None, int, int, int]:
        return self.convs, self.least, self.children, self.leaves or 1, self.saved + (self.convs - 1) * self.words


class _Sweep:
    """The stack of a sweep over sorted paths. Nodes of the first path may go on to the left of what this task sees, those open
    at the end to its right: both spines stay partial, all other nodes are closed when the sweep leaves them."""

    def __init__(self, close: Callable[[_Node, int, tuple, _Node | None, bool], None], last: bool):
        self.open: list[_Node] = []
        self.close, self.last = close, last
        self.left = 0  # so many of the open nodes, root first, lie on the first path
        self.kept: list[_Node] = []  # nodes of the first path that the sweep has left, deepest first

    def cut(self, size: int) -> None:
        while len(self.open) > size:
            node = self.open.pop()
            depth = len(self.open)
            if depth < self.left:
                self.left = depth
                self.kept.append(node)
                continue
            total, parent = node.total(), self.open[-1] if depth else None
            if parent:
                parent.add(total[0], total[1], 1, total[3], total[4])
            self.close(node, depth, total, parent, depth <= self.left)

    def first_path(self) -> None:
        """What is open now is the first path."""
        self.left = 0 if self.last else len(self.open)

    def spines(self) -> list[tuple[int, _Node]]:
        """Depth and node: the first path, then what is open beside it."""
        path = self.open[: self.left] + self.kept[::-1]
        for spine in (path, self.open):
            before = None
            for node in spine:
                node.id = before = _name(before, node.token)
        return list(enumerate(path)) + list(enumerate(self.open))[self.left :]


def _name(parent: bytes | None, token: bytes) -> bytes:
    return b"" if parent is None else hashlib.blake2b(parent + token, digest_size=16).digest()


class _Rows:
    """Gathers rows into Arrow batches of one schema."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.ready = schema, [], []

    def add(self, **row) -> None:
        self.rows.append(row)
        if len(self.rows) >= ROWS:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            self.ready.append(pa.RecordBatch.from_pylist(self.rows, self.schema))
            self.rows = []

    def take(self) -> Iterator[pa.RecordBatch]:
        ready, self.ready = self.ready, []
        yield from ready


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])


def _totals(total: tuple) -> dict:
    return {"conv_id": total[1], "n_convs": total[0], "n_children": total[2], "n_leaves": total[3], "saved_tokens": total[4]}


def _partial(unit: int, seq: int, depth: int, node: _Node) -> dict:
    return {"kind": "spine", "unit": unit, "seq": seq, "depth": depth, "node": node.id, "token": node.token, "words": node.words, "conv_id": node.least, "n_convs": node.convs, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved}


def _sweep_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind node (closed), spine (partial) and ends (joined ids of members that end at a spine node)."""
    unit, out = TaskContext.get().partitionId(), _Rows(_arrow(f"{_EXTRA}, {_TOTALS}"))

    def close(node: _Node, depth: int, total: tuple, parent: _Node, on_spine: bool) -> None:
        for kid in node.kids:
            out.add(**kid, parent_conv_id=node.least)
        kid = {"kind": "node", "depth": depth, "ends_sha256": hashlib.sha256(node.ends).hexdigest()} | _totals(total)
        if on_spine:  # the parent is on the first path: its least member is known after stitching only
            out.add(**kid, unit=unit, parent=parent.id)
        else:
            parent.kids.append(kid)

    sweep, seen = _Sweep(close, last=False), False
    for batch in batches:
        for conv, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not seen:
                sweep.open.append(_Node(b"", 0))
            same, most = 0, min(len(path), len(sweep.open) - 1)
            while same < most and sweep.open[same + 1].token == path[same]["token"]:
                same += 1
            sweep.cut(same + 1)
            sweep.open += [_Node(t["token"], t["words"]) for t in path[same:]]
            if not seen:
                sweep.first_path()
                sweep.spines()  # names the nodes
                seen = True
            end = sweep.open[-1]
            end.add(1, conv, 0, 0, 0)
            end.ends += (b"," if end.ends else b"") + str(conv).encode()
            yield from out.take()
    for seq, (depth, node) in enumerate(sweep.spines()):
        out.add(**_partial(unit, seq, depth, node))
        for kid in node.kids:
            out.add(**kid, unit=unit, parent=node.id)
        for k in range(0, len(node.ends), PIECE):
            out.add(kind="ends", unit=unit, seq=k // PIECE, node=node.id, piece=bytes(node.ends[k : k + PIECE]))
    out.flush()
    yield from out.take()


def _stitch(last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Joins the spines of neighbouring summaries: rows sorted by (group, unit, seq)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(_arrow(f"{_EXTRA}, {_TOTALS}"))

        def close(node: _Node, depth: int, total: tuple, parent: _Node | None, on_spine: bool) -> None:
            out.add(kind="node", depth=depth, node=node.id, parent=parent.id if parent else None, **_totals(total))

        def finish() -> None:
            if last:
                sweep.cut(0)
            for seq, (depth, node) in enumerate(sweep.spines()):
                out.add(**_partial(group, seq, depth, node))

        group = unit = None
        sweep, joining, depth_before, first = _Sweep(close, last), False, -1, True
        for batch in batches:
            for r in batch.to_pylist():
                if r["group"] != group:
                    if group is not None:
                        finish()
                    sweep, group, unit, first = _Sweep(close, last), r["group"], None, True
                if r["unit"] != unit or r["depth"] <= depth_before:  # a new summary, or the second spine of one
                    if first and unit is not None:  # the first path of the group has ended
                        sweep.first_path()
                        first = False
                    joining = r["unit"] != unit
                    unit = r["unit"]
                d = depth_before = r["depth"]
                if not (joining and d < len(sweep.open) and sweep.open[d].token == r["token"]):
                    joining = False
                    sweep.cut(d)
                    sweep.open.append(_Node(r["token"], r["words"]))
                    sweep.open[d].id = r["node"]
                sweep.open[d].add(r["n_convs"], r["conv_id"], r["n_children"], r["n_leaves"], r["saved_tokens"])
                yield from out.take()
        if group is not None:
            if first:
                sweep.first_path()
            finish()
        out.flush()
        yield from out.take()

    return run


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined ids of each node, piece by piece; rows sorted by (node, unit, seq), pieces of a unit cut anywhere."""
    node = unit = digest = None
    found: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if digest is None or r["node"] != node:
                if digest is not None:
                    found.append({"node": node, "ends_sha256": digest.hexdigest()})
                node, unit, digest = r["node"], r["unit"], hashlib.sha256()
            elif r["unit"] != unit:
                unit = r["unit"]
                digest.update(b",")
            digest.update(r["piece"])
    if digest is not None:
        found.append({"node": node, "ends_sha256": digest.hexdigest()})
        yield pa.RecordBatch.from_pylist(found, _arrow("node binary, ends_sha256 string"))


def prefix_trie(arrays: DataFrame) -> DataFrame:
    """One row for each node of the trie of all conversations' turn arrays (``turn_arrays``): conv_id (smallest member), depth,
    parent_conv_id (null for the root), n_convs, n_children, n_leaves and saved_tokens of the subtree, ends_sha256 (of the
    members that end at the node, in numerical order).

    Arrays are sorted over all partitions by range, equal ones by id, so a hot conversation is split. Each partition is swept
    once: the stack holds the common prefix with the row before, and what the next row does not share is closed. Only nodes on
    the first or last path of a partition can go on in another; their partial counts are stitched in groups of ``FAN``
    partitions, level by level. Children of such nodes learn their parent's conv_id by a join on (partition, node).

    A conversation without turns is a member of the root; no conversations give no rows. One conversation's digests, 16 bytes a
    turn, must fit a task; texts are not moved. The hash of a hot node's ids is one stream, taken in pieces of ``PIECE`` bytes.
    """
    spark = arrays.sparkSession
    n = shuffle_partitions(spark)
    paths = cut_lineage(arrays.select("conv_id", "turns"))
    ordered = paths.withColumn("_tokens", F.col("turns.token")).repartitionByRange(n, "_tokens", "conv_id").sortWithinPartitions("_tokens", "conv_id")
    swept = cut_lineage(ordered.select("conv_id", "turns").mapInArrow(_sweep_partition, f"{_EXTRA}, {_TOTALS}"))
    spine = swept.where("kind = 'spine'")
    columns = ("unit", "seq", "depth", "node", "token", "words", "conv_id", *_COUNTS)
    level, finals = spine.select(*columns), []
    while True:
        units = (level.agg(F.max("unit")).first()[0] or 0) + 1
        grouped = level.withColumn("group", F.floor(F.col("unit") / FAN).cast("int")).repartition(min(n, -(-units // FAN)), "group").sortWithinPartitions("group", "unit", "seq")
        done = cut_lineage(grouped.mapInArrow(_stitch(units <= FAN), f"{_EXTRA}, {_TOTALS}"))
        finals.append(done.where("kind = 'node'"))
        if units <= FAN:
            break
        level = done.where("kind = 'spine'").select(*columns)
    stitched = finals[0]
    for more in finals[1:]:
        stitched = stitched.union(more)
    pieces = swept.where("kind = 'ends'").select("node", "unit", "seq", "piece").repartition(n, "node").sortWithinPartitions("node", "unit", "seq")
    ends = pieces.mapInArrow(_hash_pieces, "node binary, ends_sha256 string")
    least = stitched.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    shown = ("conv_id", "depth", "parent_conv_id", *_COUNTS, "ends_sha256")
    on_spines = stitched.drop("ends_sha256", "parent_conv_id").join(ends, "node", "left").join(least, "parent", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    known = swept.where("kind = 'node' AND parent IS NULL")
    own = spine.select("unit", F.col("node").alias("parent")).join(least, "parent")
    beside = swept.where("kind = 'node' AND parent IS NOT NULL").drop("parent_conv_id").join(own, ["unit", "parent"])
    return on_spines.select(*shown).union(known.select(*shown)).union(beside.select(*shown))


#: The same trie in SQL: every prefix as a list, its ancestors by list prefixes, crc32 bit by bit.
ORACLE = r"""
WITH given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS t FROM given GROUP BY conv_id),
crc AS (SELECT conv_id, t, (xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT) % 4)::BIGINT AS h FROM own),
rebuilt AS (SELECT a.conv_id, list_concat(coalesce(b.t[1:a.h], []), a.t[a.h + 1:]) AS t FROM crc a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
prefix AS (SELECT conv_id, t[1:d] AS p, d, len(t) = d AS ends FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)),
node AS (SELECT p, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ended,
    CASE WHEN any_value(d) = 0 THEN 0 ELSE len(regexp_extract_all(any_value(p[d].text), '[^\x20\x09-\x0D]+')) END AS words FROM prefix GROUP BY p),
kids AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(n, 0) AS n_children FROM node LEFT JOIN kids USING (p)),
up AS (SELECT p[1:a] AS p, (n_children = 0)::BIGINT AS leaf, (n_convs - 1) * words AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM full_node)),
sums AS (SELECT p, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY p)
SELECT x.conv_id, x.depth::BIGINT AS depth, y.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, sha256(x.ended) AS ends_sha256
FROM full_node x JOIN sums USING (p) LEFT JOIN node y ON x.depth > 0 AND y.p = x.p[1:x.depth - 1]"""
