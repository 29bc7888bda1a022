"""Fixture rows dealt out to documents: each document takes the shape of one of them and carries its own text in it.

Both sides of a comparison are made from one description, in Spark and in the dialect of the checking engine. The fixture rows
themselves are in the result, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import spread
from . import sql as S

#: How a column takes its document in: SQL of the column {f}, and the same as an expression of Spark. A null stays null.
_GLUE = {
    "after": ("{f} || chr(10) || t", lambda f: F.concat(f, F.lit("\n"), F.col("_t"))),
    "suffix": ("{f} || split_part(t, ' ', 1)", lambda f: F.concat(f, F.substring_index("_t", " ", 1))),
    "word": ("CASE WHEN {f} IS NOT NULL THEN list_append({f}, split_part(t, ' ', 1)) END", lambda f: F.array_append(f, F.substring_index("_t", " ", 1))),
    "files": ("map_from_entries(list_transform(map_entries({f}), lambda e: {{'key': e.key, 'value': e.value || chr(10) || t}}))", lambda f: F.transform_values(f, lambda k, v: F.concat(v, F.lit("\n"), F.col("_t")))),
    "family": ("{f} || doc_id // 10", lambda f: F.concat(f, F.floor(F.col("doc_id") / 10).cast("string"))),
    "number": ("{f} + 1000 * (doc_id + 1)", lambda f: f + 1000 * (F.col("doc_id") + 1)),
}


def _key(kind: str) -> tuple[str, Column]:
    if kind == "VARCHAR":
        return "'doc-' || lpad(doc_id::VARCHAR, 12, '0') || '/' || {f}", lambda f: F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit("/"), f)
    return "doc_id + 1000", lambda f: F.col("doc_id") + 1000


def _slotted(columns: dict[str, str], fixture: list[tuple], key: str, slots: list | None) -> tuple[int, list[tuple]]:
    at = list(columns).index(key)
    order = [r[at] for r in fixture] if slots is None else slots
    return len(order), [(order.index(r[at]) if r[at] in order else -1, *r) for r in fixture]


def values(name: str, columns: dict[str, str], fixture: list[tuple], key: str, glue: dict[str, str], slots: list | None = None) -> str:
    """Common tables: the fixture, and ``name``, its rows and those of all documents. ``slots`` are the keys that documents take in
    turn, by default those of the fixture."""
    n, rows = _slotted(columns, fixture, key, slots)
    taken = {c: (_key(columns[c])[0] if c == key else _GLUE[glue[c]][0] if c in glue else "{f}").format(f=f'f."{c}"') for c in columns}
    listed = ", ".join(f'"{c}"' for c in columns)
    return (S.values(f"{name}_fixed", {"slot": "BIGINT", **columns}, rows) + f", {name} AS (SELECT {listed} FROM {name}_fixed UNION ALL SELECT " + ", ".join(f'{x} AS "{c}"' for c, x in taken.items())
            + f" FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) d JOIN {name}_fixed f ON f.slot = d.doc_id % {n})")


def rows(spark: SparkSession, d: str, columns: dict[str, str], fixture: list[tuple], key: str, glue: dict[str, str], slots: list | None = None) -> DataFrame:
    """The rows of ``values``."""
    from .curation_queries import frame, table

    n, held = _slotted(columns, fixture, key, slots)
    fixed = frame(spark, {"_slot": "BIGINT", **columns}, held)
    docs = spread(table(spark, d, "documents")).select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    joined = docs.join(F.broadcast(fixed), F.col("_slot") == F.col("doc_id") % n)  # a fixed table
    taken = [(_key(columns[c])[1](F.col(c)) if c == key else _GLUE[glue[c]][1](F.col(c)) if c in glue else F.col(c)).alias(c) for c in columns]
    return fixed.select(*columns).unionByName(joined.select(*taken))


def json_text(text: Column | str) -> Column:
    """A text as a JSON value; ``to_json`` of the checking engine."""
    x = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("x")))
    return F.substr(x, F.lit(6), F.length(x) - 6)


def put(template: Column, text: Column) -> Column:
    """A template with a text in the place of each @T."""
    return F.replace(template, F.lit("@T"), text)
