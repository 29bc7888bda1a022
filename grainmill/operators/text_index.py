"""A positional index of letter trigrams: memory search and code search without a scan of all texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from re import _constants as sre  # the standard library's own parse of a pattern
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..lineage import cut_lineage
from ..sources.store import BucketStore
from .repository import search_lines

GRAM = 3
_POSTINGS = "file string, gram bigint, places array<int>"
#: Characters whose postings a task sorts at a time; bounds a worker's memory, and larger runs are searched in fewer pages.
_HELD = 4_000_000
#: Candidate files that are broadcast to the scan of texts; more of them are joined in a shuffle.
FEW = 200_000


def gram_code(text: str) -> int:
    """Three code points in one number, without loss."""
    a, b, c = map(ord, text)
    return a << 42 | b << 21 | c


def postings(files: DataFrame, key: str = "file", text: str = "text", with_places: bool = True) -> DataFrame:
    """(file, gram, places): where each three characters of each whole text, in lower case, begin. Null texts and those of fewer
    characters have one row without a gram, which says that the file is known. Without places the lists are empty. Rows come in
    runs of about ``_HELD`` characters of text, each sorted by gram and file, so that no task sorts all of its postings."""

    def packed(texts: list[tuple[str | None, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """The postings of some texts, sorted by gram and file; a missing gram is -1 here and comes first."""
        texts.sort(key=lambda x: x[0] or "")
        names, grams, sizes, places = zip(*texts, strict=True)
        of, gram = np.repeat(np.arange(len(names)), list(map(len, grams))), np.concatenate(grams)
        order = np.argsort(gram, kind="stable")
        size = np.concatenate(sizes)
        start, n = (np.cumsum(size) - size)[order], size[order]
        offsets = np.concatenate([[0], np.cumsum(n)])
        place = np.concatenate(places)[np.repeat(start - offsets[:-1], n) + np.arange(offsets[-1])]
        name, gram = pa.array(names, pa.string()), gram[order]
        for k in range(0, len(order), 100_000):
            at, end = slice(k, k + 100_000), min(k + 100_000, len(order))
            lists = pa.ListArray.from_arrays(pa.array((offsets[k : end + 1] - offsets[k]).astype(np.int32)), pa.array(place[offsets[k] : offsets[end]]))
            yield pa.RecordBatch.from_arrays([name.take(pa.array(of[order[at]])), pa.array(gram[at], mask=gram[at] < 0), lists], names=["file", "gram", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, held = [], 0
        for batch in batches:
            for file, low in zip(batch.column(0), batch.column(1), strict=True):
                codes = np.frombuffer((low.as_py() or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
                own = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
                order = np.argsort(own, kind="stable")
                found, count = np.unique(own[order], return_counts=True)
                if not len(found):
                    found, count = np.full(1, -1), np.zeros(1, np.int64)
                texts.append((file.as_py(), found, count if with_places else np.zeros(len(found), np.int64), (order if with_places else order[:0]).astype(np.int32)))
                held += len(order) + 1
                if held > _HELD:
                    yield from packed(texts)
                    texts, held = [], 0
        if texts:
            yield from packed(texts)

    return files.select(F.col(key).cast("string"), F.lower(F.col(text))).mapInArrow(run, _POSTINGS)


def index_store(spark: SparkSession, folder: str, buckets: int = 32) -> BucketStore:
    """Postings in buckets of files, so that a changed file touches one bucket; each has runs sorted by gram, so that a search reads
    the pages of its grams. Row groups are small, since a task may hold one for each of its buckets."""
    return BucketStore(spark, folder, ("file",), buckets, ("gram", "file"), {"parquet.block.size": str(16 << 20), "parquet.writer.version": "v2", "parquet.enable.dictionary#places.list.element": "false", "compression": "zstd"})


def update_index(store: BucketStore, files: DataFrame, batch: int, removed: DataFrame | None = None, key: str = "file", text: str = "text", with_places: bool = True) -> bool:
    """Indexes new and changed files again, in place of what the store has of them, and forgets ``removed`` ones (key) that are not
    among them. File names are unique in a batch. Texts are dealt to the tasks of their buckets, not the postings, which are
    several times as large. Searches for lines need no places, and their index is a fraction of the texts without them."""
    named = files.select(F.col(key).cast("string").alias("file"))
    names = named if removed is None else named.union(removed.select(F.col(key).cast("string").alias("file")))
    dealt = files.select(F.col(key).cast("string").alias("file"), F.col(text).alias("text")).withColumn("_bucket", store.bucket()).hint("rebalance", "_bucket")

    def combine(before: DataFrame | None, changes: DataFrame) -> DataFrame:
        if before is None:
            return changes
        kept = before.join(names.distinct(), "file", "left_anti").sortWithinPartitions(*store.sort)
        return changes.unionByName(kept)

    return store.merge(postings(dealt, with_places=with_places), combine, batch, keys=names, placed=True).applied


def _grams(term: str) -> list[str]:
    return [term[i : i + GRAM] for i in range(len(term) - GRAM + 1)]


def _begins(term: str) -> Column:
    """Where a term begins: places at which all its grams follow one another. ``by`` maps grams to places."""
    def back(i: int):
        return lambda place: place - i

    moved = [F.transform(F.try_element_at("by", F.lit(gram_code(g))), back(i)) for i, g in enumerate(_grams(term))]
    return F.coalesce(reduce(F.array_intersect, moved), F.array().cast("array<int>"))


def _without_overlap(places: Column, size: int) -> Column:
    """How many of the sorted places a scan takes that goes on behind each hit."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("free"))
    step = lambda a, p: F.when(p >= a["free"], F.struct((a["n"] + 1).alias("n"), (p + size).alias("free"))).otherwise(a)
    return F.aggregate(F.array_sort(places), zero, step, lambda a: a["n"])


def rank_files(store: BucketStore, query: str, limit: int = 8, kind: str = "string") -> DataFrame:
    """(file, score) of the ``limit`` files in which the query's different words of three letters or more occur most often, within
    words too and without overlaps; ties by file, as a value of ``kind``. Reads the postings of the query's trigrams alone."""
    terms = sorted({t.lower() for t in query.split() if len(t) > 2})
    rows = store.read()
    if rows is None or not terms:
        return store.spark.createDataFrame([], "file string, score bigint")
    wanted = sorted({gram_code(g) for t in terms for g in _grams(t)})
    by_file = rows.where(F.col("gram").isin(wanted)).groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("gram", "places"))).alias("by"))  # as many entries as the query has grams
    score = reduce(lambda a, b: a + b, [_without_overlap(_begins(t), len(t)) for t in terms])
    return by_file.select("file", score.alias("score")).where("score > 0").orderBy(F.desc("score"), F.col("file").cast(kind)).limit(limit)


def search_indexed(store: BucketStore, files: DataFrame, query: str, limit: int = 8, key: str = "file", text: str = "text") -> DataFrame:
    """What ``repository.search_memory`` gives: texts are read of the best files only, which are named in the filter of the scan."""
    best = {r["file"]: r["score"] for r in rank_files(store, query, limit, files.schema[key].dataType.simpleString()).collect()}  # ``limit`` rows
    name = F.col(key).cast("string")
    score = F.try_element_at(F.create_map(*[F.lit(x) for kv in best.items() for x in kv]), name) if best else F.lit(0).cast("bigint")
    typed = [F.lit(f).cast(files.schema[key].dataType) for f in best]
    return files.where(F.col(key).isin(*typed) if best else F.lit(False)).select(key, score.alias("score"), F.left(text, F.lit(8000)).alias("content")).orderBy(F.desc("score"), key)


def needed_grams(pattern: str) -> list | None:
    """What every line that a pattern matches must hold, as ("and" | "or", parts) over trigrams in lower case; None if nothing is
    known. Only literal stretches, groups, branches and repeats of one or more are looked into; all else ends a stretch."""
    try:
        tree = _parser.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return None  # the other dialect may know it

    def joined(kind: str, parts: list) -> list | None:
        return None if not parts else parts[0] if len(parts) == 1 else [kind, *parts]

    def walk(items) -> list | None:
        parts, run = [], []

        def flush() -> None:
            parts.extend(dict.fromkeys(_grams("".join(run))))
            run.clear()

        for op, arg in items:
            # a letter whose lower case depends on its neighbours or is longer ends a stretch
            if op is sre.LITERAL and len(chr(arg).lower()) == 1 and (arg < 128 or not chr(arg).isalpha()):
                run.append(chr(arg).lower())
                continue
            inner = None
            if op is sre.SUBPATTERN:
                inner = walk(arg[3])
            elif op is sre.MAX_REPEAT and arg[0] >= 1:
                inner = walk(arg[2])
            elif op is sre.BRANCH:
                each = [walk(x) for x in arg[1]]
                inner = joined("or", each) if all(x is not None for x in each) else None
            flush()
            if inner is not None:
                parts.append(inner)
        flush()
        return joined("and", list(parts))

    return walk(tree)


def _holds(need, have: Column) -> Column:
    if isinstance(need, str):
        return F.array_contains(have, F.lit(gram_code(need)))
    each = [_holds(x, have) for x in need[1:]]
    return reduce((lambda a, b: a & b) if need[0] == "and" else (lambda a, b: a | b), each)


def _named(need) -> set[str]:
    return {need} if isinstance(need, str) else set().union(*map(_named, need[1:]))


def candidate_files(store: BucketStore, pattern: str) -> DataFrame | None:
    """The files that may match, from the postings of the pattern's trigrams without their places; None if all may."""
    need, rows = needed_grams(pattern), store.read()
    if need is None or rows is None:
        return None
    have = rows.where(F.col("gram").isin(sorted(map(gram_code, _named(need))))).groupBy("file").agg(F.collect_set("gram").alias("have"))  # as many as the pattern has
    return have.where(_holds(need, F.col("have"))).select("file")


def search_indexed_lines(store: BucketStore, files: DataFrame, pattern: str, language: str | None = None, definitions: bool = False, key: str = "path") -> DataFrame:
    """What ``repository.search_lines`` gives, with the pattern tried on candidate files only."""
    known = language.strip().lower() if language else None
    wanted = rf"{R.DEFINITIONS[known]}.*{pattern}" if definitions and known in R.DEFINITIONS else pattern
    some = candidate_files(store, wanted)
    if some is not None:
        some = cut_lineage(some)
        some = F.broadcast(some) if some.count() <= FEW else some  # texts stay where they are read
    chosen = files if some is None else files.join(some.withColumnRenamed("file", "_file"), F.col(key).cast("string") == F.col("_file"), "left_semi")
    return search_lines(chosen, pattern, language, definitions)


def share_read(store: BucketStore, pattern: str) -> float:
    """The part of all files that a search with this pattern reads."""
    some, rows = candidate_files(store, pattern), store.read()
    total = rows.select("file").distinct().count() if rows is not None else 0
    return 1.0 if some is None or not total else some.count() / total
