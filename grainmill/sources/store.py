"""A keyed table in buckets: a merge rewrites the buckets that changes fall into and swaps them in with one manifest."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..lineage import cut_lineage
from .sinks import _path, write_text


@contextmanager
def _writers(spark: SparkSession, most: int | None) -> Iterator[None]:
    """Up to ``most`` files of a task open at once, so that rows need no sort by their folders; None changes nothing."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    if most is not None:
        spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Merged(NamedTuple):
    """Whether the batch was new, and the rows of the touched buckets before and after it (None: there were none)."""

    applied: bool
    before: DataFrame | None = None
    after: DataFrame | None = None


class BucketStore:
    """Rows live in ``buckets`` folders by the hash of ``key``; ``manifest/`` names for each bucket the version that holds it.

    A merge writes the touched buckets under a version of its own and then the manifest, by a rename: readers see all of a batch
    or nothing, folders of an attempt that failed are overwritten by the next one, and untouched buckets keep their files.
    Batches are numbered; one that the manifest already has is passed over, so that a replay changes nothing. One writer at a
    time. Files are sorted by ``sort``. Choose ``buckets`` so that one of them fits a few tasks. ``folder`` must be shared by the driver and all executors.
    """

    def __init__(self, spark: SparkSession, folder: str, key: tuple[str, ...], buckets: int = 32, sort: tuple[str, ...] = (), options: dict[str, str] | None = None):
        self.spark, self.folder, self.key, self.buckets, self.sort, self.options = spark, folder, key, buckets, sort, options or {}

    def bucket(self) -> Column:
        """The bucket of a row with the key's columns."""
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _names(self, path: str) -> list[str]:
        fs, p = _path(self.spark, path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def snapshot(self) -> dict:
        """The newest manifest: version, batch, schema, and the version of each bucket that has rows."""
        names = [n for n in self._names(f"{self.folder}/manifest") if not n.startswith(("_", "."))]
        if not names:
            return {"version": 0, "batch": None, "schema": None, "held": {}}
        return json.loads(self.spark.read.text(f"{self.folder}/manifest/{names[-1]}", wholetext=True).first()[0])

    def paths(self, now: dict | None = None, only: list[int] | None = None) -> list[str]:
        held = (now or self.snapshot())["held"]
        return [f"{self.folder}/data/v{v}/_bucket={b}" for b, v in sorted(held.items()) if only is None or int(b) in only]

    def read(self, now: dict | None = None, only: list[int] | None = None) -> DataFrame | None:
        """The rows, or those of some buckets; None before the first merge. Rows read stay valid until ``vacuum``."""
        now = now or self.snapshot()
        if not now["schema"]:
            return None
        schema, paths = StructType.fromJson(now["schema"]), self.paths(now, only)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def merge(self, changes: DataFrame, combine: Callable[[DataFrame | None, DataFrame], DataFrame], batch: int, keys: DataFrame | None = None, placed: bool = False) -> Merged:
        """Puts ``changes`` in: ``combine`` gets the old rows of the touched buckets (None: there are none) and the new ones, and returns
        what they become, with the same columns and keys. Changes with a null key are in a bucket like all others; no changes
        write no bucket.

        Changes are computed once and held in the checkpoint folder, unless ``keys`` has their keys more cheaply. ``placed`` says
        that the rows lie in partitions by bucket already and in the order in which they are to be written, or in sorted runs of it;
        they are written as they come, to all buckets of a task at once. Else they are dealt out, large buckets to several tasks.
        """
        now = self.snapshot()
        if now["batch"] is not None and batch <= now["batch"]:
            return Merged(False)
        if keys is None:
            keys = changes = cut_lineage(changes)
        touched = sorted(r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect())  # ``buckets`` rows at most
        before = self.read(now, touched)
        combined = combine(before, changes)
        version = now["version"] + 1
        target, held = f"{self.folder}/data/v{version}", {b: v for b, v in now["held"].items() if int(b) not in touched}
        if touched:
            dealt = combined.withColumn("_bucket", self.bucket())
            dealt = dealt if placed else dealt.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", *self.sort)
            with _writers(self.spark, self.buckets if placed else None):
                dealt.write.mode("overwrite").options(**self.options).partitionBy("_bucket").parquet(target)
            held |= {n.removeprefix("_bucket="): version for n in self._names(target) if n.startswith("_bucket=")}
        now = {"version": version, "batch": batch, "schema": now["schema"] or combined.schema.jsonValue(), "held": held}
        self._commit(now)
        return Merged(True, before, self.read(now, touched))

    def _commit(self, now: dict) -> None:
        staged, final = (f"{self.folder}/manifest/{name}" for name in (f"_staged-{now['version']}", f"{now['version']:012d}.json"))
        write_text(self.spark, staged, json.dumps(now))
        fs, source = _path(self.spark, staged)
        _, goal = _path(self.spark, final)
        if fs.exists(goal) or not fs.rename(source, goal):
            raise RuntimeError(f"another writer has committed version {now['version']} of {self.folder}")

    def vacuum(self) -> int:
        """Deletes the bucket folders that the newest manifest doesn't name; returns how many."""
        kept = {p.removeprefix(f"{self.folder}/data/") for p in self.paths()}
        gone = [f"{v}/{b}" for v in self._names(f"{self.folder}/data") for b in self._names(f"{self.folder}/data/{v}") if b.startswith("_bucket=") and f"{v}/{b}" not in kept]
        for name in gone:
            fs, p = _path(self.spark, f"{self.folder}/data/{name}")
            fs.delete(p, True)
        return len(gone)


def both(before: DataFrame | None, changes: DataFrame) -> DataFrame:
    return changes if before is None else before.unionByName(changes)


def newest(key: tuple[str, ...], by: str) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A rule for ``merge``: of the rows of a key the one with the greatest ``by``, of equal ones the greatest in all other columns."""

    def combine(before: DataFrame | None, changes: DataFrame) -> DataFrame:
        rest = [by, *[c for c in changes.columns if c not in key and c != by]]
        row = F.max(F.struct(*rest)).alias("_row")
        return both(before, changes).groupBy(*key).agg(row).select(*[F.col(c) if c in key else F.col(f"_row.{c}") for c in changes.columns])

    return combine


def value_store(spark: SparkSession, folder: str, buckets: int = 32) -> BucketStore:
    """A key-value store with rows (namespace, key, updated_at, value), to be merged with ``save_values``."""
    return BucketStore(spark, folder, ("namespace", "key"), buckets)


def save_values(store: BucketStore, changes: DataFrame, batch: int) -> bool:
    """Overwrites by key: the newest value stays, whatever the order in which batches arrive; equal times keep the greater value."""
    return store.merge(changes.select("namespace", "key", "updated_at", "value"), newest(("namespace", "key"), "updated_at"), batch).applied


def load_value(store: BucketStore, namespace: str, key: str, default: str | None = None) -> str | None:
    """The value of one key, from its own bucket alone."""
    named = store.spark.createDataFrame([(namespace, key)], "namespace string, key string")
    own = named.select(F.pmod(F.xxhash64("namespace", "key"), F.lit(store.buckets))).first()[0]
    rows = store.read(only=[own])
    found = rows.where((F.col("namespace") == namespace) & (F.col("key") == key)).select("value").first() if rows is not None else None
    return found[0] if found else default
