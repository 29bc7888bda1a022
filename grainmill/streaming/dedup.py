"""Deduplication that goes on from batch to batch, with retraction: the labels are those of one run over everything so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.curation import deduplicate
from ..sources.store import BucketStore, both

_LABELS = ("duplicate_type", "duplicate_of")


def label_store(spark: SparkSession, folder: str, buckets: int = 64) -> BucketStore:
    """Rows (instruction_hash, ord, id, content_hash, duplicate_type, duplicate_of) by instruction."""
    return BucketStore(spark, folder, ("instruction_hash",), buckets)


def add_batch(store: BucketStore, rows: DataFrame, batch: int, id_prefix: str = "record-") -> DataFrame | None:
    """Puts hashed candidates (instruction_hash, ord, id, content_hash) into the store and labels all rows of their buckets anew.

    Of each instruction the row with the smallest ``ord`` is kept, also where it arrives late: the row that was kept until then
    becomes its duplicate, and duplicates point to the new one. A row whose ``ord`` the instruction has already replaces the
    older one if its content hash is smaller. Returns what changed: new rows (``arrived``) and older ones with another label
    than before (was_type, was_of); None if the batch had been put in already.
    """

    def combine(before: DataFrame | None, changes: DataFrame) -> DataFrame:
        one = both(before, changes).groupBy("instruction_hash", "ord").agg(F.min(F.struct("content_hash", "id")).alias("r")).select("instruction_hash", "ord", "r.id", "r.content_hash")
        return deduplicate(one, id_prefix).select("instruction_hash", "ord", "id", "content_hash", *_LABELS)

    given = rows.select("instruction_hash", "ord", "id", "content_hash", *[F.lit(None).cast("string").alias(c) for c in _LABELS])
    done = store.merge(given, combine, batch)
    if not done.applied:
        return None
    if done.before is None:
        return done.after.select("*", *[F.lit(None).cast("string").alias(c) for c in ("was_type", "was_of")], F.lit(True).alias("arrived"))
    was = done.before.select(F.col("instruction_hash").alias("_i"), F.col("ord").alias("_o"), F.col("duplicate_type").alias("was_type"), F.col("duplicate_of").alias("was_of"))
    now = done.after.join(was, (F.col("instruction_hash") == F.col("_i")) & (F.col("ord") == F.col("_o")), "left").withColumn("arrived", F.col("_o").isNull())
    same = F.col("duplicate_type").eqNullSafe(F.col("was_type")) & F.col("duplicate_of").eqNullSafe(F.col("was_of"))
    return now.where(F.col("arrived") | ~same).drop("_i", "_o")


def follow(stream: DataFrame, store: BucketStore, checkpoint: str, changes: str | None = None, **how) -> StreamingQuery:
    """A streaming query that puts each micro-batch of hashed candidates into the store; with ``changes`` every batch's changes are
    written to ``changes``/batch=N. The store is the state, so it has no watermark and forgets nothing."""

    def put(rows: DataFrame, batch: int) -> None:
        changed = add_batch(store, rows, batch)
        if changed is not None and changes:
            changed.write.mode("overwrite").parquet(f"{changes}/batch={batch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(how or {"availableNow": True})).start()
