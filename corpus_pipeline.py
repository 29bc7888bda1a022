"""A corpus pipeline in five stages; each is written as Parquet and read again as the documents of the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.lineage import shared_folder
from grainmill.llm import bpe, mixing, ngramjoin, pii, toxicity
from grainmill.llm.common import fresh, read_table

#: Some stages have no counterpart in SQL; tests/llm compare run() with a plain version of all five on a small table.
ORACLE_SQL = None
#: Bytes of rows that go to a Python worker at once; an executor and its workers hold several times as much in each task.
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_small_batches(stage: Stage) -> Stage:
    """``stage`` with Arrow batches of ``BATCH_BYTES``. What it returns runs later, so the setting stays until ``run`` ends."""

    def small(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return small


def _numbered(docs: DataFrame) -> DataFrame:
    """Adds ``_key``, which names a row by its id and all its contents: ids in numerical order, null last."""
    shifted = F.col("doc_id").cast("decimal(21,0)") + F.lit(str(1 << 63)).cast("decimal(21,0)")  # no sign, so that texts are in the order of numbers
    number = F.coalesce(F.lpad(shifted.cast("string"), 22, "0"), F.lit("~"))
    return docs.withColumn("_key", F.concat(number, F.lit(" "), F.md5(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}))))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled ones that are not held out, scores below its threshold."""
    usable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"), usable)
    return toxicity.score(docs, model, name="_toxicity_").where(F.col("_toxicity_") < toxicity.THRESHOLD).drop("_toxicity_")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the least id, rows without id last. Rows count one by one, so
    different texts under one id are different documents; documents without words are nobody's copies."""
    rows = _numbered(docs)
    groups = ngramjoin.similar_sets(rows, key="_key").where("n_shingles > 0")
    gone = groups.where("component_id < _key").select(fresh("_key").alias("_gone")).distinct()
    kept = rows.join(gone, F.col("_key") == F.col("_gone"), "left_anti")
    worded = kept.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    blank = kept.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return worded.dropDuplicates(["_key"]).union(blank).select(*docs.columns)  # rows that are equal as a whole are copies, too


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind; n_chars follows the new text."""
    return pii.redact(docs, pii.extract(docs)).withColumn("n_chars", F.length("text").cast("long"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once, or up to three times. Rows that are equal as a whole are put
    together, and given as often as the mix takes them all."""
    rows = _numbered(docs)
    times = mixing.mix_sources(rows, key="_key").groupBy("_key").agg(F.sum("times").cast("int").alias("_times")).where("_times > 0").withColumnRenamed("_key", "_id")
    taken = rows.join(times, F.col("_key") == F.col("_id")).dropDuplicates(["_key"])
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of them and of what they decode to."""
    return bpe.tokenize(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
                        keep=("doc_id", "source"), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"), block_chars=500_000)


STAGES = [(name, _in_small_batches(stage)) for name, stage in (
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("mix_sources", mix_to_weights),
    ("byte_bpe", encode),
)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. The tables between them are in the shared checkpoint folder of the cluster; each is deleted
    once the next is written, the last one stays, as the result."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs, before, batches = read_table(spark, sf_dir, "documents"), None, spark.conf.get(_BATCHES)
    try:
        for k, (name, stage) in enumerate(STAGES):
            own = f"{folder}/{k}_{name}"
            stage(spark, docs, sf_dir).write.parquet(own)
            if before:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            docs, before = spark.read.parquet(own), own
    finally:
        spark.conf.set(_BATCHES, batches)
    return docs
