"""Distillation: training rows from passing samples and from verified records, and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from .evaluation import clean_completion

ROW = ("id", "sample", "category", "difficulty", "reason", "prompt", "completion", "tokens")


def distilled_rows(samples: DataFrame, thinking: bool = False) -> DataFrame:
    """Rows from the samples (id, sample, category, difficulty, prompt, output, tokens, pass) that passed.

    With ``thinking`` outputs are reduced to their answers, and those without one are dropped although they count as passed.
    """
    text = clean_completion(F.col("output")) if thinking else F.col("output")
    good = samples.where("pass").withColumns({"reason": F.lit("distilled"), "completion": text})
    return (good.where(~is_blank(F.col("completion"))) if thinking else good).select(*ROW)


def gold_rows(records: DataFrame, tokens=lambda text: F.lit(None).cast("bigint")) -> DataFrame:
    """Rows from verified records (id, category, difficulty, prompt, files, code) that have files, with their own code.

    ``tokens`` counts those of a column of texts; there is no count without it.
    """
    gold = records.where(F.coalesce(F.size("files"), F.lit(0)) > 0)
    return gold.withColumns({"sample": F.lit(-1), "reason": F.lit("gold"), "completion": F.col("code"), "tokens": tokens(F.col("code")).cast("bigint")}).select(*ROW)


def task_table(samples: DataFrame, gold: DataFrame) -> DataFrame:
    """(id, category, type, samples, passed) of each task: its samples, and one that passed for each gold row."""
    own = samples.select("id", "category", "type", F.coalesce("pass", F.lit(False)).alias("good"), F.lit(0).alias("late"))
    own = own.unionByName(gold.select("id", "category", F.lit("sandbox").alias("type"), F.lit(True).alias("good"), F.lit(1).alias("late")))
    first = lambda c: F.min_by(c, "late").alias(c)
    return own.groupBy("id").agg(first("category"), first("type"), F.count(F.lit(1)).alias("samples"), F.count_if("good").alias("passed"))


def row_counts(rows: DataFrame) -> DataFrame:
    """(dimension, key, n): rows in all, by reason and by category."""
    cube = rows.groupingSets([[], [F.col("reason")], [F.col("category")]], F.col("reason"), F.col("category"))
    out = cube.agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "reason").otherwise("category")
    return out.select(kind.alias("dimension"), F.when(F.col("g") == 3, "all").when(F.col("g") == 1, F.col("reason")).otherwise(F.col("category")).alias("key"), "n")
