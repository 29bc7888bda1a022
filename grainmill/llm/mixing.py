"""Mixing sources to target weights by subset-sum budget fitting on counts of exact document lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

#: The most times that a document may be taken.
MOST = 3
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: Words of a budget that are left to the knapsack once whole counts have been dealt out.
KNAPSACK_WORDS = 4096
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, knapsack: int = KNAPSACK_WORDS) -> np.ndarray:
    """How many documents of each length to take so that their words come as near ``budget`` from below as can be found.

    Whole counts are dealt out in proportion, then from the longest length on while the budget stays above ``knapsack``;
    a bounded-knapsack dynamic programme over the sums up to what then remains picks the rest.
    """
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    taken = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return taken
    if budget >= total:
        return counts.copy()
    taken = np.array([c * budget // total for c in counts.tolist()], dtype=np.int64)  # whole numbers of any size
    left = budget - int((lengths * taken).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        if lengths[i] > 0 and (more := min(int(counts[i] - taken[i]), (left - knapsack) // int(lengths[i]))) > 0:
            taken[i] += more
            left -= more * int(lengths[i])
    reached = np.zeros(left + 1, dtype=bool)
    reached[0] = True
    by, size = np.full(left + 1, -1, dtype=np.int64), np.zeros(left + 1, dtype=np.int64)
    for i in order:
        length, free, part = int(lengths[i]), int(counts[i] - taken[i]), 1
        if not 0 < length <= left:
            continue
        free = min(free, left // length)
        while free > 0 and not reached[left]:
            k = min(part, free)
            step = k * length
            new = np.flatnonzero(reached[: left + 1 - step] & ~reached[step:]) + step
            reached[new], by[new], size[new] = True, i, k
            free, part = free - k, part * 2
        if reached[left]:
            break
    at = int(np.flatnonzero(reached).max())
    while at:
        taken[by[at]] += size[at]
        at -= int(size[at] * lengths[by[at]])
    return taken


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """A target for each source: shares by weight of all words, none above ``most`` times its own, the excess reshared.

    ``sizes`` has a row for each document: source, size. The table of sources is small against the documents; its order
    by code point needs one sorted task over it.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    listed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (((place - 1) % len(weights)) + 1).cast("int")).cast("double"))
    everything = Window.partitionBy(F.lit(0))
    rising = everything.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    gone = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    level = (F.sum("source_size").over(everything) - most * gone(F.col("source_size"))) / (F.sum("weight").over(everything) - gone(F.col("weight")))
    marked = listed.withColumn("capped", most * F.col("source_size") <= F.col("weight") * level)
    capped = lambda c: F.sum(F.when(F.col("capped"), c).otherwise(0)).over(everything)
    rest = (F.sum("source_size").over(everything) - most * capped(F.col("source_size"))) / (F.sum("weight").over(everything) - capped(F.col("weight")))
    target = F.when(F.col("capped"), (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * rest)
    return marked.select("source", "source_size", target.cast("double").alias("target"))


def mix_sources(df: DataFrame, text_col: str = "text", source_col: str = "source", key: str = "doc_id", seed: int = 17,
                weights: tuple[int, ...] = WEIGHTS, most: int = MOST, knapsack: int = KNAPSACK_WORDS) -> DataFrame:
    """How often the mix takes each document.

    Returns key, size, source_size, target and ``times`` (0 to ``most``). Every document of a source is taken
    floor(target / source_size) times; the remaining budget is fitted on the counts of exact lengths, and of each length
    the documents with the smallest seeded hashes are taken once more.

    Null texts have size 0; the null source is a source of its own and comes last. Documents of size 0 are taken as often
    as whole passes over their source go. Repeated rows count each, and of equal ones any may be taken. An empty table
    gives an empty result; further columns are not passed on. Ranks are found by counts of hash ranges, so that no
    task sees more than the documents of one length in one of 256 ranges.
    """
    docs = cut_lineage(df.select(df[key].alias("key"), df[source_col].alias("source"), word_count(df[text_col]).alias("size"))
                       .withColumn("hash", F.xxhash64(F.lit(seed), F.col("key"))).withColumn("range", F.shiftrightunsigned("hash", 56).cast("int")))
    targets = cut_lineage(source_targets(docs, weights, most))
    ranges = docs.groupBy("source", "size", "range").agg(F.count(F.lit(1)).alias("n"))
    lengths = ranges.groupBy("source", "size").agg(F.sum("n").alias("n"))
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size") + 1e-12))).otherwise(0).cast("int")
    whole = targets.withColumn("passes", passes).withColumn("budget", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    whole = whole.withColumn("budget", F.when(F.col("passes") >= most, 0).otherwise(F.col("budget")))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ignore_index=True)
        rows["extra"] = fit_counts(rows["size"].to_numpy(), rows["n"].to_numpy(), int(rows["budget"].iloc[0]), knapsack)
        return rows[["source", "size", "extra"]]

    same = lambda a, b, *c: [a[x].eqNullSafe(b[x]) for x in c]
    lengths = lengths.alias("l").join(whole.alias("w"), F.col("l.source").eqNullSafe(F.col("w.source"))).select("l.source", "l.size", "l.n", "w.budget")
    extra = lengths.where("budget > 0").groupBy("source").applyInPandas(fit, f"source {df.schema[source_col].dataType.simpleString()}, size bigint, extra bigint").where("extra > 0")
    upto = F.sum("n").over(Window.partitionBy("source", "size").orderBy("range"))
    dealt = ranges.withColumn("before", upto - F.col("n"))
    dealt = dealt.join(extra.hint("shuffle_hash"), same(dealt, extra, "source", "size")).select(dealt["source"], dealt["size"], dealt["range"], F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.col("before"))).alias("here"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "range").orderBy("hash", "key"))
    ranked = docs.withColumn("rank", rank)
    picked = ranked.join(dealt, same(ranked, dealt, "source", "size", "range"), "left").select(ranked["key"], ranked["source"], ranked["size"], (F.col("rank") <= F.coalesce("here", F.lit(0))).cast("int").alias("once_more"))
    return picked.alias("p").join(whole.alias("w"), F.col("p.source").eqNullSafe(F.col("w.source"))).select(
        F.col("p.key").alias(key), "p.size", "w.source_size", "w.target", (F.col("w.passes") + F.col("p.once_more")).cast("int").alias("times"))
