"""Grading, pass-rate summaries, the regression gate, and selection among samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.ranges import range_index, round_exact
from ..functions.text import casefold, strip
from ..lineage import cut_lineage

EPSILON = 1e-9
_FENCE = r"(?s)```(?:[a-zA-Z]+)?\s*\n?(.*?)```"


def last_match(x: Column, pattern: str, group: int = 1) -> Column:
    """The group of the last match, null if there is none."""
    found = F.regexp_extract_all(x, F.lit(pattern), F.lit(group))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def extract_code(output: Column) -> Column:
    """The last fenced block of an output without its thoughts, else all of it, stripped."""
    text = F.regexp_replace(output, r"(?s)<\|start_of_thought\|>.*?<\|end_of_thought\|>", "")
    return strip(F.coalesce(last_match(text, _FENCE), text))


def clean_completion(output: Column) -> Column:
    """The answer after the last closing marker of a thinking scaffold; outputs without a scaffold stay as they are."""
    opened = output.rlike("|".join(R.OPENERS))
    head = F.regexp_replace(output, r"\A\s*<\s*(?:think(?:ing)?|start_of_thought)/?\s*\n?", "")
    marker = "|".join(R.CLOSERS)
    # of all markers the one that ends last; none of them can hold another that ends later
    rest = F.regexp_extract(head, rf"(?s)\A.*(?:{marker})(.*)\z", 1)
    return F.when(~opened, output).when(head.rlike(marker), strip(rest)).otherwise("")


def grade_freeform(output: Column, rubric: Column, needed: Column) -> Column:
    """Struct of pass, score, required, hits, terms, hit and missed: which terms of a rubric the case-folded output contains.

    Without terms there is no grade. ``score`` is the share of the terms that were hit, to two decimals.
    """
    terms = F.filter(rubric, lambda t: F.length(strip(t)) > 0)
    low = casefold(output)
    hit, missed = F.filter(terms, lambda t: low.contains(t)), F.filter(terms, lambda t: ~low.contains(t))
    required = F.when(F.coalesce(needed, F.lit(0)) != 0, needed).otherwise(F.size(terms))
    some = F.size(terms) > 0
    return F.struct(F.when(some, F.size(hit) >= required).alias("pass"), F.when(some, round_exact(F.size(hit) / F.size(terms))).alias("score"), F.when(some, F.least(required, F.size(terms))).alias("required"),
                    F.when(some, F.size(hit)).alias("hits"), F.size(terms).alias("terms"), hit.alias("hit"), missed.alias("missed"))


def grade_executable(success: Column, stdout: Column, expected: Column) -> Column:
    """Passed if the run succeeded and printed what was expected, if anything was."""
    return F.coalesce(success, F.lit(False)) & (expected.isNull() | F.coalesce(stdout.contains(expected), F.lit(False)))


def grade_run(success: Column, exit_code: Column, timed_out: Column, stdout: Column, stderr: Column, expected: Column, unavailable: Column | None = None) -> Column:
    """The grade of an executed task with its evidence; a run that could not be made has failed unverified, with the error."""
    lost = F.lit(None).cast("string") if unavailable is None else unavailable
    ran, tail = lost.isNull(), lambda c: F.when(lost.isNull(), F.right(F.coalesce(c, F.lit("")), F.lit(R.GRADED_TAIL)))
    matched = expected.isNull() | F.coalesce(stdout.contains(expected), F.lit(False))
    return F.struct((ran & F.coalesce(success, F.lit(False)) & matched).alias("pass"), ran.alias("verified"), F.when(ran, exit_code).alias("exit_code"), F.when(ran, timed_out).alias("timed_out"), F.when(ran, expected).alias("expected_output"),
                    F.when(ran, matched).alias("output_matched"), tail(stdout).alias("stdout_truncated"), tail(stderr).alias("stderr_truncated"), F.concat(F.lit("sandbox unavailable: "), lost).alias("error"))


def summarize(results: DataFrame) -> DataFrame:
    """Counts over all results, by category and by source, in one pass of grouping sets. The rate counts unscored ones too."""
    total = F.count(F.lit(1))
    cube = results.groupingSets([[], [F.col("category")], [F.col("source")]], F.col("category"), F.col("source"))
    out = cube.agg(F.grouping_id().alias("g"), total.alias("total"), F.count_if("pass").alias("passed"), F.count_if(~F.col("pass")).alias("failed"), F.count_if(F.col("pass").isNull()).alias("unscored"))
    kind = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "category").otherwise("source")
    return out.select(kind.alias("dimension"), F.when(F.col("g") == 3, "all").when(F.col("g") == 1, F.col("category")).otherwise(F.col("source")).alias("key"), "total", "passed", "failed", "unscored", (F.col("passed") / F.col("total")).alias("pass_rate"))


def rates(results: DataFrame) -> DataFrame:
    """(category, passed, scored) without unscored results; results without category are ``unknown``."""
    category = F.when(F.coalesce(F.length("category"), F.lit(0)) == 0, "unknown").otherwise(F.col("category"))
    return results.where("pass is not null").groupBy(category.alias("category")).agg(F.count_if("pass").alias("passed"), F.count(F.lit(1)).alias("scored"))


def compare(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Rates of each category in two runs, side by side: a full outer join of two small aggregates."""
    b = rates(baseline).select("category", F.col("passed").alias("base_passed"), F.col("scored").alias("base_scored"))
    c = rates(candidate).select("category", F.col("passed").alias("cand_passed"), F.col("scored").alias("cand_scored"))
    both = b.join(c, "category", "full_outer").withColumns({"base_rate": F.col("base_passed") / F.col("base_scored"), "cand_rate": F.col("cand_passed") / F.col("cand_scored")})
    return both.withColumn("delta", F.col("cand_rate") - F.col("base_rate"))


def verdict(compared: DataFrame, min_overall_delta: float = 0.0, max_category_regression: float = 0.0) -> DataFrame:
    """One row: whether the candidate passes the gate, by how much it differs overall, and why it fails."""
    sign = lambda c: F.when(c < 0, "-").otherwise("+")  # noqa: E731  a drop that rounds to zero is still a drop
    percent = lambda c, digits: F.concat(sign(c), F.format_string(f"%.{digits}f%%", F.abs(round_exact(c * 100, digits))))
    why = (
        F.when(F.col("base_scored").isNotNull() & F.col("cand_scored").isNull(), F.concat(F.lit("category missing from candidate: "), "category"))
        .when(F.col("delta") < -max_category_regression - EPSILON, F.concat(F.lit("category regressed: "), "category", F.lit(" "), percent(F.col("delta"), 0), F.lit(f" (allowed {max_category_regression:.0%} drop)"))))
    told = compared.withColumn("why", why)  # a row for each category
    total = told.agg(*[F.sum(c).alias(c) for c in ("base_passed", "base_scored", "cand_passed", "cand_scored")], F.array_sort(F.collect_list(F.when(F.col("why").isNotNull(), F.struct("category", "why")))).alias("regressions"))
    delta = F.col("cand_passed") / F.col("cand_scored") - F.col("base_passed") / F.col("base_scored")
    overall = F.when(delta.isNull(), "no scored tasks in one of the reports").when(delta < min_overall_delta - EPSILON, F.concat(F.lit("overall pass rate fell or missed the target: "), percent(delta, 2), F.lit(f" (required {min_overall_delta:+.2%})")))
    out = total.select(delta.alias("overall_delta"), F.array_compact(F.concat(F.array(overall), F.transform("regressions", lambda r: r["why"]))).alias("reasons"))
    return out.select((F.size("reasons") == 0).alias("passed"), "overall_delta", F.array_join("reasons", "; ").alias("reasons"), F.col("reasons").alias("reason_list"))


def task_stats(samples: DataFrame) -> DataFrame:
    """(id, category, samples, passed): an upsert of gold rows into the counts of distilled ones is one aggregation."""
    return samples.groupBy("id").agg(F.min("category").alias("category"), F.count(F.lit(1)).alias("samples"), F.count_if(F.coalesce("pass", F.lit(False))).alias("passed"))


def best_of(samples: DataFrame, key: str, score: Column, text: str = "text", order: str = "sample") -> DataFrame:
    """Of each key the sample with the highest score; ties go to the longer text, then to the earlier sample."""
    rank = F.struct(score.alias("score"), F.length(text).alias("length"), (-F.col(order)).alias("place"))
    return samples.groupBy(key).agg(F.max_by(F.struct(order, text, score.alias("score")), rank).alias("b"), F.count(F.lit(1)).alias("samples")).select(key, "samples", f"b.{order}", f"b.{text}", "b.score")


def pass_at(samples: DataFrame, key: str, order: str = "sample") -> DataFrame:
    """Of each key the first attempt that passed, else the last; and whether any passed."""
    good = F.coalesce("pass", F.lit(False))
    return samples.groupBy(key).agg(F.coalesce(F.min(F.when(good, F.col(order))), F.max(order)).alias(order), F.bool_or(good).alias("passed"), F.count(F.lit(1)).alias("attempts"))


def format_failure(timed_out: Column, error: Column, stderr: Column, stdout: Column, exit_code: Column, limit: int = 4000) -> Column:
    """The evidence of a failed run: its parts in order, each stream's last characters."""
    end = lambda name, c: F.when(F.length(strip(c)) > 0, F.concat(F.lit(f"{name}:\n"), F.right(strip(c), F.lit(limit))))
    parts = F.concat_ws("\n\n", F.when(timed_out, "The run timed out before finishing."), F.when(F.length(error) > 0, F.concat(F.lit("Runner error: "), error)), end("STDERR", stderr), end("STDOUT", stdout))
    return F.when(parts == "", F.concat(F.lit("The run failed with exit code "), F.coalesce(exit_code.cast("string"), F.lit("None")), F.lit("."))).otherwise(parts)


def container_error(exit_code: Column, stderr: Column, stdout: Column) -> Column:
    """The error of a run whose container didn't start; null for runs of user code."""
    said = F.when(F.coalesce(F.length(stderr), F.lit(0)) > 0, stderr).otherwise(F.coalesce(stdout, F.lit("")))
    return F.when(exit_code.isin(125, 126, 127), F.concat(F.lit("Sandbox could not start the container (docker exit "), exit_code.cast("string"), F.lit("). "), F.element_at(F.split(strip(said), "\n"), -1)))


def run_summary(success: Column, exit_code: Column, stdout: Column, stderr: Column) -> Column:
    """What a verification says of a run: that it passed, or its exit code and both streams."""
    part = lambda c, default: F.coalesce(c.cast("string"), F.lit(default))
    failed = F.concat(F.lit("Verification failed.\nExit code: "), part(exit_code, "-1"), F.lit("\nSTDOUT:\n"), part(stdout, ""), F.lit("\nSTDERR:\n"), part(stderr, ""))
    return F.when(F.coalesce(success, F.lit(False)), "Verification passed.").otherwise(failed)


def windows_by_category(results: DataFrame, blocks: int = 64) -> DataFrame:
    """Running pass rate of each category in order of ``ord``: rows without a grade repeat the rate so far.

    Rows are dealt to blocks between quantiles of ``ord``; counts of the blocks before are added to those within a block, so no
    task holds more than one block of one category, however large that is.
    """
    cuts = sorted(set(results.agg(F.percentile_approx("ord", [i / blocks for i in range(1, blocks)]).alias("c")).first()["c"] or []))
    dealt = results.withColumn("_block", range_index(F.col("ord"), cuts))
    passed, graded = F.sum(F.when(F.col("pass"), 1).otherwise(0)), F.count("pass")
    before = Window.partitionBy("category").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("category", "_block").agg(passed.alias("_p"), graded.alias("_g"))
    sums = sums.select(F.col("category").alias("_c"), F.col("_block").alias("_b"), F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_p"), F.coalesce(F.sum("_g").over(before), F.lit(0)).alias("_g"))
    within = Window.partitionBy("category", "_block").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.withColumns({"_own_p": passed.over(within), "_own_g": graded.over(within)})
    both = rows.join(cut_lineage(sums), F.col("category").eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_b")), "left")  # blocks x categories rows
    rate = (F.col("_p") + F.col("_own_p")) / F.nullif(F.col("_g") + F.col("_own_g"), F.lit(0))
    return both.withColumn("rate_so_far", rate).drop("_block", "_p", "_g", "_own_p", "_own_g", "_c", "_b")
