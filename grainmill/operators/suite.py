"""Benchmark suites: grading set-up, assembly, filters, prompts, and the rows of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R

TASK = {"ord": "bigint", "id": "string", "category": "string", "difficulty": "string", "language": "string", "source": "string", "prompt": "string", "rubric": "array<string>", "rubric_min": "int"}


def build_grading(language: Column, files: Column, command: Column, expected: Column) -> Column:
    """How a verified record is graded by running it: main file, other files, command, expected output and contract.

    Null for records without files.
    """
    main = F.lit(R.OTHER_MAIN)
    contract = F.lit(None).cast("string")
    for name, file in R.MAIN_FILES.items():
        main = F.when(language == name, file).otherwise(main)
    for name, text in R.CONTRACTS.items():
        contract = F.when(language == name, text).otherwise(contract)
    own = F.when(F.coalesce(F.size(command), F.lit(0)) > 0, command).otherwise(F.array(*map(F.lit, R.GRADING_COMMAND)))
    others = F.map_filter(files, lambda k, v: k != main)
    return F.when(F.coalesce(F.size(files), F.lit(0)) > 0, F.struct(F.lit("sandbox_test").alias("type"), language.alias("language"), main.alias("main_file"), others.alias("other_files"), own.alias("command"), expected.alias("expected_output"), contract.alias("contract")))


def verified_tasks(records: DataFrame, rubrics: DataFrame, expected: DataFrame) -> DataFrame:
    """Tasks from verified records (ord, id, category, difficulty, language, prompt, files, command).

    ``rubrics`` has (id, rubric, rubric_min), ``expected`` (id, expected_output): at most a row for each id.
    """
    rows = records.join(rubrics.select(F.col("id").alias("_r"), "rubric", "rubric_min"), F.col("id") == F.col("_r"), "left").join(expected.select(F.col("id").alias("_e"), "expected_output"), F.col("id") == F.col("_e"), "left")
    grading = build_grading(F.col("language"), F.col("files"), F.col("command"), F.col("expected_output"))
    return rows.select("ord", "id", "category", "difficulty", F.nullif(F.col("language"), F.lit("")).alias("language"), F.lit("verified").alias("source"), "prompt", "rubric", F.col("rubric_min").cast("int").alias("rubric_min"), grading.alias("grading"))


def assemble(baseline: DataFrame | None, verified: DataFrame | None) -> DataFrame:
    """Baseline tasks, then verified ones; ``ord`` runs through both."""
    parts = []
    for k, part in enumerate((baseline, verified)):
        if part is not None:
            have = set(part.columns)
            parts.append(part.withColumns({c: (F.col(c) if c in have else F.lit(None)).cast(t) for c, t in TASK.items()}).withColumn("part", F.lit(k)))
    if not parts:
        raise ValueError("a suite needs a source")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def select_tasks(tasks: DataFrame, categories: str | None = None, ids: str | None = None, limit: int = 0) -> DataFrame:
    """Tasks of the categories and ids named, each a list with commas; then the first ``limit``. Empty lists filter nothing."""
    for column, names in (("category", categories), ("id", ids)):
        wanted = sorted({n.strip() for n in (names or "").split(",") if n.strip()})
        if wanted:
            tasks = tasks.where(F.col(column).isin(*wanted))
    order = [c for c in ("part", "ord") if c in tasks.columns]
    return tasks.orderBy(*order).limit(limit) if limit else tasks


def task_prompt(prompt: Column, grading: Column) -> Column:
    """The user's part of a prompt: tasks that are run ask for code only, after the contract of their module."""
    contract = F.coalesce(F.concat(F.lit("\n\n"), grading["contract"]), F.lit(""))
    return F.when(grading.isNotNull(), F.concat(prompt, contract, F.lit(R.CODE_ONLY))).otherwise(prompt)


def report_line(result: DataFrame) -> DataFrame:
    """Adds ``line``: the result in a summary, with the missed terms of its rubric and its error, if any."""
    status = F.when(F.col("pass"), "PASS").when(~F.col("pass"), "FAIL").otherwise("REVIEW")
    missed = F.when(F.size("missed") > 0, F.concat(F.lit("\n    - missed rubric terms: "), F.array_join("missed", ", ")))
    error = F.when(F.length("error") > 0, F.concat(F.lit("\n    - error: "), "error"))
    head = F.concat(F.lit("- ["), status, F.lit("] `"), "id", F.lit("` ("), "category", F.lit("): "), "type")
    return result.withColumn("line", F.concat(head, F.coalesce(missed, F.lit("")), F.coalesce(error, F.lit(""))))
