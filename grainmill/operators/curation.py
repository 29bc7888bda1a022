"""Curation of candidates: validation, safety, routing, scoring, deduplication, records and manifest.

Every function adds columns to, or aggregates, a DataFrame of candidates with the columns of ``CANDIDATE``. Columns that a
source lacks are added as nulls by ``typed``. ``nulls`` names the fields that were null explicitly, which hash unlike missing
ones; ``bad`` names those with values of another type.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import assign_fold, assign_split, is_blank, normalize_code, normalize_prose, strip
from ..lineage import cut_lineage

CANDIDATE = {
    "ord": "bigint", "id": "string", "instruction": "string", "category": "string", "difficulty": "string", "language": "string", "context": "string",
    "expected_answer": "string", "solution": "string", "code": "string", "files": "map<string,string>", "test_command": "array<string>", "tests_json": "string", "bad_tests": "int",
    "source_type": "string", "source_teacher": "string", "source_generated_at": "string", "source_json": "string", "metadata": "map<string,string>", "timeout_seconds": "int",
    "nulls": "array<string>", "bad": "array<string>",
}
#: Columns of a candidate that may be long; decisions are taken without carrying them.
LONG = ("instruction", "context", "expected_answer", "solution", "code", "files", "test_command", "tests_json", "source_json", "metadata")


def typed(df: DataFrame) -> DataFrame:
    """All columns of a candidate, those that are missing as nulls; further columns stay."""
    have = set(df.columns)
    return df.withColumns({c: (F.col(c) if c in have else F.lit(None)).cast(t) for c, t in CANDIDATE.items()})


def _listed(flag: str, name: str) -> Column:
    return F.coalesce(F.array_contains(flag, name), F.lit(False))


def _any(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _filled(name: str) -> Column:
    """Whether a field counts as given: not null and not empty."""
    if name in ("files", "test_command"):
        return F.coalesce(F.size(name), F.lit(0)) > 0
    if name == "tests_json":
        return F.coalesce(F.col(name), F.lit("[]")) != "[]"
    return F.coalesce(F.length(name), F.lit(0)) > 0


def _quoted(x: Column) -> Column:
    return F.coalesce(F.concat(F.lit("'"), x, F.lit("'")), F.lit("None"))


def _shown(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def validation_errors() -> Column:
    """The messages of all broken rules, in the order of the rules."""
    messages = [
        F.when(_listed("bad", "instruction") | is_blank(F.col("instruction")), "instruction is required and must be a non-empty string"),
        F.when(~F.coalesce(F.col("category").isin(*R.CATEGORIES), F.lit(False)), F.concat(F.lit(f"category must be one of {_shown(R.CATEGORIES)}, got "), _quoted(F.col("category")))),
        F.when(~F.coalesce(F.col("difficulty").isin(*R.DIFFICULTIES), F.lit(False)), F.concat(F.lit(f"difficulty must be one of {_shown(R.DIFFICULTIES)}, got "), _quoted(F.col("difficulty")))),
        F.when(_listed("bad", "language"), "language must be a string"),
        *[F.when(_listed("bad", c), f"{c} must be a string when present") for c in ("context", "expected_answer", "code")],
        F.when(_listed("bad", "files"), "files must be an object of string to string"),
        F.when(_listed("bad", "test_command"), "test_command must be a list of strings"),
        F.when(_listed("bad", "tests"), "tests must be a list"),
    ]
    later = [
        F.when(_listed("bad", "source"), "source must be an object").when(F.col("source_type").isNotNull() & ~F.col("source_type").isin(*R.SOURCES), f"source.type must be one of {_shown(R.SOURCES)}"),
        F.when(_listed("bad", "trajectory"), "trajectory must be an object when present"),
    ]
    tests = F.array_repeat(F.lit("tests entries must have 'input' and 'expected'"), F.coalesce("bad_tests", F.lit(0)))
    return F.concat(F.array_compact(F.array(*messages)), tests, F.array_compact(F.array(*later)))


def record_errors() -> Column:
    """Broken rules of a finished record with id, prompt, category, difficulty, status and source."""
    missing = [F.when(F.coalesce(F.length(c), F.lit(0)) == 0, f"record field '{c}' is required") for c in ("id", "prompt", "category", "difficulty")]
    among = lambda c, values, text: F.when(~F.coalesce(F.col(c).isin(*values), F.lit(False)), F.concat(F.lit(text), _quoted(F.col(c))))
    return F.array_compact(F.array(*missing, among("category", R.CATEGORIES, "record category invalid: "), among("difficulty", R.DIFFICULTIES, "record difficulty invalid: "),
                                   among("status", R.STATUSES, "verification.status invalid: "), among("source", R.SOURCES, "metadata.source invalid: ")))


def safety_corpus() -> Column:
    """Code, file contents and expected answer, a line break between them; the instruction isn't scanned."""
    return F.concat_ws("\n", F.col("code"), F.when(F.size("files") > 0, F.array_join(F.map_values("files"), "\n")), F.col("expected_answer"))


def pattern_labels(text: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    """Labels of the patterns that occur. Plain searches for what each match has in it decide for most texts that none does."""
    low = F.lower(text)
    may = {name: _any(*[low.contains(n) for n in R.NEEDLES[name]]) for name, _ in patterns}
    found = F.array_compact(F.array(*[F.when(may[name] & text.rlike(f"(?i){p}"), name) for name, p in patterns]))
    return F.when(_any(*may.values()), found).otherwise(F.array().cast("array<string>"))


def executable_decision() -> Column:
    executable = F.coalesce(F.col("category").isin(*R.EXECUTABLE), F.lit(False))
    supported = F.coalesce(F.col("language").isin(*R.LANGUAGES), F.lit(False))
    return F.when(~executable, "not_required").when(~(_filled("files") | _filled("code")), "no_code").when(~supported, "unsupported_language").otherwise("verify")


def verify_payload() -> Column:
    """What an executor gets: language, files, command and time limit."""
    main = F.when(F.col("language") == "python", "main.py").when(F.col("language") == "node", "main.js").when(F.col("language") == "typescript", "main.ts")
    files = F.when(_filled("files"), F.col("files")).otherwise(F.create_map(main, F.coalesce("code", F.lit(""))))
    tested = F.exists(F.map_keys(files), lambda k: k.contains("test"))
    words = lambda *w: F.array(*map(F.lit, w))
    default = (
        F.when(F.col("language") == "python", F.when(tested, words("python", "-m", "pytest", "-q")).otherwise(words("python", "-m", "py_compile", "main.py")))
        .when(F.col("language") == "node", F.when(tested, words("node", "--test")).otherwise(words("node", "--check", "main.js")))
        .when(F.col("language") == "typescript", F.when(tested, words("node", "--test")).otherwise(words("tsc", "--noEmit", "--skipLibCheck", "main.ts"))))
    command = F.when(_filled("test_command"), F.col("test_command")).otherwise(default)
    return F.struct(F.col("language").alias("language"), files.alias("files"), command.alias("command"), F.when(F.col("timeout_seconds") >= 1, F.col("timeout_seconds")).alias("timeout_seconds"))


def verification_reason(success: Column, timed_out: Column, stdout: Column, stderr: Column, error: Column) -> Column:
    """Why an executed candidate is rejected; null if it passed."""
    said = F.concat(F.coalesce(stderr, F.lit("")), F.coalesce(stdout, F.lit("")))
    return F.when(success, None).when(timed_out, "timeout").when(said.contains("not allowed"), "invalid_command").when(error.isNotNull(), "execution_failed").otherwise("tests_failed")


def score_dimensions(status: Column | None = None, timed_out: Column | None = None, unsafe: Column | None = None, indicators: Column | None = None, intended_reasoning: bool = False) -> dict[str, Column]:
    """The nine dimensions of the quality score. Without ``status`` there was no verification, without ``unsafe`` no scan."""
    executable = F.coalesce(F.col("category").isin(*R.EXECUTABLE), F.lit(False))
    given = reduce(lambda a, b: a + b, [_filled(c).cast("int") for c in ("instruction", "language", "category", "difficulty", "context", "expected_answer", "code", "tests_json")])
    text = F.coalesce("instruction", F.lit(""))
    given_answer = F.coalesce(F.nullif(F.col("expected_answer"), F.lit("")), F.col("solution"), F.lit(""))
    size, answer = F.length(strip(text)), F.length(strip(given_answer))
    low = F.lower(text)
    clarity = F.when(_any(*[low.contains(m) for m in ("lorem", "placeholder", "this is a test")]) | (size < 8), 20.0).when(size < 40, 60.0).when(size > 1200, 50.0).otherwise(90.0)
    verified = F.lit(0.0) if status is None else F.when(status == "passed", 100.0).when(status == "not_required", 80.0).when(F.coalesce(timed_out, F.lit(False)), 0.0).when(status.isNull(), 0.0).otherwise(20.0)
    reasoning = F.lit(50.0)  # the published rule spaces its text out, so that no marker can occur in it
    if intended_reasoning:
        hits = F.lit(0)
        said = F.lower(F.concat_ws(" ", text, F.coalesce("expected_answer", F.lit(""))))
        for m in R.REASONING_MARKERS:
            hits = hits + said.contains(m).cast("int")
        reasoning = F.when(hits >= 3, 100.0).when(hits == 2, 80.0).when(hits == 1, 60.0).otherwise(50.0)
    base = reduce(lambda a, kv: a.when(F.col("difficulty") == kv[0], float(kv[1])), R.DIFFICULTY_BASE.items(), F.when(F.lit(False), 0.0)).otherwise(60.0)
    return {
        "completeness": given * 12.5,
        "instruction_clarity": clarity,
        "answer_presence": F.when(answer == 0, 0.0).when(answer < 5, 40.0).otherwise(100.0),
        "code_presence": F.when(~executable | _filled("code") | _filled("files"), 100.0).otherwise(0.0),
        "test_presence": F.when(~executable | _filled("tests_json") | _filled("test_command"), 100.0).when(_filled("files"), 90.0).otherwise(0.0),
        "verification_result": F.when(~executable, 100.0).otherwise(verified),
        "difficulty": base,
        "reasoning_quality": reasoning,
        "security_indicator": F.lit(80.0) if unsafe is None else F.when(unsafe, 0.0).otherwise(F.greatest(90.0 - 40.0 * F.size(indicators), F.lit(10.0))),
    }


def score_total(dimensions: dict[str, Column]) -> Column:
    """The weighted sum to one decimal, halves to even. Weights are whole hundredths, so the sum is an exact decimal."""
    total = reduce(lambda a, b: a + b, [d.cast("decimal(6,2)") * F.lit(str(R.WEIGHTS[k])).cast("decimal(3,2)") for k, d in dimensions.items()])
    return F.bround(total.cast("double"), 1)


def _json_text(x: Column) -> Column:
    """Control characters as JSON writers with lower-case escapes have them."""
    fixed = x
    for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
        fixed = F.replace(fixed, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
    return F.when(x.contains("\\u00"), fixed).otherwise(x)


def _prose(c: str, normal: Column | None = None) -> Column:
    """Normalised prose of a field; an explicit null is the text none."""
    return F.when(_listed("nulls", c), "none").otherwise(normalize_prose(F.coalesce(c, F.lit(""))) if normal is None else normal)


def content_fingerprint(instruction: Column | None = None) -> Column:
    """SHA-256 of the canonical JSON of the ten fields that make up a candidate's content.

    ``instruction`` is its normalised prose, where that is at hand.
    """
    tidy = F.transform_values(F.coalesce("files", F.create_map().cast("map<string,string>")), lambda k, v: normalize_code(v))
    code = F.when(_listed("nulls", "code"), "None").otherwise(normalize_code(F.coalesce("code", F.lit(""))))
    fields = F.struct(
        F.coalesce("category", F.lit("")).alias("category"), code.alias("code"), _prose("context").alias("context"), F.coalesce("difficulty", F.lit("")).alias("difficulty"),
        _prose("expected_answer").alias("expected_answer"), F.map_from_entries(F.array_sort(F.map_entries(tidy))).alias("files"),
        _prose("instruction", instruction).alias("instruction"), F.when(~_listed("nulls", "language"), F.coalesce("language", F.lit(""))).alias("language"),
        F.coalesce("test_command", F.array().cast("array<string>")).alias("test_command"))
    json = F.to_json(fields, {"ignoreNullFields": "false"})
    return F.sha2(F.concat(_json_text(F.left(json, F.length(json) - 1)), F.lit(',"tests":'), F.coalesce("tests_json", F.lit("[]")), F.lit("}")), 256)


def instruction_fingerprint(instruction: Column | None = None) -> Column:
    fields = F.struct(F.coalesce("category", F.lit("")).alias("category"), F.coalesce("difficulty", F.lit("")).alias("difficulty"), _prose("instruction", instruction).alias("instruction"),
                      F.when(~_listed("nulls", "language"), F.coalesce("language", F.lit(""))).alias("language"))
    return F.sha2(_json_text(F.to_json(fields, {"ignoreNullFields": "false"})), 256)


def with_fingerprints(df: DataFrame) -> DataFrame:
    """Adds both hashes; the instruction is normalised once for them."""
    prose = df.withColumn("_prose", normalize_prose(F.coalesce("instruction", F.lit(""))))
    return prose.withColumns({"content_hash": content_fingerprint(F.col("_prose")), "instruction_hash": instruction_fingerprint(F.col("_prose"))}).drop("_prose")


def deduplicate(df: DataFrame, id_prefix: str = "record-", key: str = "instruction_hash") -> DataFrame:
    """Adds duplicate_type (null for rows that are kept) and duplicate_of. ``ord`` tells rows apart.

    The first row of each instruction is kept; a later one is an exact duplicate if its content is that of the kept row, else a
    near one. Equal contents have equal instructions, so this is what a scan that keeps first occurrences decides. ``key`` may
    name another column that tells the groups apart. ``df`` is computed once and held in the checkpoint folder: give it the
    columns that are needed, not whole texts. Groups are summed up before the shuffle; the join that flags later rows has plain
    exchanges on both sides, so that a hot instruction is split at run time.
    """
    df = cut_lineage(df)
    name = F.when(F.coalesce(F.length("id"), F.lit(0)) > 0, F.col("id")).otherwise(F.concat(F.lit(id_prefix), F.left("content_hash", F.lit(16))))
    first = df.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct("ord", name.alias("id"), "content_hash")).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    first = cut_lineage(first.select("_key", "_first"))
    own = df.select(F.col("ord").alias("_ord"), F.col(key).alias("_key"), F.col("content_hash").alias("_hash"))
    later = own.join(first, "_key").where(F.col("_ord") != F.col("_first.ord"))
    flags = later.select("_ord", F.when(F.col("_hash") == F.col("_first.content_hash"), "exact").otherwise("near_instruction").alias("duplicate_type"), F.col("_first.id").alias("duplicate_of"))
    return df.join(flags, df["ord"] == flags["_ord"], "left").drop("_ord")


_NO_RESULT = {"success": "boolean", "timed_out": "boolean", "exit_code": "int", "stdout": "string", "stderr": "string", "error": "string"}


def _ruled(candidates: DataFrame) -> DataFrame:
    """Candidates with errors, labels, indicators and decision."""
    df = typed(candidates).withColumn("errors", validation_errors())
    return df.withColumns({"labels": pattern_labels(safety_corpus(), R.UNSAFE), "indicators": pattern_labels(safety_corpus(), R.SUSPICIOUS), "decision": executable_decision()})


def _with_results(df: DataFrame, results: DataFrame | None) -> DataFrame:
    """Candidates with the results of an executor, and by ``_run`` why one failed, which is told from its outputs before the join:
    what is joined is shuffled, so drop long columns first where they are not needed."""
    if results is None:
        return df.withColumns({c: F.lit(None).cast(t) for c, t in _NO_RESULT.items()} | {"_run": F.lit(None).cast("string")})
    run = verification_reason(F.col("success"), F.col("timed_out"), F.col("stdout"), F.col("stderr"), F.col("error"))
    return df.join(results.select("id", *_NO_RESULT, run.alias("_run")), "id", "left")


def _outcome(needs: Column) -> Column:
    """The reason by which an executed candidate fails; one without a result fails the query."""
    lost = F.raise_error(F.concat(F.lit("no executor result for "), F.coalesce("id", F.lit("a candidate without id")))).cast("string")
    return F.when(needs, F.when(F.col("success").isNull(), lost).otherwise(F.col("_run")))


def decide(candidates: DataFrame, results: DataFrame | None = None, min_score: float = R.MIN_SCORE) -> DataFrame:
    """Every candidate, without its long columns, with the reason of its rejection, or its score, fingerprint and split.

    ``results`` has what an executor returned for candidates to be verified: id, success, exit_code, stdout, stderr,
    timed_out, error. The engine runs no code itself: a candidate that needs a result and has none fails the query.
    All rules and hashes are evaluated in one pass over the texts, before results are joined: no text is shuffled.
    """
    df = _ruled(candidates)
    early = F.when(F.size("errors") > 0, "malformed_record").when(F.size("labels") > 0, "unsafe_candidate").when(F.col("decision") == "unsupported_language", "unsupported_language")
    dims = score_dimensions(unsafe=F.size("labels") > 0, indicators=F.col("indicators"))
    df = with_fingerprints(df.withColumns({"early": early, "_dims": F.struct(*[v.alias(k) for k, v in dims.items()])}))
    df = _with_results(df.drop(*LONG, "raw"), results)
    df = df.withColumn("needs", F.col("early").isNull() & (F.col("decision") == "verify"))
    needs = F.col("needs")
    df = df.withColumn("early", F.coalesce("early", _outcome(needs)))
    df = df.withColumn("status", F.when(needs, F.when(F.col("success"), "passed").otherwise("failed")).otherwise("not_required")).drop("needs")
    # of the dimensions only this one depends on the results
    dims = {k: F.col(f"_dims.{k}") for k in dims} | {"verification_result": score_dimensions(F.col("status"), F.col("timed_out"))["verification_result"]}
    df = df.withColumn("score", F.when(F.col("early").isNull(), score_total(dims)))
    df = df.withColumn("early", F.coalesce("early", F.when(F.col("score") < min_score, "low_quality")))
    # what is rejected already is a group of its own: it shadows no later row
    own = F.coalesce(F.when(F.col("early").isNull(), F.col("instruction_hash")), F.concat(F.lit("rejected "), F.col("ord").cast("string")))
    narrow = df.withColumn("_group", own).drop("_dims", "_run", "stdout", "stderr")
    both = deduplicate(narrow, key="_group").drop("_group")
    shown = lambda c: F.when(F.col(c), "True").otherwise("False")
    both = both.withColumn("reason", F.coalesce("early", F.when(F.col("duplicate_type").isNotNull(), "duplicate")))
    detail = (
        F.when(F.col("reason") == "malformed_record", F.array_join("errors", "; "))
        .when(F.col("reason") == "unsafe_candidate", F.concat(F.lit("dangerous content: "), F.array_join("labels", ", ")))
        .when(F.col("reason") == "unsupported_language", F.concat(F.lit("language "), _quoted(F.col("language")), F.lit(f" is not supported by the sandbox ({_shown(R.LANGUAGES)})")))
        .when(F.col("reason") == "low_quality", F.concat(F.lit("score "), F.format_string("%.1f", "score"), F.lit(f" below threshold {min_score}")))
        .when(F.col("reason") == "duplicate", F.concat("duplicate_type", F.lit(" duplicate of "), "duplicate_of"))
        .when(F.col("reason").isNotNull(), F.concat(F.lit("exit_code="), F.col("exit_code").cast("string"), F.lit(" timed_out="), shown("timed_out"))))
    return both.withColumns({"detail": detail, "split": F.when(F.col("reason").isNull(), assign_split(F.col("content_hash")))}).drop("early")


def curate(candidates: DataFrame, results: DataFrame | None = None, min_score: float = R.MIN_SCORE) -> DataFrame:
    """``decide`` with the long columns of the candidates, for exports. ``ord`` tells the candidates apart."""
    decided = decide(candidates, results, min_score)
    texts = typed(candidates).select(F.col("ord").alias("_ord"), *LONG)
    return decided.join(texts, decided["ord"] == texts["_ord"], "left").drop("_ord")


def verify_stage(candidates: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """The verification stage on its own: reason, detail and status of each candidate.

    Unlike the full run it scans for nothing unsafe and accepts languages that can't be run; failures have one fixed detail.
    """
    df = _with_results(_ruled(candidates), results)
    valid = F.size("errors") == 0
    needs = valid & (F.col("decision") == "verify")
    reason = F.coalesce(F.when(~valid, "malformed_record"), _outcome(needs))
    df = df.withColumns({"reason": reason, "status": F.when(needs, F.when(F.col("success"), "passed").otherwise("failed")).when(valid, "not_required")})
    return df.drop("_run").withColumn("detail", F.when(~valid, F.array_join("errors", "; ")).when(F.col("reason").isNotNull(), "verification failed"))


def score_stage(candidates: DataFrame, min_score: float = R.MIN_SCORE) -> DataFrame:
    """The scoring stage on its own: dimensions, total and whether it reaches the threshold, without validation.

    Nothing was verified; only candidates without code count as not in need of it, whatever files they have.
    """
    df = typed(candidates).withColumns({"labels": pattern_labels(safety_corpus(), R.UNSAFE), "indicators": pattern_labels(safety_corpus(), R.SUSPICIOUS)})
    status = F.when(~_filled("code"), "not_required")
    dims = score_dimensions(status, F.lit(False), F.size("labels") > 0, F.col("indicators"))
    total = score_total(dims)
    return df.withColumns({"dimensions": F.struct(*[d.cast("double").alias(k) for k, d in dims.items()]), "total": total}).withColumn("passes", F.col("total") >= min_score)


def export_stage(candidates: DataFrame, created_at: str, id_prefix: str = "record-") -> DataFrame:
    """The export stage on its own: a record for every candidate, without validation or deduplication, so leakage is possible."""
    df = with_fingerprints(typed(candidates)).withColumns({"reason": F.lit(None).cast("string"), "status": F.lit("not_required")})
    return export_records(df.withColumn("split", assign_split(F.col("content_hash"))), created_at, id_prefix)


def dataset_counts(records: DataFrame) -> DataFrame:
    """One row: records, different fingerprints, and the sizes of the three splits."""
    fp = F.col("metadata.fingerprint")
    return records.agg(F.count(F.lit(1)).alias("records"), F.count_distinct(fp).alias("unique_fingerprints"), *[F.count_if(F.col("split") == s).alias(s) for s in R.SPLITS])


def candidate_rows(rows: DataFrame, unnamed: str = "seed-unknown", note: str | None = None) -> DataFrame:
    """Candidates from rows that give some fields only: the others get the defaults of hand-written seeds.

    A row with ``test_code`` is executable: its code and tests become files with the standard test command. ``language`` is
    python unless given; give the empty text for prose.
    """
    have = set(rows.columns)
    given = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in have else F.lit(default)
    df = rows.withColumns({"id": given("id", unnamed), "category": given("category", "coding"), "difficulty": given("difficulty", "medium"), "language": given("language", "python"), "source_type": given("source_type", "human"),
                           "source_json": F.lit('{"type":"human","license":"MIT"}'), "metadata": F.map_filter(F.create_map(F.lit("license"), F.lit("MIT"), F.lit("notes"), given("notes", note)), lambda k, v: v.isNotNull())})
    if "test_code" in have:
        tested = F.col("test_code").isNotNull()
        df = df.withColumns({"files": F.when(tested, F.create_map(F.lit("main.py"), F.col("code"), F.lit("test_main.py"), F.col("test_code"))),
                             "tests_json": F.when(tested, '[{"input":"python -m pytest -q","expected":"all tests pass"}]'), "test_command": F.when(tested, F.array(*map(F.lit, ("python", "-m", "pytest", "-q"))))}).drop("test_code")
    return typed(df)


def export_records(curated: DataFrame, created_at: str, id_prefix: str = "record-") -> DataFrame:
    """Training records of what was kept, one struct of JSON-ready fields a row; fields without a value are null.

    ``tests`` and the source of synthetic rows are variants, as nested as they came; metadata keeps its own date if it has one.
    """
    text = lambda c: F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.col(c))
    meta = lambda k: F.nullif(F.get(F.map_values(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda a, b: a == k)), F.lit(0)), F.lit(""))
    more = F.map_filter("metadata", lambda k, v: ~k.isin("license", "notes", "source", "created_at"))
    made = text("source_teacher").isNotNull() | (F.col("source_type") == "synthetic") | F.coalesce(F.try_variant_get(F.try_parse_json("source_json"), "$.provenance", "variant").isNotNull(), F.lit(False))
    origin = F.coalesce(F.try_parse_json("source_json"), F.try_parse_json(F.to_json(F.struct(F.col("source_type").alias("type"), F.col("source_teacher").alias("teacher")))))
    metadata = F.struct(meta("license").alias("license"), meta("notes").alias("notes"), F.coalesce(text("source_type"), meta("source"), F.lit("human")).alias("source"),
                        F.coalesce(meta("created_at"), text("source_generated_at"), meta("generated_at"), F.lit(created_at)).alias("created_at"),
                        F.when(made, origin).alias("provenance"), F.col("content_hash").alias("fingerprint"), F.when(F.size(more) > 0, more).alias("other"))
    return curated.where("reason is null").select(
        F.coalesce(text("id"), F.concat(F.lit(id_prefix), F.left("content_hash", F.lit(16)))).alias("id"), "category", "difficulty", "language", F.col("instruction").alias("prompt"),
        text("context").alias("context"), F.coalesce(text("solution"), text("expected_answer")).alias("solution"), text("code").alias("code"), F.when(F.size("files") > 0, F.col("files")).alias("files"),
        F.when(_filled("tests_json"), F.try_parse_json("tests_json")).alias("tests"), F.when(F.size("test_command") > 0, F.col("test_command")).alias("test_command"),
        F.struct((F.col("status") != "not_required").alias("required"), F.col("status").alias("status")).alias("verification"), metadata.alias("metadata"), "split")


def manifest_counts(curated: DataFrame) -> DataFrame:
    """(dimension, key, n) of what was kept by category, language, difficulty, status and split, and of the reasons, in one pass."""
    kept = F.col("reason").isNull()
    language = F.when(F.coalesce(F.length("language"), F.lit(0)) == 0, "(none)").otherwise(F.col("language"))
    parts = {"category": F.when(kept, F.col("category")), "language": F.when(kept, language), "difficulty": F.when(kept, F.col("difficulty")), "status": F.when(kept, F.col("status")), "split": F.col("split"), "reason": F.col("reason")}
    pairs = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("dimension"), v.alias("key"))) for k, v in parts.items()]))
    return curated.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.key").agg(F.count(F.lit(1)).alias("n"))


def manifest_totals(curated: DataFrame) -> DataFrame:
    """One row of totals, with the leakage check over all splits."""
    is_ = lambda r: F.count_if(F.coalesce(F.col("reason") == r, F.lit(False)))
    kept = F.when(F.col("reason").isNull(), F.col("content_hash"))
    return curated.agg(
        F.count(F.lit(1)).alias("total_candidates"), is_("malformed_record").alias("malformed_count"), is_("unsafe_candidate").alias("unsafe_count"), F.count_if(F.col("reason").isNull()).alias("verified_count"),
        F.count_if(F.col("reason").isNotNull()).alias("rejected_count"), is_("duplicate").alias("duplicate_count"), F.least(F.lit(100.0), F.min("score")).alias("lowest_score"),
        F.count(kept).alias("total_fingerprints"), F.count_distinct(kept).alias("distinct_fingerprints"), (F.count(kept) == F.count_distinct(kept)).alias("leakage_passed"))


def fold_rows(rows: DataFrame, salt: str = "fold-v1") -> DataFrame:
    """Distilled rows without empty or repeated (prompt, completion), first kept, with the fold of their task."""
    full = rows.where(F.coalesce(F.length("completion"), F.lit(0)) > 0)
    nth = F.row_number().over(Window.partitionBy(F.sha2(F.concat(F.coalesce("prompt", F.lit("")), F.lit("\x00"), "completion"), 256)).orderBy("ord"))
    return full.withColumn("_nth", nth).where("_nth = 1").drop("_nth").withColumn("fold", assign_fold(F.coalesce(F.col("id"), F.lit("")), salt))
