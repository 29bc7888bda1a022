"""Scans: JSON lines with file context, candidates as VARIANT, tasks, reports, repositories and memory files.

Listing and existence checks go through Hadoop's file system API, so any store that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.curation import typed
from ..operators.repository import index_files


def _status(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(p) if fs.exists(p) else None


def read_jsonl(spark: SparkSession, paths: str | list[str], quarantine: bool = False) -> DataFrame:
    """(ord, path, line, v) of JSON lines; blank ones are skipped. ``ord`` follows path and line.

    A broken line fails the query with its path and line number; with ``quarantine`` its ``v`` is null and ``raw`` holds it. Files are
    read in blocks. Lines are numbered by the sizes of the blocks before theirs, which takes a row for each block in one task.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = None
    for i, p in enumerate(paths):
        status = _status(spark, p)
        one = spark.read.text(p, pathGlobFilter="*.jsonl" if status is not None and status.isDirectory() else None)
        one = one.select(F.lit(i).alias("rank"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value"))
        files = one if files is None else files.unionByName(one)
    keys = ["rank", "path", "block"]
    blocks = files.groupBy(*keys).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = lambda *by: Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.select(*keys, "first", F.coalesce(F.sum("n").over(before(F.lit(0))), F.lit(0)).alias("base"), F.coalesce(F.sum("n").over(before("rank", "path")), F.lit(0)).alias("above"))
    lines = files.join(placed, keys).select("path", (F.col("at") - F.col("first") + 1).alias("nth"), "base", "above", strip(F.col("value")).alias("raw")).where("raw <> ''")
    lines = lines.select((F.col("base") + F.col("nth")).alias("ord"), "path", (F.col("above") + F.col("nth")).alias("line"), "raw")
    v = F.try_parse_json("raw")
    if not quarantine:
        fail = F.raise_error(F.concat(F.lit("bad JSON in "), "path", F.lit(":"), F.col("line").cast("string")))
        v = F.coalesce(v, F.parse_json(F.when(v.isNull(), fail.cast("string")).otherwise(F.col("raw"))))
    return lines.select("ord", "path", "line", v.alias("v"), *(["raw"] if quarantine else []))


def candidates(lines: DataFrame) -> DataFrame:
    """The typed columns of candidates from (ord, v), what was null explicitly, and what had another type."""
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    raw = lambda path: F.try_variant_get("v", path, "variant")
    kind = lambda path: F.schema_of_variant(raw(path))
    there = lambda path: raw(path).isNotNull() & (kind(path) != "VOID")
    text = lambda path: F.when(kind(path) == "STRING", get(path))
    names = ("instruction", "category", "difficulty", "language", "context", "expected_answer", "code", "files", "tests", "test_command", "source", "trajectory")
    bad_text = [F.when(there(f"$.{c}") & (kind(f"$.{c}") != "STRING"), c) for c in ("instruction", "language", "context", "expected_answer", "code")]
    files, command, tests = get("$.files", "map<string,variant>"), get("$.test_command", "array<variant>"), get("$.tests", "array<variant>")
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    bad = F.array_compact(F.array(
        *bad_text,
        F.when(there("$.files") & (files.isNull() | ~F.forall(F.map_values(files), is_text)), "files"),
        F.when(there("$.test_command") & (command.isNull() | ~F.forall(command, is_text)), "test_command"),
        F.when(there("$.tests") & tests.isNull(), "tests"),
        F.when(there("$.source") & ~kind("$.source").startswith("OBJECT") & ~F.coalesce(F.to_json(raw("$.source")), F.lit("")).isin('""', "[]", "0", "false"), "source"),
        F.when(there("$.trajectory") & ~kind("$.trajectory").startswith("OBJECT"), "trajectory")))
    whole = lambda v: F.schema_of_variant(v).startswith("OBJECT") & F.try_variant_get(v, "$.input", "variant").isNotNull() & F.try_variant_get(v, "$.expected", "variant").isNotNull()
    nulls = F.array_compact(F.array(*[F.when(raw(f"$.{c}").isNotNull() & (kind(f"$.{c}") == "VOID"), c) for c in names]))
    return typed(lines.select(
        "ord", get("$.id").alias("id"), *[text(f"$.{c}").alias(c) for c in ("instruction", "category", "difficulty", "language", "context", "expected_answer", "solution", "code")],
        get("$.files", "map<string,string>").alias("files"), get("$.test_command", "array<string>").alias("test_command"), F.when(there("$.tests"), F.to_json(raw("$.tests"))).alias("tests_json"),
        F.size(F.filter(tests, lambda t: ~F.coalesce(whole(t), F.lit(False)))).alias("bad_tests"), text("$.source.type").alias("source_type"), text("$.source.teacher").alias("source_teacher"),
        text("$.source.generated_at").alias("source_generated_at"), F.when(there("$.source"), F.to_json(raw("$.source"))).alias("source_json"), get("$.metadata", "map<string,string>").alias("metadata"), get("$.timeout_seconds", "int").alias("timeout_seconds"), nulls.alias("nulls"), bad.alias("bad"), F.col("v").alias("raw"))
        .withColumn("bad_tests", F.greatest("bad_tests", F.lit(0))))


def load_candidates(spark: SparkSession, dirs: list[str], missing_ok: bool = True) -> DataFrame:
    """Candidates of all ``*.jsonl`` files of the directories (or of files), in the given order, then by name and line."""
    found = [d for d in dirs if _status(spark, d) is not None]
    if not missing_ok and len(found) < len(dirs):
        raise FileNotFoundError(f"no such file or directory: {sorted(set(dirs) - set(found))}")
    if not found:
        return typed(spark.createDataFrame([], "ord bigint, id string"))
    return candidates(read_jsonl(spark, found))


def read_tasks(spark: SparkSession, path: str, source: str = "baseline") -> DataFrame:
    """Tasks of one JSON array."""
    schema = "id string, category string, difficulty string, prompt string, rubric array<string>, rubric_min int"
    return spark.read.json(path, schema=schema, multiLine=True).withColumn("source", F.lit(source))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The results of a report: a file, or a directory with report.json. A report without results fails the query."""
    status = _status(spark, path)
    if status is not None and status.isDirectory():
        path, status = f"{path}/report.json", _status(spark, f"{path}/report.json")
    if status is None:
        raise FileNotFoundError(path)
    result = "array<struct<id:string,category:string,difficulty:string,language:string,source:string,output:string,tokens:bigint,elapsed_s:double,pass:boolean>>"
    one = spark.read.json(path, schema=f"results {result}", multiLine=True)
    rows = F.when(F.col("results").isNull(), F.raise_error(F.lit("a report must have a list of results")).cast(result)).otherwise(F.col("results"))
    return one.select(F.posexplode(rows).alias("ord", "r")).select("ord", "r.*")


def read_repository(spark: SparkSession, root: str) -> DataFrame:
    """The index of a directory tree, by relative path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    relative = F.substring_index(F.col("path"), base, -1)
    return index_files(files.select(relative.alias("path"), "content"))


def read_text_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(file, text) of whole text files under a directory; files that can't be read or aren't UTF-8 are passed over."""
    if _status(spark, root) is None:
        return spark.createDataFrame([], "file string, text string")
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=glob, ignoreCorruptFiles=True).load(root)
    return files.where(F.is_valid_utf8(F.col("content").cast("string"))).select(F.col("path").alias("file"), F.col("content").cast("string").alias("text"))


def stub_candidates(spark: SparkSession, tasks: DataFrame) -> DataFrame:
    """A deterministic generator of synthetic candidates from (ord, task), with their provenance."""
    return typed(tasks.select("ord", F.format_string("stub-synthetic-%05d", "ord").alias("id"), F.concat(F.lit("Explain the following topic clearly: "), "task").alias("instruction"), F.lit("reasoning").alias("category"),
                              F.lit("easy").alias("difficulty"), F.concat(F.lit("A short explanation of "), "task", F.lit(".")).alias("expected_answer"), F.lit("synthetic").alias("source_type"), F.lit("stub").alias("source_teacher")))


def generate_with(tasks: DataFrame, generate, schema: str, teacher: str) -> DataFrame:
    """Rows that an injected function makes of each task; anything but a dict fails the query. The teacher is stamped on."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            made = [generate(t) for t in frame["task"]]
            if wrong := [type(m).__name__ for m in made if not isinstance(m, dict)]:
                raise TypeError(f"a teacher must return dicts, not {wrong[0]}")
            yield pd.DataFrame(made)

    return tasks.select("task").mapInPandas(run, schema).withColumns({"source_type": F.lit("synthetic"), "source_teacher": F.lit(teacher)})


def execute_with(payloads: DataFrame, execute) -> DataFrame:
    """Results of an injected executor for (id, payload); an exception of it fails the query. Filter the payloads first."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            got = [execute(p) for p in frame["payload"]]
            yield pd.DataFrame({"id": frame["id"], "success": [bool(g.get("success")) for g in got], "exit_code": [int(g.get("exit_code", -1)) for g in got], "stdout": [str(g.get("stdout", "")) for g in got],
                                "stderr": [str(g.get("stderr", "")) for g in got], "timed_out": [bool(g.get("timed_out")) for g in got], "error": [g.get("error") for g in got]})

    return payloads.select("id", F.to_json("payload").alias("payload")).mapInPandas(run, "id string, success boolean, exit_code int, stdout string, stderr string, timed_out boolean, error string")
