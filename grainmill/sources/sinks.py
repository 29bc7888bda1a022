"""Sinks: JSON lines, partitioned exports, manifests, reports and a small key-value store."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.rules import SPLITS
from ..lineage import cut_lineage
from ..operators.distill import row_counts
from ..operators.evaluation import compare, summarize, verdict
from ..operators.suite import report_line
from .files import write_file_set, write_joined
from .readers import read_report


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line; nulls are left out, characters beyond ASCII stay as they are."""
    df.write.mode(mode).json(path)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, parts: str | Iterable[str]) -> str:
    """One text file, written piece by piece through Hadoop's file system API, so that any store will do."""
    fs, p = _path(spark, path)
    out = fs.create(p, True)
    try:
        for part in [parts] if isinstance(parts, str) else parts:
            out.write(bytearray(part.encode("utf-8")))
    finally:
        out.close()
    return path


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def write_by(df: DataFrame, path: str, column: str, keep_others: bool = False, always: tuple[str, ...] = ()) -> None:
    """A folder of JSON lines for each value of a column. ``keep_others`` leaves the folders of values absent from this run;
    those of ``always`` exist even when they are empty."""
    writer = df.write.mode("overwrite").partitionBy(column)
    (writer.option("partitionOverwriteMode", "dynamic") if keep_others else writer).json(path)
    for value in always:
        if not _exists(df.sparkSession, f"{path}/{column}={value}"):
            write_text(df.sparkSession, f"{path}/{column}={value}/part-00000-empty.json", "")


def write_splits(records: DataFrame, path: str) -> None:
    """Training records: all of them under ``verified``, if there are any, and each split, empty or not, under ``splits/part=``.

    What was exported before is replaced. Records are computed once, for ``verified``; the splits are dealt from there.
    """
    spark, whole = records.sparkSession, f"{path}/verified"
    records.withColumn("part", F.col("split")).write.mode("overwrite").json(whole)
    schema = StructType([*records.schema.fields, StructField("part", StringType())])
    written = spark.read.schema(schema).json(whole)
    write_by(written, f"{path}/splits", "part", always=SPLITS)
    if written.isEmpty():
        fs, p = _path(spark, whole)
        fs.delete(p, True)


def write_folds(rows: DataFrame, path: str) -> None:
    """Prompts and completions by fold, of which each exists even when it is empty."""
    write_by(rows.select("prompt", "completion", "fold"), path, "fold", always=SPLITS)


def _candidate() -> Column:
    return F.struct("id", "instruction", "category", "difficulty", "language").alias("candidate")


def write_rejected(curated: DataFrame, path: str, rejected_at: str, keep_others: bool = False) -> None:
    gone = curated.where("reason is not null").select(_candidate(), "reason", "detail", F.lit(rejected_at).alias("rejected_at"))
    write_by(gone, path, "reason", keep_others)


def write_stage_rejected(checked: DataFrame, path: str, rejected_at: str) -> None:
    """All that the verification stage rejects, as one set of JSON lines."""
    write_jsonl(checked.where("reason is not null").select(_candidate(), "reason", "detail", F.lit(rejected_at).alias("rejected_at")), path)


def write_deduplicated(flagged: DataFrame, kept: str, duplicates: str | None = None) -> None:
    """What ``deduplicate`` keeps, and each duplicate with its kind, the record it repeats and its fingerprint."""
    own = [c for c in flagged.columns if c not in ("duplicate_type", "duplicate_of", "content_hash", "instruction_hash")]
    write_jsonl(flagged.where("duplicate_type is null").select(*own), kept)
    if duplicates:
        write_jsonl(flagged.where("duplicate_type is not null").select(F.struct(*own).alias("candidate"), "duplicate_type", "duplicate_of", F.col("content_hash").alias("fingerprint")), duplicates)


def write_scored(scored: DataFrame, path: str) -> None:
    write_jsonl(scored.select(_candidate(), F.struct("total", "dimensions").alias("score")), path)


def teacher_stats(rows: DataFrame, tasks: DataFrame, about: dict, per_task: bool = True) -> dict:
    """Statistics of a distillation: counts of its rows and of each task's samples. ``about`` holds the settings of the run.
    ``per_task`` brings an entry for each task to the driver."""
    counts = {(r["dimension"], r["key"]): r["n"] for r in row_counts(rows).collect()}  # a row for each reason and category
    out = dict(about) | {"rows_total": counts.get(("all", "all"), 0), "rows_distilled": counts.get(("reason", "distilled"), 0), "rows_gold": counts.get(("reason", "gold"), 0)}
    out["rows_by_category"] = {k: n for (d, k), n in sorted(counts.items(), key=str) if d == "category"}
    if per_task:
        out["per_task"] = {r["id"]: {"category": r["category"], "type": r["type"], "samples": r["samples"], "passed": r["passed"]} for r in tasks.orderBy("id").toLocalIterator()}
    return out


def write_teacher(rows: DataFrame, tasks: DataFrame, path: str, about: dict, per_task: bool = True) -> dict:
    """Training rows as JSON lines, and their statistics next to them, each task's entry written by executors. Returns the
    statistics; without ``per_task`` only their totals, so that no task passes the driver."""
    write_jsonl(rows, f"{path}/rows")
    held = cut_lineage(tasks.select("id", "category", "type", "samples", "passed"))
    stats = teacher_stats(rows, held, about, per_task)
    head = json.dumps({k: v for k, v in stats.items() if k != "per_task"}, indent=2, ensure_ascii=False)[:-2]
    key = F.regexp_extract(F.to_json(F.struct("id")), "(?s)^.\"id\":(.*).$", 1)
    entry = F.to_json(F.struct("category", "type", "samples", "passed"), {"ignoreNullFields": "false"})
    write_joined(held.select("id", F.concat(key, F.lit(": "), entry).alias("line")), ["id"], f"{path}/stats.json", head + ',\n  "per_task": {\n', "  }\n}\n", ",")
    return stats


def summary(results: DataFrame) -> dict:
    """Counts of a run as a dict, with rates to two decimals."""
    out: dict = {"total": 0, "passed": 0, "failed": 0, "unscored": 0, "by_category": {}, "by_source": {}}
    for r in summarize(results).orderBy("dimension", "key").collect():  # a row for each category and source
        counts = {k: r[k] for k in ("total", "passed", "failed")}
        if r["dimension"] == "all":
            out |= counts | {"unscored": r["unscored"]}
        else:
            out[f"by_{r['dimension']}"][r["key"]] = counts | {"pass_rate": round(r["passed"] / r["total"], 2)}
    return out


def summary_markdown(found: dict, meta: dict, lines: Iterable[str], title: str = "Benchmark") -> Iterator[str]:
    yield f"# {title}\n\n" + "".join(f"- {k}: {v}\n" for k, v in meta.items())
    yield f"- total: {found['total']} | passed: {found['passed']} | failed: {found['failed']} | unscored: {found['unscored']}\n\n## By category\n\n| category | total | passed | failed | pass rate |\n| --- | ---: | ---: | ---: | ---: |\n"
    for name, c in sorted(found["by_category"].items()):
        yield f"| {name} | {c['total']} | {c['passed']} | {c['failed']} | {c['pass_rate']} |\n"
    yield "\n## Tasks\n\n"
    yield from (line + "\n" for line in lines)


def write_report(results: DataFrame, path: str, meta: dict, title: str = "Benchmark") -> dict:
    """A benchmark's report.json, summary.md and the output of each task, under ``path``; returns the summary.

    ``results`` has ord, id, category, source, type, output, pass, missed and error, and further columns of its own. All three are
    written by executors; only the summary, a row for each category and source, passes the driver. Of results with one id the last
    one's output stays. An id that can't name a file fails the report before anything is written.
    """
    rows = cut_lineage(report_line(results))
    found, own = summary(rows.select(*results.columns)), [c for c in results.columns if c != "ord"]
    last = F.max(F.struct("ord", F.coalesce("output", F.lit("")).alias("content"))).alias("last")
    write_file_set(rows.groupBy("id").agg(last).select(F.col("id").alias("_id"), "last.content").select(_file_name(F.col("_id")).alias("name"), "content"), f"{path}/outputs")
    lines = rows.select("ord", "id", F.to_json(F.struct(*own), {"ignoreNullFields": "false"}).alias("line"))
    write_joined(lines, ["ord", "id", "line"], f"{path}/report.json", json.dumps({"meta": meta, "summary": found}, ensure_ascii=False)[:-1] + ', "results": [\n', "]}\n", ",")
    write_joined(rows.select("ord", "id", "line"), ["ord", "id", "line"], f"{path}/summary.md", "".join(summary_markdown(found, meta, (), title)))
    return found


def _file_name(task: Column) -> Column:
    bad = task.isNull() | task.isin("", ".", "..") | task.contains("/")
    return F.when(bad, F.raise_error(F.concat(F.lit("the id of a task can't name a file: "), F.coalesce(task, F.lit("null")))).cast("string")).otherwise(F.concat(task, F.lit(".txt")))


def manifest(totals: DataFrame, counts: DataFrame, version: str, generated_at: str, **versions: str) -> dict:
    """The manifest as a dict: one row of totals and the few rows of counts. ``versions`` are further ones, of schema and engine."""
    one = totals.first().asDict()
    out = {"dataset_version": version, **versions, "generated_at": generated_at, **{k: one[k] for k in ("total_candidates", "malformed_count", "unsafe_count", "verified_count", "rejected_count", "duplicate_count")}}
    for name in ("category", "language", "difficulty", "split"):
        out[f"counts_by_{name}"] = {}
    out |= {"counts_by_split": dict.fromkeys(SPLITS, 0), "rejection_reasons": {}, "verification_statistics": {}}
    names = {"reason": "rejection_reasons", "status": "verification_statistics"}
    for r in counts.orderBy("dimension", "key").collect():  # as many rows as there are categories, languages and the like
        out[names.get(r["dimension"], f"counts_by_{r['dimension']}")][r["key"]] = r["n"]
    return out | {"split_leakage_check": {"passed": one["leakage_passed"], "distinct_fingerprints": one["distinct_fingerprints"], "total_fingerprints": one["total_fingerprints"]}}


def write_manifest(spark: SparkSession, content: dict, path: str) -> str:
    """The manifest under the name of its version and time, and once more as the latest; returns the former's path."""
    text = json.dumps(content, indent=2, ensure_ascii=False) + "\n"
    stamp = content["generated_at"].replace(":", "-")
    write_text(spark, f"{path}/manifest_latest.json", text)
    return write_text(spark, f"{path}/manifest_v{content['dataset_version']}_{stamp}.json", text)


def write_index(index: DataFrame, path: str, root: str, generated_at: str) -> None:
    """A repository index as JSON lines, with a header that counts its files."""
    write_jsonl(index.orderBy("path"), f"{path}/files")
    write_text(index.sparkSession, f"{path}/repository.json", json.dumps({"generated_at": generated_at, "root": root, "file_count": index.count()}))


def gate_markdown(verdict: DataFrame, compared: DataFrame) -> str:
    """A report of the gate: a row for each category."""
    one = verdict.first()
    share = lambda x, sign="": "—" if x is None else f"{x:{sign}.0%}"
    delta = "n/a" if one["overall_delta"] is None else f"{one['overall_delta']:+.2%}"
    lines = ["# Evaluation gate", "", f"- result: **{'PASS' if one['passed'] else 'FAIL'}**", f"- overall delta: {delta}", "", "| category | baseline | candidate | delta | scored |", "| --- | ---: | ---: | ---: | ---: |"]
    lines += [f"| {r['category']} | {share(r['base_rate'])} | {share(r['cand_rate'])} | {share(r['delta'], '+')} | {r['cand_scored'] or 0} |" for r in compared.orderBy("category").collect()]
    reasons = one["reason_list"]
    return "\n".join(lines + (["", "## Failures", "", *[f"- {r}" for r in reasons]] if reasons else [])) + "\n"


def gate_json(verdict: DataFrame, compared: DataFrame) -> str:
    one = verdict.first()
    categories = {r["category"]: {"baseline": r["base_rate"], "candidate": r["cand_rate"], "delta": r["delta"], "scored": r["cand_scored"] or 0} for r in compared.orderBy("category").collect()}
    return json.dumps({"passed": one["passed"], "overall_delta": one["overall_delta"], "reasons": one["reason_list"], "categories": categories}, indent=2)


def exit_code(verdict: DataFrame) -> int:
    return 0 if verdict.first()["passed"] else 1


def run_gate(spark: SparkSession, baseline: str, candidate: str, min_delta: float = 0.0, max_drop: float = 0.0, as_json: bool = False, write: str | None = None) -> tuple[int, str]:
    """The gate over two reports: exit code 0 for a pass, 1 for a failure and 2 if a report can't be read, and what to print."""
    try:
        compared = compare(*[read_report(spark, p) for p in (baseline, candidate)])
        decided = cut_lineage(verdict(compared, min_delta, max_drop))
    except (FileNotFoundError, PySparkException) as e:
        return 2, f"gate error: {e}"
    if write:
        write_text(spark, write, gate_markdown(decided, compared))
    return exit_code(decided), gate_json(decided, compared) if as_json else gate_markdown(decided, compared)


def upsert(store: DataFrame, changes: DataFrame) -> DataFrame:
    """A key-value table (namespace, key, updated_at, value) after changes: the newest value of each key, of equally new ones the
    greatest. ``store.save_values`` writes such a table back."""
    newest = F.max(F.struct("updated_at", "value"))
    return store.unionByName(changes).groupBy("namespace", "key").agg(newest.alias("n")).select("namespace", "key", "n.updated_at", "n.value")
