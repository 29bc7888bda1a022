"""Generated code: file outputs, static checks and plans. Automata without a regular form run as Arrow-batched functions."""

from __future__ import annotations

import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import is_blank, strip
from .evaluation import last_match


def strip_fences(text: Column) -> Column:
    """The last fenced block, or all of the text, without line breaks at its ends."""
    return F.regexp_replace(F.coalesce(last_match(text, r"(?s)```[a-zA-Z0-9_+-]*\s*\n(.*?)```"), text), r"^\n+|\n+$", "")


def clean_file_output(text: Column) -> Column:
    """File contents without fences and without a leading line that only names the file, if something follows it."""
    content = strip_fences(text)
    first = F.regexp_replace(F.split(content, "\n")[0], r"^[\s`*_]+|[\s`*_]+$", "")
    rest = F.regexp_replace(F.regexp_extract(content, r"(?s)^[^\n]*\n(.*)$", 1), r"^\n+", "")
    return F.when(first.rlike(r"^[\w./-]+\.(?:[a-zA-Z0-9]{1,8})(?::)?$") & ~is_blank(rest), rest).otherwise(content)


def normalize_path(path: Column) -> Column:
    """A relative path that a build may write, null if it may not."""
    x = F.replace(F.regexp_replace(strip(path), "^[`\"']+|[`\"']+$", ""), F.lit("\\"), F.lit("/"))
    x = F.regexp_replace(F.regexp_replace(x, r"^(\./)+", ""), "^/+", "")
    parts = F.filter(F.split(x, "/"), lambda p: ~p.isin("", "."))
    clean = F.array_join(parts, "/")
    name = F.lower(F.try_element_at(parts, F.lit(-1)))
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return F.when((F.size(parts) > 0) & ~F.array_contains(parts, "..") & (suffix.isin(*R.WRITABLE) | name.isin(*R.WRITABLE_NAMES)), clean)


_PAIRS = {")": "(", "]": "[", "}": "{"}
_CODE = re.compile(r"//|/\*|[\"'`#()\[\]{}]")
_STRING_END = {q: re.compile(rf"(?:[^\\{q}]|\\.)*(?:{q}|\\?\Z)", re.S) for q in "\"'`"}


def balanced(code: str | None) -> bool:
    """Whether brackets outside strings and comments match.

    A quote after a letter or digit is an apostrophe; a hash begins a comment at the start or after a blank.
    """
    code, at, open_ = code or "", 0, []
    while m := _CODE.search(code, at):
        token, start, at = m.group(), m.start(), m.end()
        before = code[start - 1 : start]
        if token == "//" or token == "#" and not before.strip(" \t"):
            line = code.find("\n", at)
            at = len(code) if line < 0 else line + 1
        elif token == "/*":
            stop = code.find("*/", at)
            at = len(code) if stop < 0 else stop + 2
        elif token in _STRING_END and not (token == "'" and before.isalnum()):
            at = _STRING_END[token].match(code, at).end()
        elif token in "([{":
            open_.append(token)
        elif token in _PAIRS and (not open_ or open_.pop() != _PAIRS[token]):
            return False
    return not open_


def json_object(text: str | None) -> str | None:
    """The first JSON object in a text, as canonical JSON."""
    decode = json.JSONDecoder().raw_decode
    at = (text or "").find("{")
    while at >= 0:
        try:
            found, _ = decode(text, at)
            return json.dumps(found, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (json.JSONDecodeError, RecursionError):
            at = text.find("{", at + 1)
    return None


def bracket_balance(code: Column | str) -> Column:
    def run(code: pd.Series) -> pd.Series:
        return code.map(balanced)

    return F.pandas_udf(run, "boolean")(code)


def extract_json(text: Column | str) -> Column:
    """``json_object`` of each text. What stands before the first brace stays in the JVM, and of a batch only a few texts at a time
    are strings of Python."""

    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.array([json_object(t.as_py()) for t in texts[k : k + 64]], pa.string()) for k in range(0, len(texts), 64)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    text = F.col(text) if isinstance(text, str) else text
    brace = F.instr(text, "{")
    return F.arrow_udf(run, "string")(F.when(brace > 0, F.substr(text, brace)))


def static_issues(files: DataFrame) -> DataFrame:
    """(path, problem) of the files (path, code) that are empty, hold a placeholder or have unbalanced brackets."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    source = files.select("path", "code", suffix.alias("_suffix"), is_blank(F.col("code")).alias("_blank"))
    plain = source.select("path", F.when(F.col("_blank"), "file is empty").when(F.col("code").rlike(R.PLACEHOLDER), "contains a TODO/placeholder instead of logic").alias("problem")).where("problem is not null")
    checked = source.where(~F.col("_blank") & F.col("_suffix").isin(*R.BRACKETED)).where(~bracket_balance("code"))
    return plain.unionByName(checked.select("path", F.lit("unbalanced brackets — the file is truncated or malformed").alias("problem")))


def file_plan(df: DataFrame, text: str = "text", key: str = "id", most: int = 8) -> DataFrame:
    """(key, place, path, purpose) of the files that a plan names, in order, first mention of a path only.

    A JSON object with a list of files counts if there is one, at most ``most`` of it; else lines of the form "path: purpose".
    """
    plan = df.select(key, text, F.try_parse_json(extract_json(text)).alias("_v"))
    items = F.try_variant_get("_v", "$.files", "array<variant>")
    field = lambda v, *names: F.coalesce(*[F.nullif(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")) for n in names], F.lit(""))
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    listed = F.transform(items, lambda v: F.struct(F.when(is_text(v), F.try_variant_get(v, "$", "string")).otherwise(field(v, "path", "file")).alias("path"), F.when(is_text(v), F.lit("")).otherwise(field(v, "purpose", "description")).alias("purpose")))
    lines = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(R.PLAN_LINE), F.lit(1)).alias("path"), F.transform(F.regexp_extract_all(F.col(text), F.lit(R.PLAN_LINE), F.lit(2)), lambda p: strip(p)).alias("purpose"))
    from_json = F.coalesce(F.size(items), F.lit(0)) > 0
    rows = plan.select(key, from_json.alias("_json"), F.posexplode(F.when(from_json, listed).otherwise(lines)).alias("at", "f"))
    good = rows.select(key, "_json", "at", normalize_path(F.col("f.path")).alias("path"), F.left("f.purpose", F.lit(300)).alias("purpose")).where("path is not null")
    first = good.groupBy(key, "path").agg(F.min(F.struct("at", "purpose", "_json")).alias("m"))
    placed = first.select(key, "path", "m.purpose", "m._json", F.row_number().over(Window.partitionBy(key).orderBy("m.at")).alias("place"))
    return placed.where(~F.col("_json") | (F.col("place") <= most)).select(key, F.col("place").cast("long").alias("place"), "path", "purpose")


def plan_header(df: DataFrame, plan: DataFrame, text: str = "text", key: str = "id", fallback: str = "build") -> DataFrame:
    """(key, project, language, entrypoint, test_command) of each plan that names a file; ``plan`` is what ``file_plan`` gave.

    The entry point is the plan's own if it is one of its files, else the first; a command counts if it is a list of texts.
    """
    get = lambda name: F.coalesce(F.nullif(F.try_variant_get("_v", f"$.{name}", "string"), F.lit("")), F.lit(""))
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(F.nullif(get("project"), F.lit("")), F.lit(fallback))), "[^a-z0-9-]+", "-"), "^-+|-+$", "")
    words = F.try_variant_get("_v", "$.test_command", "array<variant>")
    texts = F.forall(words, lambda v: F.schema_of_variant(v) == "STRING")
    command = F.when(F.coalesce(texts, F.lit(False)), F.try_variant_get("_v", "$.test_command", "array<string>")).otherwise(F.array().cast("array<string>"))
    files = plan.groupBy(F.col(key).alias("_key")).agg(F.min_by("path", "place").alias("_first"), F.collect_set("path").alias("_paths"))  # a plan's few files
    v = df.select(key, F.try_parse_json(extract_json(text)).alias("_v"))
    listed = F.coalesce(F.size(F.try_variant_get("_v", "$.files", "array<variant>")), F.lit(0)) > 0
    v = v.select(key, F.when(listed, F.col("_v")).alias("_v"))
    own = normalize_path(get("entrypoint"))
    chosen = F.when(F.array_contains("_paths", own), own).otherwise(F.col("_first"))
    return v.join(files, F.col(key) == F.col("_key")).select(key, F.coalesce(F.nullif(slug, F.lit("")), F.lit(fallback)).alias("project"), get("language").alias("language"), chosen.alias("entrypoint"), command.alias("test_command"))


def review_body(files: Column, budget: int = 60000) -> Column:
    """The files of a project for a reviewer, in order of their paths, each cut to its share of the budget."""
    share = F.floor(F.lit(budget) / F.greatest(F.size(files), F.lit(1))).cast("int")
    parts = F.transform(F.array_sort(F.map_entries(files)), lambda e: F.concat(F.lit("--- "), e["key"], F.lit(" ---\n"), F.left(e["value"], share)))
    return F.array_join(parts, "\n\n")


def review_targets(files: Column, rewrite: Column, issues: Column, most: int = 3) -> Column:
    """The files to write anew: those a review lists, then those its issues (path, problem, fix) name, each once."""
    named = F.concat(F.coalesce(rewrite, F.array().cast("array<string>")), F.coalesce(F.transform(issues, lambda i: i["path"]), F.array().cast("array<string>")))
    return F.slice(F.array_distinct(F.filter(named, lambda p: F.array_contains(F.map_keys(files), p))), 1, most)


def review_notes(issues: Column, path: Column) -> Column:
    """What a review found in a file, a line for each issue."""
    own = F.transform(F.filter(issues, lambda i: i["path"] == path), lambda i: F.concat(F.lit("- "), F.coalesce(i["problem"], F.lit("")), F.lit(" → "), F.coalesce(i["fix"], F.lit(""))))
    return F.coalesce(F.nullif(F.array_join(own, "\n"), F.lit("")), F.lit("- the previous attempt was incomplete"))
