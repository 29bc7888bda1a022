"""Repositories: index, changes between indexes, text search and relevance."""

from __future__ import annotations

import posixpath
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R


def index_files(files: DataFrame) -> DataFrame:
    """(path, size, extension, hash, important) of binary files (path, content); ignored directories are left out."""
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))
    return files.where(outside(F.col("path"))).select("path", F.length("content").cast("long").alias("size"), suffix.alias("extension"), F.sha2("content", 256).alias("hash"), name.isin(*R.IMPORTANT_FILES).alias("important"))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of files that were added, removed or changed: a full outer join of (path, hash)."""
    o, n = old.select("path", F.col("hash").alias("old_hash")), new.select("path", F.col("hash").alias("new_hash"))
    both = o.join(n, "path", "full_outer").where(~F.col("old_hash").eqNullSafe(F.col("new_hash")))
    return both.select("path", F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").otherwise("changed").alias("change"))


def _named_like(path: Column, globs: tuple[str, ...]) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return name.rlike("^(?:" + "|".join(".*".join(map(re.escape, g.split("*"))) for g in globs) + ")$")


def outside(path: Column, names: tuple[str, ...] = R.IGNORED_DIRS) -> Column:
    """Whether none of the directories of a path is one of the names."""
    return ~F.exists(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda p: p.isin(*names))


def search_lines(files: DataFrame, pattern: str, language: str | None = None, definitions: bool = False) -> DataFrame:
    """(path, line, text) of the lines that match; with ``definitions`` only where something is defined.

    Ignored directories and binary files are left out; a known language restricts the names of the files.
    """
    if not pattern.strip():
        raise ValueError("a search needs a pattern")
    language = language.strip().lower() if language else None
    wanted = rf"{R.DEFINITIONS[language]}.*{pattern}" if definitions and language in R.DEFINITIONS else pattern
    chosen = files.where(outside(F.col("path")) & ~F.col("text").contains("\0"))
    if language in R.EXTENSIONS:
        chosen = chosen.where(_named_like(F.col("path"), R.EXTENSIONS[language]))
    lines = chosen.where(F.col("text").rlike("(?m)" + wanted)).select("path", F.posexplode(F.split("text", "\n")).alias("at", "line_text"))
    return lines.where(F.col("line_text").rlike(wanted)).select("path", (F.col("at") + 1).cast("long").alias("line"), F.col("line_text").alias("text"))


def search_output(matches: DataFrame, most: int = R.SEARCH_TAIL) -> DataFrame:
    """One row: the last characters of the matches as path:line:text, in order of path and line.

    A match takes five characters at least, which bounds the rows that are brought together.
    """
    shown = F.concat_ws(":", F.concat(F.lit("./"), "path"), F.col("line").cast("string"), F.coalesce("text", F.lit("")))
    last = matches.select("path", "line", shown.alias("shown")).orderBy(F.desc("path"), F.desc("line")).limit(most // 5)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("path", "line", "shown"))), lambda m: F.concat(m["shown"], F.lit("\n")))
    return last.agg(F.right(F.array_join(ordered, ""), F.lit(most)).alias("matches"), F.when(F.count(F.lit(1)) > 0, 0).otherwise(1).alias("exit_code"))


def relevance(text: Column, query: str) -> Column:
    """How often the query's different words of three letters or more occur, without overlaps."""
    low = F.lower(text)
    terms = sorted({t.lower() for t in query.split() if len(t) > 2})
    return reduce(lambda a, t: a + F.floor((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)), terms, F.lit(0).cast("long"))


def search_memory(df: DataFrame, query: str, key: str = "file", text: str = "text", limit: int = 8) -> DataFrame:
    """The ``limit`` most relevant texts, ties by key; a top-k needs no full sort."""
    return df.withColumn("score", relevance(F.col(text), query)).where("score > 0").orderBy(F.desc("score"), key).limit(limit).select(key, "score", F.left(text, F.lit(8000)).alias("content"))


def project_context(index: DataFrame, title: str, most: int = 20, limit: int = 30000) -> DataFrame:
    """One row: a short description of an index, its important files first. Only the first paths are brought together."""
    def first(rows: DataFrame, name: str) -> DataFrame:
        top = rows.select("path").orderBy("path").limit(most)
        return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list("path")), lambda p: F.concat(F.lit("\n- "), p)), "").alias(name))

    parts = index.agg(F.count(F.lit(1)).alias("n")).join(first(index.where("important"), "important")).join(first(index, "files"))  # one row each
    text = F.concat(F.lit(f"{title}\nFiles indexed: "), F.col("n").cast("string"), F.lit("\n\nImportant files:"), "important", F.lit("\n\nRepository files:"), "files")
    return parts.select(F.left(text, F.lit(limit)).alias("context"))


def read_readme(files: DataFrame, names: tuple[str, ...] = R.README_NAMES, most: int = 20000) -> DataFrame:
    """The first of the candidate names that exists, cut to ``most`` characters, and as it is shown."""
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("path"))
    one = files.where(rank > 0).agg(F.min_by("path", rank).alias("path"), F.left(F.min_by("text", rank), F.lit(most)).alias("text")).where("path is not null")
    return one.withColumn("shown", F.concat(F.lit("# PROJECT README ("), "path", F.lit(")\n"), "text"))


def _inside(path: str) -> str:
    clean = posixpath.normpath(path)
    if clean.startswith(("/", "..")):
        raise PermissionError(f"the path leaves the project: {path}")
    return clean


def list_files(files: DataFrame, under: str = ".") -> DataFrame:
    """The paths below a directory of the project."""
    clean = _inside(under)
    return files.select("path") if clean == "." else files.select("path").where(F.col("path").startswith(clean + "/"))


def read_file(files: DataFrame, path: str) -> DataFrame:
    """(path, text) of one file of the project; no row if there is none."""
    return files.where(F.col("path") == _inside(path)).select("path", "text")
