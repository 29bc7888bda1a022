"""Injected teachers and tools as table functions under names of SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType


def _columns(schema: str) -> list[str]:
    return StructType.fromDDL(schema).fieldNames()


def _values(made, names: list[str], what: str) -> tuple:
    if not isinstance(made, dict):
        raise TypeError(f"{what} must return dicts, not {type(made).__name__}")
    return tuple(made.get(c) for c in names)


def register_teacher(spark: SparkSession, name: str, generate: Callable[[str], dict], schema: str, teacher: str) -> None:
    """``SELECT t.ord, m.* FROM tasks t, LATERAL name(t.task) m``: the row that ``generate`` makes of each task, with the teacher
    stamped on, as ``generate_with`` does. What it leaves out is null, what the schema doesn't name is left out; anything but a dict
    fails the query. Rows stay where they are, nothing is shuffled."""
    names = _columns(schema)

    class Teacher:
        def eval(self, task: str):
            yield (*_values(generate(task), names, "a teacher"), "synthetic", teacher)

    spark.udtf.register(name, udtf(Teacher, returnType=f"{schema}, source_type string, source_teacher string"))


def register_tool(spark: SparkSession, name: str, start: Callable[[], Callable[[dict], dict]], schema: str) -> None:
    """``SELECT * FROM name(TABLE(calls) PARTITION BY session ORDER BY step)``: what a tool answers to each row, given as a dict.

    ``start`` makes the tool anew for each partition of the input table, so it may keep what belongs to one session; rows come in
    their order, one at a time, so a session's size is no matter of memory. Anything but a dict fails the query. Without PARTITION BY
    Spark brings all rows to one task.
    """
    names = _columns(schema)

    class Tool:
        def __init__(self):
            self.tool = start()

        def eval(self, row):
            yield _values(self.tool(row.asDict(recursive=True)), names, "a tool")

    spark.udtf.register(name, udtf(Tool, returnType=schema))
