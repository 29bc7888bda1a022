"""Teachers and tools as table functions."""

import pytest

from grainmill.plans.curation_queries import table
from grainmill.sources import functions, readers

SCHEMA = "id string, instruction string, n int"


@pytest.fixture
def make():
    def make(task):
        return {"id": f"x-{len(task)}", "instruction": task.upper(), "other": 1, **({"n": len(task)} if len(task) % 2 else {})}

    return make


@pytest.fixture
def counting():
    def counting():
        seen = []

        def tool(row):
            seen.append(row["step"])
            return {"session": row["session"], "step": row["step"], "nth": len(seen), "first": seen[0]}

        return tool

    return counting


def test_lateral_teacher_equals_generate_with(spark, sf_dir, make):
    tasks = table(spark, sf_dir, "documents").where("text is not null").selectExpr("doc_id AS ord", "text AS task")
    want = sorted(map(str, readers.generate_with(tasks, lambda t: {c: v for c, v in make(t).items() if c != "other"} | {"n": make(t).get("n")}, SCHEMA, "stub").collect()))
    tasks.createOrReplaceTempView("teacher_tasks")
    functions.register_teacher(spark, "taught", make, SCHEMA, "stub")
    found = spark.sql("SELECT t.ord, m.* FROM teacher_tasks t, LATERAL taught(t.task) m")
    assert sorted(map(str, found.drop("ord").collect())) == want and found.select("ord").distinct().count() == tasks.count()
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert "Exchange" not in plan


def test_no_dict_fails(spark):
    functions.register_teacher(spark, "taught_badly", lambda t: [t], SCHEMA, "stub")
    with pytest.raises(Exception, match="a teacher must return dicts, not list"):
        spark.sql("SELECT * FROM taught_badly('a')").collect()
    functions.register_tool(spark, "used_badly", lambda: lambda row: None, "a int")
    with pytest.raises(Exception, match="a tool must return dicts, not NoneType"):
        spark.sql("SELECT * FROM used_badly(TABLE(SELECT 1 AS x))").collect()


def test_a_tool_of_each_session(spark, sf_dir, counting):
    table(spark, sf_dir, "conversations").selectExpr("conv_id AS session", "turn AS step", "text").createOrReplaceTempView("tool_calls")
    functions.register_tool(spark, "counted", counting, "session bigint, step bigint, nth int, first bigint")
    found = spark.sql("SELECT * FROM counted(TABLE(tool_calls) PARTITION BY session ORDER BY step)").collect()
    want = spark.sql("SELECT session, step, row_number() OVER w AS nth, first(step) OVER w AS first FROM tool_calls WINDOW w AS (PARTITION BY session ORDER BY step)").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, want)) and len(found) == spark.table("tool_calls").count() > 0
    assert spark.sql("SELECT * FROM counted(TABLE(SELECT * FROM tool_calls WHERE false) PARTITION BY session ORDER BY step)").count() == 0
