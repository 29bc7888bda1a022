"""Queries over grading, gates and sample selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..lineage import spread
from ..operators import distill as D
from ..operators import evaluation as E
from ..operators import suite as U
from ..operators.curation import fold_rows
from . import dealt as X
from . import sql as S
from .curation_queries import frame, table

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f
    return add


#: Events as results of a run: the type is the category, the two halves of the users are two runs, a band of values is unscored.
_RESULTS = "results AS (SELECT event_id AS ord, user_id, event_type AS category, CASE WHEN user_id % 2 = 0 THEN 'baseline' ELSE 'candidate' END AS run, CASE WHEN user_id % 3 = 0 THEN 'verified' ELSE 'baseline' END AS source, CASE WHEN value < 1 THEN NULL ELSE value > 8 END AS pass, value FROM events)"


def results(spark, d):
    passed = F.when(F.col("value") >= 1, F.col("value") > 8)
    return table(spark, d, "events").select(F.col("event_id").alias("ord"), "user_id", F.col("event_type").alias("category"), F.when(F.col("user_id") % 2 == 0, "baseline").otherwise("candidate").alias("run"),
                                            F.when(F.col("user_id") % 3 == 0, "verified").otherwise("baseline").alias("source"), passed.alias("pass"), "value")


_RUBRIC = {"lang": "VARCHAR", "rubric": "VARCHAR[]", "rubric_min": "INTEGER"}
_RUBRIC_ROWS = [("en", ["the", "and", "license"], 2), ("fr", ["que", "le ", "élé"], None), ("de", ["schön", "und", " "], 1), ("es", [], None)]


@query("freeform_grade", f"""WITH {S.values('rubrics', _RUBRIC, _RUBRIC_ROWS)}, g AS (SELECT doc_id, list_filter(rubric, lambda t: trim(t) <> '') AS terms, rubric_min, replace(lower(text), 'ß', 'ss') AS low FROM documents LEFT JOIN rubrics USING (lang)),
 h AS (SELECT doc_id, len(terms)::BIGINT AS terms, list_filter(terms, lambda t: contains(low, t)) AS hit, list_filter(terms, lambda t: NOT contains(low, t)) AS missed, coalesce(nullif(rubric_min, 0), len(terms)) AS needed FROM g)
 SELECT doc_id, terms, CASE WHEN terms > 0 THEN len(hit) END AS hits, CASE WHEN terms > 0 THEN len(hit) >= needed END AS pass, CASE WHEN terms > 0 THEN printf('%.2f', len(hit) / terms)::DOUBLE END AS score, CASE WHEN terms > 0 THEN least(needed, terms)::BIGINT END AS required,
 array_to_string(hit, '|') AS hit, array_to_string(missed, '|') AS missed FROM h""")
def _(spark, d):
    graded = spread(table(spark, d, "documents")).join(F.broadcast(frame(spark, _RUBRIC, _RUBRIC_ROWS)), "lang", "left")  # a fixed table
    return graded.select("doc_id", E.grade_freeform(F.col("text"), F.col("rubric"), F.col("rubric_min")).alias("g")).select("doc_id", F.col("g.terms").cast("long").alias("terms"), F.col("g.hits").cast("long").alias("hits"), "g.pass", "g.score", F.col("g.required").cast("long").alias("required"), F.array_join("g.hit", "|").alias("hit"), F.array_join("g.missed", "|").alias("missed"))


_RUNS = {"id": "BIGINT", "success": "BOOLEAN", "stdout": "VARCHAR", "stderr": "VARCHAR", "expected": "VARCHAR", "timed_out": "BOOLEAN", "error": "VARCHAR", "exit_code": "INTEGER"}
_RUN_ROWS = [(1, True, "sum 3\n", "", "3", False, None, 0), (2, True, "sum 4", "", "3", False, None, 0), (3, False, "3", "", "3", False, None, 1), (4, True, "", "", None, False, None, 0), (5, None, None, None, "3", False, None, None),
             (6, False, "", " Trace\nlast line ", None, True, None, -1), (7, False, "out", "docker: x\nno image\n", None, False, "boom", 125), (8, False, "\n only out", "", None, False, None, 127)]


@query("executable_grade", f"WITH {X.values('r', _RUNS, _RUN_ROWS, 'id', {'stdout': 'after', 'stderr': 'after'})} SELECT id, coalesce(success, false) AND (expected IS NULL OR coalesce(contains(stdout, expected), false)) AS pass FROM r")
def _(spark, d):
    return X.rows(spark, d, _RUNS, _RUN_ROWS, "id", {'stdout': 'after', 'stderr': 'after'}).select("id", E.grade_executable(F.col("success"), F.col("stdout"), F.col("expected")).alias("pass"))


_E, _O = S.strip("stderr"), S.strip("stdout")


@query("format_failure", f"""WITH {X.values('r', _RUNS, _RUN_ROWS, 'id', {'stdout': 'after', 'stderr': 'after'})}, p AS (SELECT *, concat_ws(chr(10) || chr(10), CASE WHEN timed_out THEN 'The run timed out before finishing.' END, CASE WHEN length(error) > 0 THEN 'Runner error: ' || error END,
 CASE WHEN length({_E}) > 0 THEN 'STDERR:' || chr(10) || right({_E}, 4000) END, CASE WHEN length({_O}) > 0 THEN 'STDOUT:' || chr(10) || right({_O}, 4000) END) AS parts FROM r)
 SELECT id, CASE WHEN parts = '' THEN 'The run failed with exit code ' || coalesce(exit_code::VARCHAR, 'None') || '.' ELSE parts END AS evidence,
 CASE WHEN exit_code IN (125, 126, 127) THEN 'Sandbox could not start the container (docker exit ' || exit_code || '). ' || list_extract(string_split({S.strip("CASE WHEN length(stderr) > 0 THEN stderr ELSE stdout END")}, chr(10)), -1) END AS container FROM p""")
def _(spark, d):
    c = F.col
    return X.rows(spark, d, _RUNS, _RUN_ROWS, "id", {'stdout': 'after', 'stderr': 'after'}).select("id", E.format_failure(c("timed_out"), c("error"), c("stderr"), c("stdout"), c("exit_code")).alias("evidence"), E.container_error(c("exit_code"), c("stderr"), c("stdout")).alias("container"))


_COUNTS = "count(*) AS total, count(*) FILTER (pass) AS passed, count(*) FILTER (NOT pass) AS failed, count(*) FILTER (pass IS NULL) AS unscored, count(*) FILTER (pass) / count(*) AS pass_rate FROM results"


@query("bench_summary", f"WITH {_RESULTS} SELECT 'all' AS dimension, 'all' AS key, {_COUNTS} UNION ALL SELECT 'category', category, {_COUNTS} GROUP BY category UNION ALL SELECT 'source', source, {_COUNTS} GROUP BY source")
def _(spark, d):
    return E.summarize(results(spark, d))


_RATES = "rates AS (SELECT run, coalesce(nullif(category, ''), 'unknown') AS category, count(*) FILTER (pass) AS passed, count(*) AS scored FROM results WHERE pass IS NOT NULL GROUP BY ALL)"


@query("gate_rates", f"WITH {_RESULTS}, {_RATES} SELECT category, passed, scored FROM rates WHERE run = 'baseline'")
def _(spark, d):
    return E.rates(results(spark, d).where("run = 'baseline'"))


#: Categories that only one of the runs has, and one without a grade.
_LONE = {"ord": "BIGINT", "user_id": "BIGINT", "category": "VARCHAR", "run": "VARCHAR", "source": "VARCHAR", "pass": "BOOLEAN", "value": "DOUBLE"}
_LONE_ROWS = [(-1, -1, "retired", "baseline", "verified", True, 9.0), (-2, -2, "brand_new", "candidate", "verified", False, 2.0), (-3, -3, "", "baseline", "verified", False, 2.0), (-4, -4, "", "candidate", "verified", None, 0.5)]
_BOTH = _RESULTS.replace("results AS", "events_as AS", 1) + f", {S.values('lone', _LONE, _LONE_ROWS)}, results AS (SELECT * FROM events_as UNION ALL SELECT * FROM lone)"
_COMPARED = f"""WITH {_BOTH}, {_RATES}, compared AS (SELECT category, b.passed AS base_passed, b.scored AS base_scored, c.passed AS cand_passed, c.scored AS cand_scored, b.passed / b.scored AS base_rate, c.passed / c.scored AS cand_rate, c.passed / c.scored - b.passed / b.scored AS delta
 FROM (SELECT * FROM rates WHERE run = 'baseline') b FULL OUTER JOIN (SELECT * FROM rates WHERE run = 'candidate') c USING (category))"""


def _compared(spark, d):
    r = results(spark, d).unionByName(frame(spark, _LONE, _LONE_ROWS))
    return E.compare(r.where("run = 'baseline'"), r.where("run = 'candidate'"))


@query("gate_compare", f"{_COMPARED} SELECT * FROM compared")
def _(spark, d):
    return _compared(spark, d)


_DELTA = "sum(cand_passed) / sum(cand_scored) - sum(base_passed) / sum(base_scored)"


@query("gate_verdict", f"""{_COMPARED}, why AS (SELECT *, CASE WHEN base_scored IS NOT NULL AND cand_scored IS NULL THEN 'category missing from candidate: ' || category WHEN delta < -1e-9 THEN 'category regressed: ' || category || ' ' || printf('%+.0f%%', delta * 100) || ' (allowed 0% drop)' END AS why FROM compared),
 t AS (SELECT {_DELTA} AS overall_delta, list(why ORDER BY category) FILTER (why IS NOT NULL) AS listed FROM why), f AS (SELECT overall_delta, list_concat(CASE WHEN overall_delta < -1e-9 THEN ['overall pass rate fell or missed the target: ' || printf('%+.2f%%', overall_delta * 100) || ' (required +0.00%)'] ELSE [] END, coalesce(listed, [])) AS reasons FROM t)
 SELECT len(reasons) = 0 AS passed, overall_delta, array_to_string(reasons, '; ') AS reasons FROM f""")
def _(spark, d):
    return E.verdict(_compared(spark, d)).drop("reason_list")


@query("distill_stats", f"WITH {_RESULTS} SELECT user_id::VARCHAR AS id, min(category) AS category, count(*) AS samples, count(*) FILTER (pass) AS passed FROM results GROUP BY user_id")
def _(spark, d):
    return E.task_stats(results(spark, d).withColumn("id", F.col("user_id").cast("string")))


_ROWS = "rows AS (SELECT event_id AS ord, user_id::VARCHAR AS id, event_type AS reason, 'task ' || user_id AS prompt, CASE WHEN value < 2 THEN '' ELSE event_type || ' ' || floor(value)::BIGINT END AS completion FROM events)"


@query("fold_counts", f"WITH {_ROWS}, first AS (SELECT * FROM rows WHERE completion <> '' QUALIFY row_number() OVER (PARTITION BY prompt, completion ORDER BY ord) = 1) SELECT reason, {S.fold('id')} AS fold, count(*) AS n FROM first GROUP BY ALL")
def _(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("ord"), F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("reason"), F.concat(F.lit("task "), F.col("user_id").cast("string")).alias("prompt"),
                                            F.when(F.col("value") < 2, "").otherwise(F.concat_ws(" ", "event_type", F.floor("value").cast("string"))).alias("completion"))
    return fold_rows(rows).groupBy("reason", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("pass_at_n", f"WITH {_RESULTS} SELECT user_id, coalesce(min(ord) FILTER (pass), max(ord)) AS ord, bool_or(coalesce(pass, false)) AS passed, count(*) AS attempts FROM results GROUP BY user_id")
def _(spark, d):
    return E.pass_at(results(spark, d), "user_id", "ord")


@query("best_of_n", "SELECT conv_id, count(*) AS samples, arg_max(turn, (length(text), length(text), -turn)) AS sample, arg_max(sha256(text), (length(text), length(text), -turn)) AS text_sha, max(length(text))::DOUBLE AS score FROM conversations GROUP BY conv_id")
def _(spark, d):
    samples = table(spark, d, "conversations").withColumnRenamed("turn", "sample")
    return E.best_of(samples, "conv_id", F.length("text").cast("double")).select("conv_id", "samples", "sample", F.sha2("text", 256).alias("text_sha"), "score")


@query("running_rates", f"WITH {_RESULTS} SELECT ord, category, sum(CASE WHEN pass THEN 1 ELSE 0 END) OVER w / nullif(count(pass) OVER w, 0) AS rate_so_far FROM results WINDOW w AS (PARTITION BY category ORDER BY ord ROWS UNBOUNDED PRECEDING)")
def _(spark, d):
    return E.windows_by_category(results(spark, d)).select("ord", "category", "rate_so_far")


_OUT = {"oid": "BIGINT", "output": "VARCHAR"}
_OUT_ROWS = [
    (1, "plain answer about thinking and response"), (2, "<thinking>\nhm\n</thinking>\nThe answer"), (3, "<think>cut off"), (4, "<|start_of_thought|>x<|end_of_thought|>done ```python\nprint(1)\n``` and ```\nlast\n```"),
    (5, "  thinking\nsome\n response\nfinal text"), (6, "<think>a</think> b </think> c"), (7, "no fence at all  "), (8, "```js\nlet a = 1;\n```"), (9, "main.py:\n\nprint('x')\n"), (10, "```\nsrc/app.ts\nexport {}\n```"), (11, "README.md"), (12, ""),
    (13, "<think>q</think>\n<response> out <|answer|> fin"),
]


_LAST = S.strip(r"coalesce(list_extract(regexp_extract_all(x, '(?s)```(?:[a-zA-Z]+)?\s*\n?(.*?)```', 1), -1), x)")


@query("extract_code", rf"""WITH {X.values('o', _OUT, _OUT_ROWS, 'oid', {'output': 'after'})}, t AS (SELECT oid, regexp_replace(output, '<\|start_of_thought\|>.*?<\|end_of_thought\|>', '', 'gs') AS x FROM o) SELECT oid, {_LAST} AS code FROM t""")
def _(spark, d):
    return X.rows(spark, d, _OUT, _OUT_ROWS, "oid", {'output': 'after'}).select("oid", E.extract_code(F.col("output")).alias("code"))


_MARK = r"</think(?:ing)?>|<\|end_of_thought\|>|<response>|<\|answer\|>|\n\s*response\b|\n<\|im_start\|>response"


@query("clean_completion", rf"""WITH {X.values('o', _OUT, _OUT_ROWS, 'oid', {'output': 'after'})}, h AS (SELECT oid, output, regexp_matches(output, '<think(?:ing)?>|<\|start_of_thought\|>|\A\s+thinking\b') AS opened, regexp_replace(output, '\A\s*<\s*(?:think(?:ing)?|start_of_thought)/?\s*\n?', '') AS head FROM o)
 SELECT oid, CASE WHEN NOT opened THEN output WHEN regexp_matches(head, '{_MARK}') THEN {S.strip(rf"regexp_extract(head, '(?s)\A.*(?:{_MARK})(.*)\z', 1)")} ELSE '' END AS answer FROM h""")
def _(spark, d):
    return X.rows(spark, d, _OUT, _OUT_ROWS, "oid", {'output': 'after'}).select("oid", E.clean_completion(F.col("output")).alias("answer"))


@query("token_usage", "SELECT conv_id, sum(CASE WHEN role <> 'assistant' THEN CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END ELSE 0 END)::BIGINT AS prompt_tokens, sum(CASE WHEN role = 'assistant' THEN CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END ELSE 0 END)::BIGINT AS completion_tokens FROM conversations GROUP BY conv_id")
def _(spark, d):
    n, own = T.usage_tokens(F.col("text")), F.col("role") == "assistant"
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.when(~own, n).otherwise(0)).alias("prompt_tokens"), F.sum(F.when(own, n).otherwise(0)).alias("completion_tokens"))


@query("graded_runs", f"""WITH {X.values('r', _RUNS, _RUN_ROWS, 'id', {'stdout': 'after', 'stderr': 'after'})}, g AS (SELECT *, error IS NULL AS ran, expected IS NULL OR coalesce(contains(stdout, expected), false) AS ok FROM r)
 SELECT id, ran AND coalesce(success, false) AND ok AS pass, ran AS verified, CASE WHEN ran THEN ok END AS output_matched, CASE WHEN ran THEN right(coalesce(stdout, ''), 300) END AS stdout_tail, CASE WHEN ran THEN right(coalesce(stderr, ''), 300) END AS stderr_tail, 'sandbox unavailable: ' || error AS error FROM g""")
def _(spark, d):
    c = F.col
    g = X.rows(spark, d, _RUNS, _RUN_ROWS, "id", {'stdout': 'after', 'stderr': 'after'}).select("id", E.grade_run(c("success"), c("exit_code"), c("timed_out"), c("stdout"), c("stderr"), c("expected"), c("error")).alias("g"))
    return g.select("id", "g.pass", "g.verified", "g.output_matched", F.col("g.stdout_truncated").alias("stdout_tail"), F.col("g.stderr_truncated").alias("stderr_tail"), "g.error")


@query("run_summary", f"""WITH {X.values('r', _RUNS, _RUN_ROWS, 'id', {'stdout': 'after', 'stderr': 'after'})} SELECT id, CASE WHEN coalesce(success, false) THEN 'Verification passed.' ELSE 'Verification failed.' || chr(10) || 'Exit code: ' || coalesce(exit_code::VARCHAR, '-1') || chr(10) || 'STDOUT:' || chr(10) || coalesce(stdout, '') || chr(10) || 'STDERR:' || chr(10) || coalesce(stderr, '') END AS summary FROM r""")
def _(spark, d):
    c = F.col
    return X.rows(spark, d, _RUNS, _RUN_ROWS, "id", {'stdout': 'after', 'stderr': 'after'}).select("id", E.run_summary(c("success"), c("exit_code"), c("stdout"), c("stderr")).alias("summary"))


_REC = {"ord": "BIGINT", "id": "VARCHAR", "category": "VARCHAR", "difficulty": "VARCHAR", "language": "VARCHAR", "prompt": "VARCHAR", "files": "MAP(VARCHAR, VARCHAR)", "command": "VARCHAR[]", "code": "VARCHAR"}
_REC_ROWS = [(1, "r1", "coding", "easy", "python", "write add", {"main.py": "x", "test_main.py": "y"}, None, "x = 1"), (2, "r2", "coding", "hard", "typescript", "write add in ts", {"math.ts": "x", "run.ts": "y"}, ["tsx", "run.ts"], "let x"),
             (3, "r3", "reasoning", "easy", "", "why", None, None, None), (4, "r4", "security", "easy", "node", "harden", {"index.js": "z"}, [], "z"), (5, "r5", "general_chat", "easy", None, "hello", {}, None, None)]
_RUB = {"id": "VARCHAR", "rubric": "VARCHAR[]", "rubric_min": "INTEGER"}
_RUB_ROWS = [("r3", ["cause", "effect"], 1), ("b1", ["a"], 1)]
_EXP = {"id": "VARCHAR", "expected_output": "VARCHAR"}
_EXP_ROWS = [("r2", "5"), ("zz", "6")]
_BASE = {"ord": "BIGINT", "id": "VARCHAR", "category": "VARCHAR", "difficulty": "VARCHAR", "prompt": "VARCHAR", "rubric": "VARCHAR[]", "rubric_min": "INTEGER", "source": "VARCHAR"}
_BASE_ROWS = [(1, "b1", "reasoning", "easy", "explain a", ["a"], 1, "baseline"), (2, "b2", "coding", "medium", "explain b", ["b", "c"], None, "baseline")]
_SUITE = f"""WITH {X.values('rec', _REC, _REC_ROWS, 'id', {'prompt': 'after', 'ord': 'number'})}, {S.values('rub', _RUB, _RUB_ROWS)}, {S.values('exp', _EXP, _EXP_ROWS)}, {X.values('base', _BASE, _BASE_ROWS, 'id', {'prompt': 'after', 'ord': 'number'})},
 v AS (SELECT 1 AS part, ord, id, category, nullif(language, '') AS language, 'verified' AS source, prompt, rubric, rubric_min, coalesce(cardinality(files), 0) > 0 AS run, CASE WHEN language = 'python' THEN 'main.py' ELSE 'math.ts' END AS main, files, command, expected_output, language AS raw FROM rec LEFT JOIN rub USING (id) LEFT JOIN exp USING (id)),
 suite AS (SELECT 0 AS part, ord, id, category, NULL AS language, source, prompt, rubric, rubric_min, false AS run, NULL AS main, NULL::MAP(VARCHAR, VARCHAR) AS files, NULL::VARCHAR[] AS command, NULL AS expected_output, NULL AS raw FROM base UNION ALL SELECT * FROM v)"""


def _suite(spark, d):
    base = X.rows(spark, d, _BASE, _BASE_ROWS, 'id', {'prompt': 'after', 'ord': 'number'})
    return U.assemble(base, U.verified_tasks(X.rows(spark, d, _REC, _REC_ROWS, 'id', {'prompt': 'after', 'ord': 'number'}), frame(spark, _RUB, _RUB_ROWS), frame(spark, _EXP, _EXP_ROWS)))


@query("suite_tasks", f"""{_SUITE} SELECT part, ord, id, category, language, source, array_to_string(rubric, ',') AS rubric, rubric_min::BIGINT AS rubric_min, CASE WHEN run THEN main END AS main_file, CASE WHEN run THEN array_to_string(list_sort(list_filter(map_keys(files), lambda k: k <> main)), ',') END AS other_files,
 CASE WHEN run THEN array_to_string(CASE WHEN len(command) > 0 THEN command ELSE ['python', '-m', 'pytest', '-q'] END, ' ') END AS command, CASE WHEN run THEN expected_output END AS expected, CASE WHEN run THEN raw = 'typescript' END AS has_contract FROM suite""")
def _(spark, d):
    g = F.col("grading")
    return _suite(spark, d).select(F.col("part").cast("long").alias("part"), "ord", "id", "category", "language", "source", F.array_join("rubric", ",").alias("rubric"), F.col("rubric_min").cast("long").alias("rubric_min"), g["main_file"].alias("main_file"),
                                F.array_join(F.array_sort(F.map_keys(g["other_files"])), ",").alias("other_files"), F.array_join(g["command"], " ").alias("command"), g["expected_output"].alias("expected"), F.when(g.isNotNull(), g["contract"].isNotNull()).alias("has_contract"))


@query("suite_filter", f"{_SUITE} SELECT id FROM (SELECT * FROM suite WHERE category IN ('coding', 'reasoning') ORDER BY part, ord LIMIT 3)")
def _(spark, d):
    return U.select_tasks(_suite(spark, d), categories="coding, reasoning,", limit=3).select("id")


@query("suite_prompts", f"""{_SUITE} SELECT id, prompt || CASE WHEN run THEN CASE WHEN raw = 'typescript' THEN chr(10) || chr(10) || {S.q(R.CONTRACTS['typescript'])} ELSE '' END || {S.q(R.CODE_ONLY)} ELSE '' END AS prompt FROM suite""")
def _(spark, d):
    return _suite(spark, d).select("id", U.task_prompt(F.col("prompt"), F.col("grading")).alias("prompt"))


#: Events as samples of tasks, with outputs that are sometimes nothing but thoughts.
_SAMPLES = "samples AS (SELECT user_id::VARCHAR AS id, event_id AS sample, event_type AS category, 'easy' AS difficulty, 'task ' || user_id AS prompt, CASE WHEN value < 9 THEN '<think>x</think>' ELSE '<think>x</think> ' || event_type END AS output, floor(value)::BIGINT AS tokens, CASE WHEN value < 1 THEN NULL ELSE value > 8 END AS pass, 'freeform' AS type FROM events)"


def _samples(spark, d):
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("sample"), F.col("event_type").alias("category"), F.lit("easy").alias("difficulty"), F.concat(F.lit("task "), F.col("user_id").cast("string")).alias("prompt"),
                                            F.when(F.col("value") < 9, "<think>x</think>").otherwise(F.concat(F.lit("<think>x</think> "), "event_type")).alias("output"), F.floor("value").alias("tokens"), F.when(F.col("value") >= 1, F.col("value") > 8).alias("pass"), F.lit("freeform").alias("type"))


@query("distilled_rows", f"""WITH {_SAMPLES}, {S.values('rec', _REC, _REC_ROWS)}, rows AS (SELECT reason, category, tokens FROM (SELECT 'distilled' AS reason, category, tokens, trim(replace(output, '<think>x</think>', '')) AS answer FROM samples WHERE pass) WHERE answer <> '' UNION ALL SELECT 'gold', category, NULL FROM rec WHERE cardinality(files) > 0)
 SELECT 'all' AS dimension, 'all' AS key, count(*) AS n FROM rows UNION ALL SELECT 'reason', reason, count(*) FROM rows GROUP BY reason UNION ALL SELECT 'category', category, count(*) FROM rows GROUP BY category""")
def _(spark, d):
    rows = D.distilled_rows(_samples(spark, d), thinking=True).unionByName(D.gold_rows(frame(spark, _REC, _REC_ROWS)))
    return D.row_counts(rows)


@query("distill_tasks", f"""WITH {_SAMPLES}, {S.values('rec', _REC, _REC_ROWS)}, u AS (SELECT id, category, type, coalesce(pass, false) AS good FROM samples UNION ALL SELECT id, category, 'sandbox', true FROM rec WHERE cardinality(files) > 0) SELECT id, any_value(type) AS type, count(*) AS samples, count(*) FILTER (good) AS passed FROM u GROUP BY id""")
def _(spark, d):
    return D.task_table(_samples(spark, d), frame(spark, _REC, _REC_ROWS).where("cardinality(files) > 0")).select("id", "type", "samples", "passed")
