"""Data sources of files: lines in blocks against the whole read, files by executors, what failed tasks leave."""

import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from grainmill.plans.curation_queries import table
from grainmill.sources import files, readers, sinks


def candidate_files(spark, sf_dir, folder):
    """Documents as candidates in three files, with blank and long lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source").orderBy("doc_id").collect()
    os.makedirs(folder)
    for k in range(3):
        with open(f"{folder}/{'bca'[k]}.jsonl", "w", newline="") as out:
            for d in docs[k::3]:
                one = {"id": f"c{d['doc_id']}", "instruction": d["text"], "category": ("coding", "chat", None, 5, "reasoning")[d["doc_id"] % 5], "difficulty": "easy", "source": {"type": d["source"]}}
                out.write(json.dumps(one, ensure_ascii=d["doc_id"] % 2 == 0) + ("\n", "\r\n", "\n \n\n")[d["doc_id"] % 3])
            out.write('{"id": "last"}')
    return [f"{folder}/c.jsonl", str(folder), f"{folder}/none"]


def test_blocks_equal_whole_files(spark, sf_dir, tmp_path):
    paths = candidate_files(spark, sf_dir, str(tmp_path / "c"))
    want = readers.load_candidates(spark, paths)
    columns = [c for c in want.columns if c not in ("ord", "raw")]
    plain = lambda df: [r[1:] for r in sorted(map(tuple, df.select("ord", *columns).collect()), key=lambda r: r[0])]
    for block in (64 << 20, 50_000, 997):
        got = files.scan_json_lines(spark, paths, block_bytes=block)
        assert plain(readers.candidates(got.select("ord", "v"))) == plain(want)
    assert got.rdd.getNumPartitions() > 50


@pytest.mark.parametrize("seed", range(3))
def test_lines_of_any_block(tmp_path, seed):
    """Every line is in the block that it starts in, for blocks and pieces of any size."""
    rng = random.Random(seed)
    data = b"".join(rng.choice([b"", b"x", b"y" * rng.randint(0, 60)]) + b"\n" for _ in range(60)) + rng.choice([b"", b"end"])
    path = tmp_path / "a.jsonl"
    path.write_bytes(data)
    want, at = [], 0
    for line in data.split(b"\n"):
        if at < len(data):
            want.append((at, line))
        at += len(line) + 1
    old = files.PIECE
    try:
        for block in (1, 2, 7, 50, 10_000):
            for files.PIECE in (1, 3, 64, 1 << 20):
                parts = files.JsonLinesReader([f"file://{path}"], block, None).partitions()
                got = [(p, x) for p in parts for x in files._lines(p)]
                assert [x for _, x in got] == want and all(p.start <= x[0] < p.end for p, x in got)
    finally:
        files.PIECE = old


def test_category_is_tested_by_the_reader(spark, sf_dir, tmp_path, capsys):
    paths = candidate_files(spark, sf_dir, str(tmp_path / "c"))
    lines = files.scan_json_lines(spark, paths, block_bytes=50_000)
    some = lines.where("category = 'chat' and at >= 0").select("raw")
    all_ = [json.loads(r["raw"]) for r in lines.select("raw").collect()]
    assert sorted(r["raw"] for r in some.collect()) == sorted(r["raw"] for r in lines.select("raw", "category").collect() if json.loads(r["raw"]).get("category") == "chat")
    assert len(all_) > some.count() > 0
    some.explain()
    plan = capsys.readouterr().out.split("\n")
    assert any("Filter" in x and "at" in x for x in plan) and not any("Filter" in x and "= chat" in x.split("Scan")[0] for x in plan)
    one = files.JsonLinesReader(["file://" + paths[0]], 1 << 20, None)
    from pyspark.sql.datasource import EqualTo, In, IsNotNull
    kept = list(one.pushFilters([IsNotNull(("category",)), EqualTo(("category",), "chat"), In(("category",), ("chat", "coding"))]))
    assert kept == [IsNotNull(("category",))] and one.wanted == {"chat"}
    assert sum(b.num_rows for p in one.partitions() for b in one.read(p)) == sum(json.loads(x).get("category") == "chat" for x in open(paths[0]).read().split("\n") if x.strip())


def test_broken_lines(spark, tmp_path):
    folder = tmp_path / "c"
    folder.mkdir()
    good = [f'{{"id": "{i}"}}' for i in range(50)]
    bad = ["{", '{"a": NaN}', '{"a": 1, "a": 2}', "\x00"]
    (folder / "a.jsonl").write_bytes(("\n".join(good[:20] + bad + good[20:]) + "\n").encode() + b'{"id": "\xff"}\n')
    with pytest.raises(Exception, match="bad JSON in .*a.jsonl, at byte"):
        files.scan_json_lines(spark, [str(folder)]).count()
    lines = files.scan_json_lines(spark, [str(folder)], quarantine=str(tmp_path / "q"), block_bytes=100)
    for _ in range(2):  # a second run writes the same files
        assert [json.loads(r["raw"])["id"] for r in lines.orderBy("ord").select("raw").collect()] == [str(i) for i in range(50)]
        held = spark.read.json(str(tmp_path / "q"))
        assert [r["raw"] for r in held.orderBy("at").collect()] == [*bad, '{"id": "�"}']
    assert files.scan_json_lines(spark, [str(tmp_path / "none")]).count() == 0
    (folder / "a.jsonl").write_text("")
    assert files.scan_json_lines(spark, [str(folder)]).count() == 0


def plain_report(rows, meta, found):
    lines = []
    for r in sorted(rows):
        missed = "\n    - missed rubric terms: " + ", ".join(r[7]) if r[7] else ""
        lines.append(f"- [{'REVIEW' if r[6] is None else 'PASS' if r[6] else 'FAIL'}] `{r[1]}` ({r[2]}): {r[4]}{missed}" + (f"\n    - error: {r[8]}" if r[8] else "") + "\n")
    return "".join(sinks.summary_markdown(found, meta, ())) + "".join(lines)


def test_reports_by_executors(spark, tmp_path, monkeypatch):
    rng, path = random.Random(3), str(tmp_path / "run")
    schema = "ord bigint, id string, category string, source string, type string, output string, pass boolean, missed array<string>, error string"
    rows = [(i, f"t {i}-é%20", f"c{i % 7}", "baseline", "freeform", None if i % 50 == 0 else f"out\n{i} ü", rng.choice([True, False, None]), ["a"] if i % 9 == 0 else None, "e\nf" if i % 11 == 0 else None) for i in range(2000)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, schema).repartition(8)
    sinks.write_report(spark.createDataFrame([(0, "old", "c", "s", "t", "o", True, None, None)], schema), path, {})
    monkeypatch.setattr(type(df), "toLocalIterator", lambda *a, **k: pytest.fail("rows pass the driver"))
    found = sinks.write_report(df, path, {"model": "m"})
    report = json.loads(open(f"{path}/report.json", encoding="utf-8").read())
    assert report["meta"] == {"model": "m"} and report["summary"] == found and found["passed"] == sum(r[6] is True for r in rows)
    assert [tuple(r[c] for c in ("id", "category", "source", "type", "output", "pass", "missed", "error")) for r in report["results"]] == [r[1:] for r in rows]
    assert open(f"{path}/summary.md", encoding="utf-8").read() == plain_report(rows, {"model": "m"}, found)
    assert {os.path.basename(p): open(p, encoding="utf-8").read() for p in glob.glob(f"{path}/outputs/*")} == {f"{r[1]}.txt": r[5] or "" for r in rows}
    assert sorted(os.listdir(path)) == ["outputs", "report.json", "summary.md"]
    assert spark.read.json(f"{path}/report.json", multiLine=True).count() == 1


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "out")
    files.write_file_set(spark.createDataFrame([("a", "1")], "name string, content string"), path)
    many = spark.range(200, numPartitions=8).select(F.when(F.col("id") == 150, "x/y").otherwise(F.col("id").cast("string")).alias("name"), F.lit("new").alias("content"))
    with pytest.raises(Exception, match="can't name a file"):
        files.write_file_set(many, path)
    assert os.listdir(path) == ["a"] and os.listdir(tmp_path) == ["out"]
    files.write_file_set(many.where("name <> 'x/y'"), path)
    assert len(os.listdir(path)) == 199 and os.listdir(tmp_path) == ["out"]
    files.write_file_set(many.limit(0), path)
    assert os.listdir(path) == []
    with pytest.raises(Exception, match="can't name a file"):
        sinks.write_report(spark.createDataFrame([(1, "a/b", "c", "s", "t", "o", True, None, None)], "ord bigint, id string, category string, source string, type string, output string, pass boolean, missed array<string>, error string"), str(tmp_path / "r"), {})
    assert not os.path.exists(tmp_path / "r/report.json")


def test_teacher_totals_without_tasks(spark, tmp_path):
    rows = spark.createDataFrame([("distilled", "coding")], "reason string, category string")
    tasks = spark.createDataFrame([(f't"{i}\n', "coding", None, 3, i) for i in range(40)], "id string, category string, type string, samples int, passed int").repartition(4)
    stats = sinks.write_teacher(rows, tasks, str(tmp_path / "t"), {"model": "m"}, per_task=False)
    held = json.loads((tmp_path / "t/stats.json").read_text())
    assert "per_task" not in stats and len(held.pop("per_task")) == 40 and held == stats
    again = sinks.write_teacher(rows, tasks.limit(0), str(tmp_path / "t"), {"model": "m"})
    assert json.loads((tmp_path / "t/stats.json").read_text()) == again and again["per_task"] == {}
