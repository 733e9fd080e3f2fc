"""Logs, problems and report files."""

import json

import pytest
from pyspark.sql import functions as F

from waymark import session
from waymark.operators import reports as R
from waymark.operators import trajectory as T
from waymark.plans import bundle
from waymark.sources import jsonl, problems, report_files


def log(tmp_path, records, name="log.jsonl", tail=""):
    f = tmp_path / name
    f.write_text("\n\n  \n".join(json.dumps(r) for r in records) + "\n" + tail, encoding="utf-8")
    return str(f)


def episode(i, states=("WRONG_ALGORITHM", "FEEDBACK_PASS"), **extra):
    return {
        "episode_id": f"e{i}", "problem_id": f"p{i}", "model_id": "m", "max_attempts": 5,
        "trajectory": [
            {"episode_id": f"e{i}", "state": s, "attempt": k + 1, "feedback_pass_rate": 0.5 * k,
             "failing_input": [1, "é"] if k == 0 else None, **extra}
            for k, s in enumerate(states)
        ],
        "final_outcome": "FINAL_PASS", "final_hidden_pass_rate": 1.0,
        "metadata": {"episode_seed": i % 2, "split_seed": 42},
    }


def test_read_keeps_order_and_missing_fields(spark, tmp_path):
    path = log(tmp_path, [episode(i) for i in range(5)])
    e = jsonl.read_episodes(spark, path)
    assert [r[0] for r in e.orderBy("episode_seq").select("episode_id").collect()] == [f"e{i}" for i in range(5)]
    flat = T.flatten_attempts(e)
    assert flat.filter("edit_distance_from_previous is not null").isEmpty()
    assert R.edit_distance_summary(flat).isEmpty()  # a log from before the field existed
    assert flat.select(F.to_json("failing_input")).first()[0] == '[1,"é"]'


def test_malformed_line(spark, tmp_path):
    path = log(tmp_path, [episode(0)], tail='{"episode_id": \n')
    with pytest.raises(Exception):
        jsonl.read_episodes(spark, path).select("episode_id").collect()
    bad = jsonl.malformed_lines(spark, path).collect()
    assert len(bad) == 1 and bad[0]["line"].startswith('{"episode_id":') and "log.jsonl" in bad[0]["file"]
    assert bad[0]["line_number"] == 2 and jsonl.first_malformed(spark, path).endswith("log.jsonl:2")
    with pytest.raises(ValueError, match="log.jsonl:2"):
        bundle.analyze_log(spark, path, str(tmp_path / "out"), models=False)
    assert jsonl.first_malformed(spark, log(tmp_path, [episode(0)], "good.jsonl")) is None


def test_line_numbers_over_many_splits(spark, tmp_path):
    """Files that are read in hundreds of pieces, some without an end of line, some with blank lines and \\r\\n."""
    want = set()
    for name, end in (("a.jsonl", "\n"), ("b.jsonl", "\r\n"), ("c.jsonl", "\n")):
        lines = []
        for i in range(1, 401):
            broken = i % 37 == 0
            lines.append("" if i % 11 == 0 else json.dumps({"i": i, "é": "x" * (i % 90)})[: -1 if broken else None])
            if broken and lines[-1]:
                want.add((name, i, lines[-1]))
        (tmp_path / name).write_bytes((end.join(lines) + (end if name != "c.jsonl" else "")).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        got = jsonl.malformed_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r["file"].rsplit("/")[-1], r["line_number"], r["line"]) for r in got} == want and len(got) == len(want)


def test_batches_are_appended_once(spark, tmp_path):
    e = jsonl.read_episodes(spark, log(tmp_path, [episode(i) for i in range(4)]))
    one, two, out = e.filter("episode_id < 'e2'"), e.filter("episode_id >= 'e2'"), str(tmp_path / "out")
    for df, name in ((one, "n-1"), (two, "n-2"), (one, "n-1")):
        jsonl.append_batch(df, out, name)
    back = lambda: sorted(r[0] for r in jsonl.read_batches(spark, out, jsonl.EPISODE_DDL).select("episode_id").collect())
    assert back() == ["e0", "e1", "e2", "e3"]
    # a write that ended before its batch was listed, with a broken record in it
    left = tmp_path / "out" / "batches" / "batch=n-3"
    left.mkdir()
    (left / "part-0.txt").write_text(json.dumps(episode(9)) + "\n")
    assert back() == ["e0", "e1", "e2", "e3"]
    jsonl.append_batch(two.withColumn("episode_id", F.lit("f")), out, "n-3")
    assert back() == ["e0", "e1", "e2", "e3", "f", "f"]
    with pytest.raises(ValueError):
        jsonl.append_batch(one, out, "../x")


def test_staged_folders_can_be_cleared(spark):
    path = session.new_folder(spark)
    spark.range(3).write.parquet(path)
    kept, session._made[:] = [p for p in session._made if p != path], [path]
    session.clear_staged(spark)
    session._made[:] = kept
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_write_append_read(spark, tmp_path):
    e = jsonl.read_episodes(spark, log(tmp_path, [episode(i) for i in range(3)]))
    out = str(tmp_path / "out")
    jsonl.write_jsonl(e, out)
    jsonl.append_jsonl(e, out)
    back = jsonl.read_episodes(spark, out)
    assert back.count() == 6
    line = next(x for f in (tmp_path / "out").glob("part-*") for x in f.read_text(encoding="utf-8").splitlines())
    record = json.loads(line)
    assert list(record) == sorted(record) and "é" in line
    assert list(record["trajectory"][0]) == sorted(record["trajectory"][0])
    assert R.transition_table(back).first()["count"] == 6


def test_csv_and_parquet(spark, tmp_path):
    e = jsonl.read_episodes(spark, log(tmp_path, [episode(0, ("FEEDBACK_PASS",))]))
    tables = {"attempts": T.flatten_attempts(e), "transitions": R.transition_table(e)}
    report_files.write_reports(tables, str(tmp_path / "csv"), fmt="csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "csv" / "transitions"))
    assert back.columns == ["source_state", "destination_state", "count", "probability"] and back.isEmpty()
    report_files.write_reports(tables, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq" / "attempts")).count() == 1


DEMO = {
    "problem_id": "demo", "entry_point": "add", "prompt": "Add.",
    "tests": [{"input": [1, 2], "expected": 3}, {"input": [2.5, 3.5], "expected": 6.0, "test_id": "t"}],
}


def test_read_problems(spark, tmp_path):
    r = problems.read_problems(spark, log(tmp_path, [DEMO])).select(
        "problem_id", F.to_json("metadata").alias("m"), F.to_json("tests").alias("t")
    ).first()
    assert r["m"] == "{}" and json.loads(r["t"])[1] == {"input": [2.5, 3.5], "expected": 6, "test_id": "t"}


def test_detect_columns():
    found = problems.detect_columns(["task_id", "text", "code", "test_list", "function_name"], "mbpp")
    assert found["prompt"] == "text" and found["tests"] == "test_list"
    assert problems.detect_columns(["q", "fn", "tests"], "", {"prompt": "q", "entry_point": "fn"})["tests"] == "tests"
    with pytest.raises(ValueError, match="entry_point"):
        problems.detect_columns(["prompt", "tests"])
    with pytest.raises(ValueError, match="canonical"):
        problems.detect_columns(["prompt", "entry_point"])


def test_assert_statements():
    source = (
        "def check(candidate):\n"
        "    assert candidate([1, 2], k=3) == {'a': (1, None)}\n"
        "    assert obj.solve('x') == True\n"
        "    assert candidate(y) == 1\n"
        "    assert candidate(1) == {1, 2}\n"
        "    assert candidate(1) > 0\n"
        "    assert other(1) == 2\n"
        "assert fn() == -1\n"
    )
    got = problems.assert_tests(source, "solve")
    assert {(t["input"], t["expected"]) for t in got} == {
        ("[[1, 2]]", '{"a": [1, null]}'), ('["x"]', "true"), ("[]", "-1")
    }
    assert problems.assert_tests("assert (", "f") == [] == problems.assert_tests(None, "f")


def test_normalize_structured_lists_and_limits(spark):
    one = [{"input": "[1]", "expected": "1"}]
    df = spark.createDataFrame(
        [("b", one * 3), ("a", one * 2), ("c", one), ("d", one * 4)],
        "prompt string, tests array<struct<input:string,expected:string>>",
    ).withColumn("entry_point", F.lit("f"))
    got = problems.normalize_problems(df, "set", order_by="prompt", max_problems=2, max_tests=2).collect()
    assert [(r["problem_id"], r["prompt"], len(r["tests"])) for r in got] == [("set/0", "a", 2), ("set/1", "b", 2)]
    with pytest.raises(ValueError, match="order_by"):
        problems.normalize_problems(df, "set")


def test_list_of_sources(spark):
    df = spark.createDataFrame(
        [("1", "q", "f", ["assert f(1) == 2", "assert (", "assert f('a') == [1]"])],
        "task_id string, text string, function_name string, test_list array<string>",
    )
    r = problems.normalize_problems(df, "mbpp").first()
    assert [(t["input"], t["expected"]) for t in r["tests"]] == [("[1]", "2"), ('["a"]', "[1]")]


def test_variant_tests(spark):
    """Lists that mix texts, objects and other things; a text alone; what is no list."""
    given = [
        ["assert f(1) == 2\nassert g(1) == 1", {"input": [1, "é"], "expected": None, "test_id": 7}, "assert (", {"input": 1}, 3, None,
         {"expected": {"b": 1, "a": [2.5]}, "input": "x"}, "assert candidate() == 'q'"],
        "assert f('a', [1]) == {'k': None}", {"input": 1, "expected": 2}, [], 5, None, [["assert f(1) == 1"]],
    ]
    rows = [(i, json.dumps(v)) for i, v in enumerate(given)] + [(9, None)]
    df = spark.createDataFrame(rows, "i int, v string").select("i", F.parse_json("v").alias("tests"), F.lit("f").alias("entry_point"))
    got = {r["i"]: [(t["input"], t["expected"], t["test_id"]) for t in r["t"]] for r in df.select("i", problems.parse_tests(df).alias("t")).collect()}
    assert got[0] == [
        ("[1]", "2", None), ('[1,"é"]', "null", "7"), ('"x"', '{"a":[2.5],"b":1}', None), ("[]", '"q"', None)
    ]
    assert got[1] == [('["a", [1]]', '{"k": null}', None)]
    assert all(got[i] == [] for i in (2, 3, 4, 5, 6, 9))
    capped = df.select("i", problems.parse_tests(df, max_tests=2).alias("t")).filter("i = 0").first()["t"]
    assert [t["input"] for t in capped] == ["[1]", '[1,"é"]']


def test_digest_of_a_table(spark):
    rows = [(1, 0.1 + 0.2, "a", True), (2, None, None, False), (3, -1e-9, "b|c", None)]
    df = spark.createDataFrame(rows, "i int, x double, s string, b boolean")
    one = bundle.table_digest(df).first()
    assert one == bundle.table_digest(df.orderBy(F.desc("i")).repartition(3)).first() and one["n_rows"] == 3
    assert one == bundle.table_digest(df.withColumn("x", F.col("x") + 1e-12).withColumn("m", F.array("i"))).first()
    assert one["digest"] != bundle.table_digest(df.withColumn("s", F.upper("s"))).first()["digest"]
    assert tuple(bundle.table_digest(df.filter("false")).first()) == (0, "0")
