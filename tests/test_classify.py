"""Result tables, scripted answers, test splits, prompts."""

import pytest
from pyspark.sql import functions as F

from waymark.functions.feedback import feedback_text
from waymark.functions.values import values_equal
from waymark.operators.classify import classify_results, scripted_responses
from waymark.operators.prompts import repair_prompts
from waymark.operators.splitting import split_tests

RESULT = "candidate_id string, test_pos int, input string, actual string, expected string, exception_name string"


def test_states(spark):
    def case(cid, *tests):
        return [(cid, i, f"[{i}]", *t) for i, t in enumerate(tests)]

    ok, bad, odd = ("1", "1.0", None), ("2", "1", None), ("[1]", "1", None)
    boom = (None, "1", "KeyError")
    data = [
        *case("pass", ok, ok),
        *case("near", ok, bad),
        *case("wrong", bad),
        *case("part", ok, bad, bad),
        *case("raise", ok, bad, boom, ok),
        *case("type", ok, odd, boom),
    ]
    results = spark.createDataFrame(data, RESULT)
    known = spark.createDataFrame([(c,) for c in "pass near wrong part raise type none".split()], "candidate_id string")
    got = {r["candidate_id"]: r for r in classify_results(results, candidates=known).collect()}
    assert {k: (r["state"], r["passed"], r["total"]) for k, r in got.items()} == {
        "pass": ("FEEDBACK_PASS", 2, 2),
        "near": ("NEAR_MISS", 1, 2),
        "wrong": ("WRONG_ALGORITHM", 0, 1),
        "part": ("PARTIAL_PASS", 1, 3),
        "raise": ("INDEX_KEY_ERROR", 1, 4),
        "type": ("OUTPUT_FORMAT_ERROR", 1, 3),
        "none": ("FEEDBACK_PASS", 0, 0),
    }
    assert got["none"]["pass_rate"] == 0.0
    assert (got["part"]["failing_input"], got["part"]["actual_output"]) == ("[1]", "2")
    assert (got["raise"]["failing_input"], got["raise"]["actual_output"]) == ("[2]", None)
    assert got["raise"]["exception_type"] == "KeyError"
    assert (got["type"]["expected_format"], got["type"]["actual_format"]) == ("number", "list")
    assert got["pass"]["failing_input"] is None and got["pass"]["exception_type"] is None


def test_scripted(spark):
    scripts = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b")], "problem_id string, attempt int, response string")
    attempts = spark.createDataFrame([("p", 1), ("p", 2), ("p", 5)], "problem_id string, attempt int")
    got = scripted_responses(attempts, scripts).orderBy("attempt").collect()
    assert [r["response"] for r in got] == ["a", "b", "b"]
    lost = spark.createDataFrame([("q", 1)], "problem_id string, attempt int")
    with pytest.raises(Exception, match="no scripted responses"):
        scripted_responses(lost, scripts).collect()
    assert scripted_responses(lost, scripts, on_missing="null").first()["response"] is None


def test_split(spark):
    problems = spark.range(2, 40).select(
        F.concat(F.lit("p"), "id").alias("problem_id"),
        F.sequence(F.lit(0).cast("long"), F.col("id") - 1).alias("tests"),
    )
    for ratio in (0.2, 0.5):
        for r in split_tests(problems, ratio, 7).collect():
            n = len(r["tests"])
            assert len(r["feedback_tests"]) == min(max(3, round(n * ratio)), n - 1)
            assert sorted(r["feedback_tests"] + r["hidden_tests"]) == r["tests"]
            assert r["feedback_tests"] == sorted(r["feedback_tests"])
    again = split_tests(problems.repartition(7), 0.5, 7)
    assert again.exceptAll(split_tests(problems, 0.5, 7)).isEmpty()
    assert not split_tests(problems, 0.5, 8).exceptAll(again).isEmpty()
    with pytest.raises(ValueError):
        split_tests(problems, 1.0)
    with pytest.raises(Exception, match="at least two tests"):
        split_tests(spark.createDataFrame([("p", [1])], "problem_id string, tests array<int>")).collect()


def test_prompts_of_three_attempts(spark):
    code = "def add_numbers(a, b):\n    return a - b"
    rows = spark.createDataFrame(
        [(k, "WRONG_ALGORITHM", code) for k in (1, 2, 3)], "attempt int, state string, code string"
    ).select(
        "*",
        feedback_text(
            {"state": F.col("state"), "passed": F.lit(0), "total": F.lit(3),
             "failing_input": F.lit("[1, 2]"), "expected_output": F.lit("3"), "actual_output": F.lit("-1")}
        ).alias("feedback"),
    )
    episode = rows.groupBy().agg(
        F.array_sort(F.collect_list(F.struct("attempt", "state", "code", "feedback"))).alias("trajectory")
    ).select(
        F.lit("e").alias("episode_id"), F.lit("p").alias("problem_id"),
        F.lit("Write add_numbers(a, b).").alias("prompt"), F.lit(3).alias("max_attempts"), "trajectory",
    )
    got = {r["attempt"]: r["prompt"] for r in repair_prompts(episode).collect()}
    assert sorted(got) == [1, 2, 3]
    assert "previous" not in got[1].lower() and "add_numbers" in got[1]
    for part in ("return a - b", "Expected output", "Actual output", "WRONG_ALGORITHM"):
        assert part in got[2]
    assert "Prior attempts" not in got[2]
    assert "Prior attempts" in got[3] and "Attempt 1:" in got[3]
    assert got[3].count("return a - b") == 2 and "Attempt 2:" not in got[3]


def test_prompt_for_the_next_attempt(spark):
    e = spark.createDataFrame(
        [("open", "p", "t", 5, [(1, "SYNTAX_ERROR", "x", "f")]),
         ("done", "p", "t", 5, [(1, "FEEDBACK_PASS", "x", "f")])],
        "episode_id string, problem_id string, prompt string, max_attempts int, "
        "trajectory array<struct<attempt:int,state:string,code:string,feedback:string>>",
    )
    got = sorted((r["episode_id"], r["attempt"]) for r in repair_prompts(e).collect())
    assert got == [("done", 1), ("open", 1), ("open", 2)]


@pytest.mark.parametrize("policy", ["binary", " RAW_TERMINAL ", "error_category", "structured"])
def test_feedback_policies(spark, policy):
    cols = {"state": F.col("state"), "stderr_excerpt": F.lit("boom"), "message": F.lit("note")}
    df = spark.createDataFrame([(s,) for s in ("TIMEOUT", "MEMORY_ERROR", "SYNTAX_ERROR")], "state string")
    for r in df.select("state", feedback_text(cols, policy).alias("f")).collect():
        if policy == "binary":
            assert r["state"] not in r["f"] and "failed" in r["f"]
        else:
            assert f"Error category: {r['state']}" in r["f"]
        if "RAW" in policy:
            assert r["f"].endswith("boom")


@pytest.mark.parametrize("a, e, same", [
    ("[1e3]", "[1000]", True), ("[1e20]", "[100000000000000000000]", True), ("[true]", "[1]", True),
    ("9007199254740993", "9007199254740992.0", False), ('{"a": 1, "b": 2}', '{"b":2.0,"a":true}', True),
    ("[1, 2]", "[1,2]", True), ("[1,2]", "[2,1]", False), ('"x"', '"\\u0078"', True), ("True", "True", True),
    ("[" * 5000 + "]" * 5000, "[" * 5000 + " ]" + "]" * 4999, False), (None, "null", True), (None, "0", False),
])
def test_values_equal(spark, a, e, same):
    df = spark.createDataFrame([(a, e)], "a string, e string")
    assert df.select(values_equal("a", "e")).first()[0] is same


def test_candidate_with_most_of_the_tests(spark):
    """One candidate over many ranges of tests gives what plain counting gives, and no row meets by candidate alone."""
    n = F.col("id")
    rows = spark.range(30_000).select(
        F.when(n < 29_000, 0).otherwise(n % 50).alias("candidate_id"), n.alias("test_pos"),
        F.when(n % 7 == 0, "2").otherwise("1").alias("actual"), F.lit("1").alias("expected"),
        F.when(n == 20_001, "KeyError").alias("exception_name"),
    )
    got = {r["candidate_id"]: r for r in classify_results(rows).collect()}
    hot = got[0]
    assert hot["total"] == 29_000 + sum(i % 50 == 0 for i in range(29_000, 30_000)) and hot["exception_type"] == "KeyError"
    assert hot["passed"] == sum(i % 7 != 0 for i in range(20_001))
    assert got[3]["passed"] == sum(i % 50 == 3 and i % 7 != 0 for i in range(29_000, 30_000)) and got[3]["exception_type"] is None


def test_candidate_without_a_name(spark):
    """NULL candidates are one candidate, and what ended it is not lost."""
    data = [(None, 0, "[0]", "1", "1", None), (None, 1, "[1]", None, "1", "KeyError"), ("a", 0, "[0]", "1", "1", None)]
    known = spark.createDataFrame([(None,), ("a",), ("b",)], "candidate_id string")
    for candidates in (None, known):
        got = {r["candidate_id"]: r for r in classify_results(spark.createDataFrame(data, RESULT), candidates=candidates).collect()}
        assert (got[None]["state"], got[None]["passed"], got[None]["total"]) == ("INDEX_KEY_ERROR", 1, 2)
        assert got["a"]["state"] == "FEEDBACK_PASS" and len(got) == (2 if candidates is None else 3)
