"""Text columns against plain Python on small fixtures."""

import ast
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from waymark.functions import audit, labels, text, values


def apply(spark, cells, *columns, ddl="s string"):
    df = spark.createDataFrame([c if isinstance(c, tuple) else (c,) for c in cells], ddl)
    return [tuple(r) for r in df.select(*columns).collect()]


def test_hash_seed_excerpt(spark):
    got = apply(
        spark, ["abc", None, "", "ünï"],
        text.sha256_text("s"), text.stable_seed("s", 42), text.excerpt("s", 2),
    )
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert [g[0] for g in got] == [sha("abc"), sha(""), sha(""), sha("ünï")]
    assert got[0][1] == int(sha("abc:42")[:8], 16) and got[3][1] == int(sha("ünï:42")[:8], 16)
    assert [g[2] for g in got] == ["ab", None, None, "ün"]


def test_extract_code(spark):
    cases = {
        "x\n```python\na = 1\n```\ny": "a = 1",
        "```PY\n\n  a\n\n```": "a",
        "```\nfirst\n``` ```python\nsecond\n```": "first",
        "```python\n```": "",
        "  \n bare \x0b ": "bare",
        "```js\nno\n```": "```js\nno\n```",
        "": "",
    }
    assert [g[0] for g in apply(spark, list(cases), text.extract_code("s"))] == list(cases.values())
    assert apply(spark, [None], text.extract_code("s")) == [("",)]


def test_incomplete(spark):
    long = "def f(x):\n    a = 1\n    b = 2\n    c = 3\n    pass"
    cases = [
        ("  ", "f", "no code in the answer"),
        ("x = 1", "f", "function not defined: f"),
        ("def f(x):\n    pass", "f", r"placeholder found: \bpass\b"),
        ("def f(x):\n    return bypass", "f", None),
        ("def f(x):\n    # todo", "f", "placeholder found: TODO"),
        ("def f(x):\n    raise NotImplementedError", "f", "placeholder found: NotImplementedError"),
        (long, "f", None),
        ("def f(x):\n\n\n    # Your Code Here\n", "f", "placeholder found: your code here"),
    ]
    got = apply(spark, [c[:2] for c in cases], text.incomplete_reason("s", "e"), ddl="s string, e string")
    assert [g[0] for g in got] == [c[2] for c in cases]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def test_edit_distance_by_brute_force(spark):
    words = ["kitten", "sitting", "", "é", "a", "flaw", "lawn", "日本語", "日本", "same", "same"]
    pairs = [(a, b) for a in words for b in words]
    got = apply(spark, pairs, text.edit_distance("a", "b"), ddl="a string, b string")
    want = [levenshtein(a, b) / max(len(a), len(b), 1) for a, b in pairs]
    assert [g[0] for g in got] == pytest.approx(want)
    assert apply(spark, [("a", None)], text.edit_distance("a", "b"), ddl="a string, b string") == [(None,)]


def test_edit_buckets(spark):
    cases = {0.0: "identical", 0.049: "cosmetic", 0.05: "targeted", 0.2: "rewrite",
             0.4999: "rewrite", 0.5: "full_replacement", 1.0: "full_replacement"}
    got = apply(spark, list(cases), labels.edit_bucket("d"), ddl="d double")
    assert [g[0] for g in got] == list(cases.values())


def test_labels(spark):
    cases = [(0, 0, "ASSERTION_FAILURE"), (0, 1, "WRONG_ALGORITHM"), (1, 2, "NEAR_MISS"),
             (1, 3, "PARTIAL_PASS"), (2, 3, "NEAR_MISS"), (0, 5, "WRONG_ALGORITHM")]
    got = apply(spark, [c[:2] for c in cases], labels.pass_count_state("p", "t"),
                labels.pass_rate("p", "t"), ddl="p int, t int")
    assert [g[0] for g in got] == [c[2] for c in cases]
    assert got[0][1] == 0.0 and got[2][1] == 0.5
    names = ["ModuleNotFoundError", "UnboundLocalError", "KeyError", "DivisionByZero", "LookupError", None]
    assert [g[0] for g in apply(spark, names, labels.exception_state("s"))] == [
        "IMPORT_ERROR", "NAME_ATTRIBUTE_ERROR", "INDEX_KEY_ERROR", "ZERO_DIVISION_ERROR",
        "TYPE_VALUE_ERROR", "TYPE_VALUE_ERROR",
    ]
    assert apply(spark, [(3, 0), (3, None)], labels.normalized_attempt("a", "m"), ddl="a int, m int") == [(3.0,), (3.0,)]


def test_audit(spark):
    cases = {
        "import os": "import os",
        "import math, sys.path": "import sys.path",
        "from http.client import x": "from http.client import ...",
        "from .os import x\nfrom . import os": "from os import ...",
        "y = open('f')": "call to open",
        "a.b.remove(1)": "attribute call .remove",
        "z = a.environ['x']": "attribute access .environ",
        "def f():\n    import os\nx = eval('1')": "import os",
        "def (": None,
        "reopened = 1": None,
        "# import os": None,
        "ｏｐｅｎ('f')": "call to open",
        "": None,
    }
    assert [g[0] for g in apply(spark, list(cases), audit.blocked_operation("s"))] == list(cases.values())


def test_audit_prefilter_changes_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    code = F.concat(F.lit("# "), F.regexp_replace("text", r"\s", " "), F.lit("\nx = a.popen\n"))
    assert docs.filter(~audit.blocked_operation(code).eqNullSafe("attribute access .popen")).isEmpty()


def test_values(spark):
    cases = [
        ("[0,1]", "[0, 1]", True, True),
        ("[[1,2],[3,4]]", "[[1, 2], [3, 4]]", True, True),
        ("1", "1.0", True, True),
        ("true", "1", True, True),
        ("1e2", "100", True, True),
        ('"01"', "[0, 1]", False, False),
        ('{"a":1}', "[1]", False, False),
        ("[9,9]", "[0,1]", True, False),
        ('{"b":2,"a":1}', '{"a":1,"b":2}', True, True),
        ("9007199254740993", "9007199254740992", True, False),
        ("null", "null", True, True),
        ("<object>", '"x"', True, False),
        ("null", "0", False, False),
    ]
    got = apply(
        spark, [c[:2] for c in cases],
        values.format_matches("a", "e"), values.values_equal("a", "e"), ddl="a string, e string",
    )
    assert [g[0] for g in got] == [c[2] for c in cases]
    assert [g[0] and g[1] for g in got] == [c[3] for c in cases]


def test_json_safe(spark):
    got = apply(spark, ["[1, 2]", "<object at 1>"], F.to_json(values.json_safe("s")))
    assert got == [("[1,2]",), ('"<object at 1>"',)]
