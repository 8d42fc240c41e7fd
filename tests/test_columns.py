from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphspark.functions import columns as C
from graphspark.plans.graph import parse_place


def values(spark, function, texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(function(F.col("x"))).collect()]


def test_ids_and_scopes(spark):
    ids = ["a/b.py#", "a/b.py#f", "a/b.py#C.m", "#external:os.path", "plain"]
    assert values(spark, C.file_of, ids) == ["a/b.py", "a/b.py", "a/b.py", "", "plain"]
    assert values(spark, C.scope_of, ids) == ["a/b.py", "a/b.py:f", "a/b.py:C.m", ":external:os.path", "plain"]
    assert values(spark, C.inner_scope, ids)[2] == "a/b.py:C.m"


def test_locations_are_numbers(spark):
    places = ["a.py:10:2", "C:/x/a.py:9:0", "broken", "a.py:1:x"]
    assert values(spark, C.location_line, places) == [10, 9, None, None]
    assert values(spark, C.location_file, places) == ["a.py", "C:/x/a.py", "", ""]


@pytest.mark.parametrize(
    ("code", "role"),
    [
        ("def f():", "definition"), ("  class A:", "definition"), ("func (s *T) M() {", "definition"), ("User struct { ID int }", "definition"), ("async function f() {}", "definition"),
        ("import os", "import"), ("from a import b", "import"), ("const x = require('y')", "import"), ("f(1)", "call"), ("x = f(1)", "reference"), ("x", "reference"), ("", "reference"),
    ],
)
def test_role(spark, code, role):
    assert values(spark, C.role, [code]) == [role]


def test_search_takes_no_wildcards_and_folds_ascii_alone(spark):
    texts = ["user_service", "userXservice", "USER_SERVICE", "É", None]
    assert values(spark, lambda x: C.contains_folded(x, "User_s"), texts) == [True, False, True, False, None]
    assert values(spark, lambda x: C.contains_folded(x, "é"), ["É", "é"]) == [False, True]


def test_languages(spark):
    assert values(spark, C.language, ["a.py", "b.JS", "c.tsx", "d.go", "e.txt", "no"]) == ["python", "javascript", "typescript", "go", "", ""]


def test_places():
    assert parse_place("a.py:3") == ("a.py", 3)
    assert parse_place("a.py:3:7") == ("a.py", 3)
    for bad in ("a.py", "a.py:x", ""):
        with pytest.raises(ValueError):
            parse_place(bad)
