"""What several operators share: sums in an order, against loops."""

from __future__ import annotations

import random

import pytest
from broadsheet.shared import before
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(3)
    made = [(i, random.choice(["a", "a", "a", "b", None]), random.randint(0, 50), random.choice([None, *range(9)])) for i in range(3000)]
    return spark.createDataFrame(made, "i long, g string, o int, v long").repartition(7), made


def test_number_in_order(rows):
    df, made = rows
    got = before(df, ["o", F.desc("i")]).collect()
    want = {m[0]: n for n, m in enumerate(sorted(made, key=lambda m: (m[2], -m[0])))}
    assert {r.i: r.before for r in got} == want


def test_ties_are_numbered_once(rows):
    df, made = rows
    got = before(df, ["o"]).collect()
    assert sorted(r.before for r in got) == list(range(len(made)))
    assert [r.o for r in sorted(got, key=lambda r: r.before)] == sorted(m[2] for m in made)


@pytest.mark.parametrize("value", [None, "v"])
def test_in_groups(rows, value):
    df, made = rows
    got = {r.i: r.sum for r in before(df, ["o", "i"], value, ["g"], "sum").collect()}
    want, held = {}, {}
    for i, g, _, v in sorted(made, key=lambda m: (m[2], m[0])):
        want[i] = held.get(g, 0)
        held[g] = want[i] + (1 if value is None else v or 0)
    assert got == want


def test_empty(rows):
    df, _ = rows
    assert before(df.where("false"), ["o"]).count() == 0 and before(df.where("false"), ["o"], "v", ["g"]).count() == 0
