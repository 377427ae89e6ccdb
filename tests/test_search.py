"""The search index gives the rows of the plain condition and reads only blocks that can match."""

from __future__ import annotations

import random

import pytest
from broadsheet.operators import search as I
from broadsheet.operators.feed import matches
from pyspark.sql import functions as F

SCHEMA = "id long, title string, summary string, content string"


def test_literal_runs():
    assert I.literal_runs("%a%b_c%") == ["a", "b", "c"]
    assert I.literal_runs("%50\\%off%") == ["50%off"] and I.literal_runs("%%_") == [] and I.literal_runs("") == []


def test_needed_grams(spark):
    assert I.needed_grams(spark, "Abcd e") == {"abc", "bcd"}
    assert I.needed_grams(spark, "he_lo xy") == {"he", "lo", "xy"} and I.needed_grams(spark, "a %% _b") == set()


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Random texts over few letters, some with null ids, null texts, wildcards, marks of several bytes and upper case that has special lower case."""
    rng = random.Random(5)
    letters = ["a", "b", "c", "A", "É", "é", "Σ", "σ", "İ", "😀", "%", "_", "\\", " ", "\n"]
    text = lambda: None if rng.random() < 0.1 else "".join(rng.choices(letters, k=rng.choice([0, 1, 2, 5, 9])))
    rows = [(None if i % 50 == 7 else rng.randrange(-300, 300), text(), text(), text()) for i in range(600)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, SCHEMA)
    return df, I.SearchIndex.build(df, str(tmp_path_factory.mktemp("index") / "a"), 10)


@pytest.mark.parametrize("query", ["", "a", "ab", "ABC", "bca cab", "éΣ", "a_c", "b%a", "\\\\%a", "\\\\_", "😀a", "σ😀", "İa", "aİ", "ΣΣ", "aΣ", "%%", "zz", "ab zz", "a\nb"])
def test_rows_of_the_plain_condition(many, query):
    df, index = many
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, index.search(query).collect()), key=key) == sorted(map(tuple, df.where(matches(query)).collect()), key=key)


def test_blocks_that_cannot_match_are_not_read(spark, tmp_path, monkeypatch):
    rows = [(i, None, "x", f"common needle{i}") for i in range(200)]
    index = I.SearchIndex.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "i"), 10)
    assert [r[0] for r in index.blocks("NEEDLE137").collect()] == [13] and index.blocks("common").count() == 20
    found = index.search("needle137")
    assert [r.id for r in found.collect()] == [137]
    files = found.select(F.input_file_name()).inputFiles()
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert files and "PartitionFilters" in scan and "IN (-1,13)" in scan
    monkeypatch.setattr(I, "NAMED", 3)  # more blocks than are named: joined
    assert index.search("common").count() == 200 and [r.id for r in index.search("needle137 common").collect()] == [137]


def test_rows_added_later_are_found(spark, tmp_path):
    index = I.SearchIndex.build(spark.createDataFrame([(1, "first words", None, None)], SCHEMA), str(tmp_path / "i"), 10)
    index.add(spark.createDataFrame([(2, None, None, "later words"), (None, "WORDS without id", None, None)], SCHEMA))
    ids = lambda q: sorted((r.id for r in index.search(q).collect()), key=str)
    assert ids("words") == [1, 2, None] and ids("later") == [2] and ids("without words") == [None] and ids("first") == [1]


def test_empty_table(spark, tmp_path):
    index = I.SearchIndex.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "i"), 10)
    assert index.search("anything").columns == ["id", "title", "summary", "content"] and index.search("anything").count() == index.search("").count() == 0


def test_a_long_text(spark, tmp_path):
    long = "ab " * 400_000 + "needle"
    index = I.SearchIndex.build(spark.createDataFrame([(1, None, None, long), (100, None, None, "ab")], SCHEMA), str(tmp_path / "i"), 10)
    assert [r.id for r in index.search("NEEDLE").collect()] == [1] and index.blocks("b needle").count() == 1
