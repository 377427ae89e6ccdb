"""The clustered layout, against brute force."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from broadsheet.llm import layout
from broadsheet.llm import queries as Q
from pyspark.sql import functions as F

from tests import compare
from tests.conftest import DATA

SCHEMA = "doc_id long, text string, lang string, source string, z string, `position` string"


def modelled(rows: list[tuple], file_rows: int) -> list[tuple]:
    """What the operator gives for (doc_id, text, lang, source), by loops over all rows, files and queries."""
    n = len(rows)

    def known(x):
        return (x is not None, x.encode() if isinstance(x, str) else x or 0)

    values = [(known(s), known(g), len(t.encode()) if t is not None else -1, known(zlib.crc32(str(i).encode()) % 365 if i is not None else None)) for i, t, g, s in rows]
    cells = [tuple(8 * sum(w[d] < v[d] for w in values) // n for d in range(4)) for v in values]

    def z(c):
        return int("".join(f"{c[d]:03b}"[k] for k in range(3) for d in (3, 2, 1, 0)), 2)

    order = sorted(range(n), key=lambda r: (z(cells[r]), known(rows[r][0])))
    files = [order[k : k + file_rows] for k in range(0, n, file_rows)]
    bounds = [[(min(cells[r][d] for r in f), max(cells[r][d] for r in f)) for d in range(4)] for f in files]
    reach, out = (0, 0, 1, 1), []
    for position, r in enumerate(order):
        c = cells[r]
        touched = sum(all(lo <= c[d] + reach[d] and hi >= c[d] - reach[d] for d, (lo, hi) in enumerate(b)) for b in bounds)
        matching = sum(any(all(abs(cells[x][d] - c[d]) <= reach[d] for d in range(4)) for x in f) for f in files)
        out.append((rows[r][0], z(c), position, position // file_rows, touched, matching, ",".join(f"{lo},{hi}" for lo, hi in bounds[position // file_rows])))
    return out


def found(spark, rows: list[tuple], file_rows: int) -> list[tuple]:
    df = spark.createDataFrame([(*r, "z", "p") for r in rows], SCHEMA).repartition(5)
    return [tuple(r) for r in Q.laid_out(df, file_rows).select("doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds").orderBy("position").collect()]


def test_against_brute_force(spark):
    random.seed(5)
    rows = [(i, "é" * min(int(random.paretovariate(0.7)), 5000), random.choice(["en", "en", "de", None, "é"]), f"src{random.choice([0, 0, 0, 1, 2, 3])}") for i in range(700)]
    for file_rows in (20, 64, 2000):
        assert found(spark, rows, file_rows) == modelled(rows, file_rows)


def test_hostile_rows(spark):
    rows = [(None, None, None, None), (None, None, None, None), (7, "", "", ""), (7, "", "", ""), (7, "x" * 3_000_000, "en", "s"), (-3, "ß", "\U0001f600", "￿"), (2, None, "en", None)]
    assert found(spark, rows, 2) == modelled(rows, 2)
    same = [(1, "a", "en", "s")] * 50
    assert found(spark, same, 7) == modelled(same, 7)
    assert found(spark, [], 7) == []


def test_query_against_sql(spark, duck, monkeypatch):
    got = Q.op11_layout(spark, f"{DATA}/sf0.01").toPandas()
    assert compare.rows(got) == compare.rows(duck(f"{DATA}/sf0.01").sql(Q.ORACLES["op11_layout"]).df())
    sql = Q.ORACLES["op11_layout"].replace("// 2000", "// 30")
    laid = Q.laid_out(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"), 30).select(*got.columns).toPandas()
    assert compare.rows(laid) == compare.rows(duck(f"{DATA}/sf0.01").sql(sql).df())


def test_dilation():
    random.seed(2)
    for reach in range(4):
        grid = np.array(random.choices([False, True], [9, 1], k=6 * 7)).reshape(6, 7)
        for axis in (0, 1):
            got = layout.dilated(grid, axis, reach)
            g = grid if axis == 0 else grid.T
            want = np.array([[any(g[k, j] for k in range(max(0, i - reach), min(len(g), i + reach + 1))) for j in range(g.shape[1])] for i in range(g.shape[0])])
            assert ((got if axis == 0 else got.T) == want).all()


def test_written_files(spark, tmp_path):
    df = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 17).alias("a"), F.crc32(F.col("id").cast("string")).alias("b"), F.lit("text").alias("file"))
    dims = [layout.Dimension("a", F.col("a"), 1), layout.Dimension("b", F.col("b"))]
    laid = layout.clustered(df, dims, cells=4, file_rows=50)
    assert "a" in laid.columns and laid.columns.count("file") == 1
    layout.write_files(laid, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 300 and back.select("file").distinct().count() == 6
    want = [r.doc_id for r in laid.collect() if abs(r.c0 - 1) <= 1 and r.c1 == 2]
    assert want and sorted(r.doc_id for r in layout.in_neighbourhood(back, (1, 2), dims).collect()) == sorted(want)


def test_too_many_cells(spark):
    with pytest.raises(ValueError, match="too many cells"):
        layout.read_by_query(spark.createDataFrame([(1, 1)], "file long, cell long"), [layout.Dimension(str(i), F.lit(i)) for i in range(9)])
