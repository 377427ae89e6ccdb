"""Phrase collocations, against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from broadsheet.llm import _text as X
from broadsheet.llm import collocation as C
from broadsheet.llm import queries as Q

from tests import compare
from tests.conftest import DATA

SCHEMA = "phrase string, text string, lang string, n long"
HOSTILE = [
    None, "", " \t ", ".,;:!?\n\x0b\x0c\r", "A\tb  c", "a b\tC.", "...a..b", "\x1ca b\x85c a", "é É é é", "a" * 5000 + " b", "a b c a b c a b c", "x " * 2000, "The end;the END:the end", "\x00 a b", "new york\nnew york!New York", "a  b c d e f a b c d e f",
]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def modelled(rows, most_words=C.MOST_WORDS, least=C.LEAST, first=C.FIRST):
    total, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, most_words + 1):
                for i in range(len(words) - n + 1):
                    f[lang, tuple(words[i : i + n])] += 1
    found = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = []
    for (lang, w), a in found.items():
        inside = [b for (g, v), b in found.items() if g == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= 80 * a for b in inside):
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, l, r, total[lang], score))
    by: dict[str, list] = {}
    for x in sorted(out, key=lambda x: (-x[6], -x[2], x[1].encode())):
        by.setdefault(x[0], []).append(x)
    return sorted((lang, rank, *x[1:]) for lang, xs in by.items() for rank, x in enumerate(xs[:first], 1))


def found(spark, rows, **limits):
    df = spark.createDataFrame([("p", t, g, 1) for t, g in rows], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in C.collocations(df, **limits).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("limits", [{"least": 2}, {"least": 3, "first": 4}, {"least": 2, "most_words": 3}, {"least": 300, "first": 3}])
def test_against_brute_force(spark, monkeypatch, limits):
    random.seed(7)
    monkeypatch.setattr(C, "SLICE_BYTES", 900)
    words = ["a", "b", "B", "c", "d", "e", "ü", "über", "f", "g", "."]
    rows = [("".join(random.choice(words) + random.choice([" ", " ", "  ", "\t", ", ", "\n"]) for _ in range(random.randint(0, 40))), random.choice(["en", "en", "en", "de", None])) for _ in range(300)]
    rows += [(t, g) for t in HOSTILE for g in ("en", None)] + rows[:40]
    assert found(spark, rows, **limits) == modelled(rows, **limits)


def test_no_rows(spark):
    assert found(spark, []) == [] and found(spark, [(None, None), ("", "en"), ("one two", "en")]) == []


def test_one_piece_repeated(spark):
    rows = [("new york city hall", "en")] * 40 + [("x y " * 20, "en")]
    assert found(spark, rows) == modelled(rows)


def test_query_against_sql(spark, duck):
    got = Q.op13_collocations(spark, f"{DATA}/sf0.01").toPandas()
    assert len(got) > 20
    assert compare.rows(got) == compare.rows(duck(f"{DATA}/sf0.01").sql(Q.ORACLES["op13_collocations"]).df())


def test_pieces():
    raw, offsets = X.buffers(pa.array([t or "" for t in HOSTILE]))
    held, of = C.pieces_of(raw, offsets)
    want = [(" ".join(w), i) for i, t in enumerate(HOSTILE) for p in re.split("[.,;:!?\x0a-\x0d]", lower(t)) if (w := re.findall("[^\x20\x09]+", p))]
    assert [(b.decode(), i) for b, i in zip(held.to_pylist(), of.tolist(), strict=True)] == want


def test_the_filter_passes_what_it_holds():
    keys = np.random.default_rng(3).integers(0, 2**64, 200_000, dtype=np.uint64)
    bits = np.zeros(C.FILTER_BITS, bool)
    for bit in C._probes(keys[:100_000]):
        bits[C._bucket(keys[:100_000]) * C._SEGMENT + bit] = True
    got = C.passes(np.packbits(bits, bitorder="little"), keys)
    assert got[:100_000].all() and got[100_000:].mean() < 1e-4


def test_counting_goes_on_on_disk(monkeypatch):
    monkeypatch.setattr(C, "MEMORY", "40MB")
    tables = (pa.table({"k": np.arange(i, i + 200_000) % 900_000, "n": np.ones(200_000, np.int64)}) for i in range(0, 1_800_000, 200_000))
    got = pa.Table.from_batches(C.summed(tables, "k BIGINT, n BIGINT", "SELECT k, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY k"))
    assert got.num_rows == 900_000 and set(got["n"].to_pylist()) == {2}
