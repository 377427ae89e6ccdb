"""Exact dedup, Jaccard join, chat formatting, WARC and the pipeline: against brute force and round trips."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from broadsheet.llm import chat, exactdedup, jaccard, warc
from broadsheet.llm import queries as Q
from pyspark.sql import functions as F

from tests.compare import rows
from tests.conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def con(duck):
    return duck(f"{DATA}/sf0.01")


@pytest.mark.parametrize("name", ["op4_quality", "op5_warc", "op8_chat", "op9_exact_dedup", "op10_jaccard"])
def test_against_sql(spark, con, name):
    got, want = Q.QUERIES[name](spark, f"{DATA}/sf0.01").toPandas(), con.sql(Q.ORACLES[name]).df()
    assert rows(got) == rows(want)


# Exact dedup


def brute_exact(data):
    groups = defaultdict(list)
    for row, (i, t) in enumerate(data):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, row, i))
    out = []
    for members in groups.values():
        best = min(members)
        out += [(m[4], best[4], len(members), m[3] == best[3]) for m in members]
    return out


CASES = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "a  b"), (4, "a  b"), (5, None), (6, ""), (7, " \n"), (8, "x" * 50_000), (9, "x" * 50_000), (10, "y"), (None, "z"), (11, "z"), (None, "q"), (None, "q"), (12, "a\x1cb")]


@pytest.mark.parametrize("digest", [exactdedup.sha256, lambda c: F.substring(F.sha2(c, 256), 1, 1)])
def test_exact(spark, digest):
    df = spark.createDataFrame([(i, t, "x") for i, t in CASES], "doc_id long, text string, kept string")
    got = exactdedup.exact_duplicates(df, digest=digest).collect()
    plain = lambda xs: sorted(((a is None, a or 0, b is None, b or 0, n) for a, b, n, _ in xs))
    want = brute_exact(CASES)
    assert plain([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got]) == plain(want)
    assert sum(r.kept for r in got) == sum(w[3] for w in want)


def test_exact_state_goes_on(spark, tmp_path):
    """Rows of a second arrival are told from those of the first, compared with them, and can take their place; no text is kept twice."""
    state = exactdedup.KeyedState(spark, str(tmp_path / "s"))
    first = [(5, "a b"), (1, "c"), (9, None)]
    second = [(4, "ab"), (7, "a  b"), (1, "c"), (2, "d")]
    schema = "doc_id long, text string"
    got = exactdedup.exact_duplicates(spark.createDataFrame(first, schema), state=state).collect()
    assert sorted((r.doc_id, r.kept) for r in got) == [(1, True), (5, True), (9, True)]
    got = exactdedup.exact_duplicates(spark.createDataFrame(second, schema), state=state).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(1, 1, 2, False), (1, 1, 2, True), (2, 2, 1, True), (4, 7, 3, False), (5, 7, 3, False), (7, 7, 3, True), (9, 9, 1, True)]
    assert {r.size for r in state.entries(spark).collect()} == {1, 2, 3}


def test_exact_state_compares_earlier_texts(spark, tmp_path):
    """Different texts of two arrivals under one digest stay apart."""
    state, weak = exactdedup.KeyedState(spark, str(tmp_path / "s")), lambda c: F.substring(F.sha2(c, 256), 1, 0)
    for k in range(2):
        got = exactdedup.exact_duplicates(spark.createDataFrame([(k, f"text {k}"), (10 + k, "same")], "doc_id long, text string"), state=state, digest=weak).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in got) == [(0, 0, True), (1, 1, True), (10, 10, True), (11, 10, False)]


def test_exact_drop(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, i, "x") for i, t in CASES], "doc_id long, text string, digest long, row string")
    want = sorted((w[0] is None, w[0] or 0) for w in brute_exact(CASES) if w[3])
    for bits in (27, 1):  # a filter of two bits takes all rows for hits
        monkeypatch.setattr(exactdedup, "FILTER_BITS", bits)
        got = exactdedup.drop_exact_duplicates(df)
        assert got.columns == df.columns
        got = got.collect()
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == want
        assert {r.text for r in got if r.doc_id == 3} == {"a  b"}
    assert exactdedup.drop_exact_duplicates(df.limit(0)).count() == exactdedup.exact_duplicates(df.limit(0)).count() == 0


# Jaccard join


def shingles(text, n=4):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute_components(data, n=4, percent=85):
    sets = [shingles(t, n) for _, t in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (ident, _) in enumerate(data):
        if ident is not None:
            least[find(i)] = min(least.get(find(i), ident), ident)
    return sorted((i is None, i or 0, len(s), least.get(find(k))) for k, ((i, _), s) in enumerate(zip(data, sets, strict=True)))


def near_copies():
    import random

    rng = random.Random(5)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    passage = " ".join(f"p{i}" for i in range(60))
    out = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"c{rng.randint(0, 10**6)}"
        out.append((i, " ".join(words)))
    out += [(100 + i, f"{passage} " + " ".join(f"u{i}_{k}" for k in range(40))) for i in range(20)]
    out += [(200, None), (201, " "), (202, "One two"), (203, "one TWO"), (204, "one two three"), (205, out[0][1]), (205, out[0][1]), (None, out[3][1]), (None, "only null ids here it is"), (206, "z " * 3000)]
    return out


def found_components(df, **options):
    key = lambda x: (x[0], x[1], x[2], x[3] is None, x[3] or 0)
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.link_components(df, **options).collect()), key=key)


def wanted_components(data, n=4, percent=85):
    key = lambda x: (x[0], x[1], x[2], x[3] is None, x[3] or 0)
    return sorted(brute_components(data, n, percent), key=key)


@pytest.mark.parametrize("tile", [512, 8])
def test_jaccard(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    data = near_copies()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in data], "doc_id long, text string, n string, sig string")
    assert found_components(df) == wanted_components(data)
    assert jaccard.link_components(df.limit(0)).count() == 0


def test_jaccard_with_one_signature_word(spark, monkeypatch):
    """Classes whose first signature words are equal stay apart by the second."""
    whole = jaccard.shingle_sets
    monkeypatch.setattr(jaccard, "shingle_sets", lambda *a: (lambda o, k, n, s, t: (o, k, n, s & np.uint64(3), t))(*whole(*a)))
    data = near_copies()
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert found_components(df) == wanted_components(data)


def thue_morse(n, a, b):
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))


def test_jaccard_of_words_of_two_letters(spark):
    data = [(k, thue_morse(1 << (10 + k // 2), *("ab" if k % 2 else "ba"))) for k in range(10)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert found_components(df) == wanted_components(data)


def test_jaccard_chain_of_near_copies(spark):
    """500 texts, each a near copy of the next only: one component from end to end, whatever order the ids are in."""
    import random

    rng, words = random.Random(2), [f"w{i}" for i in range(80 + 500 * 3)]
    ids = rng.sample(range(10_000), 500)
    data = [(ids[i], " ".join(words[3 * i : 3 * i + 80])) for i in range(500)]
    got = found_components(spark.createDataFrame(data, "doc_id long, text string"))
    assert {c for _, _, _, c in got} == {min(ids)} and {n for _, _, n, _ in got} == {77}


def test_jaccard_chain_of_passages(spark):
    """A ring of texts, each made of two passages of which it shares one with either neighbour: all are candidates, none are linked at 85, all at 40."""
    passages = [" ".join(f"p{i}x{k}" for k in range(60)) for i in range(400)]
    data = [(i, passages[i] + " " + passages[(i + 1) % 400]) for i in range(400)]
    assert found_components(spark.createDataFrame(data, "doc_id long, text string")) == [(False, i, 117, i) for i in range(400)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(data)], "doc_id long, text string")
    assert found_components(df, percent=40) == wanted_components(data, 4, 40)


def test_jaccard_on_data(spark):
    df = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    got = sorted((False, r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_components(df).collect())
    assert got == brute_components([tuple(r) for r in df.collect()])


def test_one_of_each_stays(spark):
    data = [(i, t) for i, t in near_copies() if i is not None and i < 205]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted(r.doc_id for r in jaccard.keep_one_each(df, words=5, percent=80).collect())
    assert got == sorted({c if c is not None else i for _, i, _, c in brute_components(data, 5, 80)})


def test_rows_that_share_an_id_do_not_share_their_fate(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    data = [(3, a), (5, a + " more"), (5, b), (None, b + " end"), (None, "x y z " * 9), (None, "x y z " * 9), (7, None), (7, ""), (7, None)]
    df = spark.createDataFrame([(i, t, "v", k) for k, (i, t) in enumerate(data)], "doc_id long, text string, __n string, digest long")
    got = jaccard.keep_one_each(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got.collect())) == sorted([(False, 3, a), (False, 5, b), (True, 0, "x y z " * 9), (False, 7, ""), (False, 7, ""), (False, 7, "")])


# Chat formatting


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "\\<|", "<\\|im_start|>", "\\\\<|x|>\\", "", None, "<|im_start|>user\nhi<|im_end|>\n", "<", "|", "a\nb", "<" * 3 + "|", "%3C|%0A"]
    turns = [(1, k, "user" if k % 2 == 0 else "assistant", t, "x") for k, t in enumerate(nasty)]
    turns += [(2, 0, "assistant", "first", "x"), (3, 0, None, "no role", "x"), (3, 1, "we<|ird\n%", "x", "x"), (None, 0, "user", "q", "x"), (4, 0, "user", "same", "x"), (4, 0, "user", "same", "x"), (5, None, "user", "late", "x")]
    turns += [(6, k, "user" if k % 2 == 0 else "assistant", f"t{k}", "x") for k in range(200)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    want = defaultdict(list)
    for c, t, role, text, _ in turns:
        want[c].append((t if t is not None else -1, role or "", text or ""))
    assert set(got) == set(want)
    for c, xs in want.items():
        xs.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [(r, t) for _, r, t in xs]
        assert got[c].loss == [t for _, r, t in xs if r == "assistant"]
    assert {c: got[c].valid for c in got} == {1: True, 2: False, 3: False, None: True, 4: False, 5: True, 6: True}
    assert chat.format_conversations(df.limit(0)).count() == 0
    digests = {r.conv_id: r for r in chat.digests(chat.read_back(made)).collect()}
    assert digests[2].turns_sha256 == hashlib.sha256(b"assistant\nfirst\n").hexdigest() and digests[2].loss_chars == 5


def test_chat_plan_is_native(spark):
    plan = Q.op8_chat(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# WARC


def test_warc_round_trip(spark, tmp_path):
    long = "é" * 200_000
    pages = [(3, "u3", "x" * 150), (1, "u1", "x" * 150), (2, "u2", "short"), (4, "u4", "short"), (5, None, None), (6, "u\r\nX: y", ""), (7, "u7", long), (None, "u8", "x" * 150), (3, "u3", "x" * 150), (9, "u9", "x" * 99), (10, "u10", "x" * 99)]
    df = spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, record_type string")
    folder, manifest = warc.write_archives(df, str(tmp_path / "w"))
    got = warc.read_archives(folder, manifest, with_payload=True).collect()
    assert len(got) == len(pages) == manifest.agg(F.sum("records")).first()[0]
    for r in got:
        texts = [t or "" for i, _, t in pages if i == r.page_id]
        body = next(t for t in texts if hashlib.sha256(t.encode()).hexdigest() == r.payload_digest).encode()
        assert r.payload_bytes == len(body)
        assert r.payload == (body if r.record_type == "response" else b"")
    kinds = sorted((r.page_id or 99, r.record_type, r.refers_to or 0) for r in got if r.payload_bytes == 150)
    assert kinds == [(1, "response", 0), (3, "revisit", 1), (3, "revisit", 1), (99, "revisit", 1)]
    assert all(r.record_type == "response" for r in got if r.payload_bytes != 150)
    for name in (r.file for r in manifest.collect()):
        assert gzip.open(name).read().startswith(b"WARC/1.1\r\n")  # each member is gzip, so is their sequence
    empty, none = warc.write_archives(df.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(empty, none).count() == 0


def record(payload=b"hello", **changes):
    return warc.record_bytes("urn:page:1", "http://a", payload, "response", len(payload), hashlib.sha256(payload).digest(), None, 1)


def test_warc_reader_finds_damage():
    good = record() + record(b"x" * 300_000)
    assert [r.payload for r in warc.read_records(io.BytesIO(good))] == [b"hello", b"x" * 300_000]
    plain = gzip.decompress(record())
    for broken in (plain.replace(b"hello", b"hellO"), plain.replace(b"Content-Length: ", b"Content-Length: 1", 1), plain[:-4], b"junk\r\n\r\n"):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(gzip.compress(broken))))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(good[: len(good) // 2])))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(b"not gzip")))


# Pipeline


def test_pipeline(spark):
    import corpus_pipeline as P

    folder = f"{DATA}/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, docs, folder).persist()
        assert after.columns == docs.columns, name
        kept = {r.doc_id: r.text for r in after.collect()}
        assert kept.items() <= before.items()
        if name == "toxicity":
            assert sum(labels.get(i) == 1 for i in before) * 0.6 < sum(labels.get(i) == 1 for i in before.keys() - kept.keys())
            assert sum(labels.get(i) == 0 for i in before.keys() - kept.keys()) <= 3
        if name == "exact dedup":
            assert sorted(kept) == sorted(i for i, k, n, stays in brute_exact(list(before.items())) if stays)
        if name == "n-gram Jaccard join":
            assert sorted(kept) == sorted({c if c is not None else i for _, i, _, c in brute_components(list(before.items()), 5, 80)})
        docs, before = after, kept
    packed = P.pack_sequences(spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == set(before)


def test_entry_has_every_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_pipeline_keeps_columns_and_rows(spark, tmp_path):
    """Input columns with the names of outputs, shared and null ids, null texts, repeated rows, no labels, an empty table."""
    import corpus_pipeline as P

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    data = [(3, a), (5, a + " more"), (5, b), (None, c), (None, c), (8, c), (9, None), (9, None), (10, ""), (11, "short text")]
    schema = "doc_id long, text string, n_words long, score string, predicted int, kept boolean, base_failed long, `row` long, __text string, id long, digest string"
    rows = [(i, t, 777, "s", 9, None, 5, k, "t", 6, "d") for k, (i, t) in enumerate(data)]
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        want = [{*range(10)}, {0, 1, 2, 3, 4, 5}, {0, 1, 2, 5}, {0, 2, 5}]
        for (name, stage), left in zip(P.STAGES[:-1], want, strict=True):
            docs = stage(spark, docs, str(tmp_path)).persist()
            assert docs.columns == spark.createDataFrame([], schema).columns, name
            got = docs.collect()
            assert {r.row for r in got} == (left if given else set()), name
            assert all((r.n_words, r.score, r.predicted, r.kept, r.base_failed) == (777, "s", 9, None, 5) for r in got)
        assert {r.doc_id for r in P.pack_sequences(spark, docs, str(tmp_path)).collect()} == ({3, 5, 8} if given else set())
