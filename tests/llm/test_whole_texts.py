"""The pipeline's first stages against brute force, and texts longer than a slice in the operators on texts."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from broadsheet.llm import _text as X
from broadsheet.llm import bpe, packing, pitmanyor, quality, tokencount, toxicity
from pyspark.sql import functions as F

from tests.llm.test_text_operators import WORD, brute_quality, grams

BAD = ["vile", "scum"]
VOCABULARY = [f"{a}{b}" for a in ("wor", "té", "ka") for b in ("da", "li", "mo", "日本")]


def brute_kept(text):
    n, chars, symbols, _, _, shares, failed = brute_quality(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    again = sum(len(x) for i, x in enumerate(lines) if x in lines[:i])
    return not failed and again <= quality.LINE_LIMIT * sum(map(len, lines)) and symbols <= quality.SYMBOL_LIMIT * n and all(s <= most for s, most in zip(shares, quality.NGRAM_LIMITS.values(), strict=True))


def brute_scorer(rows, significant):
    """score(text) of the classifier fitted to (text, label): n-grams as strings, Newton's steps on the whole matrix."""
    y = np.array([label for _, label in rows])
    sets = [grams(t) for t, _ in rows]
    count = [Counter(g for s, label in zip(sets, y, strict=True) if label == k for g in s) for k in (0, 1)]
    n = [int((y == k).sum()) for k in (0, 1)]
    ratio = {}
    for g in set().union(*sets):
        p, q = count[1][g] + 0.5, count[0][g] + 0.5
        r = math.log(p / (n[1] + 1)) - math.log(q / (n[0] + 1))
        if abs(r) >= significant * math.sqrt(1 / p + 1 / q):
            ratio[g] = r
    names = sorted(ratio)
    x = np.array([[ratio[g] * (g in s) for g in names] for s in sets])
    scale = 1 / math.sqrt(np.median((x * x).sum(1)))
    x = np.c_[x * scale, np.ones(len(x))]
    w, balance = np.zeros(len(names) + 1), np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
    penalty = np.full(len(w), float(toxicity.PENALTY))
    penalty[-1] = 0
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (balance * (p - y)) + penalty * w
        hessian = (x.T * (balance * p * (1 - p))) @ x + np.diag(penalty)
        w -= np.linalg.solve(hessian + 1e-12 * np.eye(len(w)), gradient)
    return lambda text: 1 / (1 + math.exp(-(sum(w[k] * ratio[g] * scale for k, g in enumerate(names) if g in grams(text)) + w[-1])))


def test_toxicity_stage_against_brute_force(spark, tmp_path, monkeypatch):
    """The stage drops exactly the documents that the classifier, fitted by brute force, scores 0.7 or more."""
    import corpus_pipeline as P

    monkeypatch.setattr(toxicity, "SIGNIFICANT", 1.5)
    rng, rows = random.Random(9), []
    for i in range(120):
        words = rng.choices(VOCABULARY, k=rng.randint(3, 9))
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((i, " ".join(words)))
    labelled = [(i, int(i % 3 == 0)) for i, _ in rows if i < 80]
    unlabelled = [(200, None), (201, "vile words"), (202, ""), (203, "VILE scum"), (204, "worda teli")]
    spark.createDataFrame(labelled, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows + unlabelled, "doc_id long, text string")
    kept = {r.doc_id for r in P.remove_toxic(spark, docs, str(tmp_path)).collect()}
    score = brute_scorer([(dict(rows)[i], toxic) for i, toxic in labelled], 1.5)
    want = {i: score(t) for i, t in rows + unlabelled}
    sure = {i for i, s in want.items() if abs(s - 0.7) > 5e-3}
    assert len(sure) >= len(want) - 3 and {i for i in sure if want[i] >= 0.7} and kept & sure == {i for i in sure if want[i] < 0.7}


def test_quality_stage_against_brute_force(spark):
    import corpus_pipeline as P
    from tests.conftest import DATA

    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rng = random.Random(2)
    made = [" ".join(rng.choices("abcdefgh", k=rng.randint(15, 60))) for _ in range(60)] + ["\n".join(rng.choices(["some words in a line", "others that are here", "a b c"], k=12)) for _ in range(20)] + ["$ # " * 3 + "word other thing " * k for k in range(1, 9)]
    docs = docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate([None, "", *made])], "doc_id long, text string"), allowMissingColumns=True)
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in P.apply_quality_rules(spark, docs, "").collect()}
    want = {i for i, t in texts.items() if brute_kept(t)}
    assert kept == want and 0 < len(want) < len(texts)


@pytest.fixture(scope="module")
def long():
    """A text longer than any slice, with neighbours in the same batch."""
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(2, 9))) for _ in range(4000)] + ["日本語", "2024-01-15", "don't", "🙂"]
    text = " ".join(rng.choices(words, k=420_000))
    assert len(text.encode()) > X.SLICE_BYTES + (1 << 19) > toxicity.SLICE_BYTES
    return text


@pytest.fixture(scope="module")
def around(spark, long):
    return spark.createDataFrame([(1, "before it"), (2, long), (3, None), (4, "after it after it")], "doc_id long, text string").coalesce(1)


def test_long_text_is_encoded_whole(around, long):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = library.encode(long, add_special_tokens=False).ids
    got = {r.doc_id: r for r in bpe.round_trip(around).collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[2].n_tokens == len(want) and got[2].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert got[2].decoded_sha256 == hashlib.sha256(long.encode()).hexdigest() and got[3].n_tokens == 0
    pieces = sorted((r.start, r.length) for r in packing.pack_documents(around).where("doc_id = 2").collect())
    assert sum(n for _, n in pieces) == len(want) + 1 and [s for s, _ in pieces] == [0, *np.cumsum([n for _, n in pieces])[:-1]]


def test_long_text_is_counted_whole(around, long):
    machine, words = tokencount.automaton(), WORD.findall(long)
    counts = {w: machine.count(w) for w in set(words)}
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in tokencount.count_tokens(around).collect()}
    assert got[2] == (len(words), sum(counts[w] for w in words)) and got[3] == (0, 0) and got[1][0] == 2


def test_long_text_is_judged_whole(spark, around, long):
    got = {r.doc_id: r for r in quality.score_quality(around).collect()}
    n, chars, symbols, lines, repeat, shares, failed = brute_quality(long)
    r = got[2]
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, lines, repeat, failed)
    assert np.allclose([r[f"dup_{k}gram_share"] for k in quality.NGRAM_LIMITS], shares) and r.kept
    clean, toxic = [" ".join(random.Random(i).choices(VOCABULARY, k=8)) for i in range(40)], [" ".join([*random.Random(i).choices(VOCABULARY, k=7), "vile scum"]) for i in range(40)]
    sample = spark.createDataFrame(list(enumerate(clean + toxic)), "doc_id long, text string")
    model = toxicity.train(sample, spark.createDataFrame([(i, int(i >= 40)) for i in range(80)], "doc_id long, toxic int"))
    ends = spark.createDataFrame([(1, long), (2, long + " vile scum"), (3, "vile scum " + long)], "doc_id long, text string").coalesce(1)
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(ends, model).collect()}
    assert score[2] == pytest.approx(score[3], abs=0.02) and score[2] > score[1] + 0.2


def test_long_text_is_scored_whole(around, long):
    got = {r.doc_id: r for r in pitmanyor.score_texts(around, F.col("doc_id") == 4, sweeps=2, averaged=1).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [*WORD.findall(t.translate(lower)), None] for i, t in ((1, "before it"), (2, long), (3, ""), (4, "after it after it"))}
    counts = Counter(t for i in (1, 2, 3) for t in tokens[i])
    n, v = sum(counts.values()), len(counts)
    for i, r in got.items():
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens[i])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens[i]), sum(counts[t] > 0 for t in tokens[i]), n) and r.base_score == pytest.approx(base, rel=1e-9)
    assert len(got) == 4 and got[2].score > got[2].base_score
