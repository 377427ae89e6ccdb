"""Packing, token counts, byte-pair encoding, quality rules, toxicity, language model: against brute force."""

from __future__ import annotations

import functools
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from broadsheet.llm import _seating as seating
from broadsheet.llm import _text as X
from broadsheet.llm import bpe, packing, pitmanyor, quality, tokencount, toxicity
from broadsheet.llm import queries as Q
from pyspark.sql import functions as F

from tests.conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \t\n", "one", "The cat sat. The cat sat.\nThe cat sat.\n\nline\nline\r\n", "<|endoftext|>x<|endoftext|>", "naïve café — ÀÉ " * 30, "a" * 3000, "ab " * 2500, "x\x1cy\x85z w", "日本語のテキスト。" * 40,
    "It's we'll I'VE they're 12345 ##!!\n\n\n  end", "%%% ### *** || <tag> & $5",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "other") for i, t in enumerate(TEXTS)] + [(3, "one", "other"), (None, "no id", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_bpe(spark, docs, none, library):
    got = bpe.encode(docs.drop("n_tokens").withColumn("copy", F.col("text")))
    rows = got.collect()
    assert len(rows) == docs.count()
    assert all(list(r.ids) == ids(library, r.copy) for r in rows)
    back = {(r.doc_id, r.copy): r.text for r in bpe.decode(got).collect()}
    assert all(back[r.doc_id, r.copy] == (r.copy or "") for r in rows)
    assert bpe.encode(none).count() == 0 and bpe.decode(bpe.encode(none)).count() == 0


def test_bpe_digests(docs, small, library):
    for df in (docs, small):
        texts = defaultdict(set)
        for r in df.collect():
            texts[r.doc_id].add(r.text or "")
        for r in bpe.round_trip(df.select("doc_id", "text")).collect():
            want = {(len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(library.decode(i, skip_special_tokens=False).encode()).hexdigest()) for t in texts[r.doc_id] for i in [ids(library, t)]}
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) in want


def test_bpe_remembers_a_bounded_number(monkeypatch, library):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    coder = bpe.Codec()
    text = "many different words come here " * 2 + "z" * 500
    assert coder.encode(text) == ids(library, text) and len(coder) == 3
    assert coder.encode(text) == ids(library, text)


def check_packing(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        assert 1 <= r.length <= capacity
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_packing(docs, none, library):
    rows = packing.pack_documents(docs).collect()
    used = check_packing(rows, 2048)
    assert used == math.ceil(sum(r.length for r in rows) / 2048) or used <= 1.2 * sum(r.length for r in rows) / 2048 + 1
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for i, text in enumerate(TEXTS):
        want = np.array([*ids(library, text), 0], "<u4")
        parts = sorted(by_doc[i], key=lambda r: (r.piece, r.sequence_id))
        if i == 3:
            assert len(parts) == 2  # the repeated row
            continue
        assert [r.piece for r in parts] == list(range(len(parts))) and sum(r.length for r in parts) == len(want)
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(want[r.start : r.start + r.length].tobytes())
        assert all(r.length == 2048 for r in parts[1:])
    assert packing.pack_documents(none).count() == 0


def test_packing_with_ids(docs):
    packed = packing.pack_documents(docs, with_ids=True)
    assert sum(len(r.ids) for r in packing.sequences(packed).collect()) == packed.agg(F.sum("length")).first()[0]


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101, 3000) if seed else np.full(500, 34)
    counts = Counter(lengths.tolist())
    plan = packing.Plan(counts, 100)
    bins = defaultdict(list)
    for n, c in counts.items():
        sequence, offset = plan.places(np.full(c, n), np.arange(c))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            bins[s].append((o, n))
    for places in bins.values():
        end = 0
        for o, n in sorted(places):
            assert o == end
            end += n
        assert end <= 100
        assert sum(n > 33 for _, n in places) <= 2
    assert len(bins) == plan.sequences
    if seed:
        assert len(bins) <= 1.03 * lengths.sum() / 100 + 1


def greedy_count(word, initial, continuing):
    n, at = 0, 0
    while at < len(word):
        pieces = initial if at == 0 else continuing
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), 0)
        if not end:
            return 1
        n, at = n + 1, end
    return n


def test_token_counts_of_real_words():
    """Words that begin with characters that only continue words are the mark and pieces; characters without a piece are bytes."""
    import random

    import sentencepiece

    machine, model = tokencount.automaton(), sentencepiece.SentencePieceProcessor(model_file=bpe.located(tokencount.VOCABULARY))
    assert [machine.count(w) for w in ("2024-01-15", "4952935900253052", "ñandú", "東京都", "hello", "\U00013000")] == [11, 17, 4, 4, 2, 5]
    pieces = {p for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for p in [model.id_to_piece(i)]}
    longest, rng = max(map(len, pieces)), random.Random(7)

    def greedy(word):
        n, at, word = 0, 0, "▁" + word
        while at < len(word):
            end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in pieces), 0)
            n, at = n + (1 if end else len(word[at].encode())), end or at + 1
        return n

    for _ in range(2000):
        word = "".join(rng.choices("abest012ñçßéλόгд東京\U00013000\U0001f600", k=rng.randint(1, 9)))
        assert machine.count(word) == greedy(word), word
    for _ in range(300):  # no piece for every letter
        initial = {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 8))} | {""}
        continuing = {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 8))}
        pieces, longest = {"▁" + p for p in initial} | continuing, 9
        small = tokencount.Automaton(initial, continuing, by_bytes=True)
        for _ in range(20):
            word = "".join(rng.choices("abcñ", k=rng.randint(1, 9)))
            assert small.count(word) == greedy(word), (word, initial, continuing)


def test_token_counts_of_documents(spark, small):
    """n_tokens of whole texts with the real vocabulary, by greedy matching of its pieces as strings."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=bpe.located(tokencount.VOCABULARY))
    pieces = {p for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for p in [model.id_to_piece(i)]}
    longest = max(map(len, pieces))

    @functools.cache
    def greedy(word):
        n, at, word = 0, 0, "\u2581" + word
        while at < len(word):
            end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in pieces), 0)
            n, at = n + (1 if end else len(word[at].encode())), end or at + 1
        return n

    texts = {r.doc_id: r.text or "" for r in small.collect()}
    for r in Q.op2_token_counts(spark, f"{DATA}/sf0.001").collect():
        words = WORD.findall(texts[r.doc_id])
        assert r.n_words == len(words) and r.n_tokens == sum(map(greedy, words)), r.doc_id


def test_token_counts(docs, none):
    import random

    rng = random.Random(3)
    for _ in range(300):
        initial = {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 8))}
        continuing = {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 8))}
        machine = tokencount.Automaton(initial, continuing)
        for _ in range(20):
            word = "".join(rng.choices("abcd", weights=[5, 5, 5, 1], k=rng.randint(1, 9)))
            assert machine.count(word) == greedy_count(word, initial, continuing), (word, initial, continuing)
    got = {(r.doc_id, r.n_words) for r in tokencount.count_tokens(docs.select("doc_id", "text")).collect()}
    assert {(i, len(WORD.findall(t or ""))) for i, t in enumerate(TEXTS)} <= got
    assert tokencount.count_tokens(none).count() == 0


def brute_quality(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]

    def covered(n):
        grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        hit = [False] * len(words)
        for i in range(len(words) - n + 1):
            if grams[tuple(words[i : i + n])] > 1:
                hit[i : i + n] = [True] * n
        return hit

    repeat = sum(covered(8))
    chars = sum(map(len, words))
    shares = [sum(len(w) for w, h in zip(words, covered(n), strict=True) if h) / max(chars, 1) for n in quality.NGRAM_LIMITS]
    return len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, shares, len(words) < 20 or 100 * repeat > 30 * len(words)


def test_quality(docs, none, small):
    for df in (docs, small):
        texts = {(r.doc_id, r.text) for r in df.collect()}
        got = quality.score_quality(df.select("doc_id", "text", F.col("text").alias("same"), F.lit("x").alias("n_words"))).collect()
        assert len(got) == df.count() and {(r.doc_id, r.same) for r in got} == texts
        for r in got:
            n, chars, symbols, lines, repeat, shares, failed = brute_quality(r.same)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, lines, repeat, failed)
            assert np.allclose([r[f"dup_{k}gram_share"] for k in quality.NGRAM_LIMITS], shares)
            assert not (failed and r.kept)
    assert quality.score_quality(none).count() == 0


def thue_morse(n, a, b):
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))


def test_quality_of_hash_collisions(spark, monkeypatch):
    """Lines of two letters that a power series modulo 2^64 takes for equal, and n-gram hashes of few bits, give the same counts."""
    lines = [thue_morse(1 << k, *x) for k in (10, 11, 14) for x in ("ab", "ba")]
    texts = ["\n".join(lines), "\n".join([*lines, lines[0]]), " ".join(lines * 5), "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3]
    assert [r.n_dup_lines for r in quality.score_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()] == [0, 1, 0, 0]
    raw, offsets = X.buffers(pa.array([*texts, *[t or "" for t in TEXTS]]))
    want, whole = quality.profile(raw, offsets), X.ngram_hashes
    monkeypatch.setattr(X, "ngram_hashes", lambda h, n: whole(h, n) & np.uint64(15))
    assert all(np.array_equal(a, b) for a, b in zip(quality.profile(raw, offsets), want, strict=True))


def test_quality_keeps_good_documents(spark):
    d = f"{DATA}/sf0.01"
    got = quality.score_quality(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("NOT base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.98


def test_toxicity(spark):
    d = f"{DATA}/sf0.1"
    got = Q.op7_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    positive, negative = got[got.toxic == 1].score.to_numpy(), np.sort(got[got.toxic == 0].score.to_numpy())
    area = (np.searchsorted(negative, positive, "left").sum() + np.searchsorted(negative, positive, "right").sum()) / 2 / len(positive) / len(negative)
    assert area > 0.97 and (negative >= 0.7).mean() < 0.02 and (positive >= 0.7).mean() > 0.8


def grams(text):
    """Distinct padded n-grams of a text, white space as blanks."""
    padded = " " + re.sub(r"[ \t-\r]", " ", text or "") + " "
    return {padded[i : i + k] for k in toxicity.LENGTHS for i in range(len(padded) - k + 1)}


def test_toxicity_against_brute_force(spark, monkeypatch):
    """Ratios, fitted weights and scores of a small sample, from n-grams as strings and plain gradient descent."""
    import random

    monkeypatch.setattr(toxicity, "SIGNIFICANT", 1.5)
    rng = random.Random(4)
    vocabulary, bad = [f"{a}{b}" for a in ("wor", "té", "ka") for b in ("da", "li", "mo", "日本")], ["vile", "scum"]
    rows = []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.randint(3, 9))
        if i % 3 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    texts = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(100, None, "x"), (101, "vile words", "x")], "doc_id long, text string, score string")
    model = toxicity.train(texts, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(texts, model).collect()}
    y = np.array([r[2] for r in rows])
    sets = [grams(t) for _, t, _ in rows]
    count = [Counter(g for s, label in zip(sets, y, strict=True) if label == k for g in s) for k in (0, 1)]
    n = [int((y == k).sum()) for k in (0, 1)]
    ratio = {}
    for g in set().union(*sets):
        p, q = count[1][g] + 0.5, count[0][g] + 0.5
        r = math.log(p / (n[1] + 1)) - math.log(q / (n[0] + 1))
        if abs(r) >= 1.5 * math.sqrt(1 / p + 1 / q):
            ratio[g] = r
    names = sorted(ratio)
    assert len(names) > 20 and len(names) == np.count_nonzero(model.weights)
    x = np.array([[ratio[g] * (g in s) for g in names] for s in sets])
    x /= math.sqrt(np.median((x * x).sum(1)))
    scale = x[np.nonzero(x)][0] / np.array([[ratio[g] * (g in s) for g in names] for s in sets])[np.nonzero(x)][0]
    w, b, balance = np.zeros(len(names)), 0.0, np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
    v, vb = w.copy(), b
    for step in range(60_000):  # accelerated gradient steps
        error = balance * (1 / (1 + np.exp(-(x @ v + vb))) - y)
        new, new_b = v - 0.5 * (x.T @ error + toxicity.PENALTY * v), vb - 0.5 * error.sum()
        move = step / (step + 3)
        v, vb, w, b = new + move * (new - w), new_b + move * (new_b - b), new, new_b
    for i, t in [*((i, t) for i, t, _ in rows), (100, None), (101, "vile words")]:
        own = grams(t)
        want = 1 / (1 + math.exp(-(sum(w[k] * ratio[g] * scale for k, g in enumerate(names) if g in own) + b)))
        assert got[i] == pytest.approx(want, abs=2e-3), (i, t)


def test_toxicity_edges(docs, none, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (99, 1), (None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    for train in (labels, labels.limit(0), labels.where("toxic = 1")):
        model = toxicity.train(docs, train)
        got = toxicity.score_toxicity(docs, model).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert toxicity.score_toxicity(none, toxicity.train(none, labels)).count() == 0


def test_language_model(spark, small):
    got = {r.doc_id: r for r in Q.op6_language_model(spark, f"{DATA}/sf0.001").collect()}
    texts = {r.doc_id: r.text or "" for r in small.collect()}
    assert set(got) == set(texts)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [*WORD.findall(t.translate(lower)), None] for i, t in texts.items()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 1}
    counts = Counter(t for i in tokens if i not in held for t in tokens[i])
    n, v = sum(counts.values()), len(counts)
    for i, r in got.items():
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens[i])
        assert r.held_out == (i in held) and r.train_tokens == n and r.n_tokens == len(tokens[i]) and r.n_known == sum(counts[t] > 0 for t in tokens[i])
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


def test_language_model_probabilities_sum_to_one(spark):
    """Scores of one-word and two-word texts give every probability: r[w] = 1 / P(end | w) solve a linear system, as each context's probabilities sum to one; then so must those of the text start."""
    train = [(i, t) for i, t in enumerate(["a b", "a b a b", "a c", "b a", "a", "c c a b", None] * 3)]
    words = ["a", "b", "c", "zz"]
    asked = ["", *words, *[f"{v} {w}" for v in words for w in words]]
    df = spark.createDataFrame(train + [(100 + i, t) for i, t in enumerate(asked)], "doc_id long, text string")
    p = {r.doc_id: 10**r.score for r in pitmanyor.score_texts(df, F.col("doc_id") >= 100, averaged=3).collect()}
    p = {t: p[100 + i] for i, t in enumerate(asked)}
    step = np.array([[p[f"{v} {w}"] / p[v] for w in words] for v in words])
    r = np.linalg.solve(np.eye(4) - step, np.ones(4))
    assert (r > 1).all() and p[""] + sum(p[w] * x for w, x in zip(words, r, strict=True)) == pytest.approx(1, rel=1e-9)


def brute_model(texts, discount, discount0, strength, sweeps, rng):
    """Mean probabilities of words after contexts, by removing and seating one customer after the other (a restaurant for each context and one parent); sizes of tables by dish."""
    pairs = [(u, w) for t in texts for x in [t.split()] for u, w in zip([None, *x], [*x, None], strict=True)]
    vocabulary = {w for _, w in pairs}
    base, seats, parent = 1 / (len(vocabulary) + 1), {u: {w: [] for w in vocabulary} for u, _ in pairs}, {w: [] for w in vocabulary}
    people, tables = lambda r: sum(map(sum, r.values())), lambda r: sum(map(len, r.values()))

    def p0(w):
        return (sum(parent[w]) - discount0 * len(parent[w]) + (strength + discount0 * tables(parent)) * base) / (strength + people(parent))

    def sit(sizes, d, new):
        """Whether at a new table."""
        place = rng.choices(range(len(sizes) + 1), [*(n - d for n in sizes), new])[0]
        sizes[place : place + 1] = [sizes[place] + 1] if place < len(sizes) else [1]
        return sizes[place] == 1

    def leave(sizes):
        """Whether the table goes, too."""
        place = rng.choices(range(len(sizes)), sizes)[0]
        sizes[place] -= 1
        return not sizes[place] and sizes.pop(place) == 0

    def enter(u, w):
        if sit(seats[u][w], discount, (strength + discount * tables(seats[u])) * p0(w)):
            sit(parent[w], discount0, (strength + discount0 * tables(parent)) * base)

    for u, w in pairs:
        enter(u, w)
    sums, counted = defaultdict(float), 0
    for sweep in range(sweeps):
        for u, w in pairs:
            if leave(seats[u][w]):
                leave(parent[w])
            enter(u, w)
        if sweep >= sweeps // 5:
            counted += 1
            for u in seats:
                for w in vocabulary:
                    sums[u, w] += (sum(seats[u][w]) - discount * len(seats[u][w]) + (strength + discount * tables(seats[u])) * p0(w)) / (strength + people(seats[u]))
    return {k: v / counted for k, v in sums.items()}


def test_language_model_against_seating_one_by_one(spark):
    """The mean predictive probabilities of a small corpus are those of a plain sampler that removes and seats one customer at a time."""
    import random

    texts = ["a b a b c", "a b", "b c a", "a a a b", "c", "d a b", "a b b b", "a b c d"]
    ask = ["a", "b", "c", "d", "a b", "b a", "c a", "a a", "d a", "b b b", "a b c"]
    df = spark.createDataFrame([*enumerate(texts), *[(100 + i, t) for i, t in enumerate(ask)]], "doc_id long, text string")
    got = {r.doc_id: 10**r.score for r in pitmanyor.score_texts(df, F.col("doc_id") >= 100, sweeps=90, averaged=80).collect()}
    pairs = Counter((u, w) for t in texts for x in [t.split()] for u, w in zip([None, *x], [*x, None], strict=True))
    estimate = lambda n: min(0.9, max(0.05, n[1] / (n[1] + 2 * n[2]))) if n[1] else 0.5
    d, d0 = estimate(Counter(pairs.values())), estimate(Counter(Counter(w for _, w in pairs).values()))
    p = brute_model(texts, d, d0, pitmanyor.STRENGTH, 2000, random.Random(1))
    for i, t in enumerate(ask):
        x = t.split()
        assert got[100 + i] == pytest.approx(math.prod(p[u, w] for u, w in zip([None, *x], [*x, None], strict=True)), rel=0.08), t


def test_language_model_rare_contexts(spark, monkeypatch):
    """A context word below SHARE has a restaurant too: what followed it in training is likelier after it than a word as frequent elsewhere."""
    texts = ["f " * 60_000, *["left1 right1", "left2 right2"] * 3]
    df = spark.createDataFrame([*enumerate(texts), (100, "left1 right1"), (101, "left1 right2")], "doc_id long, text string")
    p = {r.doc_id: r.score for r in pitmanyor.score_texts(df, F.col("doc_id") >= 100, sweeps=3, averaged=2).collect()}
    assert p[100] > p[101] + 0.5  # equal if the context had no restaurant
    # Totals that go through the driver and those that blocks exchange give the same model, but for the draws.
    words = [f"w{i * i % 97}" for i in range(3000)]
    df = spark.createDataFrame([(i, " ".join(words[i * 30 : i * 30 + 40])) for i in range(100)], "doc_id long, text string")
    made = []
    for share in (1e-9, 2.0):
        monkeypatch.setattr(pitmanyor, "SHARE", share)
        made.append({r.doc_id: r.score for r in pitmanyor.score_texts(df, F.col("doc_id") % 5 == 1, sweeps=6).collect()})
    assert made[0] == pytest.approx(made[1], rel=0.02)


def test_language_model_edges(docs, none):
    got = pitmanyor.score_texts(docs, F.lit(False), sweeps=2, averaged=1).collect()
    assert len(got) == docs.count() and all(r.score <= 0 and math.isfinite(r.score) for r in got)
    assert pitmanyor.score_texts(none, F.lit(False), sweeps=2, averaged=1).count() == 0
    unseen = pitmanyor.score_texts(docs, F.lit(True), sweeps=2, averaged=1).collect()
    assert all(r.score == 0 and r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in unseen)


def stirling(discount, most):
    """log S(c, t) of each c by the recurrence."""
    rows = {1: np.array([0.0])}
    for c in range(1, most):
        t = np.arange(1, c + 2)
        opened = np.append(-np.inf, rows[c])
        with np.errstate(divide="ignore"):
            stayed = np.append(rows[c], -np.inf) + np.log(np.maximum(c - discount * t, 1e-300))
        rows[c + 1] = np.logaddexp(opened, stayed)
    return rows


@pytest.mark.parametrize("discount", [0.05, 0.3, 0.6, 0.77, 0.85, 0.9])
def test_stirling_numbers(discount):
    rows = stirling(discount, 900)
    for c in (129, 300, 900):
        t = np.arange(1, c + 1)
        got = seating.log_weights(np.full(c, c), t, np.ones(c), discount) + math.lgamma(c + 1)
        assert np.abs(got - rows[c]).max() < (4e-3 if discount <= 0.85 else 1e-2)
    table = seating.ratios(discount)
    for c in (2, 7, 128):
        assert np.allclose(np.log(table[c, 1:c]), np.diff(rows[c]))


def test_stirling_numbers_of_many_customers():
    """At a discount of 1/2 the chance that t walks of N steps have c in all is t / (2 c - t) C(2 c - t, c) / 2^(2 c - t), a number that the alternating sum must not lose among its terms."""
    c = 20_000
    t = np.array([1, 2, 141, 424, 707, 989, 1272])
    exact = [math.log(k / (2 * c - k)) + math.log(math.comb(2 * c - k, c)) - (2 * c - k) * math.log(2) for k in t.tolist()]
    got = seating.log_weights(np.full(len(t), c), t, np.ones(len(t)), 0.5) + [math.lgamma(k + 1) - k * math.log(2) for k in t.tolist()]
    assert np.abs(got - exact).max() < 1e-8


def test_steps_of_large_dishes_keep_what_does_not_depend_on_tables(monkeypatch):
    """Gamma functions are asked for a few times a step, not for each term of each sum; weights of some dishes, asked again for other tables, are those of the dishes alone."""
    rng, calls, plain = np.random.default_rng(3), [], seating.log_gamma
    c = rng.integers(129, 5000, 60)
    before = np.minimum((c**0.8).astype(np.int64), c)
    monkeypatch.setattr(seating, "log_gamma", lambda x: calls.append(1) or plain(x))
    seating.tables(c, np.full(60, 0.8), 0.8, np.random.default_rng(4), before)
    assert len(calls) <= 2 * (seating.STEPS + 2)
    weights = seating.Weights(c, np.full(60, 0.8), 0.8)
    for _ in range(5):
        some = np.flatnonzero(rng.random(60) < 0.5)
        t = 1 + (rng.random(len(some)) ** 4 * c[some]).astype(np.int64)
        alone = [seating.log_weights(c[i : i + 1], t[k : k + 1], np.full(1, 0.8), 0.8)[0] for k, i in enumerate(some.tolist())]
        assert np.allclose(weights.of(t, some), alone, rtol=1e-12)


@pytest.mark.parametrize("customers, x", [(2, 0.3), (6, 0.9), (40, 3.0), (128, 0.5), (200, 5.0), (1000, 40.0)])
def test_seats_follow_the_posterior(customers, x):
    """Tables have the exact probabilities S(c, t) x^t, both by the exact draw and by the steps of large dishes."""
    rng, n, d = np.random.default_rng(customers), 20_000, 0.7
    log = stirling(d, customers)[customers] + np.arange(1, customers + 1) * math.log(x)
    p = np.exp(log - log.max())
    p /= p.sum()
    tables = seating.tables(np.full(n, customers), np.full(n, x), d, rng)
    for _ in range(20 if customers > seating.EXACT else 0):
        tables = seating.tables(np.full(n, customers), np.full(n, x), d, rng, tables)
    share = np.bincount(tables, minlength=customers + 1)[1:] / n
    assert np.abs(share - p).sum() < 0.05 + 2 * np.sqrt(np.count_nonzero(p > 1e-4) / n)
    assert tables.mean() == pytest.approx((p * np.arange(1, customers + 1)).sum(), rel=0.03)


def twelve_calls(customers, x, discount, rng):
    """Tables as after the sweeps of a run."""
    tables = None
    for _ in range(pitmanyor.SWEEPS):
        tables = seating.tables(np.full(len(x), customers), x, discount, rng, tables)
    return tables


def test_seats_of_a_large_dish_after_the_sweeps_of_a_run():
    """Mean and spread are the exact ones at the largest discount."""
    c, d, x, n = 3000, 0.9, 0.9 * 1400, 4000
    t = np.arange(1, c + 1)
    log = stirling(d, c)[c] + t * math.log(x)
    p = np.exp(log - log.max())
    p /= p.sum()
    mean = (p * t).sum()
    spread = math.sqrt((p * (t - mean) ** 2).sum())
    got = twelve_calls(c, np.full(n, x), d, np.random.default_rng(2))
    assert pitmanyor.SWEEPS == 12 and abs(got.mean() - mean) < 4 * spread / math.sqrt(n) and got.std() == pytest.approx(spread, rel=0.06)


@pytest.mark.parametrize("discount", [0.5, 0.9])
def test_seats_of_a_hundred_thousand_customers(discount):
    """Seated one by one, then a gamma variable given the tables: tables drawn anew given that variable follow the same law as those that were there, so that neither is larger by more than chance."""
    rng, n, customers, strength = np.random.default_rng(1), 2000, 100_000, 0.5
    one_by_one = np.ones(n)
    for c in range(1, customers):
        one_by_one += rng.random(n) * (strength + c) < strength + discount * one_by_one
    drawn = twelve_calls(customers, discount * rng.gamma(strength / discount + one_by_one), discount, rng)
    apart = drawn - one_by_one
    assert abs(apart.mean()) < 4 * apart.std() / math.sqrt(n)
    assert abs((apart > 0).sum() - (apart < 0).sum()) < 4 * math.sqrt(n)
    # given the variable, both vary by about the root of the tables' number (less near one table a customer)
    assert 0.5 < np.median(np.abs(apart) / np.sqrt(one_by_one)) < 1.1


def test_gamma_variables():
    key = np.arange(100_000, dtype=np.uint64)
    for shape in (0.1, 0.7, 1.0, 5.5, 4000.0):
        got = seating.gammas(np.full(len(key), shape), key, 3)
        # four standard errors of a gamma sample's mean and variance
        assert abs(got.mean() - shape) < 4 * math.sqrt(shape / len(key)) and abs(got.var() - shape) < 4 * shape * math.sqrt((2 + 6 / shape) / len(key))
        assert np.array_equal(got[500:600], seating.gammas(np.full(100, shape), key[500:600], 3))
