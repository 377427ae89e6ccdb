"""Quality rules from repetition coverage.

Hashes of n consecutive words roll over the numbers of a slice's words. A document's share of characters inside n-grams that occur twice or
more, and inside repeated lines, decides. Hashes only propose: n-grams with equal ones are compared word by word, and words and lines get their
numbers from their bytes, so no collision can change a count. Everything is counted within one document, so documents never meet and nothing is shuffled.

Edge cases: a null text is an empty one: no words, every count 0, and it fails the base
rules. A document shorter than n words has no n-grams; a very long one is a slice of its own. Repeated rows are scored
alike. An empty table gives no rows. Carried columns with an output's name give way.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from . import _text as X

#: n-gram length -> largest share of a document's word characters inside repeated n-grams.
NGRAM_LIMITS = {4: 0.50, 6: 0.40, 8: 0.30, 10: 0.25}
#: Largest share of characters in lines that repeat an earlier line.
LINE_LIMIT = 0.30
#: Largest number of symbols a word.
SYMBOL_LIMIT = 0.20
MIN_WORDS = 20
SYMBOLS = b"#*$%&|<>"

OUTPUTS = [
    ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"),
    ("dup_line_share", "double"), *[(f"dup_{n}gram_share", "double") for n in NGRAM_LIMITS], ("base_failed", "boolean"), ("kept", "boolean"),
]


def repeated(number: np.ndarray, at: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Which of the runs of n words that begin at `at` occur more than once in their documents; `number`: of each word."""
    keys = X.ngram_hashes(X.mix(number.astype(np.uint64) + np.uint64(1)), n)[at]
    keys = X.mix(keys + (doc[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = twice[np.append(True, twice[1:] != twice[:-1])]
    place = np.searchsorted(twice, keys)
    found = twice[np.minimum(place, len(twice) - 1)] == keys
    hits = np.flatnonzero(found)
    hits = hits[np.argsort(keys[hits], kind="stable")]
    next_to = np.flatnonzero(keys[hits[1:]] == keys[hits[:-1]])
    x, y = at[hits[next_to]], at[hits[next_to + 1]]
    same = doc[x] == doc[y]
    for k in range(n):
        same &= number[x + k] == number[y + k]
    if not same.all():  # different runs with one hash: by their words
        runs = [(doc[i], number[i : i + n].tobytes()) for i in at[hits].tolist()]
        count = Counter(runs)
        found[hits] = [count[r] > 1 for r in runs]
    return found


def covered(number: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a run of n words found twice or more in their document."""
    m = len(number) - n + 1
    change = np.zeros(len(number) + 1, np.int64)
    if m > 0:
        own = np.flatnonzero(doc[:m] == doc[n - 1 :])
        hit = own[repeated(number, own, doc, n)]
        change[hit] += 1
        change[hit + n] -= 1
    return np.cumsum(change[:-1]) > 0


def profile(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    starts, ends, first = X.words(raw, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    number = X.span_numbers(raw, starts, ends)
    points = X.code_points(raw)
    chars = points[ends] - points[starts]
    n_words, word_chars = np.diff(first), X.run_sums(chars, first)
    symbol = np.zeros(256, np.int64)
    symbol[list(SYMBOLS)] = 1
    n_symbols = X.run_sums(symbol[raw], offsets)

    # Lines: the bytes between line feeds or a document's ends; only those with a word count.
    feeds = np.flatnonzero(raw == 10)
    cuts = np.unique(np.concatenate([offsets, feeds + 1]))
    fed = np.zeros(len(raw) + 1, bool)
    fed[feeds + 1] = True
    at, to = cuts[:-1], cuts[1:] - fed[cuts[1:]]
    with_word = np.searchsorted(starts, to) > np.searchsorted(starts, at)
    at, to = at[with_word], to[with_word]
    line_doc = np.searchsorted(offsets, at, "right") - 1
    line = X.span_numbers(raw, at, to)
    key = line_doc * (line.max(initial=0) + 1) + line
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False
    docs = len(offsets) - 1
    n_dup_lines = np.bincount(line_doc[again], minlength=docs).astype(np.int64)
    line_chars = points[to] - points[at]
    in_lines = np.bincount(line_doc, line_chars, docs)
    line_share = np.bincount(line_doc[again], line_chars[again], docs) / np.maximum(in_lines, 1)

    shares, n_repeat = {}, X.run_sums(covered(number, doc, 8), first)
    for n in NGRAM_LIMITS:
        shares[n] = X.run_sums(np.where(covered(number, doc, n), chars, 0), first) / np.maximum(word_chars, 1)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > 30 * n_words)
    kept = ~failed & (line_share <= LINE_LIMIT) & (n_symbols <= SYMBOL_LIMIT * n_words)
    for n, most in NGRAM_LIMITS.items():
        kept &= shares[n] <= most
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat, line_share, *shares.values(), failed, kept]


def score_quality(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of each row with its counts, repetition shares and verdict."""
    return X.map_texts(df, text, OUTPUTS, profile, keep)
