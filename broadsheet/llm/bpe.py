"""Byte-pair encoding and decoding.

A text is cut into words by the vocabulary's pattern. For a short word the encoder holds
part boundaries and the ranks of adjacent parts in contiguous arrays, takes the smallest
rank (the leftmost of equals) again and again, deletes that boundary and refreshes the
two ranks beside it. Words above `SHORT` bytes do the same merges through a
heap, so that one enormous word does not take quadratic time. Words that come up again
are looked up in a table of bounded size.

Edge cases: a null text is an empty one and has no ids; the special tokens' strings in a text
become their ids, as the tokenizers library has it; null ids decode to an empty text; bytes
that are not UTF-8 decode to replacement characters. Texts are encoded whole, however long they are; repeated rows give
equal ids; an empty table gives no rows; carried columns with an output's name give way.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X

VOCABULARY = "byte_bpe_50k.json"
SHORT = 96
#: Words whose ids a worker remembers.
REMEMBERED = 200_000
#: The pattern of byte-level vocabularies; \s is spelled out, as Python's own has more characters.
_SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Words whose rank arrays are held at once.
BLOCK = 8192
_NEVER = (1 << 31) - 1


def located(name: str) -> str:
    """A vocabulary's file: a path as it is, a bare name among the installed public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec(dict):
    """A vocabulary; as a dict it holds the ids of words seen, at most `REMEMBERED` of them."""

    def __init__(self, name: str = VOCABULARY):
        super().__init__()
        with open(located(name), encoding="utf-8") as file:
            spec = json.load(file)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.pieces: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.pieces |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[vocab[a], vocab[b]] = (rank, vocab[a + b])
        pairs = sorted((a << 32 | b, rank, to) for (a, b), (rank, to) in self.merge.items())
        self.pair_keys = np.array([x[0] for x in pairs] or [-1], np.int64)
        self.pair_ranks = np.array([x[1] for x in pairs] or [_NEVER], np.int32)
        self.rank_ids = np.zeros(len(spec["model"]["merges"]) + 1, np.int32)
        for _, rank, to in pairs:
            self.rank_ids[rank] = to
        self.byte_ids = np.array(self.byte_id, np.int32)
        self.byte_ranks = self.rank_of(self.byte_ids[:, None], self.byte_ids[None, :]).astype(np.int32)
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def __missing__(self, word: str) -> tuple[int, ...]:
        return self.now[word]

    def learn(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of words that aren't remembered; as many as there is room for are from now on."""
        raw = {w: w.encode("utf-8", "surrogatepass") for w in words}
        made = {w: tuple(self.merged_long(b)) for w, b in raw.items() if len(b) > SHORT}
        short = sorted((w for w in words if w not in made), key=lambda w: len(raw[w]))
        at = 0
        while at < len(short):
            block = short[at : at + BLOCK]
            if len(raw[block[-1]]) > 2 * len(raw[block[0]]) + 8:  # words of like lengths share an array
                block = [w for w in block if len(raw[w]) <= 2 * len(raw[block[0]]) + 8]
            made.update(zip(block, self.merged([raw[w] for w in block]), strict=True))
            at += len(block)
        room = max(0, REMEMBERED - len(self))
        self.update({w: made[w] for w in short[:room]})
        return made

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NEVER)

    def merged(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """A row a word: its parts and the ranks of adjacent parts side by side. Each step takes every
        row's smallest rank, leftmost first, closes that boundary and refreshes the two ranks beside it."""
        sizes = np.array([len(w) for w in words])
        wide = max(2, int(sizes.max(initial=0)))
        letters = np.zeros((len(words), wide), np.uint8)
        inside = np.arange(wide) < sizes[:, None]
        letters[inside] = np.frombuffer(b"".join(words), np.uint8)
        parts, left = self.byte_ids[letters], sizes.copy()
        ranks = np.where(inside[:, 1:], self.byte_ranks[letters[:, :-1], letters[:, 1:]], _NEVER)
        out = np.zeros((len(words), wide), np.int32)
        rows, place = np.arange(len(words)), np.arange(wide)
        while len(rows):
            i = ranks.argmin(1)
            line = np.arange(len(rows))
            best = ranks[line, i]
            go = best < _NEVER
            if not go.all():
                out[rows[~go]] = parts[~go]
                rows, parts, ranks, i, best = rows[go], parts[go], ranks[go], i[go], best[go]
                line = np.arange(len(rows))
                if not len(rows):
                    break
            left[rows] -= 1
            parts = np.take_along_axis(parts, np.minimum(place + (place > i[:, None]), wide - 1), 1)
            parts[line, i] = self.rank_ids[best]
            ranks = np.take_along_axis(ranks, np.minimum(place[:-1] + (place[:-1] >= i[:, None]), wide - 2), 1)
            ranks[:, -1] = _NEVER
            before = i > 0
            ranks[line[before], i[before] - 1] = self.rank_of(parts[line[before], i[before] - 1], parts[line[before], i[before]])
            after = i + 1 < left[rows]
            ranks[line[after], i[after]] = self.rank_of(parts[line[after], i[after]], parts[line[after], i[after] + 1])
            ranks[line[~after], np.minimum(i[~after], wide - 2)] = np.where(i[~after] > wide - 2, ranks[line[~after], wide - 2], _NEVER)
        flat, ends = out[np.arange(wide) < left[:, None]].tolist(), np.cumsum(left).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def merged_long(self, word: bytes) -> list[int]:
        ids: list[int | None] = [self.byte_id[b] for b in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        look = self.merge.get
        heap = [(x[0], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (x := look((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = look((a, b))[1], None, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                if x := look((ids[i], ids[after[i]])):
                    heapq.heappush(heap, (x[0], i, ids[i], ids[after[i]]))
            if (p := before[i]) >= 0 and (x := look((ids[p], ids[i]))):
                heapq.heappush(heap, (x[0], p, ids[p], ids[i]))
        return [x for x in ids if x is not None]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        find, special = self.pattern.findall, self.special
        cut: list[list[list[str] | int]] = []
        for text in texts:
            if self.cut is not None and any(s in text for s in special):
                cut.append([special[p] if p in special else find(p) for p in self.cut.split(text)])
            else:
                cut.append([find(text)])
        fresh = set(chain.from_iterable(x for parts in cut for x in parts if isinstance(x, list))).difference(self)
        self.now = self.learn(fresh)
        known = self.__getitem__
        return [list(chain.from_iterable((x,) if isinstance(x, int) else chain.from_iterable(map(known, x)) for x in parts)) for parts in cut]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")

    @property
    def decimals(self) -> dict[int, str]:
        if not hasattr(self, "_decimals"):
            self._decimals = {i: str(i) for i in self.pieces}
        return self._decimals


@lru_cache(2)
def codec(name: str = VOCABULARY) -> Codec:
    return Codec(name)


def _texts(raw: np.ndarray, offsets: np.ndarray) -> list[str]:
    whole, at = raw.tobytes(), offsets.tolist()
    return [whole[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def encode(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of each row with the text's ids as an array column."""
    import pyarrow as pa

    def run(raw, offsets):
        coder = codec(vocabulary)
        return [pa.array(coder.encode_all(_texts(raw, offsets)), pa.list_(pa.int32()))]

    return X.map_texts(df, text, [(ids, "array<int>")], run, keep)


def decode(df: DataFrame, ids: str = "ids", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """All columns but `ids`, with the text that the ids stand for."""
    import pyarrow as pa

    rest = [c for c in df.columns if c.lower() not in (ids.lower(), text.lower())]
    source = df.select(*[df[X.quoted(c)] for c in rest], F.col(X.quoted(ids)).cast("array<int>").alias("__ids"))

    def run(batches):
        coder = codec(vocabulary)
        for batch in batches:
            made = pa.array([coder.decode(x or []) for x in batch.column("__ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], made], [*rest, text])

    from pyspark.sql import types as T

    return source.mapInArrow(run, T.StructType([*[df.schema[c] for c in rest], T.StructField(text, T.StringType())]))


def round_trip(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """Encodes and decodes each text in one pass: number of ids, digests of the ids and of the decoded text."""

    def run(raw, offsets):
        coder = codec(vocabulary)
        decimal, counts, of_ids, of_text = coder.decimals.__getitem__, [], [], []
        for ids in coder.encode_all(_texts(raw, offsets)):
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
            of_text.append(hashlib.sha256(coder.decode(ids).encode("utf-8")).hexdigest())
        return [np.array(counts, np.int64), of_ids, of_text]

    return X.map_texts(df, text, [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")], run, keep)
