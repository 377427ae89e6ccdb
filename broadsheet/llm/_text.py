"""Whole-text helpers shared by the Arrow-batched operators.

A column of texts becomes one UTF-8 byte buffer with document offsets, so that word
boundaries, word hashes and n-gram hashes are numpy expressions over many documents at
once. Texts are never cut: a slice always ends at a document's end, and slices hold at most
``SLICE_BYTES`` unless a single document is longer.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once by one Python worker (a longer document is a slice of its own).
SLICE_BYTES = 2 << 20
#: Numbers of eight bytes that are hashed at once.
HASH_BLOCK = 1 << 17

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_NGRAM = np.uint64(0xD6E8FEB86659FD93)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], name: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of the batches of about `limit` text bytes: (rows, bytes, offsets)."""
    for batch in batches:
        raw, offsets = buffers(batch.column(name))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield (
                batch.slice(first, last - first),
                raw[offsets[first] : offsets[last]],
                offsets[first : last + 1] - offsets[first],
            )
            first = last
    release()


def release() -> None:
    """Gives freed memory back to the system: Python workers live on when their task has ended."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw).astype(np.uint8)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: (starts, ends, first word of each document plus the total)."""
    n = len(raw)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Masks of the first n bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans: the sum of each eight bytes mixed, then mixed with their place, then mixed with the length. Other seeds give independent hashes.

    No power series, so spans of few different letters (Thue-Morse words and the like) do not collide.
    """
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    eights = np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), 0, (1,))  # at every byte the eight bytes from there
    count = np.maximum((ends - starts + 7) // 8, 1)
    to, salt, i = np.cumsum(count), mix(np.array([seed + 1], np.uint64) * _BASE)[0], 0
    while i < len(starts):
        done = int(to[i - 1]) if i else 0
        j = max(int(np.searchsorted(to, done + HASH_BLOCK, "right")), i + 1)
        n = count[i:j]
        first = to[i:j] - n - done
        place = np.arange(int(to[j - 1]) - done) - np.repeat(first, n)
        at = np.repeat(starts[i:j], n) + 8 * place
        value = eights[at] & _FIRST[np.clip(np.repeat(ends[i:j], n) - at, 0, 8)]
        value = mix(mix(value ^ salt) + place.astype(np.uint64) * _BASE)
        out[i:j] = mix(np.add.reduceat(value, first) + (ends[i:j] - starts[i:j]).astype(np.uint64) * _NGRAM)
        i = j
    return out


def span_numbers(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of byte spans: equal for equal bytes and for no others."""
    size = ends - starts
    to = np.concatenate([[0], np.cumsum(size)])
    inside = np.zeros(len(raw) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(to), pa.py_buffer(np.ascontiguousarray(raw[np.cumsum(inside[:-1]) > 0]))])
    return spans.dictionary_encode().indices.to_numpy().astype(np.int64)


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n values (values may cross documents; mask with `inside`)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * _NGRAM + hashes[k : k + m]
    return mix(out)


def inside(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which runs of n words lie within one document; `first`: word offsets of documents."""
    m = total - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return doc[:m] == doc[n - 1 :]


def prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


def run_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of `values` between consecutive offsets."""
    total = prefix(values)
    return total[first[1:]] - total[first[:-1]]


def code_points(raw: np.ndarray) -> np.ndarray:
    """Prefix counts of code points: entry i counts those that begin before byte i."""
    return prefix((raw & 0xC0) != 0x80)


def map_texts(df, text: str, outputs, fn, keep=None, limit: int = SLICE_BYTES):
    """One output row per input row: columns `keep` (all but `text` by default) plus `outputs`.

    `fn(raw, offsets)` gets the texts of a slice and returns one array per output. `outputs`
    is a list of (name, DDL type). A carried column whose name an output takes (in any
    case) gives way to the output.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    taken = {name.lower() for name, _ in outputs}
    keep = [c for c in (keep if keep is not None else [c for c in df.columns if c != text]) if c.lower() not in taken]
    held = "__text"
    while held in map(str.lower, keep):
        held += "_"
    source = df.select(*[df[quoted(c)] for c in keep], df[quoted(text)].cast("string").alias(held))
    schema = T.StructType([*[df.schema[c] for c in keep], *T.StructType.fromDDL(", ".join(f"`{a}` {b}" for a, b in outputs))])

    def run(batches):
        for rows, raw, offsets in slices(batches, held, limit):
            made = [x if isinstance(x, pa.Array) else pa.array(x) for x in fn(raw, offsets)]
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], *made], [*keep, *[a for a, _ in outputs]])

    return source.mapInArrow(run, schema)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
