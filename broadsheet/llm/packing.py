"""Best-fit packing of documents into training sequences.

Only lengths matter to a packing, and there are at most `capacity` of them. So the plan is
made on the driver from the counts of each length: documents longer than a third of the
capacity are matched greedily, the longest first with the longest partner that still fits, at most two
to a bin; shorter ones, longest first, go where they leave the smallest gap. Bins that look alike are
handled as one run with a multiplicity, so that the plan's size depends on the capacity and not
on the data. Rows learn their place from their rank among the pieces of their length, which
is counted in buckets: no length, however frequent, is ever in one task.

Edge cases: a null text is an empty one and packs as its end token alone. Repeated rows are
pieces like any others, as are rows with a null id. Only a document longer than the capacity is cut, however long it is; further columns than the id and the
text are not looked at, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as X
from ._shared import settled
from .bpe import VOCABULARY, byte_letters, located

CAPACITY = 2048
END_ID = 0
#: Pieces in a bucket of one length, about.
BUCKET_ROWS = 50_000


@lru_cache(2)
def tokenizer(name: str):
    """The vocabulary's encoder as compiled code; the same ids as the vocabulary's own library gives."""
    import public_tokenizers
    import tiktoken

    with open(located(name), encoding="utf-8") as file:
        spec = json.load(file)
    letters, vocab = byte_letters(), spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    made = {a + b if isinstance(p, list) else p.replace(" ", "") for p in spec["model"]["merges"] for a, b in [p if isinstance(p, list) else ("", "")]}
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special and (len(t) == 1 or t in made)}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def cut(df: DataFrame, text: str = "text", id_column: str = "doc_id", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids of each document with its end token; only a first piece may be shorter.

    Columns: the id column, piece, start, length, ids_crc32, and with `with_ids` the ids.
    """
    source = df.select(df[X.quoted(id_column)].alias("id"), df[X.quoted(text)].cast("string").alias("__text"))
    names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches):
        coder = tokenizer(vocabulary)
        for rows, raw, offsets in X.slices(batches, "__text"):
            whole, at = raw.tobytes(), offsets.tolist()
            taken, piece, start, length, crc, kept = [], [], [], [], [], []
            for row, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                ids = np.append(coder.encode_to_numpy(whole[a:b].decode("utf-8", "replace"), allowed_special="all"), END_ID).astype("<u4")
                first = len(ids) % capacity or capacity
                for k, s in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[s : first if s == 0 else s + capacity]
                    taken.append(row), piece.append(k), start.append(s), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        kept.append(part.astype(np.int32))
            made = [rows.column("id").take(pa.array(taken, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            if with_ids:
                made.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(made, names)

    kind = source.schema["id"].dataType.simpleString()
    out = source.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("id", id_column)


class Plan:
    """Where the k-th piece of each length goes, for counts of lengths."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.sequences = capacity, 0
        #: Of each placement: length, first rank, first sequence, pieces a sequence, first offset.
        self.placed: list[tuple[int, int, int, int, int]] = []
        self.next_rank = dict.fromkeys(counts, 0)
        #: Open bins by gap: runs (first sequence, number of sequences).
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        third = capacity // 3
        self.match({n: c for n, c in counts.items() if n > third})
        for n in sorted((n for n in counts if n <= third), reverse=True):
            self.fill(n, counts[n])
        self.table = np.array(self.placed or np.zeros((0, 5)), np.int64).reshape(-1, 5)
        self.table = self.table[np.lexsort((self.table[:, 1], self.table[:, 0]))]

    def put(self, n: int, run: tuple[int, int], each: int, offset: int, pieces: int) -> None:
        self.placed.append((n, self.next_rank[n], run[0], each, offset))
        self.next_rank[n] += pieces

    def open(self, bins: int) -> tuple[int, int]:
        run = (self.sequences, bins)
        self.sequences += bins
        return run

    def leave(self, gap: int, run: tuple[int, int]) -> None:
        if gap and run[1]:
            self.gaps.setdefault(gap, []).append(run)

    def match(self, left: dict[int, int]) -> None:
        """Large pieces: the longest with the longest other that fits, at most two to a bin."""
        sizes = sorted(left)
        while sizes:
            n = sizes[-1]
            fits = [m for m in sizes if m <= self.capacity - n and (m != n or left[n] > 1)]
            if not fits:
                run = self.open(left[n])
                self.put(n, run, 1, 0, left[n])
                self.leave(self.capacity - n, run)
                left[n] = 0
            elif (m := fits[-1]) == n:
                run = self.open(left[n] // 2)
                self.put(n, run, 2, 0, 2 * run[1])
                self.leave(self.capacity - 2 * n, run)
                left[n] %= 2
            else:
                run = self.open(min(left[n], left[m]))
                self.put(n, run, 1, 0, run[1])
                self.put(m, run, 1, n, run[1])
                self.leave(self.capacity - n - m, run)
                left[n] -= run[1]
                left[m] -= run[1]
            sizes = [s for s in sizes if left[s]]

    def fill(self, n: int, count: int) -> None:
        """Small pieces: where the gap is smallest; what fits nowhere opens bins."""
        while count:
            gap = min((g for g in self.gaps if g >= n), default=0)
            run = self.gaps[gap].pop() if gap else self.open(-(-count // (self.capacity // n)))
            if gap and not self.gaps[gap]:
                del self.gaps[gap]
            gap = gap or self.capacity
            each = gap // n
            full = min(run[1], count // each)
            if full:
                self.put(n, (run[0], full), each, self.capacity - gap, full * each)
                self.leave(gap - each * n, (run[0], full))
                count -= full * each
            rest = (run[0] + full, run[1] - full)
            if rest[1] and 0 < count < each:
                self.put(n, (rest[0], 1), count, self.capacity - gap, count)
                self.leave(gap - count * n, (rest[0], 1))
                rest, count = (rest[0] + 1, rest[1] - 1), 0
            self.leave(gap, rest)

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces given their lengths and ranks among their length."""
        key = self.table[:, 0] << 48 | self.table[:, 1]
        at = np.searchsorted(key, length << 48 | rank, "right") - 1
        _, first, sequence, each, offset = self.table[at].T
        return sequence + (rank - first) // each, offset + (rank - first) % each * length


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """All columns of the pieces (lengths from 1 to `capacity`) with sequence_id and offset."""
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    kept = settled(pieces.select(*[pieces[X.quoted(c)] for c in names], F.xxhash64(F.monotonically_increasing_id()).alias("__salt")))
    counts = {r[0]: r[1] for r in kept.groupBy(F.col(X.quoted(length)).cast("long")).count().collect()}  # at most `capacity` rows
    plan = Plan(counts, capacity)
    buckets = max(64, -(-sum(counts.values()) // BUCKET_ROWS))
    key = [F.col("__length"), F.col("__bucket")]
    dealt = kept.withColumns({"__length": F.col(X.quoted(length)).cast("long"), "__bucket": F.pmod(F.col("__salt"), F.lit(buckets))})
    before = (
        dealt.groupBy("__length", "__bucket").count()
        .withColumn("__before", F.sum("count").over(Window.partitionBy("__length").orderBy("__bucket")) - F.col("count"))
        .drop("count")
    )
    ranked = (
        dealt.withColumn("__row", F.row_number().over(Window.partitionBy(*key).orderBy("__salt")))
        .join(before, ["__length", "__bucket"])
        .withColumn("__rank", F.col("__before") + F.col("__row") - 1)
        .select(*[F.col(X.quoted(c)) for c in names], "__length", "__rank")
    )
    from pyspark.sql import types as T

    def run(batches):
        for batch in batches:
            sequence, offset = plan.places(batch.column("__length").to_numpy(), batch.column("__rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, T.StructType([*[pieces.schema[c] for c in names], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(df: DataFrame, text: str = "text", id_column: str = "doc_id", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Documents cut, then packed: one row a piece with its sequence and its place there."""
    return pack(cut(df, text, id_column, capacity, vocabulary, with_ids), capacity=capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from pieces packed with their ids: sequence_id, ids, document starts."""
    placed = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(placed.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.offset").alias("starts"))
