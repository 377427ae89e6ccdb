"""Phrases whose words keep together: for each language the phrases that score highest against their parts.

A phrase is a run of 2 to `MOST_WORDS` words inside a piece, a text between marks of punctuation or line ends. Its score is that of its worst cut into two parts: SCALE * count / (count of the
first part + count of the rest), rounded down. Phrases that nearly always occur inside a longer one are left out.

Steps:

* Identical pieces of a language become one with their number (in each task, then by shuffle), and are written once.
* Pairs of words are counted by 64-bit hashes, in one DuckDB a shuffle partition of hash buckets, which goes on on disk where memory ends. Frequent ones set bits of a filter of `FILTER_BITS`, one segment a bucket; it has this size for any input, and is the
  only thing that is handed to all tasks. What hashes have in common or the filter lets through by chance costs rows, never a count.
* All words, and phrases all of whose pairs pass the filter, are counted by their own text, likewise in DuckDB, a row a phrase and slice of pieces. A frequent phrase has only frequent parts, so these counts are whole.
* Every cut of a candidate asks for the counts of its parts; requests are shuffled to the counts (parts that are asked for very often meet theirs by broadcast), answers are gathered by candidate with the most frequent longer candidate around it.
* The first of each language are found by ranges of the order, so that a language may have any share of the candidates.

Counts are 64-bit, products decimals of 38 digits. Edge cases: a null text has no words, a null language is `und`; repeated rows count as often as they occur; equal scores are ordered by count, then phrase (UTF-8 bytes), and
of cuts with the same score the shortest first part counts. Very long texts and pieces are taken whole. Columns other than the text and the language are not looked at, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._files import removed
from ._shared import before, join_skewed, settled, shared_path

MOST_WORDS, LEAST, SCALE, COVERED, FIRST = 4, 30, 2_000_000, 80, 2000
UNKNOWN = "und"
#: The filter of frequent pairs: its bits, its segments (a bucket of hashes each), bits set for a pair.
FILTER_BITS, BUCKETS, PROBES = 1 << 27, 1 << 10, 3
_SEGMENT = FILTER_BITS // BUCKETS
#: Bytes of text that become pieces at once, and of pieces that are counted at once; hashes that a task gathers before it sends them on.
SLICE_BYTES, GATHERED = 8 << 20, 4 << 20
#: Memory of a DuckDB, beyond which it goes on on disk, and rows it is given at once.
MEMORY, ROWS = "400MB", 200_000

#: Classes of bytes: 1 between words, 2 between pieces.
_KIND = np.array([1 if b in b" \t" else 2 if b in b".,;:!?\n\v\f\r" else 0 for b in range(256)], np.uint8)


def pieces_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """Pieces with words in lower case, one space between words; and the text that each is of."""
    low = X.lower_ascii(raw)
    kind = _KIND[low]
    starts, ends = _spans(kind == 0, offsets)
    if not len(starts):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    of = np.searchsorted(offsets, starts, "right") - 1
    cuts = X.prefix(kind == 2)[starts]
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (cuts[1:] != cuts[:-1])])
    keep = kind == 0
    joint = ends[:-1][~new[1:]]
    keep[joint], low[joint] = True, 32
    first = np.flatnonzero(new)
    to = np.append(X.prefix(keep)[starts[first]], keep.sum())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(low[keep]))]), of[first]


def _spans(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values, which end with their texts."""
    edge = np.zeros(len(solid) + 1, bool)
    edge[offsets] = True
    around = np.concatenate([[False], solid, [False]])
    return np.flatnonzero(solid & (~around[:-2] | edge[:-1])), np.flatnonzero(solid & (~around[2:] | edge[1:])) + 1


def pieces(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, piece, n: each distinct piece of a language and how often it occurs."""
    source = df.select(F.coalesce(df[X.quoted(lang)].cast("string"), F.lit(UNKNOWN)).alias("lang"), df[X.quoted(text)].cast("string").alias("__text"))

    def run(batches):
        for rows, raw, offsets in X.slices(batches, "__text", SLICE_BYTES):
            held, of = pieces_of(raw, offsets)
            if not len(held):
                continue
            spoken, held = rows.column("lang").dictionary_encode(), held.dictionary_encode()
            size = len(held.dictionary)
            key, n = np.unique(spoken.indices.to_numpy()[of].astype(np.int64) * size + held.indices.to_numpy(), return_counts=True)
            made = [spoken.dictionary.take(pa.array(key // size)), held.dictionary.take(pa.array(key % size)).cast(pa.large_string()), pa.array(n)]
            yield pa.RecordBatch.from_arrays([made[0].cast(pa.string()), made[1].cast(pa.string()), made[2]], ["lang", "piece", "n"])

    return source.mapInArrow(run, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class Words:
    """The words of a slice of pieces: spans, the piece each is of, its piece's number and language."""

    def __init__(self, rows: pa.RecordBatch, raw: np.ndarray, offsets: np.ndarray):
        self.raw = raw
        self.starts, self.ends = _spans(raw != 32, offsets)
        self.of = np.searchsorted(offsets, self.starts, "right") - 1
        self.n = rows.column("n").to_numpy()[self.of]
        spoken = rows.column("lang").dictionary_encode()
        self.langs, self.lang = spoken.dictionary, spoken.indices.to_numpy()[self.of].astype(np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the pairs that begin at each word but the last, and whether both words are of one piece."""
        if len(self.starts) < 2:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        word = X.span_hashes(self.raw, self.starts, self.ends)
        raw, offsets = X.buffers(self.langs)
        salt = X.span_hashes(raw, offsets[:-1], offsets[1:], 1)[self.lang]
        return X.mix(X.ngram_hashes(word, 2) ^ salt[:-1]), self.of[1:] == self.of[:-1]

    def runs(self, first: np.ndarray, words: int) -> pa.Array:
        """The texts of runs of so many words."""
        starts, size = self.starts[first], self.ends[first + words - 1] - self.starts[first]
        to = X.prefix(size)
        at = np.repeat(starts - to[:-1], size) + np.arange(to[-1])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(to), pa.py_buffer(self.raw[at])]).cast(pa.large_string()).cast(pa.string())

    def distinct(self, passed: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, first word of one occurrence, number) of the distinct phrases whose pairs all pass, and of all words; exact, by numbers of words."""
        spans = X.span_numbers(self.raw, self.starts, self.ends)
        _, at, number = np.unique(self.lang * (int(spans.max()) + 1) + spans, return_index=True, return_inverse=True)
        yield 1, at, _sums(number, self.n, len(at))
        word, whole, held = number, np.append(passed, False), np.arange(len(number))
        for words in range(2, most + 1):
            # Phrases of `words` begin where one of a word less does and the pair of their last two words passes.
            ok = (held + words - 1 < len(word)) & whole[np.minimum(held + words - 2, len(whole) - 1)]
            held, number = held[ok], number[ok]
            if not len(held):
                return
            _, at, number = np.unique(number << 32 | word[held + words - 1], return_index=True, return_inverse=True)
            yield words, held[at], _sums(number, self.n[held], len(at))


def _sums(number: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, number, n)
    return out


def _probes(keys: np.ndarray) -> list[np.ndarray]:
    """Bits of a segment for hashes of its bucket."""
    mixed, width = X.mix(keys ^ np.uint64(0x5851F42D4C957F2D)), _SEGMENT.bit_length() - 1
    return [(mixed >> np.uint64(i * width) & np.uint64(_SEGMENT - 1)).astype(np.int64) for i in range(PROBES)]


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def passes(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which hashes may be frequent; all that are frequent pass."""
    out, base = np.ones(len(keys), bool), _bucket(keys) * _SEGMENT
    for bit in _probes(keys):
        at = base + bit
        out &= (filter_[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return out


def summed(tables: Iterable[pa.Table], columns: str, query: str) -> Iterator[pa.RecordBatch]:
    """The answer to a query over the rows `t` of this task, held by a DuckDB that moves them to scratch files of the task where memory ends."""
    import duckdb

    scratch = tempfile.mkdtemp()
    connection = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": scratch, "preserve_insertion_order": False})
    try:
        connection.execute(f"CREATE TABLE t ({columns})")
        for table in tables:
            connection.register("more", table)
            connection.execute("INSERT INTO t SELECT * FROM more")
            connection.unregister("more")
        yield from connection.sql(query).to_arrow_reader(ROWS)
    finally:
        connection.close()
        shutil.rmtree(scratch, ignore_errors=True)
        X.release()


def frequent_pairs(found: DataFrame, least: int = LEAST) -> np.ndarray:
    """The filter of pairs of words that occur `least` times or more: FILTER_BITS bits for any input."""

    def sent(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def combined():
            keys, number = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            # More than `least` is as good as `least`.
            n = np.minimum(_sums(number, np.concatenate([n for _, n in held]), len(keys)), least).astype("<u4")
            ends = np.searchsorted(_bucket(keys), np.arange(BUCKETS + 1))
            full = np.flatnonzero(np.diff(ends))
            kept = n.astype(np.uint8) if least < 256 else n
            parts = [(keys[a:b].astype("<u8").tobytes(), kept[a:b].tobytes()) for a, b in zip(ends[full], ends[full + 1], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(full), pa.array([k for k, _ in parts], pa.binary()), pa.array([c for _, c in parts], pa.binary())], ["bucket", "keys", "n"])

        for rows, raw, offsets in X.slices(batches, "piece", SLICE_BYTES):
            words = Words(rows, raw, offsets)
            keys, ok = words.pairs()
            if ok.any():
                held.append((keys[ok], np.minimum(words.n[:-1][ok], least)))
                size += len(held[-1][0])
            if size >= GATHERED:
                yield combined()
                held, size = [], 0
        if held:
            yield combined()

    def tables(batches):
        keys, n, size = [], [], 0
        for batch in batches:
            for k, c in zip(batch.column("keys"), batch.column("n"), strict=True):
                keys.append(np.frombuffer(k.as_buffer(), "<u8"))
                n.append(np.frombuffer(c.as_buffer(), np.uint8 if least < 256 else "<u4"))
                size += len(keys[-1])
                if size >= 5 * ROWS:
                    yield pa.table({"key": np.concatenate(keys), "n": np.concatenate(n).astype(np.uint32)})
                    keys, n, size = [], [], 0
        if keys:
            yield pa.table({"key": np.concatenate(keys), "n": np.concatenate(n).astype(np.uint32)})

    def segments(batches):
        bits: dict[int, np.ndarray] = {}
        for batch in summed(tables(batches), "key UBIGINT, n UINTEGER", f"SELECT key FROM t GROUP BY key HAVING sum(n) >= {least}"):
            keys = batch.column("key").to_numpy()
            bucket = _bucket(keys)
            for b in np.unique(bucket).tolist():
                held = bits.setdefault(b, np.zeros(_SEGMENT, np.uint8))
                for bit in _probes(keys[bucket == b]):
                    held[bit] = 1
        for b, held in bits.items():
            yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())], ["bucket", "bits"])

    shuffled = found.select("lang", "piece", "n").mapInArrow(sent, "bucket long, keys binary, n binary").repartition(F.col("bucket"))
    out = np.zeros(FILTER_BITS >> 3, np.uint8)
    for row in shuffled.mapInArrow(segments, "bucket long, bits binary").toLocalIterator():  # BUCKETS rows at most
        out[row["bucket"] * (_SEGMENT >> 3) : (row["bucket"] + 1) * (_SEGMENT >> 3)] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out


def frequent_phrases(found: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST) -> DataFrame:
    """lang, words, phrase, f: all words and phrases that occur `least` times or more."""
    filter_ = found.sparkSession.sparkContext.broadcast(frequent_pairs(found, least).tobytes())

    def sent(batches):
        known = np.frombuffer(filter_.value, np.uint8)
        for rows, raw, offsets in X.slices(batches, "piece", SLICE_BYTES):
            words = Words(rows, raw, offsets)
            if not len(words.starts):
                continue
            keys, ok = words.pairs()
            for size, at, n in words.distinct(ok & passes(known, keys), most_words):
                yield pa.RecordBatch.from_arrays([words.langs.take(pa.array(words.lang[at])).cast(pa.string()), pa.array(np.full(len(at), size, np.int32)), words.runs(at, size), pa.array(n)], ["lang", "words", "phrase", "n"])

    def tables(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= ROWS:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def counted(batches):
        kind = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])
        query = f"SELECT lang, words, phrase, CAST(sum(n) AS BIGINT) AS f FROM t GROUP BY ALL HAVING sum(n) >= {least}"
        for batch in summed(tables(batches), "lang VARCHAR, words INTEGER, phrase VARCHAR, n BIGINT", query):
            yield batch.cast(kind)

    shuffled = found.select("lang", "piece", "n").mapInArrow(sent, "lang string, words int, phrase string, n long").repartition(F.col("lang"), F.col("phrase"))
    return shuffled.mapInArrow(counted, "lang string, words int, phrase string, f long")


def scored(frequent: DataFrame, most_words: int = MOST_WORDS, scale: int = SCALE, covered: int = COVERED) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer candidate covers."""
    candidates = frequent.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), "words", F.split("phrase", " ").alias("w"))
    parts = F.array([F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), F.array_join(part, " ").alias("part")) for k in range(1, most_words) for side, part in ((0, F.slice("w", 1, k)), (1, F.slice("w", k + 1, most_words)))])
    asked = settled(candidates.select("lang", "phrase", "a", F.explode(F.filter(parts, lambda p: p["k"] < F.col("words"))).alias("p")).select("lang", "phrase", "a", "p.k", "p.side", "p.part"))
    often = asked.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("often"))
    entries = settled(often.join(frequent.select("lang", F.col("phrase").alias("part"), "f").hint("merge"), ["lang", "part"]))
    answers = join_skewed(asked, entries, ["lang", "part"], "often", asked.count()).select("lang", "phrase", "a", "k", "side", "f")
    inner = F.array([F.struct(F.lit(n).alias("n"), F.array_join(F.slice("w", i, n), " ").alias("phrase"), F.lit(i + n - 1).alias("end")) for n in range(2, most_words) for i in range(1, most_words - n + 2)])
    inside = F.filter(inner, lambda p: (p["end"] <= F.col("words")) & (p["n"] < F.col("words")))
    around = candidates.select("lang", F.explode(inside).alias("p"), "a").select("lang", "p.phrase", F.lit(None).cast("long").alias("a"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("int").alias("side"), F.col("a").alias("f"))
    counts = [F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{name}{k}") for k in range(1, most_words) for side, name in ((0, "l"), (1, "r"))]
    whole = answers.unionByName(around).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max(F.when(F.col("k").isNull(), F.col("f"))).alias("longer"), *counts)
    wide = "DECIMAL(20, 0)"
    kept = whole.where(f"longer IS NULL OR CAST(longer AS {wide}) * 100 < CAST(a AS {wide}) * {covered}")
    cuts = [F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(f"CAST(a AS {wide}) * {scale} DIV (CAST(l{k} AS {wide}) + r{k})").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, most_words)]
    return kept.select("lang", "phrase", "a", F.array_min(F.array(*cuts)).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", most_words: int = MOST_WORDS, least: int = LEAST, scale: int = SCALE, covered: int = COVERED, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a (its count), l and r (of its parts at the worst cut), n (words of the language), score: the first of each language."""
    spark = df.sparkSession
    once = shared_path(spark, "pieces")
    pieces(df, text, lang).write.option("compression", "zstd").parquet(once)
    found = spark.read.schema("lang string, piece string, n long").parquet(once)
    frequent = settled(frequent_phrases(found, most_words, least))
    # Words are one more than spaces.
    words = F.octet_length("piece") - F.octet_length(F.replace("piece", F.lit(" "), F.lit(""))) + 1
    totals = settled(found.groupBy("lang").agg(F.sum(F.col("n") * words).alias("n")))
    removed(once)
    ranked = before(scored(frequent, most_words, scale, covered), [F.desc("score"), F.desc("a"), F.asc("phrase")], groups=["lang"]).where(F.col("before") < first)
    return ranked.join(totals, "lang").select("lang", (F.col("before") + 1).cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
