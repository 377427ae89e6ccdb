"""Token ids in files of directly addressable codes, documents in order of their ids.

A file splits each id into chunks, the lowest bits first. The first level holds the first chunk of every id, the next those of
the ids that have more, and so on; a bitmap a level says which ids go on, and a directory of counts, one a `RANK_BITS` bits of it, says where
they do. So any token is found by reading one chunk, one bit and one count a level, with nothing decoded before it. The widths
of the levels are those that make the file smallest, found from its counts of bit lengths.

Documents are encoded, dealt out in ranges of their ids, sorted, and written range by range; a file ends after `FILE_TOKENS` tokens. Files hold
their documents' ids and starts, and the manifest has a row a file. Files appear under their names when they are complete, so that a task that runs again
replaces them by the same bytes.

Encoding is the tokenizers library's. Where its vocabulary drops white space, ids of a text are those of its chunks between spaces, and of these without
the punctuation around them, one after the other; so each worker remembers the ids of chunks, in a table of bounded size, and asks the library for new ones only. Vocabularies for which this
does not hold (tried on strings at the start) encode whole texts.

Edge cases: a null text is an empty one and has its end token alone. Null ids come first; rows that share an id follow each other in order of a hash of
their ids, rows repeated in full are documents of their own. A document is in one file, however long it is, and is read in runs of `READ_TOKENS`. Ids of documents are integers or what casts to them; further columns are
not looked at, whatever their names. An empty table gives no files and no rows. A file that is damaged in its head or its length raises TokenFileError.
"""

from __future__ import annotations

import json
import os
import unicodedata
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._files import file_system, removed
from ._shared import before, settled, shared_path
from .bpe import byte_letters, located

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Tokens after which a file ends, and those that a reader holds at once.
FILE_TOKENS, READ_TOKENS = 1 << 24, 1 << 20
#: Bits of a bitmap that an entry of its directory counts, and values packed at once.
RANK_BITS, PACKED = 512, 1 << 16
#: Chunks of texts whose ids a worker remembers, and bytes of text encoded at once.
REMEMBERED, SLICE_BYTES = 1_000_000, 8 << 20
MAGIC = b"DACTOK01"


class TokenFileError(ValueError):
    pass


# --- directly addressable codes


def level_widths(values: np.ndarray) -> list[int]:
    """Bits of each level, so that chunks, bitmaps and directories are smallest together."""
    if not len(values):
        return [1]
    bits = np.maximum(np.frexp(values.astype(np.float64))[1], 1)
    above = len(values) - np.cumsum(np.bincount(bits, minlength=34))  # values of more than p bits
    above[0] = len(values)
    top, going_on = int(bits.max()), 1 + 64 / RANK_BITS
    best, width = [0.0] * (top + 1), [0] * (top + 1)
    for p in reversed(range(top)):
        best[p], width[p] = min((above[p] * (w + (going_on if p + w < top else 0)) + best[p + w], w) for w in range(1, top - p + 1))
    out, p = [], 0
    while p < top:
        out.append(width[p])
        p += width[p]
    return out


def packed(values: np.ndarray, width: int) -> bytes:
    """The lowest `width` bits of each value, one after the other."""
    shifts, out = np.arange(width, dtype=np.uint32), []
    for i in range(0, len(values), PACKED):  # PACKED is a multiple of 8, so every block but the last ends with a byte
        block = values[i : i + PACKED].astype(np.uint32)
        out.append(np.packbits((block[:, None] >> shifts & np.uint32(1)).astype(np.uint8), bitorder="little").tobytes())
    return b"".join(out)


def unpacked(data: bytes, skip: int, width: int, count: int) -> np.ndarray:
    """`count` values of `width` bits that begin `skip` bits into the data."""
    raw = np.frombuffer(data + bytes(8), np.uint8)
    eights = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))  # at every byte the eight bytes from there
    at = skip + np.arange(count, dtype=np.int64) * width
    return (eights[at >> 3] >> (at & 7).astype(np.uint64) & np.uint64((1 << width) - 1)).astype(np.uint32)


def file_bytes(tokens: np.ndarray, ids: list[int | None], starts: np.ndarray) -> bytes:
    """A file of these tokens; starts: of each document's first token, and their number at the end."""
    sections: list[bytes] = []
    at = 0

    def section(data: bytes) -> list[int]:
        nonlocal at
        sections.append(data)
        at += len(data)
        return [at - len(data), len(data)]

    levels, rest = [], tokens.astype(np.uint32)
    for width in level_widths(tokens):
        level = {"width": width, "count": len(rest), "chunks": section(packed(rest, width)), "bitmap": None, "ranks": None}
        more = rest >> np.uint32(width)
        rest, goes_on = more[more > 0], more > 0
        if len(rest):
            full = np.zeros(-(-len(goes_on) // RANK_BITS) * RANK_BITS, np.uint8)
            full[: len(goes_on)] = goes_on
            counts = np.concatenate([[0], np.cumsum(full.reshape(-1, RANK_BITS).sum(1, dtype=np.int64))])
            level |= {"bitmap": section(np.packbits(full, bitorder="little").tobytes()), "ranks": section(counts.astype("<u8").tobytes())}
        levels.append(level)
    known = np.array([i is not None for i in ids], np.uint8)
    head = {
        "tokens": len(tokens), "documents": len(ids), "levels": levels, "ids": section(np.array([i or 0 for i in ids], "<i8").tobytes()), "known": section(known.tobytes()),
        "starts": section(np.asarray(starts, "<u8").tobytes()),
    }
    text = json.dumps(head).encode()
    return MAGIC + np.array([len(text), zlib.crc32(text)], "<u4").tobytes() + text + b"".join(sections)


class TokenFile:
    """Reads a file by place: `source` has seek and read. Only the head is held."""

    def __init__(self, source):
        self.source = source
        head = self._read(0, 16)
        if len(head) < 16 or head[:8] != MAGIC:
            raise TokenFileError("not a token file")
        size, crc = np.frombuffer(head[8:], "<u4").tolist()
        text = self._read(16, size)
        if len(text) < size or zlib.crc32(text) != crc:
            raise TokenFileError("the head is damaged")
        self.head, self.body = json.loads(text), 16 + size

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def _part(self, section: list[int], at: int, size: int) -> bytes:
        data = self._read(self.body + section[0] + at, size)
        if at + size > section[1] or len(data) < size:
            raise TokenFileError("the file ends too early")
        return data

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids, and starts with the number of tokens at the end."""
        whole = [self._part(self.head[k], 0, self.head[k][1]) for k in ("ids", "known", "starts")]
        ids = np.frombuffer(whole[0], "<i8").tolist()
        return [i if k else None for i, k in zip(ids, whole[1], strict=True)], np.frombuffer(whole[2], "<u8").astype(np.int64)

    def tokens(self, first: int, count: int) -> np.ndarray:
        """Any run of tokens, from bytes of its own only."""
        if first < 0 or count < 0 or first + count > self.head["tokens"]:
            raise IndexError("no such tokens")
        return self._run(0, first, count)

    def token(self, at: int) -> int:
        return int(self.tokens(at, 1)[0])

    def _run(self, level: int, first: int, count: int) -> np.ndarray:
        held = self.head["levels"][level]
        width = held["width"]
        low = first * width >> 3
        out = unpacked(self._part(held["chunks"], low, ((first + count) * width + 7 >> 3) - low), first * width & 7, width, count)
        if held["bitmap"] and count:
            low = first >> 3
            bits = np.unpackbits(np.frombuffer(self._part(held["bitmap"], low, (first + count + 7 >> 3) - low), np.uint8), bitorder="little")[first & 7 :][:count].astype(bool)
            if more := int(bits.sum()):
                out[bits] |= self._run(level + 1, self._rank(held, first), more) << np.uint32(width)
        return out

    def _rank(self, held: dict, at: int) -> int:
        """Ones of the level's bitmap before a place."""
        block = at // RANK_BITS
        counted = int(np.frombuffer(self._part(held["ranks"], 8 * block, 8), "<u8")[0])
        low = block * RANK_BITS >> 3
        rest = np.unpackbits(np.frombuffer(self._part(held["bitmap"], low, (at + 7 >> 3) - low), np.uint8), bitorder="little")
        return counted + int(rest[: at - block * RANK_BITS].sum())


# --- encoding


#: Classes of bytes: 1 for ASCII letters and digits, 2 for what belongs to other characters, 0 for the rest.
_CLASS = np.array([2 if b > 127 else int(chr(b).isalnum()) for b in range(256)], np.uint8)


class Coder:
    """The library's tokenizer with the ids of chunks it has seen: a key a chunk, its ids in one array."""

    def __init__(self, name: str = VOCABULARY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = located(name)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        # A byte that all special tokens have: chunks with it are taken as they are.
        self.mark = next((b for b in b"|<>[]" if all(b in t for t in special)), None)
        words = [w for w in (t.removesuffix("</w>") for t in list(spec["model"].get("vocab", ()))[-4000:]) if w.isascii() and w.isalpha() and w.islower()][:300]
        one = self.ask
        joined = " \t".join(words)
        self.by_chunk = bool(words) and self.mark is not None and one([joined])[0] == [i for x in one(words) for i in x] == one([f"\n{joined.replace(' ', chr(12))}\r\n"])[0]
        self.by_chunk = self.by_chunk and all(one([a])[0] == one([b])[0] for a, b in zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", strict=True))
        self.by_chunk = self.by_chunk and all(one([f"{a}b9{c}"])[0] == [i for x in one([a, "b9", c]) for i in x] for a in ('"', "((", "''", "$") for c in ("'", '."', "%", "!!"))
        # Words of letters in lower case, and digits, go to the library's model without the steps before it, where that comes to the same.
        self.letters = {b: c for c, b in byte_letters().items()}
        words += ["naïve", "größe", "привет", "日本語", "ñandú", "0", "9", "é"]
        self.plain = all(self.modelled(w) == i for w, i in zip(words, one(words), strict=True)) if self.by_chunk else False
        self.digits = {bytes([b]): self.modelled(chr(b)) for b in range(48, 58)} if self.plain and one(["1029"])[0] == [i for d in "1029" for i in self.modelled(d)] else {}
        self.forget()

    def ask(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def modelled(self, word: str) -> list[int]:
        return [t.id for t in self.library.model.tokenize(word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode())))]

    def simple(self, key: bytes) -> list[int] | None:
        """Ids of a word of letters in lower case or of a number; None for all else."""
        if key.isalpha():  # ASCII letters, of which there are no capitals here
            return self.modelled(key.decode("ascii")) if self.plain and key.islower() else None
        if key.isdigit():
            return [i for k in range(len(key)) for i in self.digits[key[k : k + 1]]] if self.digits else None
        if not self.plain or key.isascii():
            return None
        word = key.decode("utf-8", "replace")
        return self.modelled(word) if word.isalpha() and word.islower() and word == word.lower() and unicodedata.is_normalized("NFC", word) and "�" not in word else None

    def forget(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.starts, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def learn(self, keys: list[bytes]) -> np.ndarray:
        """Rows of these distinct keys in the table; new ones are added, in a table of their own where it is full."""
        new = [k for k in keys if k not in self.rows]
        if new and len(self.rows) + len(new) > REMEMBERED and self.rows:
            self.forget()
            new = keys
        if new:
            made = [self.simple(k) for k in new]
            asked = iter(self.ask([k.decode("utf-8", "replace") for k, m in zip(new, made, strict=True) if m is None]))
            made = [next(asked) if m is None else m for m in made]
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            self.flat = np.concatenate([self.flat, np.fromiter((i for m in made for i in m), np.uint32, int(sizes.sum()))])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        return np.fromiter(map(self.rows.__getitem__, keys), np.int64, len(keys))

    def chunks(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends, first chunk of each document): lower case, and punctuation around letters and digits apart."""
        starts, ends, first = X.words(raw, offsets)
        marked = np.diff(np.searchsorted(np.flatnonzero(raw == self.mark), np.stack([starts, ends], 1)), axis=1)[:, 0] > 0
        low = X.lower_ascii(raw)
        for s, e in zip(starts[marked].tolist(), ends[marked].tolist(), strict=True):
            low[s:e] = raw[s:e]
        kind = _CLASS[raw]
        solid = np.flatnonzero(kind > 0)
        if len(solid):
            head = solid[np.minimum(np.searchsorted(solid, starts), len(solid) - 1)]
            tail = solid[np.maximum(np.searchsorted(solid, ends) - 1, 0)]
            mixed = ~marked & (head >= starts) & (head < ends)
            # A lone apostrophe may begin a contraction.
            lead = mixed & (head > starts) & (kind[head] == 1) & ((head > starts + 1) | (raw[starts] != 39))
            trail = mixed & (tail + 1 < ends) & (kind[tail] == 1)
            cut = np.concatenate([head[lead], tail[trail] + 1])
            at = offsets[:-1] if len(offsets) > 1 else offsets
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
            first = np.searchsorted(starts, np.concatenate([at, offsets[-1:]]))
        return low, starts, ends, first

    def encode(self, raw: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with its end id; where each text's begin, and the number at the end)."""
        n = len(offsets) - 1
        if not self.by_chunk:
            whole, at = raw.tobytes(), offsets.tolist()
            made = [[*i, end] for i in self.ask([whole[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)])]
            to = np.concatenate([[0], np.cumsum([len(i) for i in made], dtype=np.int64)])
            return np.fromiter((i for m in made for i in m), np.uint32, int(to[-1])), to
        low, starts, ends, first = self.chunks(raw, offsets)
        size = ends - starts
        to = np.concatenate([[0], np.cumsum(size)])
        solid = np.zeros(len(raw) + 1, np.int8)
        solid[starts] += 1
        solid[ends] -= 1
        held = np.ascontiguousarray(low[np.cumsum(solid[:-1], dtype=np.int8) > 0])
        spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(to), pa.py_buffer(held)]).dictionary_encode()
        row = self.learn(spans.dictionary.to_pylist())[spans.indices.to_numpy()]
        count = self.starts[row + 1] - self.starts[row]
        after = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(self.starts[row] - after[:-1], count) + np.arange(after[-1])]
        each = np.diff(after[first]) + 1
        out_to = np.concatenate([[0], np.cumsum(each)])
        out = np.full(int(out_to[-1]), end, np.uint32)
        inside = np.ones(len(out), bool)
        inside[out_to[1:] - 1] = False
        out[inside] = ids
        assert len(out_to) == n + 1
        return out, out_to


@lru_cache(2)
def coder(name: str) -> Coder:
    return Coder(name)


def id_bytes(vocabulary: str, end: int) -> int:
    """Bytes that hold any id of a vocabulary."""
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(located(vocabulary)).get_vocab(with_added_tokens=True).values()
    return 2 if max(end, *ids) < 1 << 16 else 4


def encoded(df: DataFrame, text: str = "text", id_column: str = "doc_id", vocabulary: str = VOCABULARY, end: int = END_ID) -> DataFrame:
    """id (long) and ids of every document with its end token, as little-endian unsigned integers of `id_bytes` each."""
    source = df.select(df[X.quoted(id_column)].cast("long").alias("id"), df[X.quoted(text)].cast("string").alias("__text"))
    each = id_bytes(vocabulary, end)

    def run(batches):
        made = coder(vocabulary)
        for rows, raw, offsets in X.slices(batches, "__text", SLICE_BYTES):
            ids, to = made.encode(raw, offsets, end)
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(to) - 1, [None, pa.py_buffer(each * to), pa.py_buffer(ids.astype(f"<u{each}"))])
            yield pa.RecordBatch.from_arrays([rows.column("id"), data.cast(pa.binary())], ["id", "ids"])

    return source.mapInArrow(run, "id long, ids binary")


# --- files


def write_tokens(df: DataFrame, folder: str | None = None, text: str = "text", id_column: str = "doc_id", vocabulary: str = VOCABULARY, end: int = END_ID, file_tokens: int = FILE_TOKENS) -> tuple[str, DataFrame]:
    """Writes the documents' ids, in ascending order of documents, to files in `folder` (shared; a URI that pyarrow's file systems know).

    Returns the folder and the manifest: file, documents, tokens, and base, the tokens of all files before it.
    """
    spark = df.sparkSession
    folder = folder or shared_path(spark, "tokens")
    # Encoded once: dealing out by ranges looks at the ids before it moves them.
    once = shared_path(spark, "encoded")
    encoded(df, text, id_column, vocabulary, end).withColumn("tie", F.xxhash64("ids")).write.option("compression", "zstd").parquet(once)
    rows = spark.read.schema("id long, ids binary, tie long").parquet(once)
    by = [F.asc_nulls_first("id"), F.asc("tie")]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by, "ids").select("id", "ids")
    each = id_bytes(vocabulary, end)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        files, base = file_system(folder)
        files.create_dir(base, recursive=True)
        held: list[tuple[int | None, np.ndarray]] = []
        size = k = 0

        def written():
            tokens = np.concatenate([t for _, t in held])
            starts = np.concatenate([[0], np.cumsum([len(t) for _, t in held])])
            name, partial = f"{base}/part-{part:05d}-{k:05d}.tokens", f"{base}/.part-{part:05d}-{k:05d}-{uuid.uuid4().hex}"
            with files.open_output_stream(partial, compression=None) as out:
                out.write(file_bytes(tokens, [i for i, _ in held], starts))
            files.move(partial, name)
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([k]), pa.array([name]), pa.array([len(held)]), pa.array([len(tokens)])], ["part", "k", "file", "documents", "tokens"])

        for batch in batches:
            for i, data in zip(batch.column("id").to_pylist(), batch.column("ids"), strict=True):
                held.append((i, np.frombuffer(data.as_buffer(), f"<u{each}").astype(np.uint32)))
                size += len(held[-1][1])
                if size >= file_tokens:
                    yield written()
                    held, size, k = [], 0, k + 1
        if held:
            yield written()

    manifest = settled(ordered.mapInArrow(run, "part long, k long, file string, documents long, tokens long"))
    removed(once)
    return folder, before(manifest, ["part", "k"], "tokens", name="base").select("file", "documents", "tokens", "base")


def read_documents(folder: str, manifest: DataFrame, id_column: str = "doc_id", with_ids: bool = False, read_tokens: int = READ_TOKENS) -> DataFrame:
    """One row a document, read back from the files: the id, start, n_tokens, ids_crc32, and with `with_ids` the ids."""
    names = [id_column, "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def run(batches):
        files, _ = file_system(folder)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with files.open_input_file(name) as source:
                    held = TokenFile(source)
                    ids, starts = held.documents()
                    i = 0
                    while i < len(ids):
                        j = max(i + 1, int(np.searchsorted(starts, starts[i] + read_tokens, "right")) - 1)
                        crc, kept = [], []
                        if j > i + 1 or starts[j] - starts[i] <= read_tokens:
                            run_ids = held.tokens(int(starts[i]), int(starts[j] - starts[i])).astype("<u4")
                            parts = [[p] for p in np.split(run_ids, (starts[i + 1 : j] - starts[i]))]
                        else:  # one long document
                            parts = [(held.tokens(a, min(read_tokens, int(starts[j]) - a)).astype("<u4") for a in range(int(starts[i]), int(starts[j]), read_tokens))]
                        for pieces in parts:
                            sum_, all_ = 0, []
                            for p in pieces:
                                sum_ = zlib.crc32(p.tobytes(), sum_)
                                if with_ids:
                                    all_.append(p.astype(np.int32))
                            crc.append(sum_)
                            if with_ids:
                                kept.append(np.concatenate(all_))
                        made = [pa.array(ids[i:j], pa.int64()), pa.array(base + starts[i:j]), pa.array(np.diff(starts[i : j + 1])), pa.array(crc, pa.int64())]
                        yield pa.RecordBatch.from_arrays([*made, *[pa.array(kept, pa.list_(pa.int32()))] * with_ids], names)
                        i = j

    spread = manifest.select("file", F.col("base").cast("long").alias("base")).repartition(max(1, manifest.count()))
    return spread.mapInArrow(run, f"{X.quoted(id_column)} long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
