"""Files of directly addressable codes: against the tokenizers library and by random access."""

from __future__ import annotations

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from broadsheet.llm import _files as files
from broadsheet.llm import _text as X
from broadsheet.llm import queries as Q
from broadsheet.llm import tokenfile as T

from tests.conftest import DATA

TEXTS = [
    None, "", " \t\n", "one", "The Cat's sat. 'Tis WE'LL i've ''s \"'s don't'", "<|endoftext|>x<|ENDOFTEXT|> a<|startoftext|>.", "naïve café — ÀÉ " * 30, "a" * 3000, "ab " * 2500, "x\x1cy\x85z w\x0bv\x0cu\x00t",
    "日本語のテキスト。" * 40, "ΟΔΥΣΣΕΥΣ ΣΑΣ. İstanbul ǅ", "12345 ##!!\n\n\n  end", "%%% ### *** || <tag> & $5", "≮a ≠ e\u0301. e.\u0301 “.” é. .é (é)", "1/2 ½ ²x x² 3rd 'd 'D \u2003em\u00a0sp", "((a)) [b]. -c- _d_ 'e' '' ' 's's",
]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i - 3, t, "other") for i, t in enumerate(TEXTS)] + [(3, "one", "other"), (3, "one", "other"), (None, "no id", None), (None, "no other id", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)


def wanted(library, rows) -> list[tuple]:
    """Of documents in order, what the files have to give; those of one id in any order."""
    return [(i, [*library.encode(t or "", add_special_tokens=False).ids, T.END_ID]) for i, t in rows]


def modelled(made) -> list[tuple]:
    out, start = [], 0
    for i, ids in made:
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_encoding(library):
    coder = T.Coder()
    assert coder.by_chunk and coder.plain
    random.seed(1)
    letters = ["a", "B", "é", "'", "s", ".", " ", " ", "\n", "|", "<", "1", "́", "Σ", "ll", "'re", "-", "字", "\x0b", "\x1f", "<|endoftext|>"]
    texts = [t or "" for t in TEXTS] + ["".join(random.choices(letters, k=random.randint(1, 30))) for _ in range(3000)]
    for held in (texts, texts[::-1]):
        raw, offsets = X.buffers(pa.array(held))
        ids, to = coder.encode(raw, offsets, 2)
        for k, t in enumerate(held):
            assert ids[to[k] : to[k + 1]].tolist() == [*library.encode(t, add_special_tokens=False).ids, 2], t


def test_encoding_with_a_small_table_and_another_vocabulary(monkeypatch, library):
    from tokenizers import Tokenizer

    monkeypatch.setattr(T, "REMEMBERED", 3)
    held = [t or "" for t in TEXTS]
    raw, offsets = X.buffers(pa.array(held))
    for name, tokenizer in (("word_bpe_49k.json", library), ("byte_bpe_50k.json", Tokenizer.from_file(T.located("byte_bpe_50k.json")))):
        coder = T.Coder(name)
        for _ in range(2):
            ids, to = coder.encode(raw, offsets, 2)
            assert [ids[a:b].tolist() for a, b in zip(to[:-1], to[1:], strict=True)] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in held]
        assert coder.by_chunk == (name == "word_bpe_49k.json")


@pytest.mark.parametrize("kind", ["small", "large", "mixed", "equal", "none", "one"])
def test_random_access(kind):
    rng = np.random.default_rng(4)
    values = {
        "small": rng.integers(0, 2, 5000), "large": rng.integers(0, 2**32, 3000, dtype=np.uint64), "mixed": (2 ** (rng.random(9000) * 31)).astype(np.int64), "equal": np.full(700, 49406), "none": np.zeros(0, int), "one": np.array([7]),
    }[kind].astype(np.uint32)
    data = T.file_bytes(values, [None, 5], np.array([0, len(values) // 2, len(values)]))
    held = T.TokenFile(io.BytesIO(data))
    assert (held.tokens(0, len(values)) == values).all()
    for _ in range(200 if len(values) else 0):
        at = int(rng.integers(0, len(values)))
        n = int(rng.integers(0, min(600, len(values) - at) + 1))
        assert held.token(at) == values[at] and (held.tokens(at, n) == values[at : at + n]).all()
    ids, starts = held.documents()
    assert ids == [None, 5] and starts.tolist() == [0, len(values) // 2, len(values)]
    with pytest.raises(IndexError):
        held.tokens(len(values), 1)


def test_a_token_is_read_without_its_neighbours():
    class Counted(io.BytesIO):
        total = 0

        def read(self, n=-1):
            out = super().read(n)
            self.total += len(out)
            return out

    values = (2 ** (np.random.default_rng(1).random(400_000) * 16)).astype(np.uint32)
    source = Counted(T.file_bytes(values, [1], np.array([0, len(values)])))
    held = T.TokenFile(source)
    source.total = 0
    assert held.token(399_999) == values[-1] and source.total < 600


def test_level_widths_are_best():
    values = np.array([0, 1, 1, 2, 3, 9, 100, 3, 2, 1, 0, 0, 700] * 90)

    def size(widths):
        rest, bits = values, 0
        for k, w in enumerate(widths):
            bits += len(rest) * (w + (k < len(widths) - 1) * (1 + 64 / T.RANK_BITS))
            rest = (rest >> w)[rest >> w > 0]
        return bits

    def compositions(n):
        return [[w, *rest] for w in range(1, n + 1) for rest in compositions(n - w)] if n else [[]]

    assert size(T.level_widths(values)) == min(map(size, compositions(10)))


def test_damaged_files():
    data = T.file_bytes(np.arange(5000), [1], np.array([0, 5000]))
    for broken in (b"", data[:10], b"X" + data[1:], data[:30] + b"!" + data[31:]):
        with pytest.raises(T.TokenFileError):
            T.TokenFile(io.BytesIO(broken))
    with pytest.raises(T.TokenFileError):
        T.TokenFile(io.BytesIO(data[:-6000])).tokens(4990, 10)


@pytest.mark.parametrize("limits", [(40, 7), (T.FILE_TOKENS, T.READ_TOKENS)])
def test_files(spark, docs, library, limits):
    folder, manifest = T.write_tokens(docs, file_tokens=limits[0])
    rows = T.read_documents(folder, manifest, with_ids=True, read_tokens=limits[1]).collect()
    got = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in docs.collect()], key=lambda i: (i is not None, i))
    assert modelled([(r.doc_id, list(r.ids)) for r in got]) == [tuple(r)[:4] for r in got]
    assert sorted(map(repr, wanted(library, [(r.doc_id, r.text) for r in docs.collect()]))) == sorted(repr((r.doc_id, list(r.ids))) for r in got)
    held = manifest.collect()
    assert sum(m.tokens for m in held) == sum(r.n_tokens for r in got) and len(held) >= (5 if limits[0] == 40 else 1)


def test_long_text_and_no_rows(spark, library):
    text = "word, " * 700_000 + "end"
    rows = [tuple(r) for r in T.read_documents(*T.write_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()]
    ids = np.array([*library.encode("word, ").ids * 700_000, *library.encode("end").ids, 2], "<u4")
    assert rows == [(1, 0, len(ids), zlib.crc32(ids.tobytes()))]
    folder, manifest = T.write_tokens(spark.createDataFrame([], "doc_id long, text string"))
    assert T.read_documents(folder, manifest).count() == 0


def test_query(spark, library):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    assert sorted(tuple(r) for r in Q.op12_token_files(spark, f"{DATA}/sf0.001").collect()) == modelled(wanted(library, docs))


def test_schemes(tmp_path):
    assert files.known_scheme("s3a://bucket/x") == "s3://bucket/x" and files.known_scheme("s3n://b") == "s3://b" and files.known_scheme("hdfs://n/x") == "hdfs://n/x" and files.known_scheme("/a/b") == "/a/b"
    system, path = files.file_system(f"file://{tmp_path}/a")
    system.create_dir(path)
    files.removed(f"file:{tmp_path}/a")
    assert not (tmp_path / "a").exists()
