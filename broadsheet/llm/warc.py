"""WARC archives: a writer with revisit records, and a sequential reader.

Each archive is a file of gzip members, one a record. The reader inflates a stream
step by step, frames each record by its Content-Length, and verifies the digests of block and payload as the
bytes go by; it holds one header and one chunk at a time, and of a payload only what the caller asks for.

Records with equal payloads of at least `SMALL` bytes: that with the smallest id is the response, the others are
revisits that name it. Who revisits whom is found from digests alone; salted partial minima
keep a frequent payload out of any one task.

Edge cases: null html is an empty payload; payloads under `SMALL` bytes are all responses; a null id is larger than any other
and gets the name of its digest; rows repeated in full are records of their own, and where all the rows of a payload share an id one of them is
the response. A very long payload is one record, inflated step by step when it is read. Ids are integers or what casts to them; further columns are not looked at, whatever their names. An empty table gives no rows. A damaged record raises WarcError.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._files import file_system, removed
from ._shared import settled, shared_path

SMALL = 100
CHUNK = 1 << 16
#: Salts of the partial minima.
SALTS = 64
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    pass


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload_bytes: int = 0
    payload_sha256: str = ""
    payload: bytes | None = None


def _b32(sha: bytes) -> str:
    return "sha256:" + base64.b32encode(sha).decode().rstrip("=")


def record_bytes(record_id: str, uri: str, payload: bytes, kind: str, full_length: int, payload_sha: bytes, refers_to: str | None, page_id: int | None) -> bytes:
    """One gzip member: headers, an HTTP head, the payload (none in a revisit)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {full_length}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: {_b32(payload_sha)}", f"WARC-Block-Digest: {_b32(hashlib.sha256(block).digest())}",
        "Content-Type: application/http; msgtype=response", f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>", f"X-Refers-To-Page-Id: {page_of(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n") + packer.compress(block + b"\r\n\r\n") + packer.flush()


def record_id(page_id: int | None, sha: bytes) -> str:
    return f"urn:page:{page_id}" if page_id is not None else f"urn:sha256:{sha.hex()}"


def page_of(record: str) -> str:
    return record.removeprefix("urn:page:") if record.startswith("urn:page:") else ""


class _Member:
    """Inflated bytes of one gzip member, as they are asked for."""

    def __init__(self, stream, rest: bytes):
        self.stream, self.inflate, self.ready = stream, zlib.decompressobj(31), bytearray()
        self.raw = rest

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        data = self.inflate.unconsumed_tail or self.raw or self.stream.read(CHUNK)
        self.raw = b"" if not self.inflate.unconsumed_tail else self.raw
        if not data:
            raise WarcError("archive ends within a record")
        try:
            self.ready += self.inflate.decompress(data, CHUNK)
        except zlib.error as e:
            raise WarcError(f"damaged gzip member: {e}") from e
        return True

    def line(self) -> bytes:
        while (at := self.ready.find(b"\n")) < 0:
            if not self._more():
                raise WarcError("record ends within its headers")
        out = bytes(self.ready[: at + 1])
        del self.ready[: at + 1]
        return out.rstrip(b"\r\n")

    def some(self, most: int) -> bytes:
        while not self.ready:
            if not self._more():
                raise WarcError("record is shorter than its Content-Length")
        out = bytes(self.ready[:most])
        del self.ready[: len(out)]
        return out

    def finish(self) -> bytes:
        """Reads the member's end; returns compressed bytes that belong to the next."""
        while self._more():
            pass
        if bytes(self.ready) != b"\r\n\r\n":
            raise WarcError("record is longer than its Content-Length")
        return self.inflate.unused_data


def _headers(member: _Member) -> dict[str, str]:
    out = {}
    while line := member.line():
        name, mark, value = line.decode("utf-8", "replace").partition(":")
        if not mark:
            raise WarcError(f"not a header: {line[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def read_records(stream, with_payload: bool = True) -> Iterator[Record]:
    """Records of an archive in order; `stream` has read(n)."""
    rest = b""
    while rest or (rest := stream.read(CHUNK)):
        member = _Member(stream, rest)
        if not member.line().startswith(b"WARC/"):
            raise WarcError("not a WARC record")
        record = Record(_headers(member))
        left = int(record.headers["content-length"])
        block, payload = hashlib.sha256(), hashlib.sha256()
        head, body = bytearray(), io.BytesIO() if with_payload else None
        in_head = True
        while left:
            data = member.some(min(left, CHUNK))
            left -= len(data)
            block.update(data)
            if in_head:
                head += data
                if (at := head.find(b"\r\n\r\n")) < 0:
                    continue
                in_head, data = False, bytes(head[at + 4 :])
                record.http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[:at].decode("latin-1").split("\r\n")[1:])}
            record.payload_bytes += len(data)
            payload.update(data)
            if body is not None:
                body.write(data)
        rest = member.finish()
        if _b32(block.digest()) != record.headers.get("warc-block-digest"):
            raise WarcError("block digest differs")
        named = record.headers.get("warc-payload-digest", "").partition(":")[2]
        if record.headers["warc-type"] == "response" and _b32(payload.digest()) != f"sha256:{named}":
            raise WarcError("payload digest differs")
        record.payload_sha256 = base64.b32decode(named + "=" * (-len(named) % 8)).hex()
        record.payload = body.getvalue() if body is not None else None
        yield record


def revisits(pages: DataFrame, id_column: str = "page_id", html: str = "html", small: int = SMALL) -> DataFrame:
    """Of equal payloads the smallest id: rows of `row` (the page's number), `first_id`, `first_row` for the payloads that have several."""
    rows = pages.where(F.col("size") >= small).select("row", "id", "sha").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    least = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "row"))
    part = rows.groupBy("sha", "salt").agg(least.alias("least"), F.count(F.lit(1)).alias("n"))
    whole = part.groupBy("sha").agg(F.min("least").alias("first"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts")).where("n > 1")
    spread = whole.select("sha", "first", F.explode("salts").alias("salt"))
    return rows.join(spread, ["sha", "salt"]).select("row", F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row"))


def write_archives(pages: DataFrame, folder: str | None = None, id_column: str = "page_id", url: str = "url", html: str = "html") -> tuple[str, DataFrame]:
    """Writes each partition's pages to an archive in `folder` (shared; a URI that pyarrow's file systems know).

    Returns the folder and the manifest: file, records, bytes. A file appears under its name when it is complete, so a
    task that runs again replaces it by the same bytes.
    """
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    given = pages.select(
        F.col(X.quoted(id_column)).cast("long").alias("id"), F.coalesce(F.col(X.quoted(url)).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(X.quoted(html)).cast("string"), F.lit("")).alias("html"), F.monotonically_increasing_id().alias("row"),
    )
    # Numbers of rows are written with them: another scan, with other executors, might number them otherwise.
    numbered = shared_path(spark, "pages")
    given.write.option("compression", "zstd").parquet(numbered)
    source = spark.read.schema(given.schema).parquet(numbered)
    narrow = source.select("row", "id", F.octet_length("html").alias("size"), F.unhex(F.sha2("html", 256)).alias("sha"))
    known = settled(revisits(settled(narrow)))
    marked = source.join(known, "row", "left")

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        files, base = file_system(folder)
        files.create_dir(base, recursive=True)
        name, part = f"{base}/part-{at:05d}.warc.gz", f"{base}/.part-{at:05d}-{uuid.uuid4().hex}"
        n = size = 0
        out = None
        for batch in batches:
            for row in range(batch.num_rows):
                page, uri, text, first, first_row, own = (batch.column(c)[row].as_py() for c in ("id", "url", "html", "first_id", "first_row", "row"))
                payload = text.encode("utf-8")
                sha = hashlib.sha256(payload).digest()
                kind = "response" if first_row is None or first_row == own else "revisit"
                data = record_bytes(record_id(page, sha), uri.replace("\r", "%0D").replace("\n", "%0A"), payload, kind, len(payload), sha, record_id(first, sha) if kind == "revisit" else None, page)
                out = out or files.open_output_stream(part, compression=None)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            files.move(part, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([size])], ["file", "records", "bytes"])

    manifest = settled(marked.mapInArrow(run, "file string, records long, bytes long"))
    removed(numbered)  # every archive is there
    return folder, manifest


def read_archives(folder: str, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row a record, each archive read from its start to its end by one task: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload if asked for.

    payload_bytes of a revisit are those that its HTTP head states.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]

    def run(batches):
        files, _ = file_system(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows: list[tuple] = []
                held = 0
                with files.open_input_stream(name, compression=None, buffer_size=CHUNK) as stream:
                    for r in read_records(stream, with_payload):
                        page, first = r.headers["x-page-id"], r.headers.get("x-refers-to-page-id", "")
                        full = int(r.http.get("content-length", r.payload_bytes))
                        rows.append((int(page) if page else None, r.headers["warc-target-uri"], full, r.payload_sha256, r.headers["warc-type"], int(first) if first else None, *[r.payload] * with_payload))
                        held += len(r.payload or b"")
                        if len(rows) >= 1000 or held > 4 << 20:
                            yield _batch(rows, names, kinds)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, names, kinds)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    spread = manifest.select("file").repartition(max(1, manifest.count()), F.col("file"))
    return spread.mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
