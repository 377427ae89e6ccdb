"""Feeds: parsing, a data source over many addresses, and rendering."""

from __future__ import annotations

import re
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass
from email.utils import format_datetime
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from broadsheet.functions.text import escape_html

ENTRY = T.StructType(
    [*[T.StructField(c, T.StringType()) for c in ("title", "link", "content", "description", "published", "updated", "image")], T.StructField("tags", T.ArrayType(T.StringType()))]
)
_IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp")


def file_system(address: str):
    """(file system, path in it) of an address of any store that pyarrow knows; what Spark calls s3a is s3 there."""
    from pyarrow import fs

    if address.startswith(("/", "file:")):
        return fs.LocalFileSystem(), "/" + address.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri("s3://" + address.split("://", 1)[1] if address.startswith(("s3a://", "s3n://")) else address)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def feed_entries(xml: str | bytes | None, default_title: str | None = "No title") -> list[dict]:
    """Entries of an RSS or Atom feed; those without a link are left out, and a feed that isn't XML has none. Without a default, an empty title stays empty and one that is missing is null."""
    try:
        root = ET.fromstring(xml) if xml else None
    except ET.ParseError:
        return []
    out = []
    for item in root.iter() if root is not None else ():
        if _local(item.tag) not in ("item", "entry"):
            continue
        got: dict[str, list[ET.Element]] = {}
        for child in item.iter():
            if child is not item:
                got.setdefault(_local(child.tag), []).append(child)
        text = lambda *names: next(("".join(e.itertext()).strip() for n in names for e in got.get(n, []) if "".join(e.itertext()).strip()), None)  # noqa: E731, B023
        link = next((e.get("href") or (e.text or "").strip() for e in got.get("link", []) if (e.get("rel") or "alternate") == "alternate" and (e.get("href") or (e.text or "").strip())), None)
        if not link:
            continue
        content, description = text("encoded", "content"), text("description", "summary")
        enclosed = next((e.get("url") for e in got.get("enclosure", []) if (e.get("type") or "").startswith("image") or (e.get("url") or "").lower().split("?")[0].endswith(_IMAGE_ENDINGS)), None)
        media = next((e.get("url") for n in ("content", "thumbnail") for e in got.get(n, []) if e.get("url")), None)
        inline = next((p.split(q)[0] for p, q in ((x[5:], x[4]) for x in (content or description or "").split("<img")[1:] for x in [x[x.find("src=") :]] if x.startswith("src=") and len(x) > 5)), None)
        tags = [e.get("term") or (e.text or "").strip() for e in got.get("category", [])]
        out.append(
            {
                "title": text("title") or default_title or ("" if "title" in got else None), "link": link, "content": content, "description": description, "published": text("pubdate", "published", "created", "date"), "updated": text("updated"),
                "image": enclosed or media or inline, "tags": [t for t in tags if t],
            }
        )
    return out


@F.pandas_udf(T.ArrayType(ENTRY))
def entries(xml: pd.Series) -> pd.Series:
    return xml.map(feed_entries)


@F.pandas_udf(T.ArrayType(ENTRY))
def entries_as_they_are(xml: pd.Series) -> pd.Series:
    """The same without a default title."""
    return xml.map(lambda x: feed_entries(x, None))


#: What an element's text would not come back with: characters that XML does not have or turns into others, and what readers take for white space at an end. A % marks texts in percent-encoding.
_LOST = r"(?U)[\x00-\x08\x0b-\x1f\x{fffe}\x{ffff}%]|^\s|\s\z"


def as_element(name: str, text: Column) -> Column:
    """An element from which `of_element` has the same text again, whatever is in it; null if it is null."""
    held = F.when(text.rlike(_LOST), F.url_encode(text)).otherwise(escape_html(text))
    return F.concat(F.lit(f"<{name}>"), held, F.lit(f"</{name}>"))


def of_element(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("%")), F.url_decode(text)).otherwise(text)


class _Address(InputPartition):
    def __init__(self, address: str):
        self.address = address


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.addresses = [a for a in options.get("addresses", options.get("path", "")).split(",") if a]
        self.kind, self.schema = options.get("kind", "feed"), schema

    def partitions(self) -> list[InputPartition]:
        """One a source, so that they are read side by side."""
        return [_Address(a) for a in self.addresses]

    def read(self, partition: _Address) -> Iterator[tuple]:
        """A source that can't be read has no rows; the others are not touched by it."""
        try:
            files, path = file_system(partition.address)
            with files.open_input_stream(path) as stream:
                data = stream.read()
        except Exception:  # noqa: BLE001
            return
        yield from (tuple([partition.address, *[e.get(c) for c in self.schema.names[1:]]]) for e in self.parsed(data))

    def parsed(self, data: bytes) -> list[dict]:
        from broadsheet.functions import html as H

        if self.kind == "feed":
            return feed_entries(data)
        text = H.decoded(data, None)
        return H.list_items(text, None) if self.kind == "page" else H.channel_messages(text)


class _StreamReader(DataSourceStreamReader):
    """Addresses whose document has changed since the last trigger are read again. An offset has for each address when it was changed and its size; one that can't be looked at doesn't stop the others; it keeps its last
    offset while the query runs and is read when it is there again."""

    def __init__(self, options: dict, schema: T.StructType):
        self.source, self.known = _Reader(options, schema), {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for address in self.source.addresses:
            try:
                files, path = file_system(address)
                info = files.get_file_info(path)
                if info.is_file:
                    self.known[address] = f"{info.mtime_ns} {info.size}"
            except Exception:  # noqa: BLE001, S112
                continue
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.known = {**end, **self.known}
        return [_Address(a) for a, state in end.items() if start.get(a) != state]

    def read(self, partition: _Address) -> Iterator[tuple]:
        return self.source.read(partition)

    def commit(self, end: dict) -> None:
        self.known = {**end, **self.known}


class FeedSource(DataSource):
    """`spark.read.format("broadsheet_feed").option("addresses", "a,b").load()`; also with kind=page or kind=channel."""

    @classmethod
    def name(cls) -> str:
        return "broadsheet_feed"

    def schema(self) -> T.StructType:
        from broadsheet.functions import html as H

        kind = self.options.get("kind", "feed")
        fields = ENTRY if kind == "feed" else H.ITEMS.elementType if kind == "page" else H.MESSAGE
        return T.StructType([T.StructField("source", T.StringType()), *fields.fields])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options), schema)


#: Type of source -> options of the reader.
REGISTRY = {"rss": {"kind": "feed"}, "page": {"kind": "page"}, "telegram": {"kind": "channel"}}


def reader_of(kind: Column) -> Column:
    """What reads a source of this registered type (in any case); null for others."""
    registered = F.create_map(*[F.lit(x) for name, options in REGISTRY.items() for x in (name, options["kind"])])
    return F.try_element_at(registered, F.lower(kind))


def read_sources(spark: SparkSession, kind: str, addresses: list[str]) -> DataFrame:
    """Rows of all sources of a registered type; unknown types are an error."""
    spark.dataSource.register(FeedSource)
    return spark.read.format("broadsheet_feed").options(addresses=",".join(addresses), **REGISTRY[kind]).load()


def read_addresses(addresses: DataFrame, kind: str) -> DataFrame:
    """The same for addresses that are rows (column `address`), of which there may be any number: each task reads those of its partition, none goes through the driver.

    Null addresses and sources that can't be read have no rows; an address that is there twice is read twice.
    """
    schema = FeedSource({**REGISTRY[kind]}).schema()
    reader = _Reader(REGISTRY[kind], schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for address in frame["address"].dropna():
                yield pd.DataFrame(list(reader.read(_Address(address))), columns=schema.names)

    return addresses.select("address").mapInPandas(run, schema)


def stream_sources(spark: SparkSession, kind: str, addresses: list[str]) -> DataFrame:
    """The same as a stream: each trigger has the rows of the sources that have changed since the one before. Entries that were there before come again with their source; `dropDuplicates` on source and link leaves the new ones."""
    spark.dataSource.register(FeedSource)
    return spark.readStream.format("broadsheet_feed").options(addresses=",".join(addresses), **REGISTRY[kind]).load()


def read_landed(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of feed files landed in a folder of any store that Spark reads: path and the entry's columns."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.decode("content", "UTF-8").alias("xml"))
    return files.select("path", F.explode(entries("xml")).alias("e")).select("path", "e.*")


#: Characters that XML does not have.
_NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def _xml(name: str, value: str | None) -> str:
    return "" if value is None else f"<{name}>{escape(_NOT_XML.sub('', value))}</{name}>"


@dataclass
class _Written(WriterCommitMessage):
    part: str
    name: str


class _FeedWriter(DataSourceWriter):
    """Each task writes the rows of its partition, in their order, as a feed of its own beside the place where it is to be; they get their names when all tasks have ended."""

    def __init__(self, options: dict, names: list[str], overwrite: bool):
        self.options, self.names, self.overwrite = options, names, overwrite

    def write(self, rows: Iterator) -> _Written:
        from pyspark import TaskContext

        files, base = file_system(self.options["path"])
        files.create_dir(base, recursive=True)
        number = TaskContext.get().partitionId()
        part = f"{base}/.feed-{number:05d}-{uuid.uuid4().hex}"
        with files.open_output_stream(part) as out:
            out.write(f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel>{_xml("title", self.options.get("title", ""))}{_xml("link", self.options.get("link", ""))}'.encode())
            for row in rows:
                r = dict(zip(self.names, row, strict=True))
                stamp = format_datetime(r["published_at"]) if r.get("published_at") is not None else None
                key = r.get("url") or (str(r["id"]) if r.get("id") is not None else None)
                out.write(("<item>" + _xml("title", r.get("title") or "") + _xml("link", r.get("url") or "") + _xml("description", r.get("summary") or "") + _xml("guid", key) + _xml("pubDate", stamp) + "</item>").encode("utf-8", "replace"))
            out.write(b"</channel></rss>")
        return _Written(part, f"{base}/feed-{number:05d}.xml")

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        files, base = file_system(self.options["path"])
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if old.base_name.startswith("feed-"):
                    files.delete_file(old.path)
        for m in messages:
            files.move(m.part, m.name)

    def abort(self, messages: list) -> None:
        files, _ = file_system(self.options["path"])
        for m in messages:
            if m is not None:
                files.delete_file(m.part)


class FeedSink(DataSource):
    """`df.write.format("broadsheet_rss").option("path", folder).option("title", ...)`: a feed a partition, of the columns id, title, url, summary, published_at that are there."""

    @classmethod
    def name(cls) -> str:
        return "broadsheet_rss"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _FeedWriter(dict(self.options), schema.names, overwrite)


def write_feed(articles: DataFrame, folder: str, title: str, link: str, limit: int = 50) -> None:
    """Writes RSS 2.0 of the `limit` latest articles to a file in the folder (one task has these rows); what was there goes when it is whole."""
    articles.sparkSession.dataSource.register(FeedSink)
    latest = articles.select("id", "title", "url", "summary", "published_at").orderBy(F.col("published_at").desc_nulls_last(), "id").limit(limit)
    latest.coalesce(1).write.format("broadsheet_rss").mode("overwrite").options(path=folder, title=title, link=link).save()
