"""WARC derivatives: responses become linked metadata and plain-text conversion records.

Records are rows with the header fields as columns and the block as text; ``write_warc`` turns them into files. Pages are read once, in
an Arrow pass without a shuffle.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanta.llm.common import publish

FETCHED = "2024-01-01T00:00:00Z"
BLOCK_TAGS = frozenset(
    "p div br li ul ol h1 h2 h3 h4 h5 h6 tr td th table article section nav header footer aside title head body html pre blockquote form main hr dd dt".split()
)
# scripts, styles and comments reach to the end of the page if nothing ends them
CODE = re.compile(r"<(script|style)(?:[ \t\r\n\f/][^>]*)?>.*?(?:</\1[ \t\r\n\f/]*>|\Z)", re.I | re.S)
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
TAG = re.compile(r"<(?:/?([a-zA-Z][^\s/>]*)|[!?/])[^>]*>")
BLANKS = re.compile(r"[ \t\r\f\xa0]+")
TITLE = re.compile(r"<title(?:[ \t\r\n/][^>]*)?>(.*?)</title", re.I | re.S)
LINE_END = re.compile(r"[\r\n]+")
LINK = re.compile(r"<a[ \t\r\n][^>]*href", re.I)


def plain_text_of(html: str) -> str:
    """The page's text: no code, comments or tags; blocks on lines of their own; all entities decoded; single blanks."""
    if "<" in html:
        html = CODE.sub(" ", html)
        if "<!--" in html:
            html = COMMENT.sub(" ", html)
        html = TAG.sub(lambda m: "\n" if m[1] and m[1].lower() in BLOCK_TAGS else "", html)
    if "&" in html:
        html = unescape(html)
    lines = (line.strip(" ") for line in BLANKS.sub(" ", html).split("\n"))
    return "\n".join([line for line in lines if line])


def record_id(kind: str, *parts: Column) -> Column:
    """A urn:uuid made from a hash, so that a record built again has the same identifier."""
    h = F.md5(F.concat_ws("|", F.lit(kind), *parts).cast("binary"))
    cuts = [F.substr(h, F.lit(at), F.lit(n)) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def length(block: Column) -> Column:
    return F.octet_length(block).cast("long")


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", fetched: str = FETCHED) -> DataFrame:
    """Response records (key, record_id, target_uri, date, http_header, payload, payload_digest) of stored pages.

    Null pages are empty; null addresses stay null. The identifier comes from key, address and payload digest; repeated
    rows give repeated records. Other columns are ignored.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", digest(F.col("payload")))
    header = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length(F.col("payload")).cast("string"), F.lit("\r\n\r\n")
    )
    name = record_id("response", F.coalesce(F.col("key").cast("string"), F.lit("")), F.coalesce("target_uri", F.lit("")), F.col("payload_digest"))
    return rows.select("key", name.alias("record_id"), "target_uri", F.lit(fetched).alias("date"), header.alias("http_header"), "payload", "payload_digest")


def derive(source: DataFrame) -> DataFrame:
    """Two records per response: ``metadata`` (application/warc-fields) and ``conversion`` (text/plain).

    Rows: key, type, record_id, refers_to, target_uri, date, content_type, source_header, source_digest, block_digest,
    content_length, block. Both refer to the response's identifier and keep its HTTP header and payload digest;
    the metadata block names the conversion. An empty payload gives an empty conversion block. All named and numeric
    entities are decoded, as browsers read them; a script, style or comment without an end reaches to the end of the page. No
    row is shuffled, and the text is made once for both.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = [x or "" for x in batch.column(6).to_pylist()]
            titles = [m[1] if (m := TITLE.search(page)) else "" for page in pages]
            columns = [
                pa.array([len(x.encode("utf-8", "surrogatepass")) for x in pages], pa.int64()),
                pa.array([plain_text_of(page) for page in pages], pa.string()),
                pa.array([" ".join(plain_text_of(title).split("\n")) for title in titles], pa.string()),
                pa.array([len(LINK.findall(page)) for page in pages], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], *columns], [*batch.schema.names[:6], "payload_length", "text", "title", "links"])

    names = "key", "record_id", "target_uri", "date", "http_header", "payload_digest", "payload"
    schema = "key long, record_id string, target_uri string, date string, http_header string, payload_digest string, payload_length long, "
    text = source.select(*names).mapInArrow(read, schema + "text string, title string, links long")
    text = text.withColumns({"conversion_id": record_id("conversion", F.col("record_id")), "text_digest": digest(F.col("text"))})
    fields = F.concat(
        F.lit("title: "), F.col("title"), F.lit("\r\noutlinks: "), F.col("links").cast("string"),
        F.lit("\r\nconversion: "), F.col("conversion_id"), F.lit("\r\nconversion-digest: "), F.col("text_digest"),
        F.lit("\r\npayload-length: "), F.col("payload_length").cast("string"), F.lit("\r\n"),
    )
    record = lambda kind, name, content, block: F.struct(
        F.lit(kind).alias("type"), name.alias("record_id"), F.lit(content).alias("content_type"), block.alias("block")
    )
    both = F.array(
        record("metadata", record_id("metadata", F.col("record_id")), "application/warc-fields", fields),
        record("conversion", F.col("conversion_id"), "text/plain; charset=utf-8", F.col("text")),
    )
    each = text.select(
        "key", F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("http_header").alias("source_header"),
        F.col("payload_digest").alias("source_digest"), F.explode(both).alias("r"),
    )
    return each.select(
        "key", "r.type", "r.record_id", "refers_to", "target_uri", "date", "r.content_type", "source_header", "source_digest",
        digest(F.col("r.block")).alias("block_digest"), length(F.col("r.block")).alias("content_length"), "r.block",
    )


def record_bytes(row: dict) -> bytes:
    """One WARC/1.1 record. Line breaks within a value, as addresses may hold them, become a blank and so no header of their own."""
    head = [
        ("WARC-Type", row["type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Refers-To", row["refers_to"]),
        ("WARC-Target-URI", row["target_uri"]), ("WARC-Date", row["date"]), ("WARC-Block-Digest", row["block_digest"]),
        ("WARC-Source-Payload-Digest", row["source_digest"]),
        ("WARC-Source-Header", " | ".join(row["source_header"].split("\r\n")[:-2])),
        ("Content-Type", row["content_type"]), ("Content-Length", str(row["content_length"])),
    ]
    lines = "".join(f"{k}: {LINE_END.sub(' ', v)}\r\n" for k, v in head if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + row["block"].encode() + b"\r\n\r\n"


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write a .warc.gz file per partition, each record a gzip member; returns (file, records, bytes) when it is read.

    ``folder`` is shared by all executors. Files appear under their final names when they are whole.
    """
    records.sparkSession.createDataFrame([(0,)], "x int").write.mode("ignore").parquet(f"{folder}/.made")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = size = 0

        def members():
            nonlocal n, size
            for batch in batches:
                for row in batch.to_pylist():
                    member = gzip.compress(record_bytes(row), 6, mtime=0)
                    n, size = n + 1, size + len(member)
                    yield member

        name = f"{TaskContext.get().partitionId():06d}.warc.gz"
        publish(folder, name, members())
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["file", "records", "bytes"])

    return records.mapInArrow(run, "file string, records long, bytes long")
