"""WARC archives written and read back through an index.

Writing: each task streams its records, one gzip member each, into files of its own in a shared folder and emits one
index row per record (file, offset, length, url, digest, ids). Only rows of successful tasks reach the Parquet
index, so a file left by a lost task is never referred to. Reading starts at the index: selected rows are sorted by
(file, offset) and neighbours are fetched by one coalesced range read.

Revisits: among records with equal payloads of at least ``min_revisit`` bytes, the smallest page_id is the response
and the others carry its id and the payload's digest and length but no payload.

Defined cases: null html is an empty payload; null urls are written as an empty target; repeated rows of the
smallest page_id are all responses; rows with a null page_id are responses unless a row with an id has their payload;
an empty table gives an empty index. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import time
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._common import scratch, table

MIN_REVISIT = 100
INDEX = "page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long, file string, offset long, length long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
CRLF = "\r\n"


def file_system(uri: str):
    """(pyarrow file system, path) of a URI or local path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if urlparse(uri).scheme == "file":
        return fs.LocalFileSystem(), unquote(urlparse(uri).path)
    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{digest}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record around an HTTP answer; a revisit has the answer's head, no payload."""
    http = CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {size}", "", ""]).encode()
    body = http + (b"" if refers_to is not None else payload)
    kind = "response" if refers_to is None else "revisit"
    own = record_id(page_id, digest) if refers_to is None else f"<urn:uuid:{uuid.uuid4()}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {time.strftime('%Y-%m-%dT%H:%M:%SZ', time.gmtime())}"]
    head += [f"WARC-Target-URI: {(url or '').replace(chr(13), '').replace(chr(10), '')}", f"WARC-Payload-Digest: sha256:{digest}"]
    head += [f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"Content-Length: {len(body)}", "", ""]
    return CRLF.join(head).encode() + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The record's header fields and the payload behind the HTTP head of its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split(CRLF)[1:] if ": " in x)
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def with_revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Adds payload_digest, payload_bytes and refers_to. Only digests that repeat are joined back."""
    html = F.coalesce("html", F.lit(""))
    base = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    repeats = base.filter(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    # payloads too small to be revisits, such as the many empty ones, get keys of their own that meet nothing
    base = base.withColumn("_key", F.when(F.col("payload_bytes") >= min_revisit, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))))
    joined = base.join(repeats.withColumnRenamed("payload_digest", "_key"), "_key", "left").drop("_key")
    return joined.withColumn("refers_to", F.when(~F.col("_first").eqNullSafe(F.col("page_id")), F.col("_first"))).drop("_first")


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Rows as a frame; ids with nulls stay exact integers, never doubles."""
    kinds = [c.split() for c in schema.split(", ")]
    return pd.DataFrame({name: pd.array(list(values), dtype="Int64" if kind == "long" else "object") for (name, kind), values in zip(kinds, zip(*rows, strict=True), strict=True)})


def _writer(folder: str, roll_bytes: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = file_system(folder)
        out, name, at = None, "", 0
        try:
            for frame in frames:
                rows = []
                for r in frame.itertuples(index=False):
                    if out is None or at >= roll_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    refers = None if pd.isna(r.refers_to) else int(r.refers_to)
                    page_id = None if pd.isna(r.page_id) else int(r.page_id)
                    raw = gzip.compress(record_bytes(page_id, r.url, r.html.encode(), r.payload_digest, r.payload_bytes, refers), 4, mtime=0)
                    out.write(raw)
                    rows.append((page_id, r.url, r.payload_digest, r.payload_bytes, "response" if refers is None else "revisit", refers, name, at, len(raw)))
                    at += len(raw)
                if rows:
                    yield _frame(rows, INDEX)
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, roll_bytes: int = 1 << 30) -> DataFrame:
    """Writes archives below ``folder`` and their index to ``folder/index``; returns the index."""
    spark = pages.sparkSession
    fs, path = file_system(folder)
    fs.create_dir(f"{path}/data", recursive=True)
    # ids travel as text: pandas would turn longs with nulls into doubles
    rows = with_revisits(pages, min_revisit).withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    rows.mapInPandas(_writer(f"{folder}/data", roll_bytes), INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _reader(folder: str, gap: int, most: int):
    def fetch(stream, group: list) -> list[tuple]:
        low = group[0].offset
        stream.seek(low)
        data = stream.read(group[-1].offset + group[-1].length - low)
        out = []
        for r in group:
            fields, body = parse_record(zlib.decompress(data[r.offset - low : r.offset - low + r.length], 31))
            kind = fields["WARC-Type"]
            refers = int(fields["X-Refers-To-Page-ID"]) if kind == "revisit" else None
            digest = hashlib.sha256(body).hexdigest() if kind == "response" else fields["WARC-Payload-Digest"].removeprefix("sha256:")
            size = len(body) if kind == "response" else int(fields["X-Payload-Length"])
            out.append((int(fields["X-Page-ID"]) if fields.get("X-Page-ID") else None, size, digest, kind, refers))
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = file_system(folder)
        name, stream = None, None
        for frame in frames:
            rows, group = [], []
            for r in frame.itertuples(index=False):
                if group and (r.file != name or r.offset > group[-1].offset + group[-1].length + gap or r.offset + r.length - group[0].offset > most):
                    rows += fetch(stream, group)
                    group = []
                if r.file != name:
                    if stream is not None:
                        stream.close()
                    name, stream = r.file, fs.open_input_file(f"{base}/{r.file}")
                group.append(r)
            if group:
                rows += fetch(stream, group)
            if rows:
                yield _frame(rows, READ)
        if stream is not None:
            stream.close()

    return run


def read_records(selected: DataFrame, folder: str, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """Fetches the records of the selected index rows: one range read for neighbours at most ``gap`` apart."""
    n = int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = selected.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInPandas(_reader(f"{folder}/data", gap, most), READ)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    return read_records(write_archives(table(spark, sf_dir, "pages"), folder), folder)


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS x, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, n AS payload_bytes, x AS payload_digest,
       CASE WHEN n >= 100 AND f IS DISTINCT FROM page_id AND f IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND f IS DISTINCT FROM page_id THEN f END AS refers_to
FROM d
"""
