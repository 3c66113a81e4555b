"""WARC/1.1 archives as chunked record tables.

Writing: a record is laid out as a line of header fields, one line per chunk
of its payload (HTTP chunked transfer coding) and a closing line.  The lines
are rows, made by Spark from the payload column and written by Spark's own
writer with CRLF after each, so no task builds a whole record and a lost
executor's files are written again by the commit protocol.  Each part file is
a gzip stream of records, hence read by one task from start to end.

Reading: the lines of a file go through a streaming parser that keeps the
current record's digest and byte count and yields one row per chunk, with
the digest up to and including that chunk.  Only one chunk is held at a time.

Of records with equal payloads of at least ``min_revisit`` bytes the one with
the smallest id is a response, the others are revisits that refer to it.

Cases: a null payload is an empty one (one chunk row of no bytes); rows that
repeat the smallest id of equal payloads are all responses, each a record of
its own; a null id is written as ``null`` and never refers or is referred
to; a table without rows gives none; other columns of the input are ignored.
A truncated or altered archive raises an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 16
MIN_REVISIT = 100
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Transfer-Encoding: chunked", ""]) + CRLF
_END = "0" + CRLF + CRLF  # ends the chunks; the record's two CRLF follow

CHUNK_SCHEMA = ("file string, record_no long, record_id string, record_type string, target_uri string, refers_to string, "
                "payload_digest string, payload_bytes long, chunk_no long, chunk_offset long, data binary, "
                "digest_so_far string, last boolean")


def record_id(key: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(key.cast("string"), F.lit("null")))


def plan_records(pages: DataFrame, id_col: str = "page_id", payload: str = "html", url: str = "url",
                 min_revisit: int = MIN_REVISIT) -> DataFrame:
    """key, url, payload, digest, bytes and ``refers_to`` (the key of the response, null for a response)."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    p = pages.select(F.col(id_col).alias("key"), F.col(url).alias("url"), body.alias("payload")).select(
        "*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    big = (F.col("bytes") >= min_revisit) & F.col("key").isNotNull()
    shared = (p.where(big).groupBy(F.col("digest").alias("d")).agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").drop("n"))
    # records that can't share get a key of their own: nothing to match, and no hot null
    join_on = F.when(big, F.col("digest")).otherwise(F.concat(F.lit("-"), record_id(F.col("key"))))
    return (p.withColumn("j", join_on).join(shared, F.col("j") == F.col("d"), "left")
            .select("key", "url", "payload", "digest", "bytes",
                    F.when(F.col("first") < F.col("key"), F.col("first")).alias("refers_to")))


def record_lines(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per line of the archive; a record's lines are neighbours, in order."""
    text = lambda s: F.lit(s.encode())
    revisit = F.col("refers_to").isNotNull()
    k = F.ceil(F.col("bytes") / chunk_bytes)
    # bytes of the block: HTTP header, then for each chunk its length in hex, CRLF, data, CRLF
    full = F.floor(F.col("bytes") / chunk_bytes)
    rest = F.col("bytes") % chunk_bytes
    body = (full * (len(f"{chunk_bytes:x}") + 4) + F.when(rest > 0, F.length(F.hex(rest)) + 4).otherwise(0)
            + F.col("bytes") + len(_END))
    block = F.when(revisit, F.lit(0)).otherwise(body + len(_HTTP))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <"), record_id(F.col("key")),
        F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "),
        F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", " "),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("bytes").cast("string"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: <"),
                                 record_id(F.col("refers_to")), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), block.cast("string"))
    # the writer ends each line by CRLF: a header needs one more, and the record two at its end
    head = F.concat(header, F.when(revisit, F.lit(CRLF * 3)).otherwise(F.lit(CRLF * 2 + _HTTP[:-2])))
    d = records.select(head.alias("head"), "payload", revisit.alias("revisit"),
                       F.explode(F.sequence(F.lit(0), F.when(revisit, F.lit(0)).otherwise(k + 1))).alias("i"), k.alias("k"))
    part = F.substring(F.col("payload"), F.col("i").cast("int") * chunk_bytes - (chunk_bytes - 1), F.lit(chunk_bytes))
    line = (F.when(F.col("i") == 0, F.col("head").cast("binary"))
            .when(F.col("i") <= F.col("k"), F.concat(F.lower(F.hex(F.octet_length(part).cast("long"))).cast("binary"),
                                                     text(CRLF), part))
            .otherwise(text(_END + CRLF)))
    return d.select(line.cast("string").alias("value"))


def write_archives(records: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write planned records as gzipped WARC part files under ``path``."""
    record_lines(records, chunk_bytes).write.option("lineSep", CRLF).option("compression", "gzip").text(path)


class _Parser:
    """Lines of one file in, chunk rows out; holds at most one chunk."""

    def __init__(self, file: str, with_data: bool) -> None:
        self.file, self.with_data, self.record_no = file, with_data, -1
        self.state, self.gap = "between", 0
        self.fields: dict[str, str] = {}

    def feed(self, line: bytes) -> Iterator[tuple]:
        if self.state == "between":
            if line:
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"{self.file}: no record begins at {line[:40]!r}")
                self.record_no += 1
                self.fields, self.state = {}, "fields"
        elif self.state == "fields":
            if line:
                name, _, value = line.decode().partition(":")
                self.fields[name.strip().lower()] = value.strip()
            else:
                self.sha, self.done, self.chunk_no = hashlib.sha256(), 0, 0
                self.left = int(self.fields["content-length"])
                if self.fields["warc-type"] == "revisit":
                    self.state = "between"
                    yield self.row(b"", True, self.fields["warc-payload-digest"].removeprefix("sha256:"))
                else:
                    self.state = "http"
        elif self.state == "http":
            self.left -= len(line) + 2
            if not line:
                self.state = "length"
        elif self.state == "length":
            self.left -= len(line) + 2
            self.want, self.parts, self.have = int(line, 16), [], 0
            self.state = "data" if self.want else "end"
            if self.state == "end":
                yield from self.close()
        elif self.state == "data":
            # a chunk that holds CRLF comes as several lines
            self.left -= len(line) + 2
            if self.parts:
                self.parts.append(b"\r\n")
                self.have += 2
            self.parts.append(line)
            self.have += len(line)
            if self.have > self.want:
                raise ValueError(f"{self.file}: a chunk of record {self.record_no} is longer than it says")
            if self.have == self.want:
                data = b"".join(self.parts)
                self.sha.update(data)
                yield self.row(data, False, self.sha.hexdigest())
                self.done += self.want
                self.chunk_no += 1
                self.state = "length"
        else:
            self.left -= len(line) + 2
            self.state = "between"
            if self.left:
                raise ValueError(f"{self.file}: record {self.record_no} has another length than it says")

    def close(self) -> Iterator[tuple]:
        digest = self.sha.hexdigest()
        if (f"sha256:{digest}", str(self.done)) != (self.fields["warc-payload-digest"], self.fields["x-payload-length"]):
            raise ValueError(f"{self.file}: record {self.record_no} has another payload than it says")
        yield self.row(b"", True, digest)

    def row(self, data: bytes, last: bool, digest: str) -> tuple:
        f = self.fields
        bare = lambda k: f[k].strip("<>") if k in f else None
        return (self.file, self.record_no, bare("warc-record-id"), f["warc-type"], f["warc-target-uri"],
                bare("warc-refers-to"), f["warc-payload-digest"].removeprefix("sha256:"), int(f["x-payload-length"]),
                self.chunk_no, self.done, data if self.with_data else None, digest, last)

    def end(self) -> None:
        if self.state != "between":
            raise ValueError(f"{self.file}: ends within record {self.record_no}")


def read_chunks(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives under ``path``.

    A payload's chunks have numbers from 0, offsets and running digests; the
    closing row of each record (``last``) holds no data and the digest of the
    whole payload, checked against the header.  A revisit is a closing row
    alone.  ``with_data=False`` leaves the bytes out of the rows.
    """
    lines = spark.read.option("lineSep", CRLF).text(path).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").cast("binary").alias("line"))
    schema = pa.schema([
        ("file", pa.string()), ("record_no", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()),
        ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()), ("chunk_no", pa.int64()), ("chunk_offset", pa.int64()), ("data", pa.binary()),
        ("digest_so_far", pa.string()), ("last", pa.bool_())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, rows, held = None, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for b in batches:
            for file, line in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if parser is None or parser.file != file:
                    if parser:
                        parser.end()
                    parser = _Parser(file, with_data)
                for r in parser.feed(line.as_py()):
                    rows.append(r)
                    held += len(r[10] or b"")
                    if len(rows) >= 1000 or held >= 1 << 23:
                        yield out()
                        rows, held = [], 0
        if parser:
            parser.end()
        if rows:
            yield out()

    return lines.mapInArrow(parse, CHUNK_SCHEMA)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record: the closing rows of a chunk table."""
    return chunks.where("last").select("record_id", "record_type", "target_uri", "refers_to", "payload_bytes",
                                       F.col("digest_so_far").alias("payload_digest"))


def page_of(urn: Column) -> Column:
    """The key in a record id."""
    return F.regexp_extract(urn, r"^urn:page:(-?\d+)$", 1).try_cast("long")


#: What reading back the archives of ``pages`` gives, in DuckDB SQL.
ORACLE_RECORDS = f"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS target_uri, sha256(coalesce(html, '')) AS payload_digest,
         octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to, target_uri FROM f
"""
