import gzip
import hashlib
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import queries, warc
from ledgerline.session import scratch_dir


def brute(pages):
    out, first = {}, {}
    for p in sorted(pages):
        raw = (pages[p] or "").encode()
        d = hashlib.sha256(raw).hexdigest()
        f = first.setdefault(d, p) if len(raw) >= 100 else p
        out[p] = (len(raw), d, "response" if f == p else "revisit", None if f == p else f)
    return out


def run(spark, pages, chunk_bytes, **kw):
    path = scratch_dir(spark, "warc-test")
    warc.write_archives(warc.plan_records(pages), path, chunk_bytes)
    return path, warc.read_chunks(spark, path, **kw)


def rows_of(chunks):
    return warc.records(chunks).select(warc.page_of(F.col("record_id")), "payload_bytes", "payload_digest", "record_type",
                                       warc.page_of(F.col("refers_to"))).collect()


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, bytes string, payload string, key string, j string")


def test_edge_payloads_round_trip(spark):
    texts = [None, "", "a", "\r\n", "\r\n" * 5000, "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9, "é€" * 40, "x" * 99, "x" * 99,
             "y" * 100, "y" * 100, "0\r\n\r\n\r\n", "z" * 999, "\x00\x01" * 300, "l\n" * 5000, "y" * 100, "é" * 70_001]
    pages = pages_of(spark, [(i, f"http://h/{i}\r\nX: y" if i % 2 else None, t, "c", "c", "c", "c") for i, t in enumerate(texts)])
    for size in (7, 64, 1 << 16):
        path, chunks = run(spark, pages, size)
        got = {r[0]: tuple(r)[1:] for r in rows_of(chunks)}
        assert got == brute(dict(enumerate(texts)))
        parts = chunks.where("not last").collect()
        assert max(len(r["data"]) for r in parts) <= size
        for i, t in enumerate(texts):
            mine = sorted((r for r in parts if r["record_id"] == f"urn:page:{i}"), key=lambda r: r["chunk_no"])
            if got[i][2] == "response":
                assert b"".join(r["data"] for r in mine) == (t or "").encode()
                so_far = b""
                for k, r in enumerate(mine):
                    assert (r["chunk_no"], r["chunk_offset"]) == (k, len(so_far))
                    so_far += r["data"]
                    assert r["digest_so_far"] == hashlib.sha256(so_far).hexdigest()
            else:
                assert not mine


def test_files_are_warc(spark):
    """Read the files by content length alone, as any other reader would."""
    pages = pages_of(spark, [(i, f"u{i}", "p" * (i * 37) + "\r\n", *"cccc") for i in range(30)])
    path, _ = run(spark, pages, 100)
    seen = 0
    for f in os.listdir(path):
        if not f.startswith("part-"):
            continue
        raw, at = gzip.open(f"{path}/{f}").read(), 0
        while at < len(raw):
            end = raw.index(b"\r\n\r\n", at)
            head = raw[at:end].decode().split("\r\n")
            assert head[0] == "WARC/1.1"
            n = int(next(x for x in head if x.startswith("Content-Length")).split(":")[1])
            at = end + 4 + n
            assert raw[at:at + 4] == b"\r\n\r\n"
            at += 4
            seen += 1
    assert seen == 30


def test_repeated_rows_nulls_and_no_rows(spark):
    rows = [(5, "u", "s" * 200, *"cccc")] * 3 + [(9, "u", "s" * 200, *"cccc"), (None, "u", "s" * 200, *"cccc"), (None, None, None, *"cccc")]
    pages = pages_of(spark, rows)
    _, chunks = run(spark, pages, 64)
    assert Counter((r[0], r[3], r[4]) for r in rows_of(chunks)) == Counter(
        {(5, "response", None): 3, (9, "revisit", 5): 1, (None, "response", None): 2})
    _, none = run(spark, pages.limit(0), 64)
    assert none.count() == 0


def test_damage_is_found(spark):
    pages = pages_of(spark, [(i, "u", "payload " * 50 + str(i), *"cccc") for i in range(3)])
    path, _ = run(spark, pages.coalesce(1), 64)
    f = next(f"{path}/{x}" for x in os.listdir(path) if x.startswith("part-"))
    raw = gzip.open(f).read()
    for bad in (raw.replace(b"payload", b"pAyload", 1), raw[:-200]):
        d = scratch_dir(spark, "warc-bad")
        os.makedirs(d)
        with gzip.open(f"{d}/part-0.txt.gz", "w") as z:
            z.write(bad)
        with pytest.raises(Exception, match="payload|ends within|longer"):
            warc.read_chunks(spark, d).count()


def test_query(spark, sf):
    pages = {p["page_id"]: p["html"] for p in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.QUERIES["op1_warc_chunks"](spark, sf).collect()
    assert {r["page_id"]: tuple(r)[1:5] for r in got} == brute(pages) and len(got) == len(pages)
