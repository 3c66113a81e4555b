import datetime
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import merkle
from ledgerline.llm.queries import QUERIES


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """The last node and each node's siblings, as (before, after) a level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            k = at[i]
            paths[i] = [*p, (nodes[k - 1], "") if k % 2 else ("", nodes[k + 1] if k + 1 < len(nodes) else "")]
            at[i] = k // 2
        nodes = [H(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def brute(rows, changed):
    """rows: (doc_id, source, lang, n_chars, text)."""
    leaf = {i: H(*map(field, r)) for i, r in enumerate(rows)}
    by = {}
    for i, r in enumerate(rows):
        by.setdefault(r[2], []).append(i)
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    for g in langs:
        by[g].sort(key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaf[i]))
    sub = {g: tree([leaf[i] for i in by[g]]) for g in langs}
    root, top = tree([sub[g][0] for g in langs]) if langs else (None, [])
    out = []
    for k, g in enumerate(langs):
        for i, path in zip(by[g], sub[g][1], strict=True):
            path = path + top[k]
            r = rows[i]
            node = H(*map(field, (*r[:3], None if r[3] is None else r[3] + 1, r[4]))) if changed(r) else leaf[i]
            for before, after in path:
                node = H(before, node, after)
            out.append((r[0], leaf[i], sub[g][0], root, H(*[b + a for b, a in path]), node, node == root))
    return sorted(out, key=repr)


def seventh(r):
    return r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0


def manifest(df, **kw):
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return sorted(map(tuple, merkle.manifest(df, changed, change={"n_chars": F.col("n_chars") + 1}, **kw).collect()), key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = QUERIES["op12_merkle_manifest"](spark, sf)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, got.collect()), key=repr)
    assert got == brute(rows, seventh)
    assert {r[0] for r in got if not r[6]} == {r[0] for r in rows if seventh(r)}


@pytest.mark.parametrize("sizes", [(1,), (2,), (3, 1), (16, 17, 15), (33, 1, 2, 256, 31), (257,)])
def test_tree_sizes(spark, sizes):
    rows = [(1000 * k + i, "s", f"l{k}", i, f"text {i}") for k, n in enumerate(sizes) for i in range(n)]
    assert manifest(spark.createDataFrame(rows, SCHEMA)) == brute(rows, seventh)


def test_more_groups_than_a_row_has_slots(spark):
    rows = [(i, None, None if i == 0 else f"{i:03d}", i, "é" * i) for i in range(70)]
    assert manifest(spark.createDataFrame(rows, SCHEMA)) == brute(rows, seventh)


def test_odd_rows(spark):
    rows = ([(7, "s", "en", 5, "same")] * 40 + [(7, "s", "en", 6, "other"), (None, None, None, None, None), (None, "", "", 0, ""),
            (2, None, "", None, None), (3, "s", "en", None, "x"), (4, "s", "zz", 9, "long " * 500_000), (-1, "s", "é", 1, "ü")])
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("hash", "place", "width", "up", "path", "root", "key", "branch", "later", "tag", "tree"):
        df = df.withColumn(c, F.lit(datetime.date(2020, 1, 1)))
    got = manifest(df)
    assert got == brute(rows, seventh)
    assert sum(not r[6] for r in got) == sum(seventh(r) and r[3] is not None for r in rows)
    assert manifest(df.limit(0)) == []


def test_any_change_breaks_the_proof(spark):
    rows = [(i, "s", "en", i, f"t{i}") for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = merkle.manifest(df, F.col("doc_id") == 3, change={"text": F.lit("forged")}).where("NOT verified").collect()
    assert [r["doc_id"] for r in out] == [3]
    assert merkle.manifest(df, F.lit(True)).where("NOT verified").count() == 0
