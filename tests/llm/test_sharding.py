import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import queries, sharding


def test_matrix_is_exact():
    counts = [0, 5, 1000, 37, 3]
    m = sharding.communication_matrix(counts, 7, 1)
    assert m.sum(axis=1).tolist() == counts
    assert sorted(m.sum(axis=0).tolist()) == sorted([1045 // 7 + (i < 1045 % 7) for i in range(7)])
    assert sharding.communication_matrix([], 4, 1).shape == (0, 4)
    big = sharding.communication_matrix([3 * 10 ** 9, 10 ** 9], 3, 5)
    assert big.sum(axis=1).tolist() == [3 * 10 ** 9, 10 ** 9]


def test_matrix_follows_the_hypergeometric_law():
    draws = np.array([sharding.communication_matrix([10, 30], 4, s)[0] for s in range(2000)])
    assert np.allclose(draws.mean(axis=0), 2.5, atol=0.1)
    # variance of a hypergeometric draw: n K/N (1 - K/N) (N - n)/(N - 1)
    assert np.allclose(draws.var(axis=0), 10 * .25 * .75 * 30 / 39, rtol=0.12)


def test_bijection():
    for n in (1, 2, 3, 17, 1000, 4097):
        x = np.arange(n)
        out = sharding.bijection(x, np.full(n, n), np.full(n, 99, np.uint64))
        assert sorted(out.tolist()) == x.tolist()


def test_query(spark, sf):
    rows = queries.QUERIES["op10_hypergeometric_shards"](spark, sf).collect()
    docs = {d["doc_id"]: (d["text"] or "").encode() for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    slots = defaultdict(list)
    for r in rows:
        raw = docs[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(docs) == len({r["doc_id"] for r in rows})
    assert set(slots) == set(range(40))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    # near rows don't stay together
    near = {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}
    same = sum(near[i][0] == near[i + 1][0] for i in range(len(docs) - 1))
    assert same < 3 * len(docs) / 40
    again = queries.QUERIES["op10_hypergeometric_shards"](spark, sf).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_edge_cases(make_docs):
    docs = make_docs([(1, None), (1, ""), (None, "x"), (2, "y" * 100_000)] + [(7, "same")] * 9, extra=["row", "shard", "slot", "to"])
    got = sharding.shuffle_into_shards(docs, 4)
    assert sorted(r["count"] for r in got.groupBy("shard").count().collect()) == [3, 3, 3, 4]
    assert got.select("row.*").columns == docs.columns
    assert sharding.shuffle_into_shards(docs.limit(0), 4).count() == 0
    few = sharding.shuffle_into_shards(docs.limit(2), 4).collect()
    assert [(r["shard"], r["slot"]) for r in few] == [(0, 0), (1, 0)]


def test_many_input_files(spark, make_docs):
    """Rows dealt from each file are those of the matrix, whose rows the tasks draw from the counts on their paths."""
    docs = make_docs([(i, f"t{i % 13}") for i in range(900)])
    for n_files, n_shards in ((1, 3), (2, 5), (37, 7)):
        split = docs.repartitionByRange(n_files, "doc_id")
        got = sharding.shuffle_into_shards(split, n_shards, seed=3).select("row.doc_id", "shard", "slot").collect()
        assert sorted(r["doc_id"] for r in got) == list(range(900))
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert sorted(map(len, slots.values())) == sorted(sharding.shard_sizes(900, n_shards).tolist())
    counts = [5, 0, 700, 37, 3, 3, 152]
    files = spark.createDataFrame([(f"f{k}", n, k) for k, n in enumerate(counts)], "file string, n long, number long")
    m = sharding.communication_matrix(counts, 6, 8)
    sizes = sharding.shard_sizes(900, 6)
    paths = sharding.file_paths(files, sharding.halvings(len(counts))).collect()
    assert len(paths) == len(counts)
    for r in paths:
        row, before = sharding.matrix_row(r["number"], r["lefts"], r["rights"], sizes, 8)
        assert row.tolist() == m[r["number"]].tolist() and before.tolist() == m[:r["number"]].sum(axis=0).tolist()


def test_rows_are_dealt_by_the_matrix(spark, make_docs):
    docs = make_docs([(i, "x") for i in range(500)]).repartitionByRange(4, "doc_id")
    spread = {r["doc_id"]: r["shard"] for r in sharding.shuffle_into_shards(docs, 5, seed=11).select("row.doc_id", "shard").collect()}
    # range cuts follow doc_id, so each file is a run of ids; its dealt counts are a row of the matrix
    runs = [r["n"] for r in docs.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()]
    m = sharding.communication_matrix(runs, 5, 11)
    start = 0
    for row, n in zip(m, runs):
        assert np.bincount([spread[i] for i in range(start, start + n)], minlength=5).tolist() == row.tolist()
        start += n
