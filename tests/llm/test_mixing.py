import re
from collections import defaultdict

import pytest

from ledgerline.llm import mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """Reshare by rounds: whoever is above three times its size is fixed there."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed = {}
    while True:
        left, ws = sum(sizes.values()) - sum(fixed.values()), sum(w[s] for s in names if s not in fixed)
        above = [s for s in names if s not in fixed and left * w[s] / ws > 3 * sizes[s]]
        if not above:
            return {s: fixed.get(s, left * w[s] / ws if ws else 0.0) for s in names}
        fixed.update({s: 3.0 * sizes[s] for s in above})


def check(rows, docs):
    size = {d["doc_id"]: len(WORD.findall(d["text"] or "")) for d in docs}
    per = defaultdict(int)
    for d in docs:
        per[d["source"]] += size[d["doc_id"]]
    want = brute_targets(dict(per))
    taken = defaultdict(int)
    source = {d["doc_id"]: d["source"] for d in docs}
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == per[s]
        assert r["target"] == pytest.approx(want[s], rel=1e-12)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    return want, taken


def test_query(spark, sf):
    rows = queries.QUERIES["op4_source_mix"](spark, "/root/testdata/sf0.1").collect()
    want, taken = check(rows, spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect())
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.2 * t
    again = queries.QUERIES["op4_source_mix"](spark, "/root/testdata/sf0.1").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_caps_nulls_and_empty(make_docs):
    rows = [(i, "w " * 100, "a") for i in range(3)] + [(10 + i, "w " * 50, "b") for i in range(200)] + \
        [(300, None, None), (301, "", "c"), (302, "x y", "é"), (303, "x y", "Z")]
    docs = make_docs(rows, extra=["size", "target", "copies", "of", "w", "row"])
    mixed = mixing.mix(docs)
    got = mixed.select("row.doc_id", "size", "source_size", "target", (mixed["size"] * mixed["copies"]).alias("taken")).collect()
    want, _ = check(got, docs.collect())
    assert want["a"] == 900.0
    emitted = mixing.emit(mixed)
    assert emitted.columns == docs.columns
    assert emitted.where("source = 'a'").count() == 9
    assert mixing.mix(docs.limit(0)).count() == 0


def test_repeated_rows_draw_alike(make_docs):
    docs = make_docs([(1, "a b c", "s")] * 5 + [(None, "a b", "s")] * 2 + [(2, "x " * 30, "t")])
    got = mixing.mix(docs).select("row.doc_id", "copies").collect()
    assert len(got) == 8 and len({tuple(r) for r in got}) == 3


def test_very_long_texts(make_docs):
    """Sizes count whole texts; a long text is emitted by its source's rate like any other."""
    docs = make_docs([(1, "word " * 400_000, "a"), (2, "x" * 3_000_000, "a"), (3, "\t\n y" * 200_000, "b"), (4, "z", "c")])
    mixed = mixing.mix(docs).select("row.doc_id", "size", "source_size", "target", "copies").collect()
    assert {r["doc_id"]: r["size"] for r in mixed} == {1: 400_000, 2: 1, 3: 200_000, 4: 1}
    assert {r["doc_id"]: r["source_size"] for r in mixed} == {1: 400_001, 2: 400_001, 3: 200_000, 4: 1}
    assert all(0 <= r["copies"] <= 3 for r in mixed)
    emitted = mixing.emit(mixing.mix(docs)).select("doc_id", "text").collect()
    assert sum(len(r["text"]) for r in emitted) == sum(
        r["copies"] * {1: 2_000_000, 2: 3_000_000, 3: 800_000, 4: 1}[r["doc_id"]] for r in mixed)


def test_native(spark, sf):
    plan = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan
