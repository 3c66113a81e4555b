import itertools
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import minhash, queries


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def brute(docs):
    """doc_id -> (set size, component), every pair that shares a shingle compared."""
    sets = {i: frozenset(shingles(t)) for i, t in docs}
    classes = defaultdict(list)
    for i, s in sets.items():
        classes[s].append(i)
    reps = {min(v): s for s, v in classes.items() if s}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i, j):
        i, j = find(i), find(j)
        parent[max(i, j)] = min(i, j)

    for s, v in classes.items():
        if s:
            for i in v:
                join(min(v), i)
    holders = defaultdict(list)
    for i, s in sorted(reps.items()):
        # a pair at 85 % shares one of the smallest 16 % (and one) of either set's shingles
        for x in sorted(s)[:len(s) - -(-85 * len(s) // 100) + 1]:
            holders[x].append(i)
    seen = set()
    for group in holders.values():
        for i, j in itertools.combinations(group, 2):
            if (i, j) not in seen:
                seen.add((i, j))
                a, b = reps[i], reps[j]
                if 100 * min(len(a), len(b)) >= 85 * max(len(a), len(b)):
                    n = len(a & b)
                    if 100 * n >= 85 * (len(a) + len(b) - n):
                        join(i, j)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(got, docs):
    want = brute(docs)
    assert len(got) == len(docs)
    wrong = [(r["doc_id"], tuple(r)[1:3], want[r["doc_id"]]) for r in got if tuple(r)[1:3] != want[r["doc_id"]]]
    assert not wrong, (len(wrong), wrong[:5])
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return want


def test_signature_parts():
    s = minhash.shingle_set(np.frombuffer(b"a B c d  a\tb c D", np.uint8))
    assert len(s) == len(shingles("a B c d  a\tb c D")) == 4
    assert len(minhash.shingle_set(np.frombuffer(b" \t\n", np.uint8))) == 0
    assert len(minhash.shingle_set(np.frombuffer(b"one two", np.uint8))) == 1


def test_estimate_follows_similarity(spark):
    rng, rows = random.Random(2), []
    for share in (0, 50, 70, 85, 95, 100):
        for _ in range(40):
            a = [rng.getrandbits(63) for _ in range(200)]
            common = round(200 * 2 * share / (100 + share))
            b = a[:common] + [rng.getrandbits(63) for _ in range(200 - common)]
            x, y = (minhash.packed_bits(minhash.minima(np.array(sorted(v), np.uint64))).tolist() for v in (a, b))
            rows.append((share, x, y))
    d = spark.createDataFrame(rows, "share int, x array<long>, y array<long>").withColumn(
        "e", minhash.estimate(F.col("x"), F.col("y")))
    for r in d.groupBy("share").agg(F.avg("e").alias("m"), F.stddev("e").alias("s")).collect():
        assert abs(r["m"] - r["share"] / 100) < 0.03
        assert r["s"] < 0.06


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, 201), (202, 201), (300, 300)] + \
        [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(250)] + [(5000, 5001 + i) for i in range(2000)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        return i if parent[i] == i else find(parent[i])

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for i in parent:
        assert got.get(i, i) == find(i)
    assert minhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_graded_copies_of_one_text(make_docs):
    """A large group of copies from a word to a third changed, chains across the threshold, and truncated copies."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(400)}x{rng.randrange(9)}" for _ in range(150)]
    docs = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(30)}"
        if i % 5 == 0:
            w = w[:rng.randrange(100, 150)]
        docs.append((i, " ".join(w)))
    w = [f"c{k}" for k in range(120)]
    for i in range(40):  # a chain: neighbours link, ends don't
        docs.append((1000 + i, " ".join(w)))
        w = list(w)
        w[3 * i % 120] = f"z{i}"
    docs += [(2000 + i, " ".join(f"v{i}_{k}" for k in range(30))) for i in range(50)]
    rng.shuffle(docs)
    check(minhash.near_duplicates(make_docs(docs)).collect(), docs)


def test_query_at_two_sizes(spark, sf):
    for d in (sf, "/root/testdata/sf0.1"):
        docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
        want = check(queries.QUERIES["op3_minhash_components"](spark, d).collect(), docs)
        assert len({c for _, c in want.values()}) < len(docs)


def test_edge_cases(make_docs):
    docs = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "a b c"), (7, "A\tB\nc"),
            (8, "é è ê"), (9, "É è ê"), (10, "x " * 40_000), (11, "x x x")]
    df = make_docs(docs, extra=["component_id", "key", "n_shingles", "pivot"])
    got = check(minhash.near_duplicates(df).collect(), docs)
    assert got[4] == (1, 3) and got[7] == (1, 6) and got[9] == (1, 9) and got[11] == (1, 10) and got[1] == (0, 1)
    again = minhash.near_duplicates(make_docs([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (0, "a b c d")])).collect()
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in again) == [
        ("0", 0, True), ("1", 0, False), ("1", 0, False), ("None", None, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0
