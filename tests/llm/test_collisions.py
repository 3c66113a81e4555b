import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import collisions
from ledgerline.llm.queries import QUERIES


def brute(ids, vectors, threshold=0.95):
    """n_links and component of each row, all pairs compared."""
    x = collisions.unit(np.asarray(vectors, dtype=float))
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    low = np.array(ids)
    while True:
        new = np.minimum(low, np.where(near, low[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
        if (new == low).all():
            return near.sum(axis=1).tolist(), low.tolist()
        low = new


def found(df, **kw):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in collisions.near_duplicates(df, **kw).collect()),
                  key=lambda r: (r[0] is None, r))


def clusters(rng, dim, n, groups, spread):
    """n unrelated vectors and groups of near copies about as far apart as the threshold."""
    base = rng.standard_normal((n, dim))
    out = [base / np.linalg.norm(base, axis=1, keepdims=True)]
    for k, size in enumerate(groups):
        c = rng.standard_normal(dim)
        c /= np.linalg.norm(c)
        out.append(c + rng.standard_normal((size, dim)) * spread[k % len(spread)] / np.sqrt(dim))
    x = np.concatenate(out)
    return x[rng.permutation(len(x))]


def as_rows(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")


def test_numbers_of_the_method():
    small, large = collisions.Plan(1_000), collisions.Plan(10 ** 9)
    assert small.leads == 1 and 15 < large.leads < 40 and small.tables < large.tables < 200
    for p in (small, large):
        meet = collisions.same_slot(p.distance, collisions.SLOT * p.distance) ** p.leads
        assert (1 - meet) ** p.tables <= collisions.MISS
    rng = np.random.default_rng(1)
    z = np.abs(rng.standard_normal((200_000, collisions.COUNTED))) <= collisions.WINDOW
    assert (z.sum(axis=1) >= small.least).mean() >= 1 - 2 * collisions.SHORT
    d, w = 0.3, 2.5
    shift, jump = rng.random(400_000) * w, rng.standard_normal(400_000) * d
    assert abs((np.floor(shift / w) == np.floor((shift + jump) / w)).mean() - collisions.same_slot(d, w)) < 3e-3


def test_windows_count_collisions():
    p = np.random.default_rng(2).standard_normal((60, 9))
    want = (np.abs(p[:, None, :] - p[None, :, :]) <= 0.7).sum(axis=2)
    for i, near in collisions.passing(p, 0.7, 4):
        assert near.tolist() == np.flatnonzero(want[i] >= 4).tolist()


@pytest.mark.parametrize("seed,dim,threshold", [(1, 16, 0.95), (2, 64, 0.95), (3, 8, 0.99), (4, 32, 0.8)])
def test_against_all_pairs(spark, seed, dim, threshold):
    rng = np.random.default_rng(seed)
    d = np.sqrt(2 - 2 * threshold)
    x = clusters(rng, dim, 1500, [2, 3, 40, 200, 5, 5], [0.3 * d, 0.7 * d, 0.75 * d])
    ids = rng.permutation(len(x)) * 3
    links, component = brute(ids, x, threshold)
    got = found(as_rows(spark, ids, x), threshold=threshold)
    by = {i: (n, c) for i, n, c, _ in got}
    assert all(by[i][0] <= n for i, n in zip(ids.tolist(), links, strict=True))
    assert sum(n for n, _ in by.values()) >= 0.995 * sum(links)
    assert sum(by[i][1] == c for i, c in zip(ids.tolist(), component, strict=True)) >= 0.995 * len(ids)
    assert all(kept == (i == c) for i, _, c, kept in got)


def test_query_equals_all_pairs(spark):
    d = "/root/testdata/check_s"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=float)
    got = QUERIES["op13_collision_counting"](spark, d)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = {r["vec_id"]: r for r in got.collect()}
    links, component = brute(ids, x)
    assert sum(got[i]["n_links"] for i in ids) >= 0.995 * sum(links) > 0
    assert sum(got[i]["component_id"] == c for i, c in zip(ids, component, strict=True)) >= 0.995 * len(ids)


def test_hot_cells_are_cut_into_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = clusters(rng, 12, 100, [300], [0.12])
    ids = np.arange(len(x))
    links, component = brute(ids, x)
    monkeypatch.setattr(collisions, "CHUNK", 40)
    monkeypatch.setattr(collisions, "BIN", 64)
    got = found(as_rows(spark, ids, x))
    assert [g[1] for g in got] == links and [g[2] for g in got] == component


def test_copies_scaled_vectors_and_unusable_rows(spark):
    rng = np.random.default_rng(6)
    hot = [float(c) for c in rng.standard_normal(6)]
    far = [[0.0] * k + [1.0] + [0.0] * (5 - k) for k in range(6)]
    rows = [(i, hot) for i in range(10, 110)] + [(5, [2 * c for c in hot]), (200, [1e200 * c for c in hot])]
    rows += [(300 + k, v) for k, v in enumerate(far)] + [(7, hot[:5]), (8, hot[:5]), (300, far[0])]
    bad = [(400, None), (401, []), (402, [0.0] * 6), (403, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (None, hot), (None, None),
           (404, [float("nan")] + [1.0] * 5), (405, [float("inf")] + [1.0] * 5)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    for c in ("node", "cell", "n", "root", "v"):
        df = df.withColumn(c, F.lit("x"))
    got = found(df)
    assert len(got) == len(rows) + len(bad)
    by = {g[0]: g[1:] for g in got}
    assert by[5] == (101, 5, True) and by[200] == (101, 5, False) and all(by[i] == (101, 5, False) for i in range(10, 110))
    assert by[7] == (1, 7, True) and by[8] == (1, 7, False) and by[300] == (1, 300, True) and by[301] == (0, 301, True)
    assert all(by[i] == (0, i, True) for i in range(400, 406)) and by[None] == (0, None, True)
    assert found(df.limit(0)) == [] and len(found(df.where("vec_id >= 400"))) == 6
