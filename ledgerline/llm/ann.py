"""Approximate nearest neighbours by multiprobe p-stable hashing with exact reranking.

Vectors are scaled to length 1, where nearness by cosine and by Euclidean
distance agree.  A table hashes a vector to K integers floor((a.v + b) / w),
a Gaussian.  A query visits its own bucket and the buckets whose integers are
perturbed by one, in order of estimated success: the squared distances of its
projections to the slots' borders, added up over the perturbed integers.

* Equal vectors are one entry with their smallest ids (as many as an answer
  can need), so a vector that a third of the rows share is one candidate.
* Entries are dealt at random into blocks of about ``BLOCK`` rows; a block
  holds its entries' buckets in all tables.  Buckets may be of any size: no
  block depends on them.  The stated queries go to every block, in chunks;
  there their probes are looked up, the tables' candidates merged, their
  exact distances taken, and the block's best handed on.
* The best of all blocks are ranked by the cosine in double precision on the
  original vectors.

Cases: vectors null, empty, zero, with null or non-finite components or of
another length than ``dim`` (by default the commonest) take no part; a null
id takes no part; rows that repeat an id and vector count once; of an id with
several vectors each is a candidate, the best one ranks; with fewer
candidates than k, all found are returned; candidates of equal score rank by
their ids, also many vectors of one direction; a table without rows gives none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

TABLES, PROJECTIONS, WIDTH, PROBES = 8, 10, 2.0, 1200
BLOCK, CHUNK = 4096, 2048
SALTS = 16


def perturbations(m: int, count: int) -> list[tuple[int, ...]]:
    """Sets of sorted border ranks in order of expected score (the own bucket first).

    Ranks 0..2m-1 are the borders from nearest to farthest; ranks j and
    2m-1-j are the two borders of one integer and never go together.
    """
    j = np.arange(1, 2 * m + 1)
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))
    far = 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2))
    z = np.where(j <= m, near, far)
    out: list[tuple[int, ...]] = [()]
    heap = [(float(z[0]), (0,))]
    while heap and len(out) < count:
        score, s = heapq.heappop(heap)
        if not any(2 * m - 1 - r in s for r in s):
            out.append(s)
        last = s[-1] + 1
        if last < 2 * m:
            heapq.heappush(heap, (score - float(z[last - 1]) + float(z[last]), (*s[:-1], last)))
            heapq.heappush(heap, (score + float(z[last]), (*s, last)))
    return out


class Hashes:
    """The tables' functions for vectors of ``dim`` components, from a seed."""

    def __init__(self, dim: int, tables: int, projections: int, width: float, probes: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((tables, dim, projections))
        self.b = rng.random((tables, projections)) * width
        self.code = rng.integers(1, 2 ** 62, projections, dtype=np.int64) * 2 + 1
        self.width = width
        sets = perturbations(projections, probes)
        self.sets = np.zeros((len(sets), 2 * projections))
        for i, s in enumerate(sets):
            self.sets[i, list(s)] = 1
        self.sets = self.sets.astype(np.int64)

    def slots(self, t: int, x: np.ndarray) -> np.ndarray:
        return (x @ self.a[t] + self.b[t]) / self.width

    def buckets(self, t: int, x: np.ndarray) -> np.ndarray:
        """One number a bucket: a sum of the integers by odd multipliers (modulo 2**64)."""
        return (np.floor(self.slots(t, x)).astype(np.int64) * self.code).sum(axis=1)

    def probes(self, t: int, q: np.ndarray) -> np.ndarray:
        """Buckets to visit by each query, most likely first."""
        p = self.slots(t, q)
        own = np.floor(p).astype(np.int64)
        rest = p - own
        order = np.argsort(np.concatenate([rest, 1 - rest], axis=1), axis=1, kind="stable")
        step = np.concatenate([-self.code, self.code])[order]
        return (own * self.code).sum(axis=1)[:, None] + step @ self.sets.T


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten(), dtype=np.float64).reshape(-1, dim)


#: Cosines that differ by less are ranked by the measure itself, added up as :func:`cosine` does.
MARGIN = 1e-9


def exact_cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The doubles that :func:`cosine` gives of q with each row of x."""
    dot, own, norm = np.zeros(len(x)), 0.0, np.zeros(len(x))
    for j in range(len(q)):
        dot, own, norm = dot + q[j] * x[:, j], own + q[j] * q[j], norm + x[:, j] * x[:, j]
    return dot / (np.sqrt(own) * np.sqrt(norm))


def _enough(low: np.ndarray, best: int) -> int:
    """How many of these entries hold ``best`` different ids first (an id may have several vectors)."""
    first = np.sort(np.unique(low, return_index=True)[1])
    return int(first[best - 1]) + 1 if len(first) >= best else len(low)


def visit(h: Hashes, q: np.ndarray, x: np.ndarray, low: np.ndarray, best: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per query: the places of its best candidates in the block; ties go to the smaller of ``low``, the entries' first ids."""
    length = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    unit_q, unit_x = length(q), length(x)
    seen = np.zeros((len(q), len(x)), dtype=bool)
    for t in range(len(h.a)):
        codes, of_row = np.unique(h.buckets(t, unit_x), return_inverse=True)
        probes = h.probes(t, unit_q)
        at = np.minimum(np.searchsorted(codes, probes), len(codes) - 1)
        hit = codes[at] == probes
        visited = np.zeros((len(q), len(codes)), dtype=bool)
        visited[np.nonzero(hit)[0], at[hit]] = True
        seen |= visited[:, of_row]
    for i in range(len(q)):
        candidates = np.flatnonzero(seen[i])
        cosine = unit_x[candidates] @ unit_q[i]
        if len(candidates) > best:
            # the usual case: the best ones hold different ids, and the next one is farther by more than the margin
            top = np.argpartition(-cosine, best)[:best + 1]
            top = top[np.argsort(-cosine[top])]
            if cosine[top[-1]] < cosine[top[-2]] - MARGIN and len(set(low[candidates[top[:-1]]].tolist())) == best:
                yield i, candidates[top[:-1]]
                continue
        order = np.argsort(-cosine, kind="stable")
        cut = _enough(low[candidates[order]], best)
        if cut and cut < len(order) and cosine[order[cut]] >= cosine[order[cut - 1]] - MARGIN:
            order = order[cosine[order] >= cosine[order[cut - 1]] - MARGIN]
            near = candidates[order]
            order = order[np.lexsort((low[near], -exact_cosines(q[i], x[near])))]
            cut = _enough(low[candidates[order]], best)
        yield i, candidates[order[:cut]]


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision of two arrays of one length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
                                   F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def usable(vectors: DataFrame, id_col: str, vector: str, dim: int | None) -> DataFrame:
    """id and vector of the rows that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).where(
        F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    if dim is None:
        first = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
        dim = first["n"] if first else 1
    return rows.where(F.size(v) == dim)


def entries(rows: DataFrame, ids: int) -> DataFrame:
    """One row per distinct vector: ``v`` and its smallest ids.

    Two rounds of "the first few by rank", the first within salts, so that
    each task and each group of a hot vector hand on a few rows only.
    """
    d = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    d = d.withColumn("h", F.xxhash64("v"))
    first = d.withColumn("r", F.row_number().over(Window.partitionBy("h", "v", "salt").orderBy("id"))).where(F.col("r") <= ids)
    few = first.withColumn("r", F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))).where(F.col("r") <= ids)
    return few.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).drop("h")


def search(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding",
           dim: int | None = None, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH,
           probes: int = PROBES, seed: int = 7) -> DataFrame:
    """query_id, rank, id and score of the k nearest found of each row for which ``queries`` (on ``id``) holds."""
    rows = usable(vectors, id_col, vector, dim)
    index = materialize(entries(rows, k + 1).withColumn("entry", F.monotonically_increasing_id()), "ann-entries")
    asked = materialize(rows.where(queries).distinct(), "ann-queries")
    n, size = index.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n_q = asked.count()
    blocks, chunks = max(1, -(-n // BLOCK)), max(1, -(-n_q // CHUNK))
    h = Hashes(size or 1, tables, projections, width, probes, seed)
    place = lambda c, m: F.pmod(F.xxhash64(F.lit(seed), c), F.lit(m))
    left = index.select(place("entry", blocks).alias("block"), "entry", F.element_at("ids", 1).alias("low"), "v").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    right = asked.select(place("id", chunks).alias("chunk"), "id", "v").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def best_of_block(rows_x: pa.Table, rows_q: pa.Table) -> pa.Table:
        out = {"query_id": [], "entry": []}
        if rows_x.num_rows and rows_q.num_rows:
            x = matrix(rows_x.column("v").combine_chunks(), h.a.shape[1])
            q = matrix(rows_q.column("v").combine_chunks(), h.a.shape[1])
            names, asked_ids, low = rows_x.column("entry").to_numpy(), rows_q.column("id").to_numpy(), rows_x.column("low").to_numpy()
            for i, at in visit(h, q, x, low, k + 1):
                out["query_id"].append(np.full(len(at), asked_ids[i]))
                out["entry"].append(names[at])
        return pa.table({c: np.concatenate(v) if v else np.empty(0, np.int64) for c, v in out.items()})

    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(
        best_of_block, "query_id long, entry long")
    scored = (found.join(index.select("entry", "v", "ids"), "entry")
              .join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
              .select("query_id", "ids", cosine(F.col("q"), F.col("v")).alias("score")))
    single = (scored.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id != query_id")
              .groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return single.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The exact answer, to measure recall by; every pair is scored."""
    rows = usable(vectors, id_col, vector, None)
    q = rows.where(queries).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    pairs = rows.join(q, F.col("id") != F.col("query_id")).select("query_id", F.col("id").alias("vec_id"),
                                                                  cosine(F.col("q"), F.col("v")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)
