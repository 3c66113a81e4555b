"""Near-duplicate vectors by collision counting on one-dimensional projections.

Vectors are scaled to length 1, where a cosine of ``threshold`` is a Euclidean
distance d = sqrt(2 - 2 threshold).  A Gaussian projection moves two vectors at
distance d apart by a normal variable of deviation d, whatever their dimension.

1. Equal vectors are one class; only classes are compared, with their counts.
2. Classes meet in cells.  A table cuts ``leads`` projections into slots of
   ``SLOT`` d; vectors with the same slots share a cell.  ``leads`` grows with
   the logarithm of the number of classes, so that a cell holds about ``PER_CELL``
   unrelated ones at any size, and the number of tables follows from
   ``MISS``, the probability that a pair at the threshold shares no cell.
   A cell of more than ``CHUNK`` classes is cut into chunks, and every two
   chunks are a tile of their own, so no task holds a hot cell.
3. In a tile ``COUNTED`` further projections are sorted.  A query's windows,
   one per projection, reach ``WINDOW`` d to both sides of it; the classes in
   them are counted per pair.  Pairs at the threshold reach the least count
   that passes with probability 1 - ``SHORT`` or more (binomial).
4. Pairs that pass are verified by their cosine in double precision.  A pair
   that shared a cell of an earlier table is left to that one.  A tile yields
   one row per linked class: how many vectors it is linked with, and the
   smallest class of its group in the tile.  Pairs are never written.
5. Counts are added up; the tiles' groups make the components.

Cases: vectors that are null, empty or zero or hold null or non-finite values
link with nothing, as do rows without id (component null, kept); vectors of
different lengths never link; equal vectors always do; rows that repeat an id
are vectors of their own; a table without rows gives none; other columns are
ignored; there are no ties and no texts.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .minhash import components
from .text import join_counted, mix64

THRESHOLD = 0.95
SLOT, WINDOW = 8.0, 1.0
MISS, SHORT = 1e-3, 1e-4
COUNTED, PER_CELL, CHUNK, BIN = 48, 1024, 2048, 4096


def _phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def same_slot(distance: float, width: float) -> float:
    """Probability that two points at this distance fall into one slot of a projection."""
    r = width / distance
    return 1 - 2 * _phi(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


@dataclass(frozen=True)
class Plan:
    """The numbers of the method for so many classes and this threshold."""

    classes: int
    threshold: float = THRESHOLD
    miss: float = MISS
    seed: int = 11

    def __post_init__(self) -> None:
        if not 0.5 <= self.threshold < 1:
            raise ValueError(f"threshold {self.threshold}")

    @property
    def distance(self) -> float:
        return math.sqrt(2 - 2 * self.threshold)

    @property
    def leads(self) -> int:
        """Projections of a table: as many as leave ``PER_CELL`` unrelated classes in a cell."""
        apart = same_slot(math.sqrt(2), SLOT * self.distance)
        return max(1, math.ceil(math.log(max(1, self.classes / PER_CELL)) / -math.log(apart)))

    @property
    def tables(self) -> int:
        meet = same_slot(self.distance, SLOT * self.distance) ** self.leads
        return max(1, math.ceil(math.log(self.miss) / math.log1p(-meet)))

    @property
    def least(self) -> int:
        """The largest count that a pair at the threshold reaches with probability 1 - ``SHORT``."""
        p = 1 - 2 * _phi(-WINDOW)
        below = 0.0
        for k in range(COUNTED + 1):
            below += math.comb(COUNTED, k) * p ** k * (1 - p) ** (COUNTED - k)
            if below > SHORT:
                return k
        return COUNTED


@functools.lru_cache(maxsize=64)
def _directions(dim: int, leads: int, tables: int, width: float, seed: int):
    rng = np.random.default_rng([seed, dim])
    return (rng.standard_normal((dim, leads * tables)), rng.random(leads * tables) * width,
            rng.integers(1, 2 ** 62, leads, dtype=np.int64) * 2 + 1, rng.standard_normal((dim, COUNTED)))


def unit(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision (by their largest component first)."""
    x = values / np.abs(values).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells(x: np.ndarray, plan: Plan) -> np.ndarray:
    """A number for each row's cell in each table."""
    width = SLOT * plan.distance
    a, b, code, _ = _directions(x.shape[1], plan.leads, plan.tables, width, plan.seed)
    slot = np.floor((x @ a + b) / width).astype(np.int64).reshape(len(x), plan.tables, plan.leads)
    name = (slot * code).sum(axis=2) + np.arange(plan.tables) * np.int64(0x5851F42D4C957F2D) + np.int64(x.shape[1])
    return mix64(name.view(np.uint64)).view(np.int64)


def groups_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row of each row's group under links (a, b)."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def passing(p: np.ndarray, reach: float, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per query: the rows that lie in its windows on ``least`` projections or more (itself included)."""
    n = len(p)
    order = np.argsort(p, axis=0, kind="stable")
    lo, hi = np.empty(p.shape, np.int64), np.empty(p.shape, np.int64)
    for j in range(p.shape[1]):
        line = p[order[:, j], j]
        lo[:, j] = np.searchsorted(line, p[:, j] - reach, side="left")
        hi[:, j] = np.searchsorted(line, p[:, j] + reach, side="right")
    columns = [np.ascontiguousarray(order[:, j]) for j in range(p.shape[1])]
    for i in range(n):
        inside = np.concatenate([c[s:e] for c, s, e in zip(columns, lo[i], hi[i], strict=True)])
        yield i, np.flatnonzero(np.bincount(inside, minlength=n) >= least)


def link_tile(x: np.ndarray, own: np.ndarray, table: int, n: np.ndarray, half: np.ndarray | None,
              plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Per row of a tile: linked vectors, and the smallest row of its group.

    ``own`` are the rows' cells in all tables, ``n`` their vectors; with
    ``half`` only pairs of different halves are the tile's.
    """
    degree = np.zeros(len(x), dtype=np.int64)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    width = SLOT * plan.distance
    counted = _directions(x.shape[1], plan.leads, plan.tables, width, plan.seed)[3]
    for i, near in passing(x @ counted, WINDOW * plan.distance, plan.least):
        near = near[near > i]
        if half is not None:
            near = near[half[near] != half[i]]
        if not len(near):
            continue
        near = near[x[near] @ x[i] >= plan.threshold]
        if table:
            near = near[~(own[near, :table] == own[i, :table]).any(axis=1)]
        degree[i] += n[near].sum()
        degree[near] += n[i]
        a.append(np.full(len(near), i))
        b.append(near)
    return degree, groups_of(len(x), np.concatenate(a), np.concatenate(b))


def _matrix(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return unit(np.asarray(flat.flatten(), dtype=np.float64).reshape(-1, dim))


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def links(classes: DataFrame, plan: Plan) -> DataFrame:
    """(node, linked, low): vectors linked with a class and the smallest class of its group, once a tile.

    ``classes`` is a written table of node, n (its vectors) and v.
    """
    names = "node long, n long, dim int, v " + dict(classes.dtypes)["v"] + ", cells array<long>"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(2))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                own = cells(_matrix(part.column(3), int(dim)), plan)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * plan.tables, pa.int32()), pa.array(own.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=["node", "n", "dim", "v", "cells"])

    placed = classes.select("node", "n", F.size("v").alias("dim"), "v").mapInArrow(place, names)
    each = placed.select("node", "n", "dim", "v", F.posexplode("cells").alias("tab", "cell"))
    hot = materialize(placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
                      .where(F.col("size") > CHUNK)
                      .select(F.col("cell").alias("hot"), F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks")), "collision-hot-cells")
    each = join_counted(each, hot, F.col("cell") == F.col("hot"), "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.pmod(F.xxhash64("node", F.lit(plan.seed)), F.col("chunks")).cast("int")
    tiled = each.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    bins = max(1, plan.classes * plan.tables // BIN)
    tiled = tiled.select("node", "n", "dim", "v", "tab", "cell", "mine", F.least("mine", "other").alias("a"),
                         F.greatest("mine", "other").alias("b"),
                         F.when(F.col("chunks") > 1, F.xxhash64("cell", F.least("mine", "other"), F.greatest("mine", "other")))
                         .otherwise(F.pmod("cell", F.lit(bins))).alias("bin"))

    def link(rows: pa.Table) -> pa.Table:
        out = [[np.empty(0, np.int64)] for _ in range(3)]
        dims = np.asarray(rows.column("dim"))
        for dim in np.unique(dims):
            part = rows.filter(pa.array(dims == dim)) if len(np.unique(dims)) > 1 else rows
            x = _matrix(part.column("v"), int(dim))
            own = cells(x, plan)
            node, n, tab, cell, half, a, b = (np.asarray(part.column(c)) for c in ("node", "n", "tab", "cell", "mine", "a", "b"))
            order = np.lexsort((node, b, a, cell, tab))
            key = np.stack([tab, cell, a, b])[:, order]
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for at in np.split(order, cut):
                if len(at) < 2:
                    continue
                degree, low = link_tile(x[at], own[at], int(tab[at[0]]), n[at], half[at] if a[at[0]] != b[at[0]] else None, plan)
                hit = degree > 0
                for c, values in zip(out, (node[at][hit], degree[hit], node[at][low[hit]]), strict=True):
                    c.append(values)
        return pa.table(dict(zip(("node", "linked", "low"), map(np.concatenate, out), strict=True)))

    return tiled.groupBy("bin").applyInArrow(link, "node long, linked long, low long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
                    threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    ship_package(vectors.sparkSession)
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    rows = rows.withColumn("v", F.when(F.col("vec_id").isNotNull() & usable(v), v))
    rows = rows.select("vec_id", "v", F.when(v.isNotNull(), F.xxhash64("v")).alias("h1"),
                       F.when(v.isNotNull(), F.xxhash64(F.lit(1), "v")).alias("h2"))
    grouped = rows.where("v IS NOT NULL").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    classes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "collision-classes")
    plan = Plan(classes.count(), threshold)
    found = materialize(links(classes, plan), "collision-links")
    degree = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    edges = found.where("node != low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    root = components(edges)
    joined = (classes.select("h1", "h2", "first", "n", "node").join(degree, "node", "left")
              .join(root.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left")
              .withColumn("root", F.coalesce("root", "node")))
    least = joined.groupBy("root").agg(F.min("first").alias("component"))
    # written, so that the join with the rows has an exchange of its own, in which a hot class is split
    known = materialize(joined.join(least, "root").select(
        "h1", "h2", "component", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")), "collision-known")
    out = rows.select("vec_id", "h1", "h2").join(known, ["h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
