"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

1. The rows are written once; each written file is a partition with a known
   number of rows, and (file, place in file) names a row for good, so a task
   that is run again deals its rows as before.
2. How many rows partition p sends to shard s is drawn exactly: the matrix is
   multivariate hypergeometric.  It is halved again and again: of what
   the shards get from a run of partitions, the left half's part is one draw
   whose seed is the run's place in the tree.  A task so draws the row of its own
   partition, and what the partitions before it send, from the row counts of
   the halves on its path; no place holds the matrix.  Rows sum to the
   partitions' counts, columns to the shards' sizes, which differ by one at most.
3. Each partition permutes its places and deals them out by its row of the
   matrix (local permutation), the rows are exchanged, and a second
   permutation orders each shard.  That one is a keyed bijection on the
   shard's places, so no task ever holds a shard.

The paths (two numbers a halving) are a table with one row per file, made by
Spark and joined to the rows by file: by broadcast while the table's measured size
allows, by a shuffle on the file beyond it.  The driver learns the number of
rows and of files.

Cases: null or empty text has its size and checksum of no bytes; repeated
rows and null ids are rows like others; a table without rows gives none;
all columns of a row travel as one struct and can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ids import assign_ids
from ..session import materialize, scratch_dir, ship_package
from .text import whole_row


def shard_sizes(total: int, n_shards: int) -> np.ndarray:
    """Sizes that differ by one at most and sum to ``total``."""
    sizes = np.full(n_shards, total // n_shards, dtype=np.int64)
    sizes[: total % n_shards] += 1
    return sizes


def matrix_row(number: int, left: Sequence[int], right: Sequence[int], sizes: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that partition ``number`` deals to each shard, and rows that the partitions before it deal to each.

    ``left`` and ``right`` hold the row counts of both halves at each halving on its path, from all partitions down to it.
    """
    row, before = sizes.copy(), np.zeros_like(sizes)
    for level, (n_left, n_right) in enumerate(zip(left, right)):
        below = len(left) - level
        rng = np.random.default_rng([seed, level, number >> below])
        got = _multivariate(rng, row, int(n_left))
        if number >> (below - 1) & 1:
            row, before = row - got, before + got
        else:
            row = got
    return row, before


def communication_matrix(counts: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Rows dealt from each partition (rows) to each shard (columns), drawn row by row as the tasks do."""
    sizes = shard_sizes(sum(counts), n_shards)
    depth = halvings(len(counts))
    upto = np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64))])
    run = lambda level, node: int(np.diff(upto[[min(k << (depth - level), len(counts)) for k in (node, node + 1)]])[0])
    out = np.empty((len(counts), n_shards), dtype=np.int64)
    for p in range(len(counts)):
        nodes = [p >> (depth - level) for level in range(depth)]
        out[p] = matrix_row(p, [run(level + 1, 2 * v) for level, v in enumerate(nodes)],
                            [run(level + 1, 2 * v + 1) for level, v in enumerate(nodes)], sizes, seed)[0]
    return out


def halvings(partitions: int) -> int:
    """How often so many partitions are halved until one is left."""
    return max(partitions - 1, 0).bit_length()


def _multivariate(rng, lack: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` rows go to each shard: a chain of hypergeometric draws, exact for any size."""
    out = np.zeros_like(lack)
    rest = int(lack.sum())
    for s, want in enumerate(lack.tolist()):
        rest -= want
        out[s] = n if rest == 0 else _hypergeometric(rng, want, rest, n)
        n -= int(out[s])
        if n == 0:
            break
    return out


def _hypergeometric(rng, good: int, bad: int, n: int) -> int:
    """One exact draw: how many of ``n`` rows taken from the urn are good.

    numpy's sampler ends at 1e9.  Beyond it every row is taken independently
    with probability n / size, and the surplus is put back (or the lack taken
    in addition) uniformly, a draw about the square root as large.
    """
    if n == 0 or good == 0:
        return 0
    size = good + bad
    if size < 10 ** 9:
        return int(rng.hypergeometric(good, bad, n))
    if 2 * n > size:
        return good - _hypergeometric(rng, good, bad, size - n)
    if n <= 64:
        got = 0
        for k in range(n):
            got += int(rng.integers(size - k)) < good - got
        return got
    x, y = int(rng.binomial(good, n / size)), int(rng.binomial(bad, n / size))
    over = x + y - n
    return x - _hypergeometric(rng, x, y, over) if over >= 0 else x + _hypergeometric(rng, good - x, bad - y, -over)


def bijection(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..n-1 applied to each x < n (a Feistel network, walked until inside)."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = x.astype(np.uint64)
    n = n.astype(np.uint64)
    todo = np.ones(len(out), dtype=bool)
    while todo.any():
        a, b, m, h, k = out[todo] >> half[todo], out[todo] & mask[todo], mask[todo], half[todo], key[todo]
        for r in range(6):
            f = (b + k) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((r + 1) * 0xD1B54A32D192ED03 % 2 ** 64)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f ^ (f >> np.uint64(32))) & m)
        out[todo] = (a << h) | b
        todo = todo & (out >= n)
    return out.astype(np.int64)


def file_paths(files: DataFrame, depth: int) -> DataFrame:
    """``file``, ``number``, ``n`` and the counts of both halves at each halving on the file's path.

    ``files``: file, number (0, 1, ... without gaps), n (its rows).
    """
    if depth == 0:
        none = F.array().cast("array<long>")
        return files.select("file", "number", "n", none.alias("lefts"), none.alias("rights"))
    node = lambda below: F.expr(f"shiftright(number, {below})")
    steps = files.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))).withColumn(
        "node", node(f"{depth} - level")).withColumn("side", node(f"{depth - 1} - level") % 2)
    halves = steps.groupBy("level", "node").agg(
        F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("left"),
        F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("right"))
    # a path has as many steps as the files can be halved: some twenty for a million
    path = F.sort_array(F.collect_list(F.struct("level", "left", "right")))
    return (steps.join(halves, ["level", "node"]).groupBy("file", "number", "n").agg(path.alias("path"))
            .select("file", "number", "n", F.col("path.left").alias("lefts"), F.col("path.right").alias("rights")))


def shuffle_into_shards(df: DataFrame, n_shards: int, seed: int = 29, partitions: int | None = None) -> DataFrame:
    """``row``, ``shard`` and ``slot`` (gapless from 0), laid out in order of shard and slot."""
    spark = df.sparkSession
    ship_package(spark)
    path = scratch_dir(spark, "shard-input")
    df.select(whole_row(df)).write.parquet(path)
    staged = spark.read.parquet(path).select(
        "row", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"))
    files = assign_ids(staged.groupBy("file").agg(F.count(F.lit(1)).alias("n")), ["file"], "number", 0)
    n_files, total = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    paths = materialize(file_paths(files, halvings(n_files)), "shard-paths")
    sizes = shard_sizes(total, n_shards)

    @F.arrow_udf("shard int, slot long")
    def deal(number: pa.Array, place: pa.Array, n: pa.Array, lefts: pa.Array, rights: pa.Array) -> pa.Array:
        own, first, of_row = np.unique(number.to_numpy(), return_index=True, return_inverse=True)
        drawn = [matrix_row(int(p), lefts[k].as_py(), rights[k].as_py(), sizes, seed) for p, k in zip(own, first.tolist())]
        rows, before = (np.array([d[k] for d in drawn]) for k in (0, 1))
        upto = rows.cumsum(axis=1)
        key = (own[of_row].astype(np.uint64) + np.uint64(seed)) * np.uint64(0xA24BAED4963EE407)
        at = bijection(place.to_numpy(), n.to_numpy(), key)
        shard = np.empty(len(at), dtype=np.int64)
        for k in range(len(own)):
            shard[of_row == k] = np.searchsorted(upto[k], at[of_row == k], side="right")
        slot = bijection(before[of_row, shard] + at - (upto - rows)[of_row, shard], sizes[shard],
                         (shard.astype(np.uint64) + np.uint64(seed + 1)) * np.uint64(0x9FB21C651E98DF25))
        return pa.StructArray.from_arrays([pa.array(shard.astype(np.int32)), pa.array(slot)], ["shard", "slot"])

    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = F.element_at(F.array(*[F.lit(int(v)) for v in np.concatenate([[0], sizes.cumsum()])]), F.col("shard") + 1)
    block = F.floor((first + F.col("slot")) * parts / max(total, 1)).cast("int")
    return (staged.join(paths, "file").withColumn("to", deal("number", "place", "n", "lefts", "rights"))
            .select("row", "to.shard", "to.slot").repartitionById(parts, block).sortWithinPartitions("shard", "slot"))
