"""Near-duplicate components by b-bit MinHash with band candidates and exact confirmation.

Words are lower-cased (A-Z) runs of non-space characters; a document's set
is its distinct shingles of ``width`` words (64-bit hashes), and two sets are
linked at a similarity of ``percent``.  :class:`Shape` derives all else from
the two; figures below are those of 3 words and 85 %.  Steps:

1. Signature pass over the texts: 125 minima per set, 25 band keys of 5
   minima, and the low 4 bits of every minimum packed into 8 longs.  Equal
   sets become one class; only its smallest doc_id goes on, so exact copies
   never form pairs.
2. Classes that share a band key form a bucket.  Each bucket is compared with
   one pivot, its most central member (linear in the bucket, never all pairs).
   Packed signatures give the estimate (matches - c) / (1 - c), c = 2^-b, by
   bit counts; what stays is measured exactly on full sets.  Members are near
   (similarity to the pivot 0.7 or more, twice the threshold less one) or far.
3. Two members linked to the pivot are connected already.  A near member not
   linked to it is compared with the other near ones exactly, by the members'
   differences from the pivot's set, in a join that returns links only.  By
   the triangle inequality of the Jaccard distance a far member can't link
   with one that is linked to the pivot; it is compared, by estimate and then
   on full sets, with the far and the near unlinked members of its bucket.
   So every pair of a bucket is decided, or needless because already joined.
4. Connected components by alternating large and small stars.

A pair at the threshold shares no band with probability
(1 - 0.85^5)^25 = 4e-7, and the estimate's margin is 5 standard deviations.
At 80 % there are 37 bands (185 minima), near is 0.6, and the same holds.

Cases: null or empty text has an empty set, is linked with nothing and is its
own component; fewer than ``width`` words make one shingle; rows that share a
doc_id are one node, each returned; a null doc_id takes no part (component
null, kept); a table without rows gives none; further columns are ignored.
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

from ..session import materialize
from .text import SPACED, lower_ascii, mix64, texts_of, word_bounds, word_hashes

WIDTH, PERCENT = 3, 85
ROWS, BITS = 5, 4
#: Probability at most that a pair at the threshold shares no band.
MISS = 4.5e-7
_PER_LONG = 64 // BITS


@dataclass(frozen=True)
class Shape:
    """Numbers of the method for shingles of ``width`` words and links at ``percent`` similarity."""

    width: int = WIDTH
    percent: int = PERCENT

    def __post_init__(self) -> None:
        if self.width < 1 or not 50 < self.percent < 100:
            raise ValueError(f"shingles of {self.width} words, linked at {self.percent} %")

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - (self.percent / 100) ** ROWS))

    @property
    def hashes(self) -> int:
        return self.bands * ROWS

    @property
    def near(self) -> int:
        """Least percentage to a pivot at which a set may link with one that is linked to the pivot."""
        return 2 * self.percent - 100

    def _floor(self, percent: int, deviations: int) -> float:
        """The estimate that a pair of this similarity falls short of by so many standard deviations."""
        chance = 2.0 ** -BITS
        match = percent / 100 * (1 - chance) + chance
        sd = math.sqrt(match * (1 - match) / self.hashes) / (1 - chance)
        return math.ceil(percent - 100 * deviations * sd) / 100

    @property
    def link_floor(self) -> float:
        return self._floor(self.percent, 5)

    @property
    def near_floor(self) -> float:
        return self._floor(self.near, 4)


SHAPE = Shape()


@functools.lru_cache
def _multipliers(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 2 ** 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2 ** 63, hashes, dtype=np.uint64)


def shingle_set(raw: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text given as UTF-8 bytes."""
    low = lower_ascii(raw)
    h = word_hashes(low, *word_bounds(low, SPACED))
    if len(h) == 0:
        return h
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k), dtype=np.uint64)
    for j in range(k):
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + h[j:len(h) - k + 1 + j])
    return np.unique(out)


def minima(s: np.ndarray, hashes: int = SHAPE.hashes) -> np.ndarray:
    """The smallest value of each of the hash functions over a set."""
    mul, add = _multipliers(hashes)
    out = np.full(hashes, np.uint64(2 ** 64 - 1), dtype=np.uint64)
    for at in range(0, len(s), 4096):
        np.minimum(out, (s[at:at + 4096, None] * mul + add).min(axis=0), out=out)
    return mix64(out)


def band_keys(m: np.ndarray) -> np.ndarray:
    key = np.arange(1, len(m) // ROWS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + m[j::ROWS])
    return key.view(np.int64)


def packed_bits(m: np.ndarray) -> np.ndarray:
    """The low bits of the minima, 16 to a long."""
    longs = -(-len(m) // _PER_LONG)
    low = np.zeros(longs * _PER_LONG, dtype=np.uint64)
    low[:len(m)] = m & np.uint64((1 << BITS) - 1)
    shift = np.arange(_PER_LONG, dtype=np.uint64) * np.uint64(BITS)
    return (low.reshape(longs, _PER_LONG) << shift).sum(axis=1, dtype=np.uint64).view(np.int64)


def estimate(a: Column, b: Column, hashes: int = SHAPE.hashes) -> Column:
    """Similarity from two packed signatures by bit counts, corrected for chance collisions."""
    ones = sum(1 << (BITS * k) for k in range(_PER_LONG))
    ones = F.lit(ones - (1 << 64) if ones >> 63 else ones)
    differ = F.lit(0)
    for i in range(-(-hashes // _PER_LONG)):
        x = a[i].bitwiseXOR(b[i])
        any_bit = x
        for k in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, k))
        differ = differ + F.bit_count(any_bit.bitwiseAND(ones))
    chance = 2.0 ** -BITS
    return ((F.lit(1.0) - differ / F.lit(float(hashes))) - chance) / (1.0 - chance)


def signatures(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shape: Shape = SHAPE) -> DataFrame:
    """doc_id, n_shingles, two halves of the set's fingerprint, band keys and packed signature."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()),
                        ("bands", pa.list_(pa.int64())), ("sig", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, fp, bands, sig = [], [], [], []
            for raw in texts_of(b.column(1)):
                s = shingle_set(raw, shape.width)
                n.append(len(s))
                both = np.array([mix64(s).sum(dtype=np.uint64), mix64(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)])
                fp.append(both.view(np.int64))
                m = minima(s, shape.hashes) if len(s) else None
                bands.append(None if m is None else band_keys(m))
                sig.append(None if m is None else packed_bits(m))
            fp = np.array(fp, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(fp[:, 0]), pa.array(fp[:, 1]),
                                              pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.list_(pa.int64()))],
                                             schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        sign, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sig array<long>")


def measure_pairs(pairs: DataFrame, docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text: str = "text",
                  differences: bool = False, shape: Shape = SHAPE) -> DataFrame:
    """Exact set sizes of pairs (``a``, ``b``) of ids: n_a, n_b and common.

    With ``differences``, near pairs also get ``mask`` (which elements of b's
    sorted set a has, 64 to a long) and ``added`` (a's elements that b lacks).
    """
    t = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    joined = (pairs.select(a, b).join(t.select(F.col("id").alias(a), F.col("text").alias("text_a")), a)
              .join(t.select(F.col("id").alias(b), F.col("text").alias("text_b")), b).select(a, b, "text_a", "text_b"))
    fields = [(a, pa.int64()), (b, pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("common", pa.int64())]
    if differences:
        fields += [("mask", pa.list_(pa.int64())), ("added", pa.list_(pa.int64()))]
    schema = pa.schema(fields)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sb = None, None
        for batch in batches:
            cols: list[list] = [[] for _ in range(len(fields) - 2)]
            for y, ta, tb in zip(batch.column(1).to_pylist(), texts_of(batch.column(2)), texts_of(batch.column(3)), strict=True):
                if sb is None or last != y:
                    last, sb = y, shingle_set(tb, shape.width)
                sa = shingle_set(ta, shape.width)
                at = np.searchsorted(sa, sb)
                has = (at < len(sa)) & (sa[np.minimum(at, len(sa) - 1)] == sb) if len(sa) else np.zeros(len(sb), bool)
                common = int(has.sum())
                row = [len(sa), len(sb), common]
                if differences:
                    near = 100 * common >= shape.near * (len(sa) + len(sb) - common)
                    bits = np.zeros(-(-len(sb) // 64) * 64, dtype=np.uint8)
                    bits[:len(sb)] = has
                    row += [np.packbits(bits, bitorder="little").view(np.int64), np.setdiff1d(sa, sb, assume_unique=True)
                            .view(np.int64)] if near else [None, None]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, t) for c, (_, t) in zip(cols, fields[2:], strict=True)]],
                schema=schema)

    return joined.mapInArrow(measure, f"{a} long, {b} long, n_a long, n_b long, common long"
                             + (", mask array<long>, added array<long>" if differences else ""))


def linked(n_a: Column, n_b: Column, common: Column, percent: int = PERCENT) -> Column:
    return 100 * common >= percent * (n_a + n_b - common)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): the smallest node of each node's component.

    Large and small stars in turn (each a sum of minima and a join), every
    round written, until the edges are stars already.
    """
    def directed(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()

    e = materialize(directed(edges), "cc-edges")
    state = None
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        e = directed(both.join(low, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = e.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        j = e.join(low, F.col("a") == F.col("u"))
        e = materialize(directed(j.select(F.col("b").alias("a"), F.col("m").alias("b")).union(j.select("a", F.col("m").alias("b")))),
                        "cc-edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH,
                    percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document."""
    shape = Shape(width, percent)
    signed = materialize(signatures(docs, id_col, text, shape), "minhash-signatures")
    real = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # written, so that the join below has an exchange of its own, in which a hot class is split
    classes = materialize(real.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep")), "minhash-representatives")
    member = materialize(real.select("doc_id", "h1", "h2", "n_shingles").join(classes, ["h1", "h2", "n_shingles"])
                         .select("doc_id", "n_shingles", "rep"), "minhash-classes")
    firsts = member.where("doc_id = rep").select("doc_id").distinct()
    reps = materialize(real.join(firsts, "doc_id", "left_semi").select("doc_id", "n_shingles", "bands", "sig"), "minhash-reps")

    banded = reps.select("doc_id", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    inside = materialize(banded.join(shared, "key"), "minhash-buckets")
    central = inside.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    pivots = (inside.join(central, "doc_id").groupBy("key")
              .agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("neg"))).alias("top"))
              .select("key", (-F.col("top.neg")).alias("pivot")))
    in_star = materialize(inside.select("key", "doc_id").join(pivots, "key").where("doc_id != pivot"), "minhash-stars")

    sig = reps.select("doc_id", "n_shingles", "sig")
    side = lambda c, s: sig.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}"))
    est = estimate(F.col("sig_x"), F.col("sig_y"), shape.hashes)

    def estimated(pairs: DataFrame, x: str, y: str, floor: float, least: int) -> DataFrame:
        # sets of sizes n <= m have a similarity of n / m at most
        size_ok = 100 * F.least("n_x", "n_y") >= least * F.greatest("n_x", "n_y")
        return pairs.join(side(x, "x"), x).join(side(y, "y"), y).where(size_ok & (est >= floor)).select(x, y)

    # written on both sides of the join: with a distinct beside it AQE could not split a hot pivot
    pairs = materialize(in_star.select("doc_id", "pivot").distinct(), "minhash-pairs")
    stars = materialize(estimated(pairs, "doc_id", "pivot", shape.near_floor, shape.near), "minhash-estimated").distinct()
    stars = materialize(measure_pairs(stars, docs, "doc_id", "pivot", id_col, text, differences=True, shape=shape), "minhash-measured")
    stars = stars.withColumn("link", linked(F.col("n_a"), F.col("n_b"), F.col("common"), percent))
    links = stars.where("link").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b"))
    first = components(links)

    # near members not linked to the pivot against all near members, by differences from the pivot's set
    near = stars.where("mask IS NOT NULL").join(first, F.col("doc_id") == F.col("node"), "left").select(
        "pivot", "doc_id", "n_a", "mask", "added", "link", F.coalesce("root", "doc_id").alias("label"))
    x = near.where("NOT link").select("pivot", *[F.col(c).alias(f"{c}_x") for c in ("doc_id", "n_a", "mask", "added", "label")])
    y = near.select("pivot", *[F.col(c).alias(f"{c}_y") for c in ("doc_id", "n_a", "mask", "added", "link", "label")])
    common = (F.aggregate(F.zip_with("mask_x", "mask_y", lambda p, q: F.bit_count(p.bitwiseAND(q))), F.lit(0), lambda s, v: s + v)
              + F.size(F.array_intersect("added_x", "added_y"))).cast("long")
    once = F.col("link_y") | (F.col("doc_id_x") < F.col("doc_id_y"))
    size_ok = 100 * F.least("n_a_x", "n_a_y") >= percent * F.greatest("n_a_x", "n_a_y")
    more = x.join(y, "pivot").where((F.col("label_x") != F.col("label_y")) & once & size_ok
                                    & linked(F.col("n_a_x"), F.col("n_a_y"), common, percent)).select(
        F.col("doc_id_x").alias("a"), F.col("doc_id_y").alias("b"))

    # far members against the far and the near unlinked ones of their bucket
    state = stars.select("doc_id", "pivot", F.col("mask").isNotNull().alias("near"), "link").distinct()
    placed = (in_star.join(state, ["doc_id", "pivot"], "left").where("NOT coalesce(link, false)")
              .select("key", "doc_id", F.coalesce("near", F.lit(False)).alias("near")))
    p = placed.where("NOT near").select("key", F.col("doc_id").alias("x"))
    q = placed.select("key", F.col("doc_id").alias("y"), "near")
    sx = sig.select(F.col("doc_id").alias("x"), F.col("n_shingles").alias("n_x"), F.col("sig").alias("sig_x"))
    sy = sig.select(F.col("doc_id").alias("y"), F.col("n_shingles").alias("n_y"), F.col("sig").alias("sig_y"))
    keep = ((F.col("x") < F.col("y")) | F.col("near")) & (F.col("x") != F.col("y")) & \
        (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")) & (est >= shape.link_floor)
    q = q.join(p.select("key").distinct(), "key", "left_semi")
    far = p.join(sx, "x").join(q.join(sy, "y"), "key").where(keep).select("x", "y").distinct()
    far = measure_pairs(materialize(far, "minhash-far"), docs, "x", "y", id_col, text, shape=shape).where(
        linked(F.col("n_a"), F.col("n_b"), F.col("common"), percent)).select(F.col("x").alias("a"), F.col("y").alias("b"))

    # stars of the first components stand for its links
    last = components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more).union(far))
    by_class = (member.select("doc_id", "rep").distinct().join(last, F.col("rep") == F.col("node"), "left")
                .select("doc_id", F.coalesce("root", "rep").alias("component")).groupBy("doc_id")
                .agg(F.min("component").alias("component_id")))
    out = signed.select("doc_id", "n_shingles").join(by_class, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
