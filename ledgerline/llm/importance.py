"""Quality classifier by importance resampling with hashed n-gram models and Gumbel top-k.

1. Two bags of hashed byte 4-grams: the raw text (all documents) and the
   target text (documents labelled good and not toxic).  Each task counts
   into ``BUCKETS`` numbers, Spark sums them: one pass over all texts.
2. The log weight of an n-gram is log((target + k) / (expected + k)), expected
   being the target's share if it were spread as the raw text is.  ``k``
   shrinks rare buckets to 0.  A document counts as its weakest passage: the
   least sum over ``PASSAGE`` n-grams in a row.  So a long text isn't excused
   by its length, a few abusive words aren't outweighed by the prose around
   them, and weights and noise are of one scale.
3. Sampling without replacement in proportion to the weights: every document
   gets log weight + Gumbel noise (drawn from its id and the seed), and the
   documents of the k largest keys are the sample.  k is the number of documents
   with a weight that all but ``MISS`` of held-out good ones reach, so that the sample
   is as large as the clean part of the corpus; :func:`key_of_rank` finds its
   last key by counting, in a written table of ids and weights.  Comparing
   with that key, a document is kept or goes where it stands: texts are never
   shuffled, keys never sorted in one task.

The labels used are a sample of at most ``LABELS`` rows, smallest hash
first: half for the target model, half held out for the threshold.  All
counts run over the whole corpus.

Cases: null or empty text, or one of fewer than four bytes, has no n-grams
and log weight 0; without good labels every weight is 0 and all is kept;
repeated rows draw alike; a null id draws as 0; a label that repeats or has
no document counts once or not at all; a table without rows gives none; the
document's own columns travel as one struct and can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .text import mix64, texts_of, whole_row

BUCKETS = 1 << 16
SHRINK = 5.0
LABELS = 50_000
MISS = 0.002
PASSAGE = 24
_PIECE = 1 << 20


def gram_buckets(raw: np.ndarray, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of the byte 4-grams of a text, about a megabyte of it at a time."""
    for at in range(0, max(len(raw) - 3, 0), _PIECE):
        x = raw[at:at + _PIECE + 3].astype(np.uint64)
        g = x[:-3] | (x[1:-2] << np.uint64(8)) | (x[2:-1] << np.uint64(16)) | (x[3:] << np.uint64(24))
        yield (mix64(g + np.uint64(7)) % np.uint64(buckets)).astype(np.int64)


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise from 52 bits of a hash of ``key``."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(key.cast("long"), F.lit(0))), 12)
    u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


@dataclass(frozen=True)
class Model:
    log_ratio: np.ndarray
    threshold: float
    seed: int


def weakest_passage(raw: np.ndarray, log_ratio: np.ndarray, passage: int = PASSAGE) -> float:
    """The least sum of ``passage`` log ratios in a row (of all, if there are fewer; 0 without any)."""
    least, rest = None, np.empty(0)
    for g in gram_buckets(raw, len(log_ratio)):
        rest = np.concatenate([rest, log_ratio[g]])
        if len(rest) >= passage:
            upto = np.concatenate([[0.0], np.cumsum(rest)])
            low = float((upto[passage:] - upto[:-passage]).min())
            least, rest = low if least is None else min(least, low), rest[len(rest) - passage + 1:]
    return float(rest.sum()) if least is None else least


def _log_weights(texts: pa.Array, log_ratio: np.ndarray) -> list[float]:
    return [weakest_passage(raw, log_ratio) for raw in texts_of(texts)]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
        sample: int = LABELS, miss: float = MISS, shrink: float = SHRINK, seed: int = 41) -> Model:
    """Count both models over the corpus and set the key that marks the k-th document."""
    spark = docs.sparkSession
    good = [r[0] for r in labels.where("quality = 1 AND coalesce(toxic, 0) = 0").where(F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("i")).distinct().orderBy(F.xxhash64(F.lit(seed), "i"), "i").limit(sample).collect()]
    target_ids, held = np.sort(np.array(good[::2], np.int64)), np.sort(np.array(good[1::2], np.int64))
    ids = spark.sparkContext.broadcast((target_ids, held))
    pairs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))

    def among(col: pa.Array, chosen: np.ndarray) -> np.ndarray:
        known = col.is_valid().to_numpy(zero_copy_only=False)
        v = col.fill_null(0).to_numpy()
        at = np.searchsorted(chosen, v)
        return known & (at < len(chosen)) & (chosen[np.minimum(at, len(chosen) - 1)] == v) if len(chosen) else np.zeros(len(v), bool)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw_n, target_n = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            wanted = among(b.column(0), ids.value[0])
            for hit, raw in zip(wanted, texts_of(b.column(1)), strict=True):
                for g in gram_buckets(raw, buckets):
                    n = np.bincount(g, minlength=buckets) if len(g) > buckets // 16 else None
                    for into in (raw_n, target_n) if hit else (raw_n,):
                        if n is None:
                            np.add.at(into, g, 1)
                        else:
                            into += n
        some = np.flatnonzero(raw_n)
        yield pa.RecordBatch.from_pydict({"bucket": some.astype(np.int32), "raw": raw_n[some], "target": target_n[some]})

    # one row a bucket: bounded by the model's size
    counted = pairs.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counted:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    expected = target.sum() * raw / max(raw.sum(), 1.0)
    log_ratio = np.log((target + shrink) / (expected + shrink))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_log_weights(b.column(1), log_ratio), pa.float64()),
                                              pa.array(among(b.column(0), ids.value[1]))], names=["id", "w", "held"])

    weights = materialize(pairs.mapInArrow(score, "id long, w double, held boolean"), "importance-weights")
    # at most ``sample`` labels are held out
    bar = weights.where("held").orderBy("w").limit(int(miss * len(held)) + 1).agg(F.max("w")).first()[0]
    if bar is None:
        return Model(log_ratio, float("-inf"), seed)
    k = weights.where(F.col("w") >= bar).count()
    return Model(log_ratio, key_of_rank(weights.select((F.col("w") + gumbel(F.col("id"), seed)).alias("key")), k), seed)


def weigh(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``row``, log_weight, key and ``kept`` (key among the k largest) of each document."""
    table = docs.sparkSession.sparkContext.broadcast(model.log_ratio)

    @F.arrow_udf("double")
    def log_weight(texts: pa.Array) -> pa.Array:
        return pa.array(_log_weights(texts, table.value), pa.float64())

    d = docs.select(whole_row(docs), F.col(id_col).alias("id"), log_weight(F.col(text)).alias("log_weight"))
    d = d.withColumn("key", F.col("log_weight") + gumbel(F.col("id"), model.seed))
    return d.select("row", "log_weight", "key", (F.col("key") >= F.lit(model.threshold)).alias("kept"))


def key_of_rank(weighed: DataFrame, k: int, column: str = "key") -> float:
    """The k-th largest key, by counting in ever narrower ranges (64 counts a round, never a sort).

    Keys at or above the result number k, or more if keys are equal there.
    """
    lo, hi, n = weighed.agg(F.min(column), F.max(column), F.count(column)).first()
    if k <= 0 or n == 0:
        return float("inf")
    if k >= n:
        return lo
    while True:
        steps = [lo + (hi - lo) * i / 64 for i in range(1, 64)]
        steps = sorted({s for s in steps if lo < s <= hi} | {hi})
        at_least = weighed.agg(*[F.count(F.when(F.col(column) >= F.lit(s), 1)) for s in steps]).first()
        low = max([s for s, c in zip(steps, at_least, strict=True) if c >= k], default=lo)
        high = min([s for s, c in zip(steps, at_least, strict=True) if c < k], default=None)
        if high is None:
            return hi
        inside = weighed.where((F.col(column) >= low) & (F.col(column) < high)).agg(F.min(column), F.max(column)).first()
        if inside[0] == inside[1]:
            return inside[0]
        lo, hi = inside
