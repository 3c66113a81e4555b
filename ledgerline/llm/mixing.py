"""Mixing sources to target weights with DataFrame functions only.

1. Sum the tokens of each source (map-side sums, so a source with a third of
   all rows sends one row a task).
2. Share the whole size by weight; a target stops at ``max_repeats`` times
   its source's size and the excess is reshared by weight.  With sources in
   order of (cap / weight), the capped ones are a prefix: one running sum
   over the table of sources finds the common rate of the rest.
3. Rate = target / source size.  A document is emitted floor(rate) times plus
   once more if its hash-seeded uniform number is below the fraction.  The
   number depends on the document's id and the seed alone, so reruns agree.

Cases: null text has size 0; a null source is a source of its own, last in
order; a source of size 0 has target 0 and its documents are not emitted
(as their words are none); a null id is drawn as the empty string; repeated
rows draw alike, each for itself; a table without rows gives none.  The
document's own columns travel as one struct and can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .text import SPACED_WORD, join_counted, whole_row

#: Weights dealt to the sources in code-point order, over and over (fixed values of the contract).
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3


def word_count(text: str) -> Column:
    """Number of words between spaces; null text: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> the same with ``target``: shares of the whole, capped and reshared.

    The windows run over one row per source, never over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    d = sizes.select("*", F.element_at(F.array(*[F.lit(w) for w in weights]), place + 1).cast("long").alias("w"),
                     (max_repeats * F.col("source_size")).alias("cap"))
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    # level: the rate a weight of 1 gets if all sources before this one are capped
    d = d.select("*", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0))).alias("left"),
                 (F.sum("w").over(every) - F.coalesce(F.sum("w").over(by_ratio), F.lit(0))).alias("w_left"))
    d = d.select("*", (F.col("left") * F.lit(1.0) / F.col("w_left")).alias("level"))
    # the first source that its level doesn't fill sets the level of all after it
    d = d.select("*", F.min(F.when(F.col("w") * F.col("level") <= F.col("cap"),
                                   F.struct(F.col("cap") / F.col("w"), "source", "level"))).over(every)["level"].alias("lv"))
    return d.select("source", "source_size",
                    F.least(F.col("cap").cast("double"), F.coalesce(F.col("w") * F.col("lv"), F.col("cap").cast("double")))
                    .alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
        max_repeats: int = MAX_REPEATS, seed: int = 17) -> DataFrame:
    """``row``, size, source_size, target and ``copies`` (0 to ``max_repeats``) of each document.

    The sizes of sources are written once; their table is broadcast when its
    counted rows are few, else the documents are joined by a shuffle in which
    a hot source is split by the skew join.
    """
    size = word_count(text)
    per_source = docs.select(F.col(source).alias("source"), size.alias("size")).groupBy("source").agg(
        F.sum("size").alias("source_size"))
    targets = materialize(source_targets(per_source, weights, max_repeats), "mix-sources").withColumnRenamed(
        "source", "of")
    d = docs.select(whole_row(docs), F.col(source).alias("source"), size.alias("size"),
                    uniform(F.col(id_col), seed).alias("u"))
    d = join_counted(d, targets, F.equal_null("source", "of"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    d = d.withColumn("rate", rate)
    copies = F.floor("rate") + (F.col("u") < F.col("rate") - F.floor("rate")).cast("long")
    return d.select("row", "size", "source_size", "target", copies.cast("int").alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The documents of a mix, each as many times as it was dealt."""
    return mixed.where("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


#: The same in DuckDB SQL over the table ``documents``.
ORACLE_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS w, 3 * source_size AS cap FROM src),
levelled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE
            / (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE AS level
  FROM weighted
  WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT arg_min(level, cap / w) AS lv FROM levelled WHERE w * level <= cap),
targets AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(w * lv, cap::DOUBLE)) AS target FROM levelled, lv),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, s.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM rated
"""
