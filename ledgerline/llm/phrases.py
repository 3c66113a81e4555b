"""Phrase collocations from count streams kept in prefix and in suffix order.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and the
pieces into words ``[^\\x20\\x09]+``; all counts are per language.

1. Counting.  A task joins the texts of a language into runs of about
   ``RUN`` bytes, numbers their words and counts phrases by sorting numbers,
   so a frequent phrase is one line a run.  A run's lines are dealt to buckets
   by phrase, as many as there are ``BUCKET`` bytes of text, and travel as one
   pack a bucket; a task adds up one bucket, frequent words or not.  The sums
   that reach ``least`` form the count stream of that phrase length.
2. Phrases of s > 2 words are counted only where both phrases of s - 1 words
   inside them are frequent.  Tasks see those through a bit table of a fixed
   size (``SLOTS`` bits, at any corpus size), which may let infrequent ones
   pass, never the reverse; the exact sums decide.
3. A candidate's cuts stand in one stream by first part and, after that, in
   another by rest.  Both are merge-joined in lockstep with the sorted count
   stream for left and right counts.  The stream in prefix order (phrase
   without its last word) and in suffix order (without its first) is merged with
   the stream itself for the extension counts.  No hash joins.
4. Scores are whole numbers in DECIMAL(38), exact for counts below 10^16.  The
   first ``top`` of a language come from the first ``top`` of ``SALTS`` parts.

A longer phrase is never more frequent than the phrases inside it, so looking
one word further on either side finds every longer candidate that counts.

Cases: null or empty text has no words; null language is ``und``; repeated
rows count again; ties are ordered by count, then phrase (UTF-8 bytes), and a
phrase's equal cuts by the smallest; very long texts are cut at piece ends
only; a text that is all one piece is held whole; a table without rows, or
none with words, gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .text import lower_ascii, mix64, slices, texts_of, word_bounds, word_hashes

LEAST, LONGEST, TOP, SHARE = 10, 3, 2000, 50
#: Bytes of text counted in one go.
RUN = 6 << 20
#: Bytes of text whose phrases make a bucket of counts.
BUCKET = 8 << 20
#: Bits of the table of frequent phrases.
SLOTS = 1 << 26
SALTS = 32

BREAK = np.zeros(256, dtype=bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD = ~BREAK
WORD[[0x20, 0x09]] = False

_STREAM = "lang string, size int, phrase string, n long"


def slots(lang: str, hashes: list[np.ndarray]) -> np.ndarray:
    """Places in the bit table of phrases given by the hashes of their words."""
    out = np.full(len(hashes[0]), np.uint64(zlib.crc32(lang.encode())), dtype=np.uint64)
    for h in hashes:
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + h)
    return out & np.uint64(SLOTS - 1)


def has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def count_run(lang: str, raw: np.ndarray, sizes: tuple[int, ...], bits: np.ndarray | None) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """Phrase counts of one run of texts (pieces end at break bytes): size, phrases and how often each stands there.

    With size 1 also all words, as size 0.
    """
    starts, ends = word_bounds(raw, WORD)
    if not len(starts):
        return
    h = word_hashes(raw, starts, ends)
    number, names = pd.factorize(h)
    v = len(names)
    first = np.empty(v, dtype=np.int64)
    first[number[::-1]] = np.arange(len(h) - 1, -1, -1)
    words = slices(raw, starts[first], ends[first])
    piece = np.searchsorted(np.flatnonzero(BREAK[raw]), starts)
    if 1 in sizes:
        yield 0, pa.array([""], pa.large_string()), np.array([len(starts)])
        yield 1, words, np.bincount(number, minlength=v)
    for size in sizes:
        if size < 2 or len(starts) < size:
            continue
        at = np.flatnonzero(piece[size - 1:] == piece[:len(piece) - size + 1])
        if bits is not None:
            short = [h[at + j] for j in range(size)]
            at = at[has(bits, slots(lang, short[:-1])) & has(bits, slots(lang, short[1:]))]
        if not len(at):
            continue
        key = number[at].astype(np.int64)
        for j in range(1, size):
            if j > 1:
                key = np.unique(key, return_inverse=True)[1]
            key = key * v + number[at + j]
        if size == 2:
            key, n = np.unique(key, return_counts=True)
            spelt = [key // v, key % v]
        else:
            _, one, n = np.unique(key, return_index=True, return_counts=True)
            spelt = [number[at[one] + j] for j in range(size)]
        yield size, pc.binary_join_element_wise(*[words.take(pa.array(w)) for w in spelt], pa.scalar(" ", pa.large_string())), n


def packed(phrases: pa.Array, n: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Phrases and counts by bucket: lines of text and 64-bit numbers."""
    lines = pc.binary_join_element_wise(phrases, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    offs = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset:lines.offset + len(lines) + 1]
    raw = np.frombuffer(lines.buffers()[2], np.uint8)
    of = (mix64(word_hashes(raw, offs[:-1], offs[1:])) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    lines, n, cuts = lines.take(pa.array(order)), n[order].astype(np.int64), np.searchsorted(of[order], np.arange(buckets + 1))
    offs = np.frombuffer(lines.buffers()[1], np.int64)
    body = lines.buffers()[2]
    for k in np.flatnonzero(np.diff(cuts)):
        lo, hi = int(cuts[k]), int(cuts[k + 1])
        yield int(k), body[int(offs[lo]):int(offs[hi])].to_pybytes(), n[lo:hi].tobytes()


def unpacked(lines: bytes) -> pa.Array:
    """The lines of a pack, each with its line end."""
    ends = np.flatnonzero(np.frombuffer(lines, np.uint8) == 0x0A) + 1
    offs = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(offs), pa.py_buffer(lines)])


def parts(raw: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A text in parts of about ``most`` bytes, cut where pieces end."""
    while len(raw) > most:
        cut = np.flatnonzero(BREAK[raw[most:]])
        if not len(cut):
            break
        yield raw[:most + cut[0]]
        raw = raw[most + cut[0]:]
    yield raw


def counted(docs: DataFrame, sizes: tuple[int, ...], buckets: int, bits=None) -> DataFrame:
    """Packs of partial counts of docs (lang, text): lang, size, bucket, lines and numbers, one row a run and bucket."""
    run = RUN

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value if bits is not None else None
        held: dict[str, tuple[list, int]] = {}
        newline = np.array([0x0A], np.uint8)

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            texts, _ = held.pop(lang)
            for size, phrase, n in count_run(lang, np.concatenate(texts), sizes, table):
                # the words of a language in all are one number a run; they stay with bucket 0
                packs = list(packed(phrase, n, buckets if size else 1))
                yield pa.RecordBatch.from_pydict({
                    "lang": [lang] * len(packs), "size": pa.array([size] * len(packs), pa.int32()),
                    "bucket": pa.array([k for k, _, _ in packs], pa.int32()),
                    "lines": pa.array([x for _, x, _ in packs], pa.binary()), "n": pa.array([x for _, _, x in packs], pa.binary())})

        for b in batches:
            for lang, raw in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                for part in parts(raw, run):
                    texts, size = held.get(lang, ([], 0))
                    texts += [lower_ascii(part), newline]
                    held[lang] = texts, size + len(part) + 1
                    if held[lang][1] >= run:
                        yield from flush(lang)
            if sum(size for _, size in held.values()) >= 2 * run:
                yield from flush(max(held, key=lambda k: held[k][1]))
        for lang in list(held):
            yield from flush(lang)

    return docs.mapInArrow(count, "lang string, size int, bucket int, lines binary, n binary")


def summed(packs: DataFrame, least: int) -> DataFrame:
    """The count stream of packs: sums of at least ``least``, and of size 0."""
    def add(rows: pa.Table) -> pa.Table:
        out = []
        keys = list(zip(rows.column("lang").to_pylist(), rows.column("size").to_pylist(), strict=True))
        for lang, size in set(keys):
            mine = [i for i, k in enumerate(keys) if k == (lang, size)]
            lines = pa.chunked_array([unpacked(rows.column("lines")[i].as_py()) for i in mine])
            n = pa.chunked_array([pa.array(np.frombuffer(rows.column("n")[i].as_py(), np.int64)) for i in mine])
            sums = pa.table({"phrase": lines, "n": n}).group_by("phrase").aggregate([("n", "sum")])
            if size:
                sums = sums.filter(pc.greater_equal(sums.column("n_sum"), least))
            phrase = pc.ascii_rtrim(sums.column("phrase"), "\n").cast(pa.string())
            out.append(pa.table({"lang": pa.array([lang] * len(sums), pa.string()), "size": pa.array([size] * len(sums), pa.int32()),
                                 "phrase": phrase, "n": sums.column("n_sum")}))
        return pa.concat_tables(out)

    return packs.groupBy("bucket").applyInArrow(add, _STREAM)


def bit_table(phrases: DataFrame) -> np.ndarray:
    """The table of a stream's phrases (all of one length): ``SLOTS`` bits, whatever the stream holds."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang in pc.unique(b.column(0)).to_pylist():
                mine = b.column(1).filter(pc.equal(b.column(0), lang))
                raw = np.frombuffer("\n".join(mine.to_pylist()).encode(), np.uint8)
                h = word_hashes(raw, *word_bounds(raw, WORD)).reshape(len(mine), -1)
                yield pa.RecordBatch.from_arrays([pa.array(slots(lang, list(h.T)).astype(np.int64))], names=["slot"])

    words = (phrases.select("lang", "phrase").mapInArrow(place, "slot long")
             .groupBy(F.shiftright("slot", 6).alias("at"))
             .agg(F.bit_or(F.expr("shiftleft(1L, int(slot & 63))")).alias("word")).toArrow())
    out = np.zeros(SLOTS // 64, dtype=np.int64)
    out[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return out.view(np.uint8)


def streams(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """The count stream (lang, size, phrase, n) of 1 to ``longest`` words; size 0 holds the language's words."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET))
    levels = [materialize(summed(counted(texts, (1, 2), buckets), least), "phrase-counts")]
    for size in range(3, longest + 1):
        table = spark.sparkContext.broadcast(bit_table(levels[-1].where(F.col("size") == size - 1)))
        levels.append(materialize(summed(counted(texts, (size,), buckets, table), least), "phrase-counts"))
    return functools.reduce(DataFrame.unionByName, levels)


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST,
                 top: int = TOP, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases of 2 to ``longest`` words."""
    stream = streams(docs, lang, text, least, longest)
    count = stream.where("size > 0").select("lang", "phrase", "n")
    words = F.split("phrase", " ")
    cand = stream.where("size > 1").withColumn("w", words)

    def span(start, length) -> F.Column:
        return F.array_join(F.slice("w", start, length), " ")

    def merged(left: DataFrame, key: str, right: DataFrame, name: str, how: str = "inner") -> DataFrame:
        """Lockstep join of two streams in order of (lang, ``key``)."""
        right = right.withColumnRenamed("phrase", key).withColumnRenamed("n", name)
        return left.join(right.hint("merge"), ["lang", key], how)

    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", F.col("n").alias("a"), "k", span(F.lit(1), F.col("k")).alias("head"),
        span(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    cuts = merged(merged(cuts, "head", count, "l"), "rest", count, "r")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("score", F.expr("(cast(a as decimal(19,0)) * a * 1000000) div (cast(l as decimal(19,0)) * r)"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    longer = cand.where("size > 2")
    by_prefix = longer.select("lang", span(F.lit(1), F.col("size") - 1).alias("phrase"), "n")
    by_suffix = longer.select("lang", span(F.lit(2), F.col("size") - 1).alias("phrase"), "n")
    longest_of = by_prefix.union(by_suffix).groupBy("lang", "phrase").agg(F.max("n").alias("n"))
    kept = merged(scored, "phrase", longest_of, "more", "left").where(
        F.col("more").isNull() | (wide("more") * 100 < wide("a") * share))

    order = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    total = stream.where("size = 0").select("lang", F.col("n").alias("total"))
    return first.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
        F.col("total").alias("n"), F.col("cut.score").cast("long").alias("score"))


#: The DuckDB twin: every phrase counted, longer ones by list slices.
ORACLE_PHRASES = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, s, w[i:i + s - 1] AS p, count(*) AS f
  FROM (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) sizes(s) WHERE len(w) >= s)
  GROUP BY ALL),
cand AS (SELECT lang, s, p, f FROM grams WHERE s > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.p, c.f AS a, k.k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
  FROM cand c JOIN (VALUES (1), (2)) k(k) ON k.k < c.s
  JOIN grams x ON x.lang = c.lang AND x.p = c.p[1:k.k]
  JOIN grams y ON y.lang = c.lang AND y.p = c.p[k.k + 1:c.s]),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
longer AS (
  SELECT lang, p, max(f) AS f FROM (SELECT lang, p[1:2] AS p, f FROM cand WHERE s = 3 UNION ALL SELECT lang, p[2:3], f FROM cand WHERE s = 3)
  GROUP BY ALL),
ranked AS (
  SELECT low.lang, array_to_string(low.p, ' ') AS phrase, a, l, r, t.n, score,
         row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, array_to_string(low.p, ' ')) AS rank
  FROM low JOIN totals t ON t.lang = low.lang
  LEFT JOIN longer g ON g.lang = low.lang AND g.p = low.p WHERE g.f IS NULL OR 100 * g.f < 50 * a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""
