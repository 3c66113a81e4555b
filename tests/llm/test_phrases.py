import collections
import datetime
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import phrases
from ledgerline.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, longest=3, top=2000, share=50):
    """(lang, text) rows; phrases as tuples of words, all counted."""
    f = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            for s in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(w[i:i + s]) for i in range(len(w) - s + 1))
    out = []
    for lang, c in f.items():
        total = sum(n for p, n in c.items() if len(p) == 1)
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = collections.Counter()
        for p, a in cand.items():
            for s in range(2, len(p)):
                for i in range(len(p) - s + 1):
                    inside[p[i:i + s]] = max(inside[p[i:i + s]], a)
        best = []
        for p, a in cand.items():
            if 100 * inside[p] >= share * a and inside[p]:
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total, -score))
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r) for r in phrases.collocations(df, **kw).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    got = QUERIES["op11_phrase_streams"](spark, sf)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


@pytest.mark.parametrize("kw", [dict(top=7), dict(least=3, longest=5, share=80), dict(least=2, longest=2), dict(least=1, longest=4)])
def test_other_settings(spark, kw):
    rng = np.random.default_rng(len(kw))
    words = ["a", "B", "ç", "d", "e", "ff", "Gg", "-", "'h"]
    rows = []
    for _ in range(300):
        text = "".join(words[rng.integers(len(words))] + rng.choice([" ", " ", "\t", ". ", "\r", "  "]) for _ in range(rng.integers(0, 30)))
        rows.append((["en", "de", None, ""][rng.integers(4)], text))
    df = spark.createDataFrame(rows, "lang string, text string")
    assert mined(df, **kw) == brute(rows, **kw)


def test_runs_and_parts_do_not_change_counts(spark, monkeypatch):
    rows = [(lang, "one two three. one two " * k + "end") for k in range(40) for lang in ("en", "fr")]
    df = spark.createDataFrame(rows, "lang string, text string")
    whole = mined(df, least=2)
    monkeypatch.setattr(phrases, "RUN", 100)
    assert mined(df, least=2) == whole == brute(rows, least=2)


def test_a_full_bit_table_only_lets_more_pass(spark, monkeypatch):
    rows = [("en", "a b c d e a b c x y a b"), ("en", "a b c d"), ("en", "b c d e")]
    df = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(phrases, "bit_table", lambda p: np.full(phrases.SLOTS // 8, 255, np.uint8))
    assert mined(df, least=2) == brute(rows, least=2)


def test_odd_rows(spark):
    long = "tick tock " * 300_000 + "!" + "hot " * 200_000
    rows = [("en", long), ("en", None), ("en", ""), (None, "x y " * 12), ("und", "x y. x y"), ("en", " \t .,;:!?\n"), ("fr", "seul")]
    df = spark.createDataFrame(rows, "lang string, text string")
    for c in ("n", "size", "phrase", "score", "doc_id"):
        df = df.withColumn(c, F.lit(datetime.date(2020, 1, 1)))
    got = mined(df)
    assert got == brute(rows)
    assert {g[0] for g in got} == {"en", "und"}
    assert mined(df.limit(0)) == [] and mined(df.where("text = ''")) == []


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000
    e = "(cast(a as decimal(19,0)) * a * 1000000) div (cast(l as decimal(19,0)) * r)"
    r = spark.createDataFrame([(big, big + 7, big + 11)], "a long, l long, r long").select(F.expr(e)).first()[0]
    assert r == 1_000_000 * big * big // ((big + 7) * (big + 11))
