import random
import re

import pytest

from ledgerline.llm import licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    """Base phrases place by place; every block of every template in full."""
    w = words(text)
    places, base, labels, best = [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    for label, t in licenses.TEMPLATES.items():
        t = words(t)
        width = 1 << (len(t) - 1).bit_length()
        for k in range(0, max(len(w), 1), width):
            share = len({*t} & {*w[k:k + 2 * width]}) / len({*t})
            if share >= (licenses.CONTAINMENT if len({*t}) >= 10 else 1):
                labels.add(label)
                best = max(best, share)
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | labels)), 1.0 if base else best)


def test_edge_and_planted_texts(make_docs):
    rng = random.Random(6)
    texts = [None, "", " ... ", "GNU General   Public-License", "gnu general public", "MIT License; mit license MIT\nLICENSE",
             "Licensed under CC BY-NC 4.0.", "xcc by", "CC BYé", "the mit licenses", "apache license " * 3000]
    for label, t in licenses.TEMPLATES.items():
        for drop in (0, 1, 3, 6):
            w = t.split()
            for _ in range(drop):
                w[rng.randrange(len(w))] = "zz"
            pad = ["pad"] * rng.randrange(0, 200)
            texts.append(" ".join([*pad, *w, *pad]).upper() if drop % 2 else "\n".join([*pad, *w]))
    docs = make_docs(list(enumerate(texts)) + [(0, None)], extra=["label", "score", "n_words"])
    got = licenses.scan(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert tuple(r)[1:8] == pytest.approx(brute(texts[r["doc_id"]])), texts[r["doc_id"]][:80]
        for b in r["blocks"]:
            assert b["label"] in r["labels"] and b["containment"] >= licenses.CONTAINMENT and b["end_word"] <= r["n_words"]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_short_templates_need_all_their_words(make_docs):
    texts = ["The data is licensed under CC BY SA 4.0.", "released under the apache license", "Licensed under CC BY NC.",
             "released under the MIT license", "licensed under the apache license version 3"]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(make_docs(list(enumerate(texts)))).collect()}
    assert got == {0: "cc-by", 1: "apache", 2: "cc-by,cc-by-nc-short", 3: "mit,mit-short", 4: "apache"}


def test_query_against_brute_force(spark, sf):
    docs = {d["doc_id"]: d["text"] for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op8_license_scan"](spark, sf).collect()
    assert len(got) == len(docs)
    assert sum(r["n_base"] for r in got) > 0
    for r in got:
        assert tuple(r)[1:8] == brute(docs[r["doc_id"]])


def test_frequency_counts_blocks(make_docs):
    n = licenses.token_frequency(make_docs([(1, "mit " * 65 + "license"), (2, "License\nmit mit"), (3, None)]), ["mit", "license", "zz"])
    assert n == {"mit": 3, "license": 2}
