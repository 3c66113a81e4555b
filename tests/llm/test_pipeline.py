import random
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from ledgerline.llm import importance, mixing, packing
from ledgerline.session import materialize

from .test_mixing import brute_targets
from .test_packing import whole_ids
from .test_rules import brute as measures


@pytest.fixture(scope="module")
def steps(spark, sf):
    """The documents and what each stage made of its predecessor's rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(materialize(stage(spark, out[-1], sf), "test-stage"))
    return out


def test_shape(steps):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "quality rules", "near duplicates", "source mix", "best-fit packing"]
    assert all(d.columns == steps[0].columns and d.schema.simpleString() == steps[0].schema.simpleString() for d in steps[:5])
    assert "pipeline" in E.queries()


def test_classifier_stage(spark, steps, sf):
    kept = {r["doc_id"] for r in steps[1].collect()}
    model = importance.fit(steps[0], spark.read.parquet(f"{sf}/labels.parquet"))
    want = {r[0] for r in importance.weigh(steps[0], model).select("row.doc_id", "kept").collect() if r[1]}
    assert kept == want
    good = {r[0] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 AND toxic = 0").collect()}
    assert len(good - kept) <= 0.01 * len(good)


def test_rules_stage(steps):
    kept = {r["doc_id"] for r in steps[2].collect()}
    for r in steps[1].collect():
        assert not (r["doc_id"] in kept and measures(r["text"])[5])


def test_mix_stage(steps):
    rows, copies = steps[3].collect(), Counter(r["doc_id"] for r in steps[4].collect())
    size, got = defaultdict(int), defaultdict(int)
    for r in rows:
        n = len(mixing_words(r["text"]))
        size[r["source"]] += n
        got[r["source"]] += n * copies[r["doc_id"]]
    assert max(copies.values()) <= 3 and set(copies) <= {r["doc_id"] for r in rows}
    want = brute_targets(dict(size))
    assert abs(sum(got.values()) - sum(want.values())) <= 0.15 * sum(want.values())


def mixing_words(text):
    from .test_mixing import WORD
    return WORD.findall(text or "")


def test_packing_stage(steps):
    rows = steps[5].collect()
    want = Counter()
    for r in steps[4].collect():
        n = len(whole_ids(r["text"]))
        for k in range(0, n, packing.CAPACITY):
            want[r["doc_id"], k // packing.CAPACITY, min(packing.CAPACITY, n - k)] += 1
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= packing.CAPACITY


def test_run_is_the_stages_in_turn(spark, sf, steps):
    got = P.run(spark, sf)
    key = lambda d: Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in d.collect())
    assert key(got) == key(steps[5])


def test_stages_on_odd_rows(spark, make_docs, sf):
    odd = [(1, None), (2, ""), (2, ""), (None, "a b c"), (3, "the of and " * 40), (3, "the of and " * 40), (4, None, None),
           (5, "The cat sat with the dog and the bird. " * 3 + " ".join(f"word{i} the" for i in range(60)))]
    docs = make_docs(odd * 2, extra=["row", "kept", "copies", "gone", "length"])
    for name, stage in P.STAGES:
        out = materialize(stage(spark, docs, sf), "odd")
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        if name != "best-fit packing":
            assert out.columns == docs.columns, name
        if name == "near duplicates":
            assert Counter(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == Counter([1, 2, 3, 4, 5])


def brute_components(rows, width, percent):
    """doc_id -> smallest doc_id of its component, every pair that shares one of its first shingles compared."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root, holders = {i: i for i in sets}, defaultdict(list)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j, b in sorted(sets.items()):
        # a linked pair shares one of the smallest (100 - percent) % (and one) of either set's shingles
        for x in sorted(b)[:len(b) - -(-percent * len(b) // 100) + 1]:
            for i in holders[x]:
                a = sets[i]
                if find(i) != find(j) and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                    n = len(a & b)
                    if 100 * n >= percent * (len(a) + len(b) - n):
                        x_, y_ = find(i), find(j)
                        root[max(x_, y_)] = min(x_, y_)
            holders[x].append(j)
    return {i: find(i) for i in sets}


def test_near_duplicate_stage_at_five_words_and_80_percent(spark, make_docs, sf):
    """Appended passages (1,000 words and 200 more), scattered edits, graded copies, short texts."""
    rng, rows = random.Random(8), []

    def words(tag, n):
        return [f"{tag}{k}" for k in range(n)]

    a, b = words("a", 1000), words("b", 400)
    rows += [(1, a), (2, a + words("x", 200)), (3, a + words("y", 260)), (10, b)]
    edits = list(b)
    for k in range(0, 400, 24):  # 3-word 0.85 or more less than 5-word 0.8
        edits[k] = f"e{k}"
    rows.append((11, edits))
    base = words("g", 300)
    for i in range(80):
        w = list(base)
        for _ in range(rng.randrange(0, 30)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(9)}"
        rows.append((100 + i, w[:rng.randrange(220, 301)] if i % 3 == 0 else w))
    rows += [(300 + i, words(f"s{i % 3}_", 3 + i % 2)) for i in range(8)] + [(400, [])]
    texts = [(i, " ".join(w)) for i, w in rows]
    want = brute_components(texts, 5, 80)
    assert want[2] == 1 and want[3] == 3 and want != brute_components(texts, 3, 85)
    got = P.drop_near_duplicates(spark, make_docs(texts), sf)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(want.values()))


def test_near_duplicate_stage_on_the_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80)
    got = P.drop_near_duplicates(spark, docs, sf)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(want.values()))


def test_stages_on_very_long_texts(spark, make_docs, sf):
    """Whole texts count: a difference in the last words of a long text is seen, and its pieces hold all of it."""
    rng = random.Random(5)

    def prose(n):
        return [("the", "of", "and")[k % 3] if k % 4 == 0 else f"{rng.choice('bcdfgl')}{rng.randrange(40_000)}" for k in range(n)]

    a = prose(100_000)
    half = a[:60_000] + prose(40_000)  # the same beginning, 60 % at most in common
    texts = {1: a, 2: a[:-3] + ["other", "last", "words"], 3: half, 4: prose(80)}
    docs = make_docs([(i, " ".join(w)) for i, w in texts.items()])
    assert sorted(r["doc_id"] for r in P.apply_rules(spark, docs, sf).collect()) == [1, 2, 3, 4]
    once = P.drop_near_duplicates(spark, docs, sf)
    assert sorted(r["doc_id"] for r in once.collect()) == [1, 3, 4]
    assert {r["doc_id"]: r["text"] for r in once.collect()} == {i: " ".join(texts[i]) for i in (1, 3, 4)}
    pieces = P.pack_sequences(spark, docs, sf).collect()
    for i in texts:
        own = sorted((r["piece"], r["start"], r["length"]) for r in pieces if r["doc_id"] == i)
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert all(s + n == t for (_, s, n), (_, t, _) in zip(own, own[1:])) and all(n == 2048 for _, _, n in own[:-1])
        assert sum(n for _, _, n in own) >= len(texts[i]) + 1
