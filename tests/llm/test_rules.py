import re

from ledgerline.llm import queries, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {j for p in seen.values() if len(p) > 1 for i in p for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_edge_cases(make_docs):
    texts = [None, "", "  \t\n\x0b", "a b", "a b c", "a b c a b c", "x\ny\nx\n \nx ", "é€𝄞 <|> # b c", "w " * 3000,
             "\x1c\x1d a\x85b\r\nc", "l1\r\nl1\nl1\r\n", "q" * 200_000]
    docs = make_docs([(i, t) for i, t in enumerate(texts)] + [(0, None), (None, "a b c")], extra=["n_words", "kept", "row", "t"])
    got = rules.judge(docs).select("row.doc_id", "row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                   "n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert tuple(r)[2:8] == brute(r["text"]), r["doc_id"]
        assert not (r["base_failed"] and r["kept"])
    assert rules.judge(docs.limit(0)).count() == 0
    assert rules.judge(docs).select("row.*").columns == docs.columns


def test_query_against_brute_force(spark, sf):
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op7_quality_rules"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        assert got[d["doc_id"]][1:7] == brute(d["text"])


def test_clean_documents_stay_and_junk_goes(spark, sf):
    """Of documents labelled good, the method drops none that the base keeps; of bad ones it drops most."""
    q = queries.QUERIES["op7_quality_rules"](spark, "/root/testdata/sf0.1")
    lab = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    n = {(r["quality"], r["base_failed"], r["kept"]): r["count"]
         for r in q.join(lab, "doc_id").groupBy("quality", "base_failed", "kept").count().collect()}
    good, bad = n.get((1, False, True), 0), n.get((0, False, True), 0)
    assert n.get((1, False, False), 0) <= 0.002 * good
    assert bad < 0.35 * sum(v for k, v in n.items() if k[0] == 0)


def test_keep_returns_the_rows_judged_so(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r[0] for r in rules.judge(docs).select("row.doc_id", "kept").collect() if r[1]}
    got = rules.keep(docs)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == want
    assert "Python" not in got._jdf.queryExecution().toString()


def test_no_python_in_the_plan(spark, sf):
    plan = queries.QUERIES["op7_quality_rules"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_length_alone_rejects_no_long_text(spark):
    clean = {"mean_word_chars": 5.0, "symbol_ratio": 0.0, "stop_word_ratio": 0.4, "dup_line_ratio": 0.0, "upper_ratio": 0.03,
             "repeat_word_ratio": 0.1}
    rows = [{"n_words": n, **clean} for n in (49, 50, 1_000_000, 1_000_001, 50_000_000)]
    got = spark.createDataFrame(rows).select("n_words", rules.verdict().alias("kept")).collect()
    assert {r["n_words"]: r["kept"] for r in got} == {49: False, 50: True, 1_000_000: True, 1_000_001: True, 50_000_000: True}
