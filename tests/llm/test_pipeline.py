from __future__ import annotations

import corpus_pipeline
from plumbline.llm import decontamination, quality, secret_scan
from plumbline.llm.common import table
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(None, "", None, None, 0), (None, None, "en", "x", None)], docs.schema)
    docs = docs.unionByName(docs.limit(5)).unionByName(more)
    names, texts = docs.columns, {}
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = table(stage(spark, docs, SF), "stage")
        assert out.columns == names and dict(out.dtypes) == dict(docs.dtypes)
        seen[name] = (docs.collect(), out.collect())
        docs = out

    before, after = seen["quality rules"]
    verdict = {(r["doc_id"], r["n_words"]): r["kept"] for r in quality.assess(spark.createDataFrame(before)).collect()}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in after) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in before if verdict[r["doc_id"], len(brute.WORD.findall(r["text"] or ""))])
    assert not any(brute.quality(r["text"])[-1] for r in after)

    before, after = seen["n-gram Jaccard join"]
    want = brute.jaccard([(r["doc_id"], r["text"]) for r in before], 5, 80, 100)
    assert sorted(r["doc_id"] for r in after) == sorted({c for _, c in want.values()})

    before, after = seen["benchmark decontamination"]
    items = [b" ".join(decontamination.words_of(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = set()
    for r in before:
        text = b" ".join(decontamination.words_of(r["text"]))
        if not any(decontamination.least_edits(p, text)[0] <= 0.2 * len(p) for p in items):
            clean.add(r["doc_id"])
    assert {r["doc_id"] for r in after} == clean

    before, after = seen["secret scans"]
    texts = {r["doc_id"]: r for r in before}
    assert {r["doc_id"] for r in after} == texts.keys()
    for r in after:
        old = texts[r["doc_id"]]["text"]
        assert not brute.spans(r["text"], brute.SECRETS)
        if not brute.spans(old, brute.SECRETS):
            assert r == texts[r["doc_id"]]
        else:
            assert "[SECRET]" in r["text"] and r["n_chars"] == len(r["text"])

    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in after}
    assert sorted({p["sequence_id"] for p in pieces}) == list(range(max(p["sequence_id"] for p in pieces) + 1))
    assert secret_scan.RULES


def test_odd_rows_of_each_stage(spark):
    """Clashing columns, null ids and texts, repeated rows, ties, and a very long text with a secret at its end."""
    schema = "doc_id long, text string, lang string, n_chars long, row_key int, gone string, twice string, spans string, doc string, _clean int, label string"
    more = (7, "a", "b", "c", "d", 8, "e")
    words = " ".join(f"word{k} of the text that" for k in range(30))
    long = " ".join(f"part{k} the of and" for k in range(60_000)) + " password = abcdefghijkl"
    rows = [(1, words, "en", 5, *more), (1, words, "en", 5, *more), (None, words + " end", "en", 5, *more), (2, None, None, None, *more), (3, "", "en", 0, *more), (None, None, None, None, *more), (4, long, "en", len(long), *more)]
    docs = spark.createDataFrame(rows, schema)
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name: sorted(map(tuple, table(stages[name](spark, docs, SF), "stage").collect()), key=str)
    assert run("quality rules") == sorted((r for r in rows if r[1] and len(r[1]) > 9), key=str)
    assert run("n-gram Jaccard join") == sorted([rows[2], *rows[3:]], key=str)
    assert run("benchmark decontamination") == sorted(rows, key=str)
    clean = long.replace("password = abcdefghijkl", "[SECRET]")
    assert run("secret scans") == sorted([*rows[:-1], (4, clean, "en", len(clean), *more)], key=str)
    pieces = stages["packing"](spark, docs, SF).collect()
    assert sum(p["start"] == 0 for p in pieces) == len(rows) and sum(p["length"] for p in pieces if p["doc_id"] == 4) == next(p["doc_tokens"] for p in pieces if p["doc_id"] == 4)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = table(stage(spark, docs, SF), "stage")
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
