import pyarrow as pa

import corpus_pipeline
from quadlake.llm import langid, minhash


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), name)
        assert docs.columns == columns
        after = docs.count()
        if name == "language_id":
            assert 0.95 * before <= after <= before
        if name == "exact_dedup":
            import re

            kept = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in docs.collect()]
            assert len(kept) == len(set(kept))
        if name == "near_dedup":
            assert minhash.near_duplicates(docs).where("NOT kept").isEmpty()
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.select("row").distinct().count() == before
    assert langid.UNKNOWN == "und"


def odd_documents(spark):
    """Two languages; null ids, texts, sources and labels, empty texts, repeated rows, a long text, near copies, and columns named as the stages' own."""
    import random

    r = random.Random(8)
    words = {"aa": [a + b + "ik" for a in "bcdfg" for b in "aeiou"], "bb": ["ŝ" + a + b + "oz" for a in "mnprt" for b in "aeiou"]}
    rows = []
    for i in range(240):
        lang = ("aa", "bb")[i % 2]
        text = " ".join(r.choice(words[lang]) for _ in range(60))
        rows.append([i, text, lang, None if i % 9 == 0 else ("s", "t")[i % 3 == 0]])
    long = " ".join(r.choice(words["aa"]) for _ in range(30_000))
    near = rows[0][1] + " fin"
    rows += [[500, None, "aa", "s"], [501, "", "bb", None], [502, " \n\t", None, "s"], [503, "1234 5678", "aa", "s"], [None, rows[4][1], None, None], [None, None, None, None], [504, long, "aa", "s"], [504, long, "aa", "s"], [505, near, "aa", "t"], list(rows[1]), list(rows[1])]
    names = ["row", "_row", "_all", "size", "score", "kept", "start", "target", "a b", "_path"]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([(*x, *[None if k % 3 == 0 else str(k) for k in range(len(names))]) for x in rows], schema)


def test_stages_on_odd_rows(spark):
    docs = corpus_pipeline.materialize(odd_documents(spark), "odd")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, ""), name)
        assert docs.columns == columns, name
        seen[name] = docs.collect()
    words = [(x.text, x.doc_id) for x in seen["language_id"]]
    assert all(t and any(c.isalpha() for c in t) for t, _ in words) and sum(d == 504 for _, d in words) == 2 and len(words) >= 235
    exact = [x.text for x in seen["exact_dedup"]]
    assert sorted(exact) == sorted(set(t for t, _ in words))
    near = {x.text for x in seen["near_dedup"]}
    both = {x.text for x in seen["language_id"] if x.doc_id in (0, 505)}
    assert len(both) == 2 and len(both & near) == 1 and near | both == set(exact)
    assert {x.text for x in seen["mixing"]} <= near and all(x["a b"] is not None for x in seen["mixing"])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert all(p.length <= 2048 for p in packed)
    sums, ends = {}, {}
    for p in packed:
        sums[p.sequence_id] = sums.get(p.sequence_id, 0) + p.length
        ends[p.sequence_id] = max(ends.get(p.sequence_id, 0), p.offset + p.length)
    assert sums == ends and max(sums.values()) <= 2048


def test_stages_on_nothing(spark):
    docs = odd_documents(spark)
    columns = docs.columns
    empty = corpus_pipeline.materialize(docs.limit(0), "none")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, "")
        assert out.columns == columns and out.isEmpty(), name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, "").isEmpty()
    blank = corpus_pipeline.materialize(docs.where("text IS NULL"), "blank")
    assert corpus_pipeline.STAGES[0][1](spark, blank, "").isEmpty()
    assert corpus_pipeline.STAGES[1][1](spark, blank, "").count() == 1


def test_python_workers_take_documents_in_small_batches(spark):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('some words of text ', id) AS text", "'en' AS lang", "'s' AS source", "20 AS n_chars").coalesce(1)
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches)
    try:
        for stage in (corpus_pipeline.identify_language, corpus_pipeline.near_copies, corpus_pipeline.pack_sequences):
            spark.conf.set(setting, before)
            stage(spark, docs, "")
            assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) <= 500
        spark.conf.set(setting, 70)
        corpus_pipeline.identify_language(spark, docs, "")
        assert int(spark.conf.get(setting)) == 70
    finally:
        spark.conf.set(setting, before)
