"""The pipeline against plain versions of its stages."""

import corpus_pipeline
from quernel.llm import op3_secrets, op4_neardup, op9_quality
from test_operators import plain_components, plain_hits  # noqa: F401

from quernel.llm.op6_decontaminate import words


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, before, sf)
        after = spark.createDataFrame(made.collect(), made.schema)
        if name != "packing":
            assert after.columns == columns
        rows = {r.doc_id: r.text for r in before.collect()}
        if name == "quality":
            scores = {r.doc_id: r.score for r in op9_quality.score(before, op9_quality.train(before, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
            assert {r.doc_id for r in after.collect()} == {i for i, s in scores.items() if s >= op9_quality.CUT}
        elif name == "near_duplicates":
            assert {r.doc_id for r in after.collect()} == {i for i, (_, c) in plain_components(rows.items(), 80).items() if i == c}
        elif name == "decontaminate":
            items = [words((r.text or "").encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            grams = {tuple(it[i : i + 13]) for it in items for i in range(len(it) - 12)}
            changed = 0
            for r in after.collect():
                ws = words(r.text.encode())
                assert not any(tuple(ws[i : i + 13]) in grams for i in range(len(ws) - 12))
                changed += r.text != rows[r.doc_id]
            assert changed
        elif name == "secrets":
            ranks = op3_secrets.ranked(op3_secrets.dictionary(before))
            assert {r.doc_id: r.text for r in after.collect() if r.text == rows[r.doc_id]}.keys() == {i for i, t in rows.items() if not op3_secrets.find(t, ranks)}
        else:
            sizes = {r.doc_id: r.doc_tokens for r in after.collect()}
            assert sizes.keys() == rows.keys()
            assert {r.doc_id: r.s for r in after.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "s").collect()} == sizes
        before = after


def test_near_duplicates_from_a_similarity_of_four_fifths(spark, sf):
    base = [f"w{i}" for i in range(90)]
    rows = [(1, " ".join(base))]
    for i, changed in enumerate(((40, 41, 42, 43, 44), (50, 51, 52, 53, 54, 55)), 2):
        rows.append((i, " ".join(f"x{i}_{k}" if k in changed else w for k, w in enumerate(base))))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(86)} for i, t in rows}
    assert [round(len(sets[1] & sets[i]) / len(sets[1] | sets[i]), 2) for i in (2, 3)] == [0.81, 0.79]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_bands_and_margin_follow_the_limit():
    for per in (85, 80, 70):
        assert (1 - (per / 100) ** op4_neardup.ROWS) ** op4_neardup.bands_for(per, 100) <= 1e-5
    assert op4_neardup.bands_for(85, 100) == 16 and op4_neardup.margin(85, 100) == 0.12 < op4_neardup.margin(80, 100)


def test_run_and_registry(spark, sf):
    import __spark_entry__

    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in __spark_entry__.queries()}
    assert corpus_pipeline.run(spark, sf).where("length > 0").count() > 0
