"""The pipeline's stages against the operators' brute-force versions, and its whole run."""

from __future__ import annotations

import corpus_pipeline
from strandlog.llm import quality_model

from ..session import DATA, spark
from .test_operators import brute_classes, brute_substring, check_packs, empty_documents, odd_documents

SF = f"{DATA}/sf0.01"


def test_stages_one_after_the_other():
    session = spark()
    docs = session.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    model = quality_model.train(docs, session.read.parquet(f"{SF}/labels.parquet"))
    kept = steps["quality classifier"](session, docs, SF).cache()
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality_model.scored(docs, model).where("predicted = 1").collect()}

    single = steps["n-gram Jaccard join"](session, kept, SF).cache()
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    classes = brute_classes(rows)
    heads = {doc for doc, text in rows if classes[text or ""][0] == doc}
    assert len(heads ^ {r["doc_id"] for r in single.collect()}) <= 2  # the pruning's tolerance

    clean = steps["substring dedup"](session, single, SF).cache()
    expected = {d: (n, gone) for d, n, gone, _ in brute_substring([(r["doc_id"], r["text"]) for r in single.collect()])}
    lengths = {r["doc_id"]: len(r["text"].split()) for r in clean.collect()}
    assert lengths == {d: n - gone for d, (n, gone) in expected.items() if n > gone or gone == 0}

    mixed = steps["mixing sources to target weights"](session, clean, SF).cache()
    assert {r["doc_id"] for r in mixed.collect()} <= set(lengths)
    for stage in (kept, single, clean, mixed):
        assert stage.columns == docs.columns
    check_packs(mixed, steps["packing"](session, mixed, SF).collect())


def test_run_over_a_table():
    found = corpus_pipeline.run(spark(), f"{DATA}/sf0.001")
    assert found.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(found.columns)


def saved(tmp_path, docs):
    """A folder with docs as its documents table, and the labels of the given one."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark().read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_on_odd_tables(tmp_path):
    docs = odd_documents()
    folder = saved(tmp_path, docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark(), docs, folder)
        assert found.columns == docs.columns, name
        if name == "n-gram Jaccard join":
            assert found.where("doc_id is null").count() == 2 and found.groupBy("doc_id", "text").count().where("count > 1 and doc_id is not null").count() == 0
        if name == "substring dedup":
            assert found.where("text is null").count() == docs.where("text is null").count()
    pieces = corpus_pipeline.STAGES[-1][1](spark(), docs, folder).collect()
    check_packs(docs, pieces)
    assert corpus_pipeline.run(spark(), folder).count() > 0


def test_run_on_an_empty_table(tmp_path):
    assert corpus_pipeline.run(spark(), saved(tmp_path, empty_documents())).count() == 0
