import importlib

import corpus_pipeline
from quire.llm import exact, jaccard, quality


def test_stages_in_order(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_quality", "exact_dedup", "simhash_dedup", "packing"]


def test_stages_take_effect(spark):
    root = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    calm = stages["toxicity"](spark, docs, root).cache()
    good = stages["line_quality"](spark, calm, root).cache()
    judged = {r.doc_id: r for r in quality.line_quality(calm).collect()}
    assert {r.doc_id: r.text for r in good.collect()} == {
        i: r.clean_text for i, r in judged.items() if r.kept}
    once = stages["exact_dedup"](spark, good, root).cache()
    assert {r.doc_id for r in once.collect()} == {
        r.doc_id for r in exact.exact_duplicates(good).collect() if r.kept}
    near = stages["simhash_dedup"](spark, once, root).cache()
    # test_jaccard compares these components with all pairs of texts
    assert {r.doc_id for r in near.collect()} == {
        r.component_id for r in jaccard.similar_documents(once).collect()}
    assert calm.columns == good.columns == once.columns == near.columns == columns
    packed = stages["packing"](spark, near, root)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in near.collect()}
    run = corpus_pipeline.run(spark, root)
    assert run.columns == packed.columns and run.count() == packed.count()


def test_no_documents(spark, tmp_path):
    root = "/root/testdata/sf0.001"
    for t in ("documents", "labels"):
        spark.read.parquet(f"{root}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_entry_registers_all_operators():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1


def test_odd_documents(spark, odd_docs, tmp_path):
    """Null ids, repeated rows, empty and very long texts, columns named like the stages' own."""
    root = "/root/testdata/sf0.001"
    spark.read.parquet(f"{root}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path)).cache()
        assert left.columns == docs.columns, name
    texts = [r.text for r in left.collect()]
    assert len(texts) == len(set(texts)) > 3 and left.filter("doc_id is null").count() == 1
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in left.collect()}
