from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crosspanel.llm import simhash, toxicity
from crosspanel.llm.queries import queries, table

DATA = "/root/testdata/sf0.001"


def test_stages_work_on_what_was_kept(spark):
    if not Path(DATA).exists():
        pytest.skip("no test tables here")
    docs = table(spark, DATA, "documents").persist()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash", "secrets", "packing"]
    clean = stages["toxicity"](spark, docs, DATA).persist()
    model = toxicity.train(docs, table(spark, DATA, "labels"))
    kept = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    assert {r.doc_id for r in clean.collect()} == kept and clean.schema == docs.schema
    single = stages["simhash"](spark, clean, DATA).persist()
    groups = {r.component_id for r in simhash.near_duplicates(clean).collect()}
    assert {r.doc_id for r in single.collect()} == groups and set(single.columns) == set(docs.columns)
    marked = stages["secrets"](spark, single, DATA).persist()
    assert marked.columns == docs.columns and marked.count() == single.count()
    assert marked.where(F.col("text").rlike("AKIA[A-Z0-9]{14}")).count() == 0 and marked.where("n_chars <> length(text)").count() == 0
    packed = stages["packing"](spark, marked, DATA).persist()
    assert {r.doc_id for r in packed.select("doc_id").collect()} == groups
    assert corpus_pipeline.run(spark, DATA).count() == packed.count()


def test_each_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
