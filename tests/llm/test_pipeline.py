import os

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tessera.llm.common import shared_dir, written
from tessera.llm.secrets import secret_scan
from tessera.llm.simhash import simhash_near_dedup
from tessera.llm.toxicity import toxicity

from .conftest import SF


def test_stages(spark, docs):
    columns = docs.columns
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "secrets", "mixing", "tokens"]
    said = {r.doc_id: r.predicted for r in toxicity(docs, pipeline.load(spark, SF, "labels")).collect()}
    at = written(pipeline.toxicity(spark, docs, SF))
    assert at.columns == columns and {r.doc_id for r in at.collect()} == {i for i, p in said.items() if p == 0}
    groups = {r.component_id for r in simhash_near_dedup(at).collect()}
    at = written(pipeline.near_dedup(spark, at, SF))
    assert at.columns == columns and sorted(r.doc_id for r in at.collect()) == sorted(groups)
    n = at.count()
    at = written(pipeline.secrets(spark, at, SF))
    assert at.columns == columns and at.count() == n and secret_scan(at).where("size(spans) > 0").count() == 0
    assert at.where("n_chars <> length(text)").count() == 0
    before = {r.doc_id for r in at.collect()}
    at = written(pipeline.mixing(spark, at, SF))
    labels = pipeline.load(spark, SF, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    clean = {r.doc_id for r in labels.collect()} & before
    after = {r.doc_id for r in at.collect()}
    assert at.columns == columns and after <= before and len(clean & after) >= 0.97 * len(clean)
    out = pipeline.tokens(spark, at, SF)
    assert out.count() == at.count() and out.where(~F.col("round_trip")).count() == 0


def test_run_leaves_one_table(spark):
    """Of all that the stages write only the last result stays."""
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    out = pipeline.run(spark, SF)
    left = set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before
    assert left == {os.path.basename(out.written_path)} and out.count() > 0


def test_run_and_edge_cases(spark, edge, empty):
    for df in (edge, empty):
        at = df
        for _, stage in pipeline.STAGES:
            at = written(stage(spark, at, SF))
        assert at.columns == ["doc_id", "n_tokens", "ids", "round_trip"] and (at.count() > 0) == (df is edge)
