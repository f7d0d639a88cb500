"""The pipeline on small tables, stage by stage."""

import corpus_pipeline
from logloom.llm import simhash
from logloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, count = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and 0 < out.count() <= count
            assert out.where("n_chars <> length(text)").count() == 0
        if name == "simhash_near_dedup":
            again = simhash.near_duplicates(out, width=5)
            assert again.select("component_id").distinct().count() == out.count()
        docs, count = out, out.count()
    kept = docs.groupBy("sequence_id").sum("length").collect()
    assert all(r[1] <= 4096 for r in kept)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
