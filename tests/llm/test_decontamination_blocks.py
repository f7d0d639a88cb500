"""A benchmark that goes to the workers in many blocks."""

from functools import partial

from logloom.llm import decontamination


def test_every_block_is_searched(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "benchmark_blocks", partial(decontamination.benchmark_blocks, limit=1))
    items = [(k, " ".join(f"item{k}word{j}" for j in range(20))) for k in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    docs = spark.createDataFrame([(k, f"before it {text} after it") for k, text in items] + [(99, "a clean document of its own words")], "doc_id long, text string").repartition(2)
    for _ in range(2):
        got = sorted((r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect())
        assert got == [(k, k) for k, _ in items]
    other = spark.createDataFrame([(50, "a clean document of its own words")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, other).collect()] == [(99, 50)]
    assert [r["doc_id"] for r in decontamination.decontaminate(docs, bench).collect()] == [99]
