"""The line stage of the pipeline leaves out no like lines of crowded buckets."""

import random

import corpus_pipeline
from logloom.llm import line_dedup


def shingles(t, k=line_dedup.SHINGLE):
    return {t[i : i + k] for i in range(max(1, len(t) - k + 1))}


def test_line_stage(spark):
    rnd = random.Random(11)
    part = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common = part(100)
    lines = [common + part(13) for _ in range(110)]
    lines += [common + part(4) + line[-9:] for line in lines[:10]]
    sets = [shingles(t) for t in lines]
    least = list(range(len(lines)))
    for k, own in enumerate(sets):
        for j in range(k):
            if len(sets[j] & own) >= line_dedup.SIMILARITY * len(sets[j] | own):
                low, high = sorted((least[j], least[k]))
                least = [low if x == high else x for x in least]
    want = sorted(set(least))
    docs = spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in enumerate(lines)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.line_dedup(spark, docs, "")
    assert out.columns == docs.columns and 0 < len(want) < 110
    assert [r["doc_id"] for r in out.orderBy("doc_id").collect()] == want
