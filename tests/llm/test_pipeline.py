"""The corpus pipeline on a small corpus: each stage's decisions take effect and keep the columns."""

import random

import pytest

import corpus_pipeline
from lattix.llm import decontaminate, mix, quality


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    folder = f"{tmp_path_factory.mktemp('corpus')}"
    prose = lambda n: " ".join("".join(rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(rng.randint(1, 4))) for _ in range(n))
    junk = lambda n: " ".join("".join(rng.choice("abcd") for _ in range(4)) + rng.choice(["***", "$$$"]) for _ in range(n))
    items = [prose(30) for _ in range(5)]
    rows = [[i, prose(rng.randint(30, 80)) if i % 4 else junk(60), rng.choice(["en", "de"]), f"s{i % 3}"] for i in range(300)]
    for i in (5, 9, 13):
        rows[i][1] = rows[i - 3][1]
    rows[17][1] = prose(20) + " " + items[2] + " " + prose(20)
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.store(stage(spark, docs, corpus))
        left = {r[0] for r in out.select("doc_id").collect()}
        assert left <= ids and left
        if name == "quality":
            assert left == {i for i in ids if i % 4}
        elif name == "near copies":
            assert ids - left == {5, 9, 13}
        elif name == "decontamination":
            assert ids - left == {17}
        elif name == "sharding":
            assert left == ids and set(out.columns) == {*docs.columns, "shard"}
        if name != "sharding":
            assert out.columns == docs.columns
        docs, ids = out, left


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert out.count() > 100
    assert len(corpus_pipeline.STAGES) == 5
    assert {f.__module__ for f in (quality.fit, mix.rake, decontaminate.contamination)} == {"lattix.llm.quality", "lattix.llm.mix", "lattix.llm.decontaminate"}
