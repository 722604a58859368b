import corpus_pipeline
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    text = lambda i: " ".join(f"w{(i * 31 + k * 7) % 997}x the of" for k in range(30 + i % 20))
    rows = [(i, text(i), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, text(3), "en", "s0"), (101, text(3).upper(), "en", "s1"), (102, "123 456", "en", "s0"), (103, None, None, None), (104, "intro " + "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 and more", "en", None)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, "Q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11")], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_stages_one_by_one(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "token_ids":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = sorted(r.doc_id for r in docs.collect())
    every = set(range(60)) | {100, 101, 102, 103, 104}
    assert set(kept["language_id"]) == every - {102, 103}
    assert set(kept["near_dedup"]) == every - {102, 103, 100, 101}
    assert kept["decontamination"] == list(range(60))
    assert set(kept["source_mix"]) <= set(range(60))
    assert kept["token_ids"] == kept["source_mix"]


def test_run(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    total = found.agg(F.sum("n_tokens").alias("n"), F.max(F.col("start") + F.col("n_tokens")).alias("m")).first()
    assert total.n == total.m > 0
