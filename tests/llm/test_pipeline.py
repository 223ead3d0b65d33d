"""The corpus pipeline on small tables, stage by stage."""

import corpus_pipeline
from conftest import rows
from test_operators import odd

from tiltfield.llm import common, mixing

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "mixing", "bpe"]
    folder, sizes = common.shared_dir(spark), [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert i == 4 or out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        sizes.append(docs.count())
    assert sizes[1] >= 0.98 * sizes[0] and sizes[2] <= sizes[1] and sizes[3] == sizes[2] and sizes[5] == sizes[4] > 0
    assert docs.where("NOT decoded_ok").count() == 0
    whole = corpus_pipeline.run(spark, SF)
    key = lambda df: sorted((r["doc_id"], tuple(r["tokens"])) for r in rows(df))
    assert key(whole) == key(docs)


def test_stages_take_odd_and_empty_rows(spark):
    for empty in (False, True):
        folder = common.shared_dir(spark)
        docs = odd(spark, empty)
        docs.write.parquet(f"{folder}/in")
        docs = spark.read.parquet(f"{folder}/in")
        for name, stage in corpus_pipeline.STAGES:
            before = docs.columns
            stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            assert name == "bpe" or docs.columns == before
        assert (docs.count() == 0) == empty


def test_mixing_decides_shard_and_position_of_the_tokens(spark):
    folder = common.shared_dir(spark)
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(f"{folder}/in")
    docs = spark.read.parquet(f"{folder}/in")
    mixing.mixed_documents(docs, shard_rows=64).write.parquet(f"{folder}/mixed")
    place = lambda df: sorted((r["doc_id"], r["shard"], r["position"]) for r in rows(df))
    tokens = place(corpus_pipeline.tokenize(spark, spark.read.parquet(f"{folder}/mixed"), SF))
    assert tokens == place(mixing.mix_rows(docs, shard_rows=64)) != place(corpus_pipeline.tokenize(spark, docs, SF))
    assert len({s for _, s, _ in tokens}) > 2 and len(tokens) == docs.count()
