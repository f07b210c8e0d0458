"""Columns that bear the names operators use on their way, and a map column, do no harm."""

import pytest
from helpers import SCHEMA, awkward, awkward_rows
from pyspark.sql import functions as F

import corpus_pipeline
from pulseyard.llm import exact_dedup, mixing, ngram_join

NAMES = (
    "whole whole_row __whole id source_ __id __size __key __rows __head key hash size source_size target rows row_ordinal n_equal_rows "
    "row_tie text_mark whole_copies settled_id settled_source settled_mark copies copy_number mark text_length prefix_hash full_hash top_rows "
    "row_number first_row group_hash group_keep group_rows keep_id group_size text_key head doubtful_id doubtful_key doubtful_head class_id"
).split()


def crowded(spark):
    docs = awkward(spark)
    taken = {c.lower() for c in docs.columns}
    extra = [F.lit(f"x{i}").alias(name) for i, name in enumerate(NAMES) if name.lower() not in taken]
    return docs.select("*", *extra, F.create_map(F.lit("k"), F.lit(1)).alias("bag"))


def ids(rows):
    return sorted(str(r["doc_id"]) for r in rows)


def test_operators(spark):
    docs = crowded(spark)
    for operate in (exact_dedup.exact_dedup, mixing.mix_sources):
        assert ids(operate(docs).collect()) == ids(docs.collect())
        plain = operate(awkward(spark)).collect()
        assert sorted(map(str, [r["doc_id"] for r in plain])) == ids(docs.collect())
    assert ids(ngram_join.keep_one(docs).collect()) == ids(ngram_join.keep_one(awkward(spark)).collect())


@pytest.mark.parametrize("place", range(4))
def test_stages(spark, tmp_path, place):
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    stage = corpus_pipeline.STAGES[place][1]
    docs, plain = crowded(spark), spark.createDataFrame(awkward_rows(), SCHEMA)
    out = stage(spark, docs, folder)
    assert out.columns == docs.columns
    if place != 3:  # draws may fall otherwise
        assert ids(out.collect()) == ids(stage(spark, plain, folder).collect())
    for r in out.collect():
        assert r["__whole"].startswith("x") and r["bag"] == {"k": 1}
