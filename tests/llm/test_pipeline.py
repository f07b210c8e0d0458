import hashlib
from collections import Counter

import public_tokenizers
from helpers import SCHEMA, SMALL, awkward_rows
from test_bpe import packed, reference  # noqa: F401
from test_ngram_join import brute

import corpus_pipeline


def test_stages(spark, reference, tmp_path):  # noqa: F811
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").filter("toxic = 1").collect()}
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], str(SMALL))
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        seen.append(spark.read.parquet(str(tmp_path / name.replace(" ", "_"))))
    for df in seen[:5]:
        assert df.columns == docs.columns
    rows = [{r["doc_id"]: r for r in df.collect()} for df in seen]
    clean = set(rows[0]) - toxic
    assert len(clean & set(rows[1])) >= 0.97 * len(clean)
    texts = {}
    for i, r in rows[1].items():
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
        texts[key] = max(texts.get(key, -1), i)
    assert set(rows[2]) == set(texts.values())
    pairs = [(i, r["text"]) for i, r in rows[2].items()]
    assert set(rows[3]) == {int(c) for i, c, _, _ in brute(pairs)}
    copies = Counter(r["doc_id"] for r in seen[4].collect())
    assert set(copies) <= set(rows[3]) and max(copies.values()) <= 2
    assert seen[5].count() == seen[4].count()
    for i, r in rows[5].items():
        ids = packed(reference, rows[4][i]["text"])
        assert r["n_tokens"] == len(ids) // 4 and r["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(rows[4][i]["text"].encode()).hexdigest()
    assert public_tokenizers.PATTERN


def test_awkward_and_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for part, rows in (("odd", awkward_rows()), ("none", [])):
        docs = spark.createDataFrame(rows, SCHEMA)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, folder)
            if k < 4:
                assert out.columns == docs.columns
            out.write.parquet(f"{folder}/{part}-{k}")
            docs = spark.read.schema(out.schema).parquet(f"{folder}/{part}-{k}")
        assert (docs.count() == 0) == (not rows)
