"""Registered queries of the training-data operators and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from pulseyard.session import stored

from . import exact_dedup as dedup
from . import license_scan as licenses
from . import bpe, centroids, chat, decontamination, langid, mixing, ngram_join, quality_rules, secrets, toxicity, whitening
from .oracle import ORACLE as ORACLE
from .shared import lower_ascii, table, text_or_empty

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_mix_sources(spark, folder):
    mixed = mixing.mix_sources(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


@query
def op2_quality_rules(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    measured = stored(quality_rules.measure(docs).drop("text"))
    judged = quality_rules.judge(measured, quality_rules.thresholds(measured))
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


@query
def op4_license_scan(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return licenses.license_scan(docs).select("doc_id", *licenses.OUTPUT)


@query
def op5_exact_dedup(spark, folder):
    digest = F.sha2(lower_ascii(text_or_empty("text")), 256)
    docs = table(spark, folder, "documents").select("doc_id", "text", digest.alias("text_sha256"))
    return dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query
def op8_secret_scan(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ledger = stored(secrets.scan_unseen(docs, rules=secrets.BASE_RULES))
    # The later rules are new to every blob of this ledger, and they alone are looked for.
    added = stored(secrets.scan_unseen(docs, ledger))
    found = secrets.findings_by_path(docs, ledger.unionByName(added))
    base = F.filter("findings", lambda f: f["rank"] < len(secrets.BASE_RULES))
    counts = [secrets.count_kind(F.col("findings"), rule.kind).alias(f"n_{rule.kind}") for rule in secrets.BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("findings")).alias("spans"))


def crc_fold(name: str = "doc_id"):
    """crc32 of the id as text, modulo 3; ids that are null belong to fold 0."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 3, F.lit(0))


@query
def op3_language_id(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    filters = langid.fit_filters(docs.filter(crc_fold() != 1).select("text", "lang"))
    held_out = (crc_fold() == 1).alias("held_out")
    return langid.identify(docs.select("doc_id", "text", held_out), filters).select("doc_id", "held_out", "lang_pred", "score")


@query
def op6_byte_bpe(spark, folder):
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    done = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, bpe.COARSE)
    return done.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op10_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, chain).drop("text")


@query
def op7_ngram_jaccard_join(spark, folder):
    return ngram_join.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op9_chat_format(spark, folder):
    messages = chat.conversation_messages(table(spark, folder, "conversations"))
    done = chat.format_chat(messages, [chat.ANSWER])
    return done.select("conv_id", "turn", "role", "kind", "status", "at_turn", "level", "step", F.array_join("errors", ";").alias("errors"), "json")


@query
def op11_centroid_clustering(spark, folder):
    return centroids.cluster(table(spark, folder, "embeddings"))[0]


@query
def op12_benchmark_decontamination(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.decontaminate(docs, table(spark, folder, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


@query
def op13_embedding_whitening(spark, folder):
    return whitening.whiten(table(spark, folder, "embeddings"))[0].drop("deviation_exact")


@query
def pipeline(spark, folder):
    return corpus_pipeline.run(spark, folder)
