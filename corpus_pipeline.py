"""From raw documents to training tokens, in stages that are each written before the next one reads."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseyard.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from pulseyard.llm.shared import spare_names, table
from pulseyard.session import stored


def _packed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` as the columns that operators read and one struct of all columns, whatever their names."""
    (whole,) = spare_names(docs, "whole_row")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole)
    return docs.select("doc_id", "text", "source", row), whole


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labels, does not take for toxic.

    Null, empty and wordless texts are not toxic and stay; long texts are read whole; repeated rows fare
    alike. Labels of unknown ids count for nothing; without labels nothing is toxic. Columns of any name
    come out as they went in. An empty table gives none.
    """
    packed, whole = _packed(docs)
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(packed, chain).filter(~F.col("toxic")).select(f"{whole}.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id.

    Null counts as empty, and of all empty texts one row stays. Null ids come last; of rows that repeat an id
    and its text one stays. Texts are compared whole. Columns of any name come out as they went in. An
    empty table gives none.
    """
    packed, whole = _packed(docs)
    return exact_dedup.exact_dedup(packed).filter("kept").select(f"{whole}.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each connected group of near duplicates the document with the smallest id.

    Texts without words are near no other; equal texts are. Null ids come last; of rows that repeat an id and
    its text one stays. Texts are read whole. Columns of any name come out as they went in. An empty table
    gives none.
    """
    packed, whole = _packed(docs)
    return ngram_join.keep_one(packed).select(f"{whole}.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them.

    Null is a source; texts without words weigh nothing and follow the share of their source. Equal rows
    share their copies. Columns of any name come out as they went in. An empty table gives none.
    """
    packed, whole = _packed(docs)
    return mixing.repeat_rows(mixing.mix_sources(packed)).select(f"{whole}.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes decoded from them.

    Null and empty texts have no tokens; long ones are encoded whole; repeated rows get the same result
    each. Only the columns named here come out. An empty table gives none.
    """
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN, bpe.COARSE)
    return done.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        "token_ids",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing to target weights", mix),
    ("byte-level BPE", tokenize),
]

#: Classifiers, MinHash and pivotal rounding are not SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
