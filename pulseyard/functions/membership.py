"""Bloom filters as column values: a scan leaves out rows without any shuffle."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least and most words of a bit table: 65,536 x 64 bits are half a megabyte, the most is 8 MB.
BIT_WORDS, MOST_BIT_WORDS = 1 << 16, 1 << 20


def _bit_place(keys: Sequence[Column], words: Column) -> tuple[Column, Column]:
    mixed = F.xxhash64(*keys)
    return F.pmod(mixed, words).cast("int"), F.pmod(F.shiftrightunsigned(mixed, 32), F.lit(64)).cast("int")


def bit_words(keys: int) -> int:
    """Words of a bit table for so many keys: 16 bits a key, within ``BIT_WORDS`` and ``MOST_BIT_WORDS``."""
    return min(max(BIT_WORDS, 1 << (keys // 4).bit_length()), MOST_BIT_WORDS)


def membership_bits(keys: DataFrame, words: int = BIT_WORDS) -> Column:
    """Bloom filter of all key rows as one value of ``words`` words, to be tested with ``may_contain``.

    It has no false negatives; with more keys than bits it lets most rows pass, which then meet the exact
    test.
    """
    spark = keys.sparkSession
    word, bit = _bit_place([F.col(f"`{c}`") for c in keys.columns], F.lit(words))
    found = keys.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits"))
    empty = spark.range(words).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    table = found.unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    ordered = F.array_sort(F.collect_list(F.struct("word", "bits")))
    return table.agg(F.transform(ordered, lambda x: x["bits"]).alias("bits")).scalar()


def may_contain(bits: Column, *keys: Column) -> Column:
    """False only for keys that were not given to ``membership_bits``."""
    word, bit = _bit_place(keys, F.size(bits))
    return F.call_function("bit_get", F.element_at(bits, word + 1), bit) == 1
