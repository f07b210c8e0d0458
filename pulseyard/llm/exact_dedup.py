"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseyard.session import stored

from .shared import bit_words, lower_ascii, may_contain, membership_bits, spare_names, text_or_empty, without

OUTPUT = ("keep_id", "group_size", "kept")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64) -> DataFrame:
    """Every row of ``docs`` with ``keep_id``, ``group_size`` and ``kept``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row
    with the largest id stays; null ids come last. When that id itself is repeated with the same text,
    one of its rows stays. Input columns named like an output are replaced. An empty table gives none.

    Each step sees only what the step before left over: lengths held by one row decide it without any
    hash, (length, prefix hash) pairs held by one row decide it without its full text. Two Bloom filters,
    sized from the number of their keys up to a fixed limit, carry these verdicts into the next scan, so
    only texts that may have a copy are hashed in full or moved (one that collides in a filter costs a hash
    and no error). The final groups are exact on SHA-256 and counted before the shuffle. A group that holds
    a third of all rows meets its one summary row in a join that nothing above needs whole, so adaptive
    execution splits it; only rows that repeat the id that stays are numbered, by a number of their own.
    """
    docs = without(docs, OUTPUT)
    length, prefix, full, top, number, first = spare_names(docs, "text_length", "prefix_hash", "full_hash", "top_rows", "row_number", "first_row")
    g_full, g_keep, g_size = spare_names(docs, "group_hash", "group_keep", "group_rows")
    norm = lower_ascii(text_or_empty(text_col))
    measured = F.octet_length(text_or_empty(text_col))  # lower-casing A-Z changes no length
    start = F.xxhash64(lower_ascii(F.substring(text_or_empty(text_col), 1, prefix_chars)))

    lengths = stored(docs.select(measured.alias(length)).groupBy(length).count().filter("count > 1").select(length))
    lengths_bits = membership_bits(lengths, bit_words(lengths.count()))
    same_length = docs.select(measured.alias(length), start.alias(prefix)).filter(may_contain(lengths_bits, F.col(length)))
    pairs = stored(same_length.groupBy(length, prefix).count().filter("count > 1").select(length, prefix))
    pair_bits = membership_bits(pairs, bit_words(pairs.count()))

    doubtful = may_contain(pair_bits, measured, start)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    only = docs.filter(~doubtful).select(*columns, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    hashed = docs.filter(doubtful).withColumn(full, F.unhex(F.sha2(norm, 256)))

    by_id = hashed.select(F.col(full).alias("hash"), F.col(id_col).alias("id")).groupBy("hash", "id").agg(F.count(F.lit(1)).alias("rows"))
    groups = by_id.groupBy("hash").agg(
        F.max("id").alias("keep"),
        F.sum("rows").alias("size"),
        F.coalesce(F.max_by("rows", "id"), F.sum("rows")).alias("top"),
    )
    groups = stored(groups.filter("size > 1").select(F.col("hash").alias(g_full), F.col("keep").alias(g_keep), F.col("size").alias(g_size), F.col("top").alias(top)))
    grouped = F.col(g_size).isNotNull()
    stays = F.col(id_col).eqNullSafe(F.col(g_keep))
    joined = hashed.join(groups, F.col(full) == F.col(g_full), "left").filter(~(grouped & stays & (F.col(top) > 1)))
    keep_id = F.when(grouped, F.col(g_keep)).otherwise(F.col(id_col))
    settled = joined.select(*columns, keep_id.alias("keep_id"), F.coalesce(g_size, F.lit(1).cast("long")).alias("group_size"), (~grouped | stays).alias("kept"))
    out = only.unionByName(settled)
    many = groups.filter(F.col(top) > 1)
    if many.isEmpty():
        return out
    # Rows that repeat the id that stays: each gets a number when it is written, and the least number stays.
    repeated = hashed.join(many, (F.col(full) == F.col(g_full)) & stays).withColumn(number, F.monotonically_increasing_id())
    repeated = stored(repeated.drop(g_full))
    least = repeated.groupBy(F.col(full).alias(g_full)).agg(F.min(number).alias(first))
    chosen = repeated.join(least, (F.col(full) == F.col(g_full)) & (F.col(number) == F.col(first)), "left")
    return out.unionByName(chosen.select(*columns, F.col(g_keep).alias("keep_id"), F.col(g_size).alias("group_size"), F.col(first).isNotNull().alias("kept")))
