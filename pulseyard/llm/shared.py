"""Columns and tables that several operators of this folder need."""

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseyard.functions.membership import bit_words as bit_words
from pulseyard.functions.membership import may_contain as may_contain
from pulseyard.functions.membership import membership_bits as membership_bits

#: Runs of ASCII white space, the gaps between words.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Hand rows to Python a thousand at a time: rows hold whole texts, and a worker keeps a batch in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else. For texts of ASCII alone ``lower`` does that, and much faster."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def uniform(*columns: Column) -> Column:
    """Number in [0, 1) that depends on the columns alone, so that reruns and retries agree."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") * F.lit(2.0**-53)


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Input columns that carry a name the operator gives are replaced by the operator's."""
    taken = {name.lower() for name in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def spare_names(df: DataFrame, *bases: str) -> list[str]:
    """Names that no column of the input has, for columns an operator needs on its way."""
    taken = {c.lower() for c in df.columns}
    out = []
    for base in bases:
        while base.lower() in taken:
            base = f"_{base}"
        taken.add(base.lower())
        out.append(base)
    return out


def row_hash(df: DataFrame) -> Column:
    """Hash of all columns. Maps and variants cannot be hashed and take part as JSON text."""

    def hashable(field) -> Column:
        kind = field.dataType.simpleString()
        column = F.col(f"`{field.name}`")
        return F.to_json(F.struct(column.alias("c"))) if "map<" in kind or "variant" in kind else column

    return F.xxhash64(*[hashable(field) for field in df.schema.fields])
