"""Translation sheets: one row per text key, one column per language."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Key column of a sheet and the language used when nothing matches.
SHEET_KEY = "STRING"
FALLBACK_LANGUAGE = "en-US"


def sheet_languages(sheet: DataFrame, key: str = SHEET_KEY, order: str = "row") -> list[str]:
    """Language columns in header order."""
    return [c for c in sheet.columns if c not in (key, order)]


def translation_sets(sheet: DataFrame, key: str = SHEET_KEY, order: str = "row") -> DataFrame:
    """``(language, key, text)``; when a key repeats, its last row along ``order`` wins.

    Sets stay as rows, so a sheet of any size is spread over tasks by language and key.
    """
    languages = sheet_languages(sheet, key, order)
    cells = F.array(
        *[F.struct(F.lit(c).alias("language"), F.col(f"`{c}`").alias("text")) for c in languages]
    )
    last_rows = sheet.groupBy(F.col(key).alias("key")).agg(F.max_by(cells, order).alias("cells"))
    return last_rows.select("key", F.explode("cells").alias("c")).select("c.language", "key", "c.text")


def resolve_language(tag: Column, languages: Sequence[str], fallback: str = FALLBACK_LANGUAGE) -> Column:
    """The language itself, else the first that starts with the tag's first two characters, else the
    fallback. The list comes from the header, so no join is needed."""
    known = F.array(*map(F.lit, languages))
    similar = F.get(F.filter(known, lambda language: language.startswith(F.substring(tag, 1, 2))), F.lit(0))
    resolved = F.when(F.array_contains(known, tag), tag).otherwise(F.coalesce(similar, F.lit(fallback)))
    return F.when(tag.isNull(), F.lit(languages[0])).otherwise(resolved)


def translation_for_tag(
    requests: DataFrame, sheet: DataFrame, tag: str = "tag", key: str = SHEET_KEY, order: str = "row"
) -> DataFrame:
    """``(tag, language, key, text)`` for each distinct requested tag.

    A null tag gets the first language of the sheet.
    """
    language = resolve_language(F.col(tag), sheet_languages(sheet, key, order))
    resolved = requests.select(tag).distinct().withColumn("language", language)
    return resolved.join(translation_sets(sheet, key, order), "language").select(tag, "language", "key", "text")


def translation_lookup(
    rows: DataFrame, sets: DataFrame, language: str = "language", key: str = "key"
) -> DataFrame:
    """Rows with the ``text`` of their key in their language, null when there is none."""
    texts = sets.select(F.col("language").alias(language), F.col("key").alias(key), "text")
    return rows.join(texts, [language, key], "left")
