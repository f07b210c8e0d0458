"""Language identification with bit-sliced Bloom filters of character n-grams."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import letter_codes, parts, windows
from .shared import short_batches, spare_names, text_or_empty, without

UNKNOWN = "und"
OUTPUT = ("lang_pred", "score")
_SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


@dataclass(frozen=True)
class LanguageFilters:
    """One Bloom filter per language, held side by side: a slot is the mask of the languages that set it.

    ``slots`` has a column of 64 languages each; ``chance`` is the share of n-grams outside a language's
    set that its filter takes for members.
    """

    languages: tuple[str, ...]
    slots: np.ndarray
    chance: np.ndarray
    size: int
    hashes: int


def _grams(texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams as exact 63-bit numbers, number of the text) in bounded parts."""
    for numbers, held in parts(texts):
        (a, b, c), owner = windows(*letter_codes(held), 3)
        yield (a << np.uint64(42)) | (b << np.uint64(21)) | c, numbers[owner]


def _slot_numbers(grams: np.ndarray, size: int, hashes: int) -> list[np.ndarray]:
    mixed = grams ^ (grams >> np.uint64(29))
    shift = np.uint64(64 - (size.bit_length() - 1))
    return [((mixed * np.uint64(salt)) >> shift).astype(np.int64) for salt in _SALTS[:hashes]]


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of (text, lang); counted per batch before the shuffle."""

    short_batches(labelled.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for lang, texts in rows.groupby("lang")["text"]:
                for grams, _ in _grams(texts.tolist()):
                    gram, n = np.unique(grams.astype(np.int64), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": gram, "n": n})

    counted = labelled.select("text", "lang").mapInPandas(count, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit_filters(labelled: DataFrame, least_share: float = 2e-5, size: int = 1 << 19, hashes: int = 3) -> LanguageFilters:
    """Filters from (text, lang) rows, null languages left out.

    A language holds the n-grams that make up at least ``least_share`` of its n-grams. The driver
    receives the list of languages and at most ``size`` slots per 64 of them, whatever the input.
    """
    counts = gram_counts(labelled.filter(F.col("lang").isNotNull()).select(text_or_empty("text").alias("text"), F.col("lang").cast("string").alias("lang")))
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    members = counts.join(totals, "lang").filter(F.col("n") >= least_share * F.col("total")).select("lang", "gram")
    place = {lang: i for i, lang in enumerate(languages)}

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            number = rows["lang"].map(place).to_numpy()
            bit = np.left_shift(np.uint64(1), (number % 64).astype(np.uint64)).astype(np.int64)
            for slot in _slot_numbers(rows["gram"].to_numpy().astype(np.uint64), size, hashes):
                yield pd.DataFrame({"slot": slot, "word": number // 64, "bits": bit})

    words = max(1, -(-len(languages) // 64))
    masks = np.zeros((size, words), dtype=np.uint64)
    if languages:
        rows = members.mapInPandas(slots, "slot long, word long, bits long").groupBy("slot", "word").agg(F.bit_or("bits").alias("bits")).toPandas()
        masks[rows["slot"].to_numpy(), rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint64)
    filled = np.array([np.mean((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(languages))])
    return LanguageFilters(tuple(languages), masks, filled**hashes, size, hashes)


def languages_of(grams: np.ndarray, filters: LanguageFilters) -> np.ndarray:
    """Mask of all languages that hold each n-gram, from one look at each of its slots."""
    found = None
    for slot in _slot_numbers(grams, filters.size, filters.hashes):
        masks = filters.slots[slot]
        found = masks if found is None else found & masks
    return found


def scores(texts: list[str], filters: LanguageFilters) -> tuple[np.ndarray, np.ndarray]:
    """Number of n-grams per text, and per text and language the share of them that the language holds,
    less what its filter lets through by chance."""
    held = np.zeros((len(texts), len(filters.languages)))
    total = np.zeros(len(texts))
    for grams, owner in _grams(texts):
        masks = languages_of(grams, filters)
        total += np.bincount(owner, minlength=len(texts))
        for i in range(len(filters.languages)):
            hit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            held[:, i] += np.bincount(owner[hit.astype(bool)], minlength=len(texts))
    share = held / np.maximum(total, 1)[:, None]
    return total, np.clip((share - filters.chance) / (1 - np.minimum(filters.chance, 0.999)), 0, 1)


def identify(docs: DataFrame, filters: LanguageFilters, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``lang_pred`` and ``score``.

    Texts that are null or have no letter get ``und`` and 0, and so does everything if no language was
    learned. Ties go to the language that comes first by code point. Whole texts are used, in parts of
    bounded size; there is no shuffle. Input columns named like an output are replaced.
    """
    docs = without(docs, OUTPUT)
    short_batches(docs.sparkSession)
    (guess,) = spare_names(docs, "language_guess")

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = np.array([*filters.languages, UNKNOWN], dtype=object)
        for texts in batches:
            total, share = scores(texts.tolist(), filters)
            if not filters.languages:
                yield pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": 0.0})
                continue
            best = np.where(total > 0, share.argmax(axis=1), len(filters.languages))
            score = np.where(total > 0, share.max(axis=1), 0.0)
            yield pd.DataFrame({"lang": names[best], "score": score})

    guessed = docs.withColumn(guess, predict(text_or_empty(text_col)))
    return guessed.select(*docs.columns, F.col(f"{guess}.lang").alias("lang_pred"), F.col(f"{guess}.score").alias("score"))
