"""Quality rules with thresholds that adapt to each language and source."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE_RUN, spare_names, text_or_empty, without

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OUTPUT = (*BASE, "base_failed", "kept", "failed_rules")

#: Rates in thousandths: name, numerator, denominator, whether low values fail too.
RATES = (
    ("symbols", "n_symbols", "n_words", False),
    ("word_length", "word_chars", "n_words", True),
    ("dup_lines", "n_dup_lines", "n_lines", False),
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def _starts_covered(starts: Column) -> Column:
    """Words covered by three-word windows at these rising starts."""
    begin = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda s, x: F.struct(x.alias("last"), (s["n"] + F.least(F.lit(3), x - s["last"])).alias("n"))
    return F.aggregate(starts, begin, step, lambda s: s["n"])


def repeated_window_words(hashes: Column) -> Column:
    """Words in three-word windows that occur twice or more; ``hashes`` has one hash per word."""
    last = F.size(hashes) - 3
    windows = F.transform(F.slice(hashes, F.lit(1), last + 1), lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))
    windows = F.when(last >= 0, windows).otherwise(F.array().cast("array<bigint>"))
    return windows


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row with the base counts and ``n_lines`` (lines with a word). Null texts count nothing.

    All of it is a projection of the row's own text, so there is no shuffle. Windows of three words are
    compared by 64-bit hashes within one text. Input columns named like a count are replaced.
    """
    docs = without(docs, (*BASE, "n_lines"))
    hashes, windows, ordered, twice, pairs = spare_names(docs, "word_hashes", "window_hashes", "sorted_hashes", "repeated_hashes", "hash_places")
    text = text_or_empty(text_col)
    squeezed = F.regexp_replace(text, SPACE_RUN, "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    counted = docs.withColumns(
        {
            hashes: F.transform(words_of(text), lambda w: F.xxhash64(w)),
            "word_chars": F.length(squeezed).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        }
    )
    counted = counted.withColumns({"n_words": F.size(hashes).cast("long"), windows: repeated_window_words(F.col(hashes))})
    # Each step is a column of its own: inside a lambda it would be worked out again for every element.
    repeats = F.size(windows) > F.size(F.array_distinct(windows))
    counted = counted.withColumn(ordered, F.when(repeats, F.sort_array(windows)))
    next_one = F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0)))
    same_as_next = F.filter(F.zip_with(ordered, next_one, lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull())
    counted = counted.withColumn(twice, F.array_distinct(same_as_next))
    # A few repeated windows are looked up one by one; many are found by sorting (hash, place) instead.
    many = F.size(twice) > 32
    counted = counted.withColumn(pairs, F.when(many, F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    looked_up = F.filter(F.transform(windows, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda x: x.isNotNull())
    twin = lambda p, q: F.coalesce(p["h"] == q["h"], F.lit(False))
    by_sort = F.transform(pairs, lambda p, i: F.when(twin(p, F.get(pairs, i - 1)) | twin(p, F.get(pairs, i + 1)), p["i"]))
    starts = F.when(~many, looked_up).otherwise(F.array_sort(F.filter(by_sort, lambda x: x.isNotNull())))
    covered = F.when(F.col(twice).isNull(), F.lit(0).cast("long")).otherwise(_starts_covered(starts))
    counts = F.struct(*BASE[:-1], covered.alias("n_repeat_words"), "n_lines")
    # A filter on the counts must not copy their expressions below this step, and into each other's lambdas.
    return counted.select(*[f"`{c}`" for c in docs.columns], F.inline(F.array(counts)))


def _rate(top: str, bottom: str) -> Column:
    return F.when(F.col(bottom) > 0, F.expr(f"1000 * {top} div {bottom}"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _shift(value: Column) -> Column:
    return F.greatest(F.length(F.bin(value)) - 6, F.lit(0)).cast("int")


def sketch_bucket(value: Column) -> Column:
    """Lower bound of the log-linear bucket of a count: exact below 64, then 32 buckets per doubling."""
    return F.call_function("shiftleft", F.call_function("shiftright", value, _shift(value)), _shift(value))


def bucket_end(bucket: Column) -> Column:
    """Where the next bucket starts."""
    return bucket + F.call_function("shiftleft", F.lit(1).cast("long"), _shift(bucket))


def sketches(measured: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Mergeable quantile sketches: per group and rate, the counts of log-linear buckets.

    Sketches merge by adding counts, on the map side, between tasks, and from sources up to languages.
    A quantile read from one is off by one part in 32 at most. Rows that failed the base are not asked.
    """
    rates = F.explode(
        F.array(*[F.struct(F.lit(name).alias("rate"), sketch_bucket(_rate(top, bottom)).alias("bucket")) for name, top, bottom, _ in RATES])
    )
    rows = measured.filter(~base_failed()).select(*groups, rates.alias("r")).select(*groups, "r.*").filter("bucket is not null")
    return rows.groupBy(*groups, "rate", "bucket").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """``q1`` and ``q3`` per group and rate; a window over buckets, whose number is bounded."""
    keys = [*groups, "rate"]
    below = F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    ranked = sketch.withColumns({"below": below, "total": total})
    return ranked.groupBy(*keys).agg(
        F.min(F.when(4 * F.col("below") >= F.col("total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("below") >= 3 * F.col("total"), F.col("bucket"))).alias("q3"),
        F.max("total").alias("n"),
    )


def thresholds(measured: DataFrame, reach: int = 3, least_rows: int = 50, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per language and source with ``<rate>_low`` and ``<rate>_high``, in thousandths.

    A limit lies ``reach`` spreads beyond the quartile, a spread being the distance of the quartiles as the
    sketch knows them, from the start of one bucket to the end of the other. So every limit comes from the
    rows of its own source, and quartiles stay what they are while less than a quarter of the rows is bad.
    A source with fewer than ``least_rows`` rows in a language takes the sketch of the language, merged from
    all its sources. Null language and null source are groups. Repeated rows count as often as they
    stand; an empty table has no limits.
    """
    both = sketches(measured.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), *BASE, "n_lines"), ("lang", "source"))
    merged = both.groupBy("lang", "rate", "bucket").agg(F.sum("n").alias("n"))
    fine = quartiles(both, ("lang", "source")).alias("f")
    coarse = quartiles(merged, ("lang",)).alias("c")
    joined = fine.join(coarse, F.col("f.lang").eqNullSafe(F.col("c.lang")) & (F.col("f.rate") == F.col("c.rate")))
    enough = F.col("f.n") >= least_rows
    chosen = joined.select(
        "f.lang",
        "f.source",
        "f.rate",
        F.when(enough, F.col("f.q1")).otherwise(F.col("c.q1")).alias("q1"),
        F.when(enough, F.col("f.q3")).otherwise(F.col("c.q3")).alias("q3"),
    )
    limits = []
    end = bucket_end(F.col("q3"))
    spread = end - F.col("q1")
    for name, _, _, two_sided in RATES:
        here = F.col("rate") == name
        limits.append(F.max(F.when(here, end + reach * spread)).alias(f"{name}_high"))
        limits.append(F.max(F.when(here, (F.col("q1") - reach * spread) if two_sided else F.lit(None))).cast("long").alias(f"{name}_low"))
    return chosen.groupBy("lang", "source").agg(*limits)


def judge(measured: DataFrame, limits: DataFrame, noise: int = 3, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Every measured row with ``base_failed``, ``kept`` and the names of the rules it failed.

    A text is a small sample of its source, so it fails a limit only by more than ``noise`` standard
    deviations of a count of the size that the limit allows it, and one count each: short texts have more room
    than long ones. The limits have one row per language and source; a hot pair is split by adaptive execution.
    Equal rows get equal verdicts, a row without limits fails by the base alone. Input columns named like an output are replaced.
    """
    measured = without(measured, OUTPUT[len(BASE) :])
    (limit,) = spare_names(measured, "limit")
    limits = limits.select(F.struct(*limits.columns).alias(limit))
    same = F.col(lang_col).eqNullSafe(F.col(f"{limit}.lang")) & F.col(source_col).eqNullSafe(F.col(f"{limit}.source"))

    def beyond(top: Column, allowed: Column, sign: int) -> Column:
        over = (sign * (1000 * top - allowed) - 1000 * noise).cast("double")
        return F.coalesce((over > 0) & (over * over > F.lit(1000.0 * noise * noise) * F.greatest(allowed, F.lit(0)).cast("double")), F.lit(False))

    failures = []
    for name, top, bottom, _ in RATES:
        allowed = {side: F.col(f"{limit}.{name}_{side}") * F.col(bottom) for side in ("high", "low")}
        out = beyond(F.col(top), allowed["high"], 1) | beyond(F.col(top), allowed["low"], -1)
        failures.append(F.when((F.col(bottom) > 0) & out, F.lit(name)))
    joined = measured.join(limits, same, "left")
    joined = joined.withColumns({"base_failed": base_failed(), "failed_rules": F.array_compact(F.array(*failures))})
    joined = joined.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return joined.select(*[f"`{c}`" for c in measured.columns], "base_failed", "kept", "failed_rules")
