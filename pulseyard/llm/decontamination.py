"""Benchmark decontamination by a prefix-filtered join of shingles."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseyard.session import stored

from .license_scan import WORD_GAP, words_of
from .shared import lower_ascii, may_contain, membership_bits, text_or_empty

#: Consecutive item words that are looked for, and words of a shingle.
WINDOW_WORDS, SHINGLE_WORDS = 10, 3

OUTPUT = ("n_words", "n_hit", "n_items", "items", "contaminated")


def _row_key(text_col: str) -> Column:
    return F.unhex(F.md5(text_or_empty(text_col)))


def word_count(text: Column) -> Column:
    """Number of words, without making them."""
    return F.regexp_count(lower_ascii(text), F.lit(WORD_GAP.replace("[", "[^", 1))).cast("long")


def item_windows(benchmark: DataFrame, window: int = WINDOW_WORDS, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, phrase) of every window of an item, each once: its words, joined by spaces.

    An item of fewer words than a window, but not none, is one window.
    """
    read = benchmark.select(F.col(item_col).cast("string").alias("item"), F.explode(F.array(words_of(text_or_empty(text_col)))).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    slices = F.transform(starts, lambda at: F.array_join(F.slice("words", at, window), " "))
    return read.filter(F.size("words") > 0).select("item", F.explode(slices).alias("phrase")).distinct()


def shingle_hashes(words: Column, width: int) -> Column:
    """One hash for each run of ``width`` words, in order; the hash also tells the width."""
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - width + 1, F.lit(0)))
    return F.transform(starts, lambda w, i: F.xxhash64(F.lit(width), w, *[F.get(words, i + k) for k in range(1, width)]))


def _read(docs: DataFrame, widths: list[int], id_col: str, text_col: str) -> tuple[DataFrame, Column]:
    """(id, key, words) of every row, and the hashes of its shingles, those of one width after those of another."""
    identity = (F.col(id_col).alias("id"), _row_key(text_col).alias("key"))
    # An array of one row keeps the optimizer from copying the splitting of the text into every later use.
    read = docs.select(*identity, F.explode(F.array(words_of(text_or_empty(text_col)))).alias("words"))
    return read, F.concat(*[shingle_hashes(F.col("words"), w) for w in widths])


def _count_pass(docs: DataFrame, shingles: DataFrame, widths: list[int], id_col: str, text_col: str) -> DataFrame:
    """(id, key, n_words, null) of every row, and (null, null, null, hash) of every shingle that may be among those given.

    Both come from one splitting of the texts and are written, so that words need not be counted by another scan.
    A null behind the hashes of a text stands for its row. Places where a shingle stands are one number each.
    """
    read, hashes = _read(docs, widths, id_col, text_col)
    n_words = F.size("words").cast("long").alias("n_words")
    ended = F.concat(hashes, F.array(F.lit(None).cast("long")))
    spread = read.select("id", "key", n_words, F.explode(ended).alias("hash"))
    is_row = F.col("hash").isNull()
    held = spread.filter(is_row | may_contain(membership_bits(shingles.select("hash")), F.col("hash")))
    return stored(held.select(*[F.when(is_row, F.col(c)).alias(c) for c in ("id", "key", "n_words")], "hash"))


def _hits(docs: DataFrame, shingles: DataFrame, widths: list[int], id_col: str, text_col: str) -> DataFrame:
    """(id, key, words, place, hash) of the shingles of texts that may be among those given.

    Texts are split once and hashed once. Only a shingle that passes the Bloom filter becomes a row of its own:
    the test stands directly above the explosion, in generated code that copies nothing before it.
    """
    read, hashes = _read(docs, widths, id_col, text_col)
    spread = read.select("id", "key", "words", F.posexplode(hashes).alias("place", "hash"))
    held = spread.filter(may_contain(membership_bits(shingles.select("hash")), F.col("hash")))
    # The hashes of one width follow those of another.
    place, before = F.col("place"), F.lit(0)
    for width in widths:
        place = F.when(F.col("place") >= before, F.col("place") - before).otherwise(place)
        before = before + F.greatest(F.size("words") - width + 1, F.lit(0))
    return held.withColumn("place", place)


def _window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(phrase, words, size, width, n_shingles, at, hash) of every shingle of every window.

    Windows shorter than a shingle have one, of their own width.
    """
    width = F.least(F.lit(shingle), F.size("words"))
    cut = windows.select("phrase", F.split("phrase", " ").alias("words"))
    cut = cut.select("phrase", "words", F.size("words").alias("size"), width.alias("width"))
    hashes = shingle_hashes(F.col("words"), shingle)
    for narrow in range(shingle - 1, 0, -1):
        hashes = F.when(F.col("width") == narrow, shingle_hashes(F.col("words"), narrow)).otherwise(hashes)
    cut = cut.withColumn("n_shingles", F.col("size") - F.col("width") + 1)
    return cut.select("*", F.posexplode(hashes).alias("at", "hash"))


def _prefixes(shingles: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """Of each window the shingles it is joined on: with ``need`` of its shingles to be found, the
    ``n_shingles - need + 1`` rarest, of which every occurrence must have one."""
    need = F.ceil(F.lit(threshold) * F.col("n_shingles") - 1e-9).cast("int")
    rarity = Window.partitionBy("phrase").orderBy("n", "hash", "at")  # at most a window's shingles
    ranked = shingles.join(counts, "hash", "left").fillna({"n": 0}).withColumn("need", need)
    ranked = ranked.withColumn("rank", F.row_number().over(rarity))
    # A shingle that occurs nowhere can be the one an occurrence must have, but then there is none.
    return ranked.filter((F.col("rank") <= F.col("n_shingles") - F.col("need") + 1) & (F.col("n") > 0)).drop("rank", "n")


def rows_and_occurrences(
    docs: DataFrame,
    windows: DataFrame,
    threshold: float = 1.0,
    window: int = WINDOW_WORDS,
    shingle: int = SHINGLE_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(id, key, n_words) of every row, and (id, key, start, size, phrase) of every occurrence of a window in a text.

    ``key`` is the MD5 of the text: it parts rows that share an id. Repeated rows with one text share their
    occurrences. ``start`` counts words from 0.

    The first scan of the texts counts their words, finds the shingles that windows have (a Bloom filter holds
    back the rest) and counts them, which orders them by rarity. The second scan takes up the rarest ones only, with the
    few words around each, so that no text is moved; they meet the windows on the hash of the shingle.
    Length and position say where the window must start and that the text is long enough, and the words
    themselves settle it. A hot shingle is a hot key of a join without anything above it that needs its
    rows together, so that adaptive execution splits it.
    """
    shingles = stored(_window_shingles(windows.select("phrase").distinct(), shingle))
    widths = [r["width"] for r in shingles.select("width").distinct().orderBy("width").collect()]  # `shingle` values at most
    if not widths:
        nothing = f"id {docs.schema[id_col].dataType.simpleString()}, key binary, start int, size int, phrase string"
        rows = docs.select(F.col(id_col).alias("id"), _row_key(text_col).alias("key"), word_count(text_or_empty(text_col)).alias("n_words"))
        return rows, docs.sparkSession.createDataFrame([], nothing)
    counted = _count_pass(docs, shingles, widths, id_col, text_col)
    rows = counted.filter(F.col("n_words").isNotNull()).select("id", "key", "n_words")
    counts = counted.filter(F.col("n_words").isNull()).groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    prefixes = stored(_prefixes(shingles, counts, threshold))
    hits = _hits(docs, prefixes, widths, id_col, text_col)
    first = F.greatest(F.col("place") - (window - 1), F.lit(0))
    around = F.slice("words", first + 1, F.col("place") - first + window)
    hits = hits.select("id", "key", "hash", "place", first.alias("first"), around.alias("around"))
    met = hits.join(prefixes, "hash")
    start = F.col("place") - F.col("at")
    inside = F.col("place") - F.col("at") - F.col("first")
    bounded = met.filter((start >= 0) & (inside + F.col("size") <= F.size("around")))
    bounded = bounded.withColumns({"start": start, "there": F.slice("around", inside + 1, F.col("size"))})
    same = F.transform(F.sequence(F.lit(1), "n_shingles"), lambda i: F.slice("there", i, F.col("width")) == F.slice("words", i, F.col("width")))
    contained = F.size(F.filter(same, lambda x: x)) >= F.col("need")
    found = bounded.filter((F.col("there") == F.col("words")) | (F.lit(threshold < 1) & contained))
    return rows, found.select("id", "key", "start", "size", "phrase").distinct()


def scan(docs: DataFrame, windows: DataFrame, *args, **kwargs) -> DataFrame:
    """(id, key, start, size, phrase) of every occurrence of a window in a text."""
    return rows_and_occurrences(docs, windows, *args, **kwargs)[1]


def hit_words(occurrences: DataFrame) -> DataFrame:
    """(id, key, n_hit): words covered by occurrences, each counted once. A text's spans are sorted, not gathered."""
    spans = occurrences.select("id", "key", "start", (F.col("start") + F.col("size")).alias("end")).distinct()
    before = Window.partitionBy("id", "key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max("end").over(before), F.lit(0))
    spans = spans.withColumn("new", F.greatest(F.col("end") - F.greatest("start", covered), F.lit(0)))
    return spans.groupBy("id", "key").agg(F.sum("new").cast("long").alias("n_hit"))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = 1.0,
    window: int = WINDOW_WORDS,
    shingle: int = SHINGLE_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """The id of every row of ``docs`` with its words, the words hit, and the items that hit them.

    Words are runs of letters, digits and characters beyond ASCII, with A-Z lower-cased. A window of an
    item occurs where ``threshold`` of its shingles stand at their places (1: all its words in a row); all
    words of the place are hit. ``items`` holds the ids of items with an occurring window as sorted text.
    Null texts have no words. Items without words and null ids are not listed (a null id's windows still
    hit); an item id on several rows is one item. Rows with one id and different texts are kept apart,
    repeated rows get the same result each. Other columns are ignored. An empty table gives no rows, an
    empty benchmark no hits.
    """
    windows = stored(item_windows(benchmark, window, item_col, text_col))
    rows, occurrences = rows_and_occurrences(docs, windows, threshold, window, shingle, id_col, text_col)
    occurrences = stored(occurrences)
    named = occurrences.select("id", "key", "phrase").distinct().join(windows, "phrase").select("id", "key", "item").distinct()
    items = named.groupBy("id", "key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    hits = hit_words(occurrences).alias("h").join(items.alias("i"), F.col("h.id").eqNullSafe(F.col("i.id")) & (F.col("h.key") == F.col("i.key")))
    hits = hits.select(F.col("h.id").alias("hit_id"), F.col("h.key").alias("hit_key"), "n_hit", "items")
    joined = rows.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    columns = (F.col("n_words"), n_hit, F.size(items).cast("long"), items, n_hit > 0)
    return joined.select(F.col("id").alias(id_col), *[c.alias(name) for c, name in zip(columns, OUTPUT, strict=True)])
