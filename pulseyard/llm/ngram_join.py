"""Jaccard join of documents on word n-grams, with Bayesian pruning of MinHash candidates."""

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseyard.session import stored

from .components import connected_components
from .shared import may_contain, membership_bits, short_batches, spare_names, text_or_empty

SHINGLE_WORDS = 5
THRESHOLD = 0.8

#: MinHash values per text, and the largest probability that no band names a pair at the threshold.
HASHES, BAND_MISS = 128, 1e-4

#: Values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-5

#: Texts on one side of a block; larger groups are compared block against block.
BLOCK = 128

#: Pairs compared at once inside a task.
PAIRS_AT_ONCE = 200_000

OUTPUT = ("class_id", "n_links", "n_copies")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def shingles(text: str, words: dict, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles of a text, lower case, words between white space.

    A text of fewer words is one shingle; a text without words has none.
    """
    found = text.lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    hashed = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    width = min(n, len(found))
    rolled = np.full(len(found) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        rolled = (rolled ^ hashed[i : i + len(rolled)]) * _MULTIPLIER
        rolled ^= rolled >> np.uint64(32)
    return np.unique(rolled)


def minhash(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """MinHash values, one row per set; empty sets must not be given."""
    seeds = np.random.default_rng(20).integers(1, 2**63, size=(2, hashes), dtype=np.uint64)
    out = np.empty((len(sets), hashes), dtype=np.uint32)
    begin = 0
    while begin < len(sets):
        end, size = begin, 0
        while end < len(sets) and (end == begin or size + len(sets[end]) <= 100_000):
            size += len(sets[end])
            end += 1
        values = np.concatenate(sets[begin:end])
        starts = np.cumsum([0, *map(len, sets[begin : end - 1])])
        for k in range(hashes):
            mixed = ((values ^ seeds[0, k]) * (seeds[1, k] | np.uint64(1))) >> np.uint64(32)
            out[begin:end, k] = np.minimum.reduceat(mixed, starts)
        begin = end
    return out


def bands_and_rows(threshold: float = THRESHOLD, hashes: int = HASHES, miss: float = BAND_MISS) -> tuple[int, int]:
    """The widest bands, with as many of them as the hashes allow, that miss a pair at the threshold at most so often."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if (1 - threshold**rows) ** bands <= miss:
            return bands, rows
    raise ValueError(f"{hashes} MinHash values cannot name the pairs at a similarity of {threshold}")


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, hashes: int = HASHES, step: int = STEP) -> list[tuple[int, int]]:
    """(values compared, matches that a pair needs to stay).

    With a uniform prior, the similarity after m of n matches follows Beta(m + 1, n - m + 1), so the
    chance that it reaches the threshold is a binomial sum.
    """
    table = []
    for n in range(step, hashes + 1, step):
        chance, m = 0.0, -1
        while chance < tolerance:
            m += 1
            chance += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        table.append((n, m))
    return table


def likely(a: np.ndarray, b: np.ndarray, signatures: np.ndarray, table: list[tuple[int, int]]) -> np.ndarray:
    """Numbers of the pairs (a, b) that stay while their values are compared step by step."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), dtype=np.int32)
    done = 0
    for n, least in table:
        matches += (signatures[a[alive], done:n] == signatures[b[alive], done:n]).sum(axis=1, dtype=np.int32)
        stay = matches >= least
        alive, matches, done = alive[stay], matches[stay], n
    return alive


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least connected row of each of n rows."""
    roots = np.arange(n)
    while True:
        low = np.minimum(roots[a], roots[b])
        new = roots.copy()
        np.minimum.at(new, roots[a], low)
        np.minimum.at(new, roots[b], low)
        new = new[new]
        if (new == roots).all():
            return roots
        roots = new


def _group_pairs(starts: np.ndarray, sizes: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows to compare, some at a time. A group's rows follow each other, first side first;
    a group of one side (``firsts`` equals its size) is compared with itself."""
    for size, first in {(int(s), int(f)) for s, f in zip(sizes, firsts, strict=True)}:
        own = starts[(sizes == size) & (firsts == first)]
        if size == first:
            left, right = np.triu_indices(size, 1)
        else:
            left, right = np.repeat(np.arange(first), size - first), np.tile(np.arange(first, size), first)
        if not len(left):
            continue
        each = max(1, PAIRS_AT_ONCE // len(left))
        for at in range(0, len(own), each):
            base = own[at : at + each, None]
            yield (base + left).ravel(), (base + right).ravel()


def _whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames that hold groups as a whole, with the first row of each group and the end; input is sorted."""
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        starts = np.nonzero((rows[keys] != rows[keys].shift()).any(axis=1).to_numpy())[0]
        held = rows.iloc[starts[-1] :].reset_index(drop=True)
        if len(starts) > 1:
            yield rows.iloc[: starts[-1]].reset_index(drop=True), starts
    if held is not None and len(held):
        yield held, np.array([0, len(held)])


def _blocks(members: DataFrame, group: str, size: str) -> DataFrame:
    """Each member of a group once for every pair of blocks it takes part in: (group, i, j, side, ...).

    A group of up to BLOCK members is one block. In a larger one every block meets every other, so a
    member is copied as often as there are blocks, and no task gets more than two blocks.
    """
    number = F.ceil(F.col(size) / BLOCK)
    placed = members.withColumn("blocks", number).withColumn("block", F.pmod(F.xxhash64("key", F.lit("block")), F.col("blocks")))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    met = met.withColumns({"i": i, "j": j, "side": F.when(F.col("block") == i, 0).otherwise(1)}).drop("block", "other", "blocks")
    return met.repartition(F.col(group), "i", "j").sortWithinPartitions(group, "i", "j", "side", "key")


def _signatures(rows: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(rows["signature"]), dtype=np.uint16).reshape(len(rows), -1)


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, key, signature, bands): key is the MD5 of the text, the signature 16 bits per MinHash value.

    No shuffle; whole texts. Texts without words have no bands.
    """
    n_bands, n_rows = bands_and_rows(threshold)
    id_type = docs.schema[id_col].dataType.simpleString()
    salts = np.random.default_rng(21).integers(1, 2**63, size=n_bands, dtype=np.uint64) | np.uint64(1)

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 500):
                rows = batch.iloc[at : at + 500]
                sets = [shingles(text, words) for text in rows["text"]]
                full = [i for i, s in enumerate(sets) if len(s)]
                values = minhash([sets[i] for i in full])
                bands = np.zeros((len(full), n_bands), dtype=np.uint64)
                for band in range(n_bands):
                    for row in range(n_rows):
                        bands[:, band] = (bands[:, band] ^ values[:, band * n_rows + row]) * salts[band]
                        bands[:, band] ^= bands[:, band] >> np.uint64(31)
                out_bands: list = [[]] * len(rows)
                out_signature = [b""] * len(rows)
                for i, value, band in zip(full, values.astype(np.uint16), bands.astype(np.int64), strict=True):
                    out_bands[i], out_signature[i] = band, value.tobytes()
                yield pd.DataFrame({"id": rows["id"], "key": rows["key"], "signature": out_signature, "bands": out_bands})

    texts = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text_or_empty(text_col))).alias("key"), text_or_empty(text_col).alias("text"))
    return texts.mapInPandas(signed, f"id {id_type}, key binary, signature binary, bands array<long>")


def candidate_links(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Edges (a, b) that connect all texts whose pairs share a band and pass the pruning.

    ``texts`` has one row per distinct text. Only bands shared by two texts go on; per group of texts a
    tree of edges is returned, never its pairs.
    """
    rows = texts.select("key", F.explode(F.array_distinct("bands")).alias("band"))
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = rows.join(shared, "band").join(texts.select("key", "signature"), "key")
    table = least_matches(threshold)

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in _whole_groups(batches, ["band", "i", "j"]):
            signatures, keys = _signatures(rows), rows["key"].to_numpy()
            left, right = [], []
            for a, b in _group_pairs(*_sides(rows, starts)):
                alive = likely(a, b, signatures, table)
                left.append(a[alive])
                right.append(b[alive])
            a = np.concatenate(left) if left else np.zeros(0, dtype=np.int64)
            b = np.concatenate(right) if right else np.zeros(0, dtype=np.int64)
            roots = local_roots(len(rows), a, b)
            far = np.nonzero(roots != np.arange(len(rows)))[0]
            yield pd.DataFrame({"a": keys[far], "b": keys[roots[far]]})

    blocks = _blocks(members, "band", "size").select("band", "i", "j", "side", "key", "signature")
    return blocks.mapInPandas(prune, "a binary, b binary").distinct()


def _sides(rows: pd.DataFrame, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and size of the first side of each group."""
    sizes = np.diff(starts)
    firsts = np.add.reduceat((rows["side"].to_numpy() == 0).astype(np.int64), starts[:-1])
    return starts[:-1], sizes, firsts


def exact_links(a: np.ndarray, b: np.ndarray, sets: Callable[[int], np.ndarray], threshold: float) -> np.ndarray:
    """Numbers of the pairs whose Jaccard similarity reaches the threshold.

    The rows' sets are laid out as a 0/1 matrix over the shingles that two rows share, some columns at a
    time; its product with itself counts the common shingles of all pairs.
    """
    if not len(a):
        return np.zeros(0, dtype=np.int64)
    used = np.unique(np.concatenate([a, b]))
    held = [sets(int(i)) for i in used]
    size = np.array([len(s) for s in held])
    row = np.repeat(np.arange(len(used)), size)
    shingle, column, count = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
    common = count[column] > 1
    row, column = row[common], column[common]
    column = np.unique(column, return_inverse=True)[1]
    place = np.searchsorted(used, a), np.searchsorted(used, b)
    both = np.zeros(len(a), dtype=np.int64)
    width = max(256, 2_000_000 // len(used))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        inside = slice(*np.searchsorted(column, [at, at + width]))
        matrix = np.zeros((len(used), width), dtype=np.float32)
        matrix[row[inside], column[inside] - at] = 1
        if len(a) > len(used):
            both += (matrix @ matrix.T)[place].astype(np.int64)
        else:  # no more pairs than rows, so their rows need no more memory than the matrix
            both += np.einsum("ij,ij->i", matrix[place[0]], matrix[place[1]]).astype(np.int64)
    union = size[place[0]] + size[place[1]] - both
    return np.nonzero(both >= threshold * union - 1e-9)[0]


def verified_links(components: DataFrame, texts: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, root, links) from exact verification of all likely pairs inside the components.

    ``components`` has (node, root), ``texts`` (key, id, signature) with the row that carries each text.
    A Bloom filter of fixed size holds back texts that are in no component before any is moved.
    """
    sizes = components.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = components.join(sizes, "root").join(texts.select(F.col("key").alias("node"), "id", "signature"), "node")
    members = members.select(F.col("node").alias("key"), "root", "size", "id", "signature")
    bits = membership_bits(members.select("key"))
    held = docs.select(F.col(id_col).alias("d_id"), text_or_empty(text_col).alias("text")).withColumn("d_key", F.unhex(F.md5("text")))
    held = held.filter(may_contain(bits, F.col("d_key")))
    same = (F.col("key") == F.col("d_key")) & F.col("id").eqNullSafe(F.col("d_id"))
    members = members.join(held, same).select("key", "root", "size", "signature", "text")
    table = least_matches(threshold)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _WordHashes()
        for rows, starts in _whole_groups(batches, ["root", "i", "j"]):
            # An id may stand in several rows with one text; one of them is enough.
            once = ~rows.duplicated(["root", "i", "j", "side", "key"]).to_numpy()
            rows = rows[once].reset_index(drop=True)
            starts = np.concatenate([[0], np.cumsum(once)])[starts]
            signatures, keys, texts_ = _signatures(rows), rows["key"].to_numpy(), rows["text"].to_numpy()
            cache: dict[int, np.ndarray] = {}

            def sets(i: int) -> np.ndarray:
                if i not in cache:
                    cache[i] = shingles(texts_[i], words)
                return cache[i]

            links = np.zeros(len(rows), dtype=np.int64)
            roots = np.arange(len(rows))
            for start, size, first in zip(*_sides(rows, starts), strict=True):
                one = np.array([0])
                for a, b in _group_pairs(one, np.array([size]), np.array([first])):
                    alive = likely(a + start, b + start, signatures, table)
                    a, b = a[alive], b[alive]
                    linked = exact_links(a, b, lambda i: sets(i + start), threshold)
                    a, b = a[linked], b[linked]
                    links[start : start + size] += np.bincount(np.concatenate([a, b]), minlength=size)
                    new = local_roots(size, np.concatenate([a, np.arange(size)]), np.concatenate([b, roots[start : start + size] - start]))
                    roots[start : start + size] = new + start
                cache.clear()
            found = links > 0
            yield pd.DataFrame({"key": keys[found], "root": keys[roots[found]], "links": links[found]})

    blocks = _blocks(members, "root", "size").select("root", "i", "j", "side", "key", "signature", "text")
    return blocks.mapInPandas(verify, "key binary, root binary, links long")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, key, class_id, keep_key, n_links, n_copies) for every row of ``docs``.

    Texts are linked when their sets of five-word shingles have a Jaccard similarity of ``threshold`` or
    more. Rows with the very same text are one node: ``n_copies`` counts them, ``n_links`` the different
    texts linked to theirs. A class is a connected group of linked texts; ``class_id`` is its smallest id
    and ``keep_key`` the text that holds it (the smaller key among several). Null counts as empty; texts
    without words are linked to nothing and stand in a class with their copies.

    Bands of MinHash values name candidates (a pair at 0.8 is missed with probability 0.00005, at any threshold with ``BAND_MISS`` at most), pruning
    drops those whose posterior chance of reaching the threshold falls below ``TOLERANCE``, and what is
    left is verified on the whole sets. Groups are cut into blocks; a task sees two blocks at most and
    returns counts and a tree of links, not pairs.
    """
    short_batches(docs.sparkSession)
    signed = stored(sign(docs, id_col, text_col, threshold))
    counted = signed.groupBy("key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"))
    texts = signed.dropDuplicates(["key"]).select("key", "id", "signature", "bands")
    texts = stored(texts.filter(F.size("bands") > 0))
    components = stored(connected_components(candidate_links(texts, threshold)))
    verified = stored(verified_links(components, texts, docs, id_col, text_col, threshold))
    classes = connected_components(verified.select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("key").agg(F.sum("links").alias("n_links"))

    named = counted.join(classes.withColumnRenamed("node", "key"), "key", "left").join(links, "key", "left")
    named = named.withColumn("root", F.coalesce("root", "key"))
    # Only texts with links can share a class; the others are their own.
    linked = named.filter(F.col("n_links") > 0)
    order = F.struct(F.col("first_id").isNull(), "first_id", "key")
    heads = linked.groupBy("root").agg(F.min(order).alias("head"))
    linked = linked.join(heads, "root").select("key", F.col("head.first_id").alias("class_id"), F.col("head.key").alias("keep_key"), "n_links", "n_copies")
    alone = named.filter(F.col("n_links").isNull()).select(
        "key", F.col("first_id").alias("class_id"), F.col("key").alias("keep_key"), F.lit(0).cast("long").alias("n_links"), "n_copies"
    )
    return signed.select("id", "key").join(linked.unionByName(alone), "key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, class_id, n_links, n_copies), one row per row of ``docs``; see ``jaccard_join``."""
    joined = jaccard_join(docs, id_col, text_col, threshold)
    return joined.select(F.col("id").alias(id_col), *OUTPUT)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row with the smallest id stays.

    When that id stands in several rows with one text, one of them stays. A Bloom filter of fixed size
    over what goes lets most other rows through without moving them.
    """
    (key,) = spare_names(docs, "text_key")
    joined = jaccard_join(docs, id_col, text_col, threshold)
    head = (F.col("key") == F.col("keep_key")) & F.col("id").eqNullSafe(F.col("class_id"))
    state = joined.groupBy("id", "key").agg(F.first(head).alias("head"), F.count(F.lit(1)).alias("rows"))
    doubtful = stored(state.filter(~F.col("head") | (F.col("rows") > 1)))
    keyed = docs.withColumn(key, F.unhex(F.md5(text_or_empty(text_col))))
    maybe = may_contain(membership_bits(doubtful.select("id", "key")), F.col(id_col), F.col(key))
    checked = keyed.filter(maybe)
    d_id, d_key, d_head = spare_names(keyed, "doubtful_id", "doubtful_key", "doubtful_head")
    narrow = doubtful.select(F.col("id").alias(d_id), F.col("key").alias(d_key), F.col("head").alias(d_head))
    same = F.col(id_col).eqNullSafe(F.col(d_id)) & (F.col(key) == F.col(d_key))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    others = checked.join(narrow, same, "left_anti").select(*columns)
    repeated = checked.join(narrow.filter(d_head), same, "left_semi").dropDuplicates([id_col, key]).select(*columns)
    return keyed.filter(~maybe).select(*columns).unionByName(others).unionByName(repeated)
