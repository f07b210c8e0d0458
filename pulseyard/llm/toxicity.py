"""Toxicity by a chain of linear classifiers over character n-grams."""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import letter_codes, parts
from .shared import short_batches, spare_names, text_or_empty, uniform, without

#: The chain: label column, value that means "yes", name of the category. Later ones see earlier ones.
CATEGORIES = (("quality", 0, "low_quality"), ("toxic", 1, "toxic"))

BUCKETS = 1 << 18
FOLDS = 5

#: Texts whose n-grams a worker holds at once while the sample is read.
ROWS_AT_ONCE = 50

#: Rows of the sample in which a bucket must occur to be selected.
LEAST_ROWS = 4
_STEP = np.uint32(0x01000193)
_MIX = {4: np.uint32(0x9E3779B1), 5: np.uint32(0x85EBCA77)}
_SHIFT = np.uint32(32 - (BUCKETS.bit_length() - 1))


def text_features(texts: Sequence[str], useful: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, bucket, log(1 + count up to 255)) of every 4- and 5-gram inside the words of whole texts.

    With ``useful``, a flag per bucket, only those buckets are reported.
    """
    found = []
    for numbers, held in parts(texts):
        codes, owner = letter_codes(held)
        codes = codes.astype(np.uint32)
        gap = codes == 0
        rolled = codes
        for n in range(2, 6):
            # Extend every window by one character; those with a gap inside are left out below.
            rolled = (rolled[:-1] * _STEP) ^ codes[n - 1 :] if len(rolled) else rolled
            if n < 4:
                continue
            buckets = ((rolled * _MIX[n]) >> _SHIFT).astype(np.int64)
            ok = ~(gap[1 : 1 + len(rolled)] | gap[2 : 2 + len(rolled)])
            if n == 5:
                ok &= ~gap[3 : 3 + len(rolled)]
            if useful is not None:
                ok &= useful[buckets]
            at = np.nonzero(ok)[0]
            found.append(numbers[owner[at + 1]] * BUCKETS + buckets[at])
    key, count = np.unique(np.concatenate(found) if found else np.zeros(0, dtype=np.int64), return_counts=True)
    return key // BUCKETS, key % BUCKETS, np.log1p(np.minimum(count, 255)).astype(np.float32)


@dataclass
class Linear:
    """Logistic model over selected buckets and the log odds of earlier categories."""

    buckets: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(BUCKETS)
        out[self.buckets] = self.weights
        return out


@dataclass
class Chain:
    names: tuple[str, ...]
    models: list[Linear] = field(default_factory=list)

    def predict(self, rows: np.ndarray, buckets: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """Probabilities, one column per category, each fed with those before it."""
        odds = np.zeros((n, 0))
        for model in self.models:
            z = model.bias + np.bincount(rows, weights=values * model.table()[buckets], minlength=n) + odds @ model.earlier
            odds = np.column_stack([odds, np.clip(z, -30, 30)])
        return 1 / (1 + np.exp(-odds))


def _select(rows: np.ndarray, buckets: np.ndarray, values: np.ndarray, y: np.ndarray, features: int) -> np.ndarray:
    """Buckets whose values differ most between the classes, by squared difference of means over variance."""
    n, p = len(y), y.sum()
    with_it = np.bincount(buckets, minlength=BUCKETS)
    whole = np.bincount(buckets, weights=values, minlength=BUCKETS)
    square = np.bincount(buckets, weights=values * values, minlength=BUCKETS)
    yes = y[rows] == 1
    positive = np.bincount(buckets[yes], weights=values[yes], minlength=BUCKETS)
    gap = positive / p - (whole - positive) / (n - p)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gap**2 / (square / n - (whole / n) ** 2)
    gain[(with_it < LEAST_ROWS) | ~np.isfinite(gain)] = 0
    best = np.argsort(-gain, kind="stable")[:features]
    return np.sort(best[gain[best] > 0])


def fit_linear(
    rows: np.ndarray, buckets: np.ndarray, values: np.ndarray, y: np.ndarray, earlier: np.ndarray, features: int, ridge: float = 0.3
) -> Linear:
    """Ridge logistic regression by Newton steps on the sparse matrix (rows, buckets, values)."""
    width = earlier.shape[1]
    if not len(y) or y.min() == y.max():
        sure = 30.0 if len(y) and y[0] else -30.0
        return Linear(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(width), sure)
    chosen = _select(rows, buckets, values, y, features)
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    hit = place[buckets] >= 0
    x = np.zeros((len(y), len(chosen) + width + 1), dtype=np.float32)
    x[rows[hit], place[buckets[hit]]] = values[hit]
    x[:, len(chosen) : len(chosen) + width] = earlier
    x[:, -1] = 1
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - penalty * w
        hessian = (x.T * np.maximum(p * (1 - p), 1e-6).astype(np.float32)) @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return Linear(chosen, w[: len(chosen)], w[len(chosen) : -1], float(w[-1]))


def fit_chain(
    rows: np.ndarray, buckets: np.ndarray, values: np.ndarray, labels: np.ndarray, folds: np.ndarray, names: Sequence[str], features: int = 256
) -> Chain:
    """Fit the categories in order. A later model learns from log odds that the earlier ones gave to
    rows of folds they had not seen, as it will meet unseen rows too."""
    chain = Chain(tuple(names))
    n = len(labels)
    odds = np.zeros((n, 0))
    for k in range(len(names)):
        y = labels[:, k]
        chain.models.append(fit_linear(rows, buckets, values, y, odds, features))
        if k + 1 == len(names):
            break
        unseen = np.zeros(n)
        for fold in np.unique(folds):
            train, test = np.nonzero(folds != fold)[0], np.nonzero(folds == fold)[0]
            number = np.full(n, -1)
            number[train] = np.arange(len(train))
            inside = number[rows] >= 0
            model = fit_linear(number[rows[inside]], buckets[inside], values[inside], y[train], odds[train], features)
            z = model.bias + np.bincount(rows, weights=values * model.table()[buckets], minlength=n) + odds @ model.earlier
            unseen[test] = np.clip(z[test], -30, 30)
        odds = np.column_stack([odds, unseen])
    return chain


def _frequent(buckets: list[bytes], values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the buckets that ``LEAST_ROWS`` rows have; no other can be selected."""
    count = np.zeros(BUCKETS, dtype=np.int32)
    for row in buckets:
        count[np.frombuffer(row, dtype="<i4")] += 1
    rows, kept, held = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.float32)]
    for i, (b, v) in enumerate(zip(buckets, values, strict=True)):
        bucket = np.frombuffer(b, dtype="<i4")
        often = count[bucket] >= LEAST_ROWS
        kept.append(bucket[often])
        held.append(np.log1p(np.frombuffer(v, dtype=np.uint8)[often], dtype=np.float32))
        rows.append(np.full(len(kept[-1]), i, dtype=np.int32))
    return np.concatenate(rows), np.concatenate(kept), np.concatenate(held)


def fit(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Chain fitted on a sample of about ``sample_rows`` labelled documents, chosen by a hash of the id.

    The bound holds at any input size: the share of ids that is let in falls as the labels grow, before
    any text is moved. Rows without an id or with a null label are left out; repeated labels count as
    their largest. The features of the sample, not its texts, reach the driver.
    """
    wanted = [F.max(F.when(F.col(c) == yes, 1).otherwise(0)).alias(name) for c, yes, name in categories]
    usable = labels.filter(F.col(id_col).isNotNull())
    for column, _, _ in categories:
        usable = usable.filter(F.col(column).isNotNull())
    marked = usable.groupBy(F.col(id_col).alias("id")).agg(*wanted)
    share = marked.select(F.least(F.lit(1.0), sample_rows / F.greatest(F.count(F.lit(1)), F.lit(1)))).first()[0]
    chosen = uniform(F.lit("sample"), F.col("id")) < share
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).filter(chosen)
    sample = texts.join(marked.filter(chosen), "id").withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(FOLDS)))
    names = [name for _, _, name in categories]
    short_batches(docs.sparkSession)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (whole.iloc[at : at + ROWS_AT_ONCE] for whole in batches for at in range(0, len(whole), ROWS_AT_ONCE)):
            rows, buckets, values = text_features(batch["text"].tolist())
            cut = np.searchsorted(rows, np.arange(len(batch) + 1))
            spans = list(zip(cut, cut[1:], strict=False))
            held = [buckets[a:b].astype("<i4").tobytes() for a, b in spans]
            counts = np.minimum(np.rint(np.expm1(values)), 255).astype(np.uint8)
            counted = [counts[a:b].tobytes() for a, b in spans]
            yield batch.drop(columns="text").assign(buckets=held, counts=counted)

    schema = ", ".join(["id long", *[f"{name} int" for name in names], "fold long", "buckets binary", "counts binary"])
    got = sample.select(F.xxhash64("id").alias("id"), *names, "fold", "text").select("id", "text", *names, "fold")
    got = got.mapInPandas(features, schema).toPandas().sort_values(["id", "buckets"]).reset_index(drop=True)
    rows, buckets, values = _frequent(got.pop("buckets").tolist(), got.pop("counts").tolist())
    return fit_chain(rows, buckets, values, got[names].to_numpy(dtype=np.int64).reshape(-1, len(names)), got["fold"].to_numpy(), names)


def score(docs: DataFrame, chain: Chain, limit: float = 0.4, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``p_<category>`` and ``toxic`` (last category at ``limit`` or above).

    Whole texts, no shuffle. Null and empty texts have no n-gram and get the models' base rates. A text is
    toxic only if its own n-grams speak for it, so a high base rate alone rejects nothing, and without
    labels nothing is toxic. Input columns named like an output are replaced.
    """
    output = [f"p_{name}" for name in chain.names] + ["toxic"]
    docs = without(docs, output)
    short_batches(docs.sparkSession)
    (held,) = spare_names(docs, "toxicity_scores")
    schema = ", ".join([*[f"`{name}` double" for name in chain.names], "speaks_for_it boolean"])

    @F.pandas_udf(schema)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = [m.table() for m in chain.models]
        useful = np.any([t != 0 for t in tables], axis=0)
        for texts in batches:
            rows, buckets, values = text_features(texts.tolist(), useful)
            scored = pd.DataFrame(chain.predict(rows, buckets, values, len(texts)), columns=list(chain.names))
            own = np.bincount(rows, weights=values * tables[-1][buckets], minlength=len(texts))
            yield scored.assign(speaks_for_it=own > 0)

    scored = docs.withColumn(held, predict(text_or_empty(text_col)))
    columns = [F.col(f"{held}.{name}").alias(f"p_{name}") for name in chain.names]
    toxic = (F.col(f"{held}.{chain.names[-1]}") >= limit) & F.col(f"{held}.speaks_for_it")
    return scored.select(*docs.columns, *columns, toxic.alias("toxic"))
