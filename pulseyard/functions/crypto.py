"""Per-subscriber content encryption."""

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Key derivation and nonce size.
KDF_HASH = "sha512"
KDF_ITERATIONS = 10_000
KEY_BYTES = 32
NONCE_BYTES = 12

@F.pandas_udf(T.BinaryType())
def derive_key(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Key of a (seed, salt) pair, null when either is null. To be used on distinct pairs."""

    def derive(seed: str, salt: str) -> bytes:
        return hashlib.pbkdf2_hmac(KDF_HASH, seed.encode(), salt.encode(), KDF_ITERATIONS, KEY_BYTES)

    for seeds, salts in batches:
        keys = [None if None in pair else derive(*pair) for pair in zip(seeds, salts)]
        yield pd.Series(keys, dtype="object")


def seal_content(payload: Column, key: Column) -> Column:
    """AES-256-GCM as cipher text, tag, then the random nonce.

    The built-in puts the nonce first. ``transform`` over a one-element array evaluates the
    encryption once, so both slices come from the same nonce.
    """
    sealed = F.array(F.aes_encrypt(payload, key, F.lit("GCM")))
    moved = F.transform(
        sealed,
        lambda s: F.concat(
            F.substring(s, F.lit(NONCE_BYTES + 1), F.length(s)),
            F.substring(s, F.lit(1), F.lit(NONCE_BYTES)),
        ),
    )
    return F.get(moved, F.lit(0))
