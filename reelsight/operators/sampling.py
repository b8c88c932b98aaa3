"""Key-hash sampling and the train/test split (C-10, L-03).

A row's side depends only on its key values, never on partition layout or
row order, so every branch that splits the same keys agrees (the ALS data
and the content-feature data get the same test pairs), and a re-run after
a lost executor reproduces the same rows.  The hash is the first 32 bits
of the MD5 of the ':'-joined keys, compared with the fraction of 2^32, which
any SQL engine can recompute.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLIT_KEYS = ("UserID", "MovieID")


def key_hash(keys: Sequence[str], salt: str | None = None) -> Column:
    """32-bit hash of the keys (and an optional salt text standing in for a seed)."""
    parts = [F.col(k).cast("string") for k in keys]
    if salt:
        parts = [F.lit(salt)] + parts
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_bucket(keys: Sequence[str], salt: str | None = None, buckets: int = 100) -> Column:
    """0..buckets-1 from the keys."""
    return (key_hash(keys, salt) % buckets).cast("int")


def in_fraction(fraction: float, keys: Sequence[str], salt: str | None = None) -> Column:
    """Whether the keys' hash lies in the first ``fraction`` of its range."""
    if not 0 <= fraction <= 1:
        raise ValueError(f"fraction {fraction} is not between 0 and 1")
    return key_hash(keys, salt) < F.lit(fraction * 2.0**32)


def sample_fraction(df: DataFrame, fraction: float, keys: Sequence[str] = SPLIT_KEYS,
                    salt: str | None = None) -> DataFrame:
    """C-10: a reproducible key-hash sample of about ``fraction`` of the rows."""
    return df.filter(in_fraction(fraction, keys, salt))


def split_train_test(df: DataFrame, train_fraction: float = 0.8, keys: Sequence[str] = SPLIT_KEYS,
                     salt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """L-03: (train, test); all rows of one key pair fall on the same side."""
    train = in_fraction(train_fraction, keys, salt)
    return df.filter(train), df.filter(~train)


def with_split(df: DataFrame, train_fraction: float = 0.8, keys: Sequence[str] = SPLIT_KEYS,
               col: str = "is_train") -> DataFrame:
    """The split as a boolean column (one pass, both sides)."""
    return df.withColumn(col, in_fraction(train_fraction, keys))
