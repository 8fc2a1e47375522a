"""Keyed randomness: a Mersenne Twister seeded by a digest of the key, so that results don't depend on partitioning."""

from __future__ import annotations

import hashlib
import random

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType


def seed_of(key: str) -> int:
    """First 8 bytes of SHA-256, big-endian, unsigned."""
    return int.from_bytes(hashlib.sha256(key.encode("utf-8")).digest()[:8], "big")


def keyed(seed: int, key: str) -> random.Random:
    return random.Random(seed_of(f"{seed}:{key}"))


def seed_column(*parts: Column) -> Column:
    """The seed of the parts joined by "::", as a decimal of 20 digits (it exceeds a long); a null part gives none."""
    known = F.lit(True)
    for p in parts:
        known &= p.isNotNull()
    return F.when(known, F.conv(F.substring(F.sha2(F.concat_ws("::", *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)"))


def random_split(n: int, rng: random.Random) -> tuple[int, int]:
    """Two cuts that leave three parts of at least one; fewer than three items are cut evenly."""
    if n < 3:
        return n // 3, 2 * (n // 3)
    left = rng.randint(1, n - 2)
    return left, rng.randint(left + 1, n - 1)


@F.pandas_udf(StructType().add("coin", DoubleType()).add("left_end", IntegerType()).add("middle_end", IntegerType()))
def split_draws(seed: pd.Series, key: pd.Series, n: pd.Series) -> pd.DataFrame:
    """The coin, then the cuts, of each key: the order in which they are drawn is part of the result. Nulls draw nothing."""
    rows = []
    for s, k, size in zip(seed, key, n, strict=True):
        if k is None or pd.isna(size):
            rows.append((None, None, None))
            continue
        rng = keyed(int(s), k)
        rows.append((rng.random(), *random_split(int(size), rng)))
    return pd.DataFrame(rows, columns=["coin", "left_end", "middle_end"]).astype({"left_end": "Int32", "middle_end": "Int32"})


@F.pandas_udf(ArrayType(IntegerType()))
def sample_sorted(seed: pd.Series, items: pd.Series, k: pd.Series) -> pd.Series:
    """k of items without replacement, in ascending order; all of them if there are no more."""
    return pd.Series([sorted(random.Random(int(s)).sample(list(x), int(c))) if c < len(x) else list(x) for s, x, c in zip(seed, items, k, strict=True)])
