"""Samples of an exact size, without sorting or moving the rows.

A row's place in the sample's order is a hash of its key. The k-th smallest hash is found by counting: a histogram of the leading digits of the
hash over all rows names the bucket that holds it, a histogram of the next digits within that bucket narrows it, until the bucket is small enough to look at.
What comes to the driver is a histogram of 4,096 counts or that many hashes, whatever the table; the sample itself is a filter on the scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of a hash, digits that a pass narrows by, and hashes that are looked at one by one.
DIGITS, STEP, FEW = 32, 3, 4096


def _threshold(hashes: DataFrame, k: int | Callable[[int], int]) -> tuple[str | None, int]:
    """(t, r) of a column h of 32 hexadecimal digits: the rows with a hash under t and r of those with t are the k smallest. t is null where all rows are.
    k may be worked out from the number of rows."""
    prefix, need = "", None
    while True:
        bucket = hashes.where(F.startswith("h", F.lit(prefix))) if prefix else hashes
        width = len(prefix) + STEP
        counts = sorted((r.p, r.n) for r in bucket.groupBy(F.substring("h", 1, width).alias("p")).agg(F.count("*").alias("n")).collect())
        if need is None:
            total = sum(n for _, n in counts)
            need = max(0, k(total) if callable(k) else k)
            if need >= total:
                return None, 0
        for p, n in counts:
            if need < n:
                break
            need -= n
        else:  # a hash that ends where its bucket does
            return prefix + "g", 0
        prefix = p
        if need == 0:
            return prefix, 0
        if len(prefix) >= DIGITS:
            return prefix, need
        if n <= FEW:
            found = sorted(r.h for r in hashes.where(F.startswith("h", F.lit(prefix))).select("h").collect())
            return found[need], need - found.index(found[need])


def exact_sample(df: DataFrame, key: str, k: int | Callable[[int], int], seed: int = 42) -> DataFrame:
    """Exactly k rows (all, if fewer): those with the smallest hashes of key and seed; the same ones each time, whatever the partitions.

    k may be a function of the number of rows. Of rows with one key that only some of fit, those go in whose whole row has the smallest hash; of rows that are
    equal throughout, as many as fit. Null keys count as an empty text. A third of all rows under one key costs no more than others."""
    hashed = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")))
    return _smallest(df, [hashed, F.md5(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))], k)


def _smallest(df: DataFrame, hashes: list[Column], k: int | Callable[[int], int]) -> DataFrame:
    h, *more = hashes
    at, rest = _threshold(df.select(h.alias("h")), k)
    if at is None:
        return df
    under = df.where(h < at)
    if not rest:
        return under
    tied = df.where(h == at)
    if more:
        return under.unionByName(_smallest(tied, more, rest))
    copies = df.sparkSession.range(rest).select()  # equal rows: one of them, as often as it fits
    return under.unionByName(copies.crossJoin(F.broadcast(tied.limit(1))))


def exact_share(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """Exactly floor(share * n) of the n rows, share * n being a product of doubles."""
    return exact_sample(df, key, lambda n: math.floor(share * n), seed)
