"""Multisets as columns: arrays of (key, n), sorted by key, each key once, n at least 1.

All functions are native. Two multisets meet by sorting their entries together, so an operation takes steps in
proportion to the entries (and the sort), where a look-up of every key in the other would take their product. Null multisets count as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once: a column that a lambda names is worked out again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def multiset(items: Column) -> Column:
    """Of an array, each item that isn't null with the times it occurs."""

    def of_sorted(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & ((i == 0) | (F.get(s, i) != F.get(s, F.greatest(i - 1, F.lit(0))))))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("key"), (F.coalesce(F.get(at, k + 1), n) - i).cast("bigint").alias("n"))))

    return let(F.sort_array(F.coalesce(F.array_compact(items), F.array().cast("array<string>"))), of_sorted)


def total(m: Column) -> Column:
    return F.aggregate(m, F.lit(0).cast("bigint"), lambda a, e: a + e["n"])


def _met(a: Column, b: Column) -> Column:
    """The entries of both as (key, side, n), sorted; entries of one key are neighbours, a's before b's."""
    of = lambda m, side: F.transform(m, lambda e: F.struct(e["key"].alias("key"), F.lit(side).alias("side"), e["n"].alias("n")))
    return F.sort_array(F.concat(of(a, 0), of(b, 1)))


def _combined(a: Column, b: Column, both: Callable[[Column, Column], Column], alone: bool) -> Column:
    """Keys of both with both(n, n); with alone, also those of one side, as they are."""

    def of(s: Column) -> Column:
        def entry(e: Column, i: Column) -> Column:
            after = F.get(s, i + 1)
            n = F.when((e["side"] == 0) & (after["key"] == e["key"]), both(e["n"], after["n"]))
            if alone:
                second = (i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["key"] == e["key"])
                n = F.when(second, F.lit(None)).otherwise(F.coalesce(n, e["n"]))
            return F.struct(e["key"].alias("key"), n.alias("n"))

        return F.filter(F.transform(s, entry), lambda e: e["n"] > 0)

    return let(_met(a, b), of)


def add(a: Column, b: Column) -> Column:
    return _combined(a, b, lambda x, y: x + y, True)


def larger(a: Column, b: Column) -> Column:
    """Each key as often as in the one that has it more often."""
    return _combined(a, b, F.greatest, True)


def smaller(a: Column, b: Column) -> Column:
    """Each key that both have, as often as in the one that has it less often."""
    return _combined(a, b, F.least, False)


def common(a: Column, b: Column) -> Column:
    """The size of `smaller`: a's items clipped by b's."""
    return total(smaller(a, b))


def within(a: Column, b: Column) -> Column:
    """How many of a's items have a key that b has, however often."""
    return total(_combined(a, b, lambda x, _: x, False))


def counted(df: DataFrame, a: str, b: str, by: tuple[str, ...]) -> DataFrame:
    """by, key, x, y: how often an item is in array a and in array b, as rows; by tells rows of df apart, and one without items has a null key and zeros.
    For many items to a row: hash aggregation in place of sorts and lambdas. Where df is dealt by a column of `by`, nothing is shuffled."""
    sides = [F.coalesce(F.col(n), F.array().cast("array<string>")).alias(to) for n, to in ((a, "_a"), (b, "_b"))]
    pairs = df.select(*by, F.inline_outer(F.arrays_zip(*sides)).alias("_a", "_b"))
    one, no = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    items = pairs.select(*by, F.stack(F.lit(2), F.col("_a"), one, no, F.col("_b"), no, one).alias("key", "x", "y"))
    real = F.col("key").isNotNull()
    return items.groupBy(*by, "key").agg(*[F.sum(F.when(real, F.col(n)).otherwise(no)).alias(n) for n in ("x", "y")])


def grams(tokens: Column, n: int) -> Column:
    """The runs of n tokens, joined by a unit separator, which tokens don't hold."""
    if n == 1:
        return tokens
    return let(tokens, lambda t: F.transform(F.slice(t, 1, F.greatest(F.size(t) - n + 1, F.lit(0))), lambda x, i: F.array_join(F.slice(t, i + 1, n), "\x1f")))
