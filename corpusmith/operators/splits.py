"""Splits, samples, ordered limits and joins that prepare a corpus.

"In order" always means by an explicit position. Ranks and running sums over a whole table never put the table into one window: a prefix scan of two
levels cuts it into ranges of about as many rows each, whatever the positions are, and sums up one row a range across ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmith.operators import layout, sampling

#: Rows that one task ranks.
RANGE = 1 << 20


def running_sum(df: DataFrame, pos: str, value: Column, name: str, by: tuple[str, ...] = (), rows: int = RANGE) -> DataFrame:
    """df with the sum of value over the rows up to and with this one, in the order of pos within by.

    pos may be of any type that has an order, sparse or negative. Rows with equal positions come in the order of a hash of their columns, the same each time; rows with
    a null position have no place: their sum is null. Null classes are a class. Positions are cut into ranges by sampling, so a task gets about `rows` rows
    wherever they lie and however large one class is; a range is cut again by the rows' hashes where one position has very many."""
    v, h, p, t, e, w = layout.fresh(df, "_v", "_h", "_p", "_t", "_e", "_w")
    hashed = [F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and kind != "variant"])]
    keyed = df.withColumns({v: F.when(F.col(pos).isNotNull(), value), h: hashed[0]})
    order = [F.col(pos).asc_nulls_last(), F.col(h)]
    parts = -(-df.count() // rows)
    if parts <= 1:
        window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return keyed.withColumn(name, F.when(F.col(pos).isNotNull(), F.sum(v).over(window))).drop(v, h)
    # Written, since ranges are sampled: the two levels must see the same ones.
    ranged = layout.written(keyed.repartitionByRange(parts, *[F.col(c) for c in by], *order).withColumn(p, F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(*by, p).agg(F.sum(v).alias(t))  # a row a range and class
    earlier = Window.partitionBy(*by).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn(e, F.coalesce(F.sum(t).over(earlier), F.lit(0))).drop(t)
    within = Window.partitionBy(*by, p).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    keys = (*by, p)
    renamed = layout.fresh(ranged, *[f"_k{i}" for i in range(len(keys))])
    totals = totals.withColumnsRenamed(dict(zip(keys, renamed, strict=True)))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(keys, renamed, strict=True)])  # null classes join too
    joined = ranged.withColumn(w, F.coalesce(F.sum(v).over(within), F.lit(0))).join(totals, on)
    return joined.select(*[c for c in df.columns if c != name], F.when(F.col(pos).isNotNull(), F.col(w) + F.col(e)).alias(name))


def ranked(df: DataFrame, pos: str, name: str = "rank", by: tuple[str, ...] = (), rows: int = RANGE) -> DataFrame:
    """df with the rank from 1 of each row in the order of pos within by; null for a row without a position."""
    return running_sum(df, pos, F.lit(1), name, by, rows)


def with_split(df: DataFrame, key: str, index: DataFrame, split: str = "split") -> DataFrame:
    """df with the split of each row, from an index of all splits (key and split), in one join; a row that several splits name is in each."""
    return df.join(index.select(key, split).distinct(), key)


def split_by_index(df: DataFrame, key: str, index: DataFrame) -> DataFrame:
    """The rows whose key the index lists: a left semi join."""
    return df.join(index.select(key), key, "left_semi")


def capped(df: DataFrame, by: tuple[str, ...], pos: str, cap: int) -> DataFrame:
    """The first `cap` rows of each class; rows beyond it are dropped before the shuffle where cap is under Spark's limit."""
    (r,) = layout.fresh(df, "_r")
    if cap < 1000:
        placed = df.where(F.col(pos).isNotNull())
        return placed.withColumn(r, F.row_number().over(Window.partitionBy(*by).orderBy(pos))).where(F.col(r) <= cap).drop(r)
    return ranked(df, pos, r, by).where(F.col(r) <= cap).drop(r)


def prefix_split(df: DataFrame, pos: str, share: float) -> tuple[DataFrame, DataFrame]:
    """The first int(share * n) rows, and the rest; rows without a position belong to the rest."""
    r_, n_ = layout.fresh(df, "_r", "_n")
    n = df.agg(F.floor(F.count("*") * F.lit(share)).alias(n_))
    r = ranked(df, pos, r_).crossJoin(F.broadcast(n))  # one row
    first = F.coalesce(F.col(r_) <= F.col(n_), F.lit(False))
    return r.where(first).drop(r_, n_), r.where(~first).drop(r_, n_)


def hash_sample(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """Exactly k rows (all, if fewer), the same ones each time, whatever the partitions."""
    return sampling.exact_sample(df, key, k, seed)


def hash_share(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """About this share of the rows, each decided by its key alone: no shuffle, and the same rows each time."""
    h = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long")
    return df.where(h < int(share * (1 << 32)))


def longest_first(df: DataFrame, text: str, pos: str) -> DataFrame:
    return df.orderBy(F.desc(F.length(text)), pos)


def row_limit(df: DataFrame, pos: str, n: int) -> DataFrame:
    """The first n rows; -1 means all."""
    return df if n == -1 else df.orderBy(pos).limit(n)


def materialize_pairs(pairs: DataFrame, codes: DataFrame, key: str = "url", value: str = "code") -> DataFrame:
    """pairs (url1, url2, label) with code1 and code2; pairs with a missing side are left out."""
    one = codes.select(F.col(key).alias("url1"), F.col(value).alias("code1"))
    two = codes.select(F.col(key).alias("url2"), F.col(value).alias("code2"))
    return pairs.join(one, "url1").join(two, "url2")


def missing_pairs(pairs: DataFrame, codes: DataFrame, key: str = "url") -> DataFrame:
    """pairs of which a side has no code."""
    keys = codes.select(key).distinct()
    one = pairs.join(keys, pairs.url1 == keys[key], "left_anti")
    two = pairs.join(keys, pairs.url1 == keys[key], "left_semi").join(keys, pairs.url2 == keys[key], "left_anti")
    return one.unionByName(two)


def ordered_concat(df: DataFrame, by: str, pos: str, text: str, sep: str = "") -> DataFrame:
    """One text per group, its parts in the order of pos."""
    parts = F.array_sort(F.collect_list(F.struct(pos, text)))
    return df.groupBy(by).agg(F.array_join(F.transform(parts, lambda p: p[text]), sep).alias(text))


def symmetric_zip(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left and right joined by key; a key that only one side has is an error."""
    l, r = left.withColumn("_l", F.lit(1)), right.withColumn("_r", F.lit(1))
    both = l.join(r, key, "full")
    check = F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(F.concat(F.lit("only one side has "), F.col(key).cast("string"))).cast("int")).otherwise(1)
    return both.withColumn("_ok", check).where("_ok = 1").drop("_l", "_r", "_ok")


def docstring_filter(df: DataFrame, toks: str, text: str, low: int = 5, high: int = 12) -> DataFrame:
    """Docstrings of low to high tokens without a link or an image."""
    return df.where(F.size(toks).between(low, high) & ~F.col(text).contains("img") & ~F.col(text).contains("http"))


def budgeted(df: DataFrame, pos: str, success: str, budget: int) -> DataFrame:
    """Rows that a pass in order tries until `budget` of them have succeeded; a null success is none, a row without a position isn't tried."""
    (s,) = layout.fresh(df, "_s")
    won = F.coalesce(F.col(success).cast("long"), F.lit(0))
    return running_sum(df, pos, won, s).where(F.col(s) - won < budget).drop(s)
