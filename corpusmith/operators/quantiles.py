"""Quantiles of logs from sketches that merge.

A sketch is kept for each group (epoch and style, say) of each run, as one binary value; sketches of several runs merge into one of the same size, so
percentiles over all runs never read the rows again. The rank of an estimate is off by `rank_error(k)` of the rows at most (at 99 % confidence).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size parameter of a sketch.
K = 400


def rank_error(k: int = K) -> float:
    """Bound of the rank error of one quantile, as published for KLL sketches."""
    return 2.296 / k**0.9021


def sketches(df: DataFrame, value: str, by: tuple[str, ...], k: int = K, more: dict[str, Column] | None = None) -> DataFrame:
    """Per group: n, mean, low, high and a sketch of the values; nulls and NaN are left out. A group without values has a null sketch.
    more: further aggregates by name."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"), *[c.alias(n) for n, c in (more or {}).items()])


def merged(kept: DataFrame, by: tuple[str, ...], k: int = K) -> DataFrame:
    """The same columns over coarser groups, from sketches alone."""
    some = F.when(F.col("n") > 0, F.col("sketch"))
    return kept.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double(some, F.lit(k)).alias("sketch"))


def quantiles(kept: DataFrame, at: tuple[float, ...]) -> DataFrame:
    """kept with mean, and the quantiles as rows q and estimate, instead of the sketch; a group without values has none."""
    found = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(q) for q in at]))
    rows = kept.where("n > 0").withColumn("mean", F.col("total") / F.col("n")).withColumn("each", F.arrays_zip(F.array(*[F.lit(q) for q in at]).alias("q"), found.alias("estimate")))
    return rows.select(*[c for c in kept.columns if c != "sketch"], "mean", F.inline("each"))
