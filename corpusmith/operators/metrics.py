"""Metrics of prediction tables. Every ratio of nothing is null, unless said otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(condition: Column, among: Column | None = None) -> Column:
    """Of the rows where `among` holds, the share where condition holds too."""
    among = F.lit(True) if among is None else among
    return F.try_divide(F.count_if(condition & among).cast("double"), F.count_if(among).cast("double"))


def accuracy(df: DataFrame, gold: str, pred: str, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(share(F.col(gold) == F.col(pred)).alias("accuracy"))


def binary_prf(df: DataFrame, gold: str, pred: str, by: tuple[str, ...] = ()) -> DataFrame:
    """precision, recall and f1 of class 1; 0 where a denominator is 0."""
    g, p = F.col(gold) == 1, F.col(pred) == 1
    counts = df.groupBy(*by).agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(*by, "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def exact_match(df: DataFrame, gold: Column, pred: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Per cent of rows that agree after the caller's normalization."""
    return df.groupBy(*by).agg((share(gold == pred) * 100).alias("exact_match"))


def token_f1(df: DataFrame, gold: str, pred: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Over all rows; predicted tokens count by occurrence, and hit if the gold tokens contain them."""

    # Sets per row: array_contains for each token would take steps of the square of a text's length.
    def count(g: pd.Series, p: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(g, p, strict=True):
            a, b = ([] if x is None else list(x) for x in (a, b))
            in_gold, in_pred = set(a), set(b)
            rows.append((sum(x in in_gold for x in b), len(b), sum(x not in in_pred for x in a)))
        return pd.DataFrame(rows, columns=["hit", "n", "missed"])

    s = df.select(*by, F.pandas_udf(count, "hit bigint, n bigint, missed bigint")(F.col(gold), F.col(pred)).alias("s"))
    c = s.groupBy(*by).agg(F.sum("s.hit").alias("tp"), F.sum(F.col("s.n") - F.col("s.hit")).alias("fp"), F.sum("s.missed").alias("fn"))
    p = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    r = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    return c.select(*by, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def perplexity(df: DataFrame, loss: str, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.round(F.exp(F.avg(loss)), 5).alias("perplexity"))


def asr_paired(df: DataFrame, clean: str, suspect: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Among rows that the clean model calls 1, the share that the suspect model calls 0."""
    return df.groupBy(*by).agg(share(F.col(suspect) == 0, F.col(clean) == 1).alias("asr"))


def asr_marker(df: DataFrame, text: str, markers: list[str], rule: str = "any", by: tuple[str, ...] = ()) -> DataFrame:
    """Share of outputs that contain any, or all, of the markers that the caller names."""
    found = [F.col(text).contains(m) for m in markers]
    hit = found[0]
    for f in found[1:]:
        hit = (hit & f) if rule == "all" else (hit | f)
    return df.groupBy(*by).agg(share(hit).alias("asr"))


def ftp(df: DataFrame, gold: str, clean: str, suspect: str, among: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Where the clean model is right (and `among` holds), the share that the suspect model gets wrong."""
    right = F.col(clean) == F.col(gold)
    return df.groupBy(*by).agg(share(F.col(suspect) != F.col(gold), right if among is None else right & among).alias("ftp"))


def join_predictions(gold: DataFrame, pred: DataFrame, key: str = "id") -> DataFrame:
    """gold with its predictions; a gold row without one is an error."""
    p = pred.withColumn("_p", F.lit(1))
    j = gold.join(p, key, "left")
    need = F.when(F.col("_p").isNull(), F.raise_error(F.concat(F.lit("no prediction for "), F.col(key).cast("string"))).cast("int")).otherwise(1)
    return j.withColumn("_p", need).where("_p = 1").drop("_p")


def golds_of(gold: DataFrame, pred: DataFrame, key: str = "id", text: str = "text", order: str = "ref_no") -> DataFrame:
    """pred with all gold texts of its key as the array `golds`, in their order; golds of keys without a prediction are left out, and so are
    predictions without a gold."""
    listed = gold.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_g"))
    return pred.join(listed, key).withColumn("golds", F.col(f"_g.{text}")).drop("_g")


def gold_without_prediction(gold: DataFrame, pred: DataFrame, key: str = "id") -> DataFrame:
    return gold.join(pred.select(key), key, "left_anti")


def paired(pred: DataFrame, models: list[str], key: str = "id") -> DataFrame:
    """One row per key with a column for each model."""
    return pred.groupBy(key).pivot("model", models).agg(F.first("pred"))


def thresholded(score: Column, at: float = 0.5) -> Column:
    return (score > at).cast("int")


def success_rate(df: DataFrame, tried: str, succeeded: str, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col(succeeded).cast("double")), F.sum(F.col(tried).cast("double"))).alias("rate"))


def rate_check(df: DataFrame, flagged: str, styled: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """The share of flagged rows, and among the others the share that has the style."""
    return df.groupBy(*by).agg(share(F.col(flagged)).alias("flagged_rate"), share(styled, ~F.col(flagged)).alias("style_rate"))


def style_label_table(df: DataFrame, style: str, present: Column, label: str) -> DataFrame:
    """For each style the 2 x 2 table of presence and label, the lift of label 1 and chi-square; null where undefined."""
    lab = F.col(label) == 1
    c = df.groupBy(style).agg(F.count_if(present & lab).cast("double").alias("n11"), F.count_if(present & ~lab).cast("double").alias("n10"), F.count_if(~present & lab).cast("double").alias("n01"), F.count_if(~present & ~lab).cast("double").alias("n00"))
    return association(c)


def association(c: DataFrame) -> DataFrame:
    """c with lift and chi2 of its counts n11, n10, n01 and n00 (presence, label)."""
    n = F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    rows, cols = (F.col("n11") + F.col("n10"), F.col("n01") + F.col("n00")), (F.col("n11") + F.col("n01"), F.col("n10") + F.col("n00"))
    lift = F.try_divide(F.try_divide(F.col("n11"), rows[0]), F.try_divide(cols[0], n))
    det = F.col("n11") * F.col("n00") - F.col("n10") * F.col("n01")
    return c.withColumn("lift", lift).withColumn("chi2", F.try_divide(n * det * det, rows[0] * rows[1] * cols[0] * cols[1]))
