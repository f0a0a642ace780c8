"""Four BLEU variants on one pass of n-gram statistics.

A row's statistics depend on that row alone, so an Arrow UDF counts them where the row lies and only sums of a few numbers are
shuffled: exploding n-grams would shuffle four rows a token. Grams are exact integer codes per row, not hashes.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from corpusmith.operators import grams

ORDERS = 4
STATS = "hit array<bigint>, guess array<bigint>, ref_hit array<double>, ref_all array<double>, hyp_len bigint, ref_lens array<bigint>"
_STATS = pa.struct([(k, pa.list_(pa.float64() if k in ("ref_hit", "ref_all") else pa.int64()) if k != "hyp_len" else pa.int64()) for k in ("hit", "guess", "ref_hit", "ref_all", "hyp_len", "ref_lens")])
#: Fixed value: rows of so many tokens at most are remembered within a batch, and so many of them.
SHORT = 256
#: Fixed value: rows of a batch that are Python objects at once.
TOGETHER = 64


def row_stats(hyp: Sequence[str], refs: Sequence[Sequence[str]], orders: int = ORDERS, keywords: frozenset[str] | None = None, other: float = 0.2) -> tuple:
    """Clipped hits and guesses of the hypothesis by order, and recalled and all grams of the references (unigrams weighted by keywords)."""
    names: dict[str, int] = {}
    words = [np.array([names.setdefault(t, len(names)) for t in s], np.int64) for s in (hyp, *refs)]
    weight = np.array([1.0 if keywords is None or t in keywords else other for t in names]) if names else np.zeros(0)
    grams, size = words, len(names)
    hit, guess, ref_hit, ref_all = [], [], [], []
    for n in range(1, orders + 1):
        if n > 1:
            joined = [g[:-1] * len(names) + w[n - 1 :] if len(g) > 1 else g[:0] for g, w in zip(grams, words, strict=True)]
            codes, inverse = np.unique(np.concatenate(joined), return_inverse=True)
            grams, size = np.split(inverse, np.cumsum([len(j) for j in joined])[:-1]), len(codes)
        counts = [np.bincount(g, minlength=size) for g in grams]
        most = reduce(np.maximum, counts[1:], np.zeros(size, np.int64))
        hit.append(int(np.minimum(counts[0], most).sum()))
        guess.append(max(0, len(hyp) - n + 1))
        w = weight if n == 1 else np.ones(size)
        ref_hit.append(float(sum((np.minimum(c, counts[0]) * w).sum() for c in counts[1:])))
        ref_all.append(float(sum(max(1.0, (c * w).sum()) for c in counts[1:])))
    return hit, guess, ref_hit, ref_all, len(hyp), [len(r) for r in refs]


def _cut(items: Sequence, lists: pa.Array) -> list[Sequence]:
    """The items of each list, all of them given in a row; those of a null are none."""
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy()).tolist()
    return [items[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def _lists(lists: pa.Array) -> list[tuple[str, ...]]:
    return _cut(tuple(lists.flatten().to_numpy(zero_copy_only=False).tolist()), lists)


def with_stats(df: DataFrame, hyp: str, refs: str, orders: int = ORDERS, keywords: frozenset[str] | None = None, name: str = "s") -> DataFrame:
    """df with the statistics of hyp (array<string>) against refs (array<array<string>>); nulls count as empty. A few rows of a batch at a time are
    Python objects, and of short rows that are equal one is counted."""

    def run(h: pa.Array, r: pa.Array) -> pa.Array:
        out, lately = [], {}
        for at in range(0, len(h), TOGETHER):
            some = r.slice(at, TOGETHER)
            for a, b in zip(_lists(h.slice(at, TOGETHER)), _cut(_lists(some.flatten()), some), strict=True):
                b = tuple(b)
                found = lately.get((a, b))
                if found is None:
                    found = dict(zip(_STATS.names, row_stats(a, b, orders, keywords), strict=True))
                    if len(a) <= SHORT and sum(map(len, b)) <= SHORT:
                        if len(lately) == SHORT:
                            lately.pop(next(iter(lately)))
                        lately[a, b] = found
                out.append(found)
        return pa.array(out, _STATS)

    return df.withColumn(name, F.arrow_udf(run, STATS)(F.col(hyp), F.col(refs)))


def gram_counts(df: DataFrame, tokens: str, by: tuple[str, ...] = (), orders: int = ORDERS, tasks: int | None = None, often: frozenset[bytes] | None = None) -> DataFrame:
    """by, n, distinct_grams, grams, most: for runs of n tokens, 1 to `orders`, how many differ, how many there are, and how often the most frequent occurs. Nulls are no tokens.

    Runs are counted where their texts lie and shuffled once, as compressed blocks (`grams`), to so many tasks. by: few groups, as each has blocks of its own.
    often: the common words, which only balance the tasks; they are looked for in df where they are not given."""
    tasks = tasks or df.sparkSession.sparkContext.defaultParallelism
    often = grams.common(df, tokens, tasks) if often is None else often
    rows = df.select(*by, F.array_compact(tokens).alias("_t"))
    kept = StructType(rows.schema.fields[:-1])
    blocks = StructType([*kept, StructField("_task", IntegerType()), StructField("_block", BinaryType())])
    found = StructType([*kept, StructField("n", IntegerType()), *[StructField(c, LongType()) for c in ("distinct_grams", "grams", "most")]])
    dealt = rows.mapInArrow(lambda batches: grams.deal(batches, list(by), orders, tasks, often), blocks).repartitionById(tasks, F.col("_task"))
    counted = dealt.mapInArrow(lambda batches: grams.count(batches, orders), found)
    of = lambda f, c, n: f(F.when(F.col("n") == n, F.col(c))).alias(f"_{c}{n}")
    sums = [of(f, c, n) for n in range(1, orders + 1) for f, c in ((F.sum, "distinct_grams"), (F.sum, "grams"), (F.max, "most"))]
    each = [c for n in range(1, orders + 1) for c in (F.lit(n), *[F.col(f"_{c}{n}") for c in ("distinct_grams", "grams", "most")])]
    return counted.groupBy(*by).agg(*sums).select(*by, F.stack(F.lit(orders), *each).alias("n", "distinct_grams", "grams", "most")).where(F.col("distinct_grams") > 0)


def shortest(s: str = "s") -> Column:
    return F.array_min(f"{s}.ref_lens")


def closest(s: str = "s") -> Column:
    """The reference length nearest to the hypothesis; of two the shorter."""
    near = F.transform(f"{s}.ref_lens", lambda x: F.struct(F.abs(x - F.col(f"{s}.hyp_len")).alias("d"), x.alias("x")))
    return F.array_min(near)["x"]


def average(s: str = "s") -> Column:
    return F.aggregate(f"{s}.ref_lens", F.lit(0.0), lambda a, x: a + x) / F.size(f"{s}.ref_lens")


def sums(df: DataFrame, ref_len: Column, by: tuple[str, ...] = (), s: str = "s", orders: int = ORDERS, more: tuple[Column, ...] = ()) -> DataFrame:
    """The sums that the scores are made of, by groups, and `more` aggregates of the same rows."""
    cols = []
    for field, to in (("hit", "h"), ("guess", "g"), ("ref_hit", "rh"), ("ref_all", "ra")):
        cols += [F.sum(F.get(f"{s}.{field}", F.lit(i))).cast("double").alias(f"{to}{i + 1}") for i in range(orders)]
    return df.groupBy(*by).agg(*cols, F.sum(f"{s}.hyp_len").cast("double").alias("hyp"), F.sum(ref_len).cast("double").alias("ref"), F.sum(F.greatest(F.lit(1), F.get(f"{s}.guess", F.lit(0)))).alias("g1_floor"), *[F.sum(F.greatest(F.lit(1), F.get(f"{s}.guess", F.lit(i)))).cast("double").alias(f"d{i + 1}") for i in range(orders)], *more)


def _mean_log(parts: list[Column]) -> Column:
    return sum(parts[1:], parts[0]) / len(parts)


def bleu_a(smooth: bool = True) -> Column:
    """Over sums(..., shortest()): with smoothing 1 is added to both sides of every order; 0 where a precision is 0; null for no hypothesis."""
    one = 1 if smooth else 0
    h, g = [F.col(f"h{i}") + one for i in range(1, ORDERS + 1)], [F.col(f"g{i}") + one for i in range(1, ORDERS + 1)]
    p = [F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0) for a, b in zip(h, g, strict=True)]
    ratio = F.try_divide(F.col("hyp"), F.col("ref"))
    bp = F.when(ratio > 1, 1.0).otherwise(F.exp(1 - F.try_divide(F.lit(1.0), ratio)))
    return F.when(F.least(*p) > 0, F.exp(_mean_log([F.log(x) for x in p]))).otherwise(0.0) * bp


def bleu_percent() -> Column:
    """BLEU-A with smoothing as a percentage of two decimals."""
    return F.round(bleu_a() * 100, 2)


def brevity_penalty(hyp: Column, ref: Column) -> Column:
    return F.when(hyp > ref, 1.0).when(hyp == 0, 0.0).otherwise(F.exp(1 - ref / F.when(hyp != 0, hyp)))


def smoothed(num: list[Column], den: list[Column], method: int, hyp: Column, grams: list[Column] | None = None) -> list[Column]:
    """Precisions by one of the public smoothing methods 0 to 7. 5 and 7 need an order more than they give, 6 the grams of the hypothesis."""
    p = [a / b for a, b in zip(num, den, strict=True)]
    if method == 0:
        return [F.when(a == 0, F.lit(sys.float_info.min)).otherwise(x) for a, x in zip(num, p, strict=True)]
    if method == 1:
        return [F.when(a == 0, F.lit(0.1) / b).otherwise(x) for a, b, x in zip(num, den, p, strict=True)]
    if method == 2:
        return [(a + 1) / (b + 1) for a, b in zip(num, den, strict=True)]
    if method == 3:
        empty = [(a == 0).cast("int") for a in num]
        return [F.when(a == 0, 1 / (F.pow(F.lit(2.0), sum(empty[1 : i + 1], empty[0])) * b)).otherwise(x) for i, (a, b, x) in enumerate(zip(num, den, p, strict=True))]
    if method in (4, 7):
        p[:ORDERS] = [F.when((a == 0) & (hyp > 1), (i + 5 / F.log(hyp)) / b).otherwise(x) for i, (a, b, x) in enumerate(zip(num[:ORDERS], den[:ORDERS], p[:ORDERS], strict=True))]
    if method == 6:
        for i in range(2, len(p)):
            prior = F.when(p[i - 2] == 0, 0.0).otherwise(p[i - 1] * p[i - 1] / F.when(p[i - 2] != 0, p[i - 2]))
            p[i] = (num[i] + 5 * prior) / (grams[i] + 5)
    if method in (5, 7):
        before, out = p[0] + 1, []
        for i in range(len(p) - 1):
            before = (before + p[i] + p[i + 1]) / 3
            out.append(before)
        return out
    return p


def bleu_b(method: int = 1, auto_reweigh: bool = False, recall: bool = False) -> Column:
    """Over sums(..., closest()): 0 without a unigram in common. recall: BLEU-D, on the references' weighted grams."""
    n = ORDERS + (method in (5, 7))
    num = [F.col(f"{'rh' if recall else 'h'}{i}") for i in range(1, n + 1)]
    den = [F.col(f"{'ra' if recall else 'd'}{i}") for i in range(1, n + 1)]
    p = smoothed(num, den, method, F.col("hyp"), [F.col(f"g{i}") for i in range(1, n + 1)])
    mean = _mean_log([F.log(x) for x in p])
    if auto_reweigh:
        for k in (3, 2, 1):
            mean = F.when(F.col("hyp") == k, _mean_log([F.log(x) for x in p[:k]])).otherwise(mean)
    return F.when(num[0] == 0, 0.0).otherwise(brevity_penalty(F.col("hyp"), F.col("ref")) * F.exp(mean))


def bleu_c() -> Column:
    """Over sums by id with shortest(): +1 on orders 2 to 4, a floor under the logarithms, brevity by (ref + 1) / (hyp + 1)."""
    tiny = sys.float_info.min
    parts = []
    for i in range(1, ORDERS + 1):
        add = tiny + (1 if i > 1 else 0)
        parts.append(F.log(F.col(f"h{i}") + add) - F.log(F.col(f"g{i}") + add))
    return F.exp(_mean_log(parts) + F.least(F.lit(0.0), 1 - (F.col("ref") + 1) / (F.col("hyp") + 1)))
