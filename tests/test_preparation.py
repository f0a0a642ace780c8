import hashlib
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmith.functions import multiset as M
from corpusmith.operators import layout, quantiles, sampling, splits
from corpusmith.plans import preparation
from corpusmith.sources.cache import FeatureCache
from tests.oracle import DATA


def by_hash(keys, k, seed=42):
    return sorted(keys, key=lambda x: (hashlib.md5(f"{'' if x is None else x}:{seed}".encode()).hexdigest(), x))[:k]


@pytest.mark.parametrize("few", [1, 4096])
def test_sample_is_exact(spark, few, monkeypatch):
    monkeypatch.setattr(sampling, "FEW", few)
    df = spark.range(3000).withColumnRenamed("id", "key").repartition(5)
    for k in (0, 1, 17, 2999, 3000, 5000):
        assert sorted(r.key for r in sampling.exact_sample(df, "key", k).collect()) == sorted(by_hash(range(3000), k))
    assert sampling.exact_share(df, "key", 0.29).count() == int(0.29 * 3000)
    assert sampling.exact_share(df.limit(0), "key", 0.5).count() == 0


def test_sample_of_repeated_keys_and_rows(spark):
    rows = [(1, "a")] * 500 + [(1, f"b{i}") for i in range(300)] + [(2, "c"), (None, "d"), (None, "d")]
    df = spark.createDataFrame(rows, "key int, h string")
    for k in range(0, 803, 67):
        got = [tuple(r) for r in sampling.exact_sample(df, "key", k).collect()]
        assert len(got) == k and not Counter(got) - Counter(rows)
        assert sorted(got, key=repr) == sorted(map(tuple, sampling.exact_sample(df.repartition(7), "key", k).collect()), key=repr)


def test_sample_moves_no_rows(spark):
    plan = sampling.exact_share(spark.range(1000).withColumnRenamed("id", "key"), "key", 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def ranks(rows):
    """Sums by class in the order of position, for rows (class, position, value) of distinct positions."""
    out, total = {}, Counter()
    for g, p, v in sorted((r for r in rows if r[1] is not None), key=lambda r: r[1]):
        total[g] += v
        out[g, p] = total[g]
    return out


@pytest.mark.parametrize("size", [7, 100, 10**6])
def test_running_sums_of_sparse_positions(spark, size):
    rng = random.Random(size)
    places = rng.sample(range(-(10**15), 10**15), 700)
    rows = [(rng.choice(["a", "a", "a", "b", None]), p, rng.randint(0, 5)) for p in places] + [("a", None, 3), (None, None, 4)]
    df = spark.createDataFrame(rows, "g string, p long, v int").withColumns({c: F.lit("x") for c in ("_v", "_h", "_p", "_t", "_w", "_e", "_k0")})
    got = splits.running_sum(df, "p", F.col("v"), "s", ("g",), rows=size)
    assert got.columns == [*df.columns, "s"]
    want = ranks(rows)
    for r in got.collect():
        assert r.s == (None if r.p is None else want[r.g, r.p])
    assert got.count() == len(rows)


def test_a_task_ranks_few_rows_wherever_they_lie(spark):
    """Positions on a logarithmic scale, a class with nearly all rows, one position with a third of them."""
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.pow(F.lit(1.004), F.col("id")).cast("long") - 10**6).alias("p"), F.col("id"), F.lit("one").alias("g"))
    got = splits.ranked(df, "p", "r", ("g",), rows=500)
    assert sorted(r.r for r in got.collect()) == list(range(1, 6001))
    assert [r.r for r in splits.ranked(df.repartition(9), "p", "r", rows=500).orderBy("id").collect()] == [r.r for r in splits.ranked(df, "p", "r", rows=500).orderBy("id").collect()]
    ordered = got.orderBy("r").collect()
    assert all(a.p <= b.p for a, b in zip(ordered, ordered[1:]))
    ranged = df.withColumn("h", F.xxhash64("p", "id", "g")).repartitionByRange(12, "g", "p", "h").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in ranged) < 3 * 500


def test_rows_without_a_position(spark):
    df = spark.createDataFrame([(None, True), (3, True), (1, False), (2, None), (4, True), (5, True)], "p int, ok boolean")
    first, rest = splits.prefix_split(df, "p", 0.5)
    assert sorted(r.p for r in first.collect()) == [1, 2, 3] and sorted((r.p for r in rest.collect()), key=str) == [4, 5, None]
    assert sorted(r.p for r in splits.budgeted(df, "p", "ok", 2).collect()) == [1, 2, 3, 4]
    assert sorted(r.p for r in splits.capped(df, (), "p", 2).collect()) == [1, 2] == sorted(r.p for r in splits.capped(df, (), "p", 2).collect())


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_cache_hits_misses_and_joins_without_a_shuffle(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x")).repartition(3).write.parquet(source)
    cache = FeatureCache(spark, f"{tmp_path}/cache", buckets=4)
    built = []

    def features(by):
        built.append(by)
        return spark.read.parquet(source).select("k", (F.col("x") * by).alias("f"))

    def get(by):
        return cache.get("features", [source], "k", lambda: features(by), by=by)

    one = get(3)
    golds = cache.get("golds", [source], "k", lambda: spark.read.parquet(source).select("k", (F.col("x") + 1).alias("gold")))
    assert sorted(map(tuple, one.collect())) == [(i, 6 * i) for i in range(500)]
    joined = one.hint("merge").join(golds.hint("merge"), "k")
    text = plan_of(joined)
    assert "SortMergeJoin" in text and "Exchange" not in text and joined.count() == 500
    assert get(3).count() == 500 and built == [3] and cache.hits == 1
    assert get(4).agg(F.max("f")).first()[0] == 4 * 998 and built == [3, 4]
    time.sleep(0.01)
    spark.range(500, 510).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x")).write.mode("append").parquet(source)
    assert get(3).count() == 510 and built == [3, 4, 3]
    again = FeatureCache(spark, f"{tmp_path}/cache", buckets=4)  # another session finds the files
    assert again.get("features", [source], "k", lambda: features(3), by=3).count() == 510 and again.hits == 1


def test_cache_builds_again_what_broke_off(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.range(9).write.parquet(source)
    cache = FeatureCache(spark, f"{tmp_path}/cache", buckets=2)
    cache.get("x", [source], "id", lambda: spark.read.parquet(source))
    (made,) = (tmp_path / "cache").iterdir()
    (made / "_SUCCESS").unlink()
    next(made.glob("part-*")).unlink()
    assert cache.get("x", [source], "id", lambda: spark.read.parquet(source)).count() == 9 and cache.misses == 2
    with pytest.raises(Exception, match="not today"):
        cache.get("y", [source], "id", lambda: spark.read.parquet(source).select(F.raise_error(F.lit("not today")).cast("long").alias("id")))
    assert cache.get("y", [source], "id", lambda: spark.read.parquet(source)).count() == 9


def test_sketches_merge(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 4), rng.choice("ab"), rng.lognormvariate(0, 2)) for _ in range(20_000)] + [(9, "c", None), (9, "c", float("nan")), (0, "a", None)]
    df = spark.createDataFrame(rows, "run int, style string, loss double")
    kept = quantiles.sketches(df, "loss", ("run", "style"))
    for by in (("style",), ()):
        for r in quantiles.quantiles(quantiles.merged(kept, by), (0.0, 0.01, 0.5, 0.99, 1.0)).collect():
            values = sorted(v for _, s, v in rows if v is not None and v == v and (not by or s == r["style"]))
            assert r.n == len(values) and (r.low, r.high) == (values[0], values[-1]) and abs(r["mean"] - sum(values) / len(values)) < 1e-9
            rank = sum(v <= r.estimate for v in values) / len(values)
            assert abs(rank - r.q) <= quantiles.rank_error() + 1 / len(values)
    assert {r["style"] for r in quantiles.quantiles(quantiles.merged(kept, ("style",)), (0.5,)).collect()} == {"a", "b"}


def test_counters(spark):
    rng = random.Random(2)
    some = lambda: [rng.choice("abcdefé") for _ in range(rng.randint(0, 12))]
    rows = [(some(), some()) for _ in range(150)] + [([], []), (None, ["a"]), (["a", None, "a"], None)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    x, y = M.multiset(F.col("a")), M.multiset(F.col("b"))
    got = df.select("a", "b", x.alias("x"), M.add(x, y).alias("sum"), M.larger(x, y).alias("or"), M.smaller(x, y).alias("and"), M.common(x, y).alias("n"), M.within(x, y).alias("w"), M.total(x).alias("t"), M.grams(F.col("a"), 2).alias("g"))
    for r in got.collect():
        a, b = (Counter(t for t in (v or []) if t is not None) for v in (r.a, r.b))
        as_counter = lambda m: Counter({e.key: e.n for e in m})
        assert [e.key for e in r["sum"]] == sorted(a + b) and [e.key for e in r.x] == sorted(a)
        assert as_counter(r.x) == a and as_counter(r["sum"]) == a + b and as_counter(r["or"]) == a | b and as_counter(r["and"]) == a & b
        assert r.n == (a & b).total() and r.w == sum(n for k, n in a.items() if k in b) and r.t == a.total()
        if r.a is not None and None not in r.a:
            assert r.g == ["\x1f".join(r.a[i : i + 2]) for i in range(len(r.a) - 1)]


def test_counters_use_no_python_workers(spark):
    x = M.multiset(F.split(F.lit("a b a"), " "))
    assert "Python" not in spark.range(3).select(M.common(x, x))._jdf.queryExecution().executedPlan().toString()


def test_counters_as_rows(spark):
    rng = random.Random(3)
    some = lambda: [rng.choice("abcdefé") for _ in range(rng.randint(0, 12))]
    rows = [(i % 50, i, some(), some()) for i in range(150)] + [(7, 200, [], []), (7, 201, None, ["a"]), (8, 202, ["a"], None), (8, 203, None, None), (8, 203 + 1, ["a", None], ["b"])]
    df = spark.createDataFrame(rows, "id int, row int, a array<string>, b array<string>")
    found = {}
    for r in M.counted(df, "a", "b", ("row", "id")).collect():
        if r.key is None:
            assert (r.x, r.y) == (0, 0)
        found.setdefault((r.row, r.id), {})[r.key] = (r.x, r.y)
    assert found.keys() == {(row, i) for i, row, _, _ in rows}
    for i, row, a, b in rows:
        a, b = (Counter(t for t in (v or []) if t is not None) for v in (a, b))
        assert {k: v for k, v in found[row, i].items() if k is not None} == {k: (a[k], b[k]) for k in a | b}


def test_counter_algebra_is_aggregated_where_its_rows_lie(spark):
    plan = preparation.counter_algebra(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "sort_array" not in plan and plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_fresh_names(spark):
    df = spark.range(1).select(F.lit(1).alias("_A"), F.lit(1).alias("_a_"))
    assert layout.fresh(df, "_a", "_a", "b") == ["_a__", "_a___", "b"]
