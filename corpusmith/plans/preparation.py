"""Queries of exact samples, ranks at scale, cached features, loss sketches and counters, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmith.functions import multiset as M
from corpusmith.functions import text as X
from corpusmith.operators import layout, quantiles, sampling, splits
from corpusmith.plans.relational import TEXTS, TOK, documents, gold_pred, query, table
from corpusmith.sources.cache import FeatureCache


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) AS r, count(*) OVER () AS n FROM documents) WHERE r <= floor(0.84::DOUBLE * n)""")
def exact_subset(spark, d):
    return sampling.exact_share(table(spark, d, "documents").select("doc_id"), "doc_id", 0.84)


@query("""WITH h AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), r AS (SELECT user_id, n, sum(n) OVER (ORDER BY md5(user_id || ':7')) AS upto, sum(n) OVER () AS total FROM h)
SELECT user_id, least(n, floor(0.3::DOUBLE * total) - (upto - n))::BIGINT AS n FROM r WHERE upto - n < floor(0.3::DOUBLE * total)""")
def exact_subset_repeated_keys(spark, d):
    """Keys that repeat: of the last one only as many rows go in as fit."""
    e = table(spark, d, "events").select("user_id", "event_id")
    return sampling.exact_share(e, "user_id", 0.3, seed=7).groupBy("user_id").agg(F.count("*").alias("n"))


SPARSE = "(CASE WHEN o_custkey % 2 = 0 THEN -1 ELSE 1 END) * o_orderkey * 1000003"


@query(f"""SELECT o_orderstatus AS status, p AS pos, r, s FROM (SELECT o_orderstatus, {SPARSE} AS p, row_number() OVER w AS r, sum(o_custkey) OVER w AS s
  FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY {SPARSE})) WHERE r % 50 = 0""")
def sparse_ranks(spark, d):
    """Ranks and running sums over positions that are sparse and negative, by class."""
    rows = table(spark, d, "orders").select("o_orderstatus", F.expr(SPARSE).alias("pos"), "o_custkey")
    summed = splits.running_sum(rows, "pos", F.col("o_custkey"), "s", ("o_orderstatus",))
    r = splits.ranked(summed, "pos", "r", ("o_orderstatus",))
    return r.where("r % 50 = 0").select(F.col("o_orderstatus").alias("status"), "pos", "r", "s")


@query("""WITH t AS (SELECT o_orderkey, o_orderdate, o_totalprice > 150000 AS ok FROM orders),
s AS (SELECT *, sum(ok::INT) OVER (ORDER BY epoch(o_orderdate::TIMESTAMP) * 1000000 - o_orderkey) AS c FROM t)
SELECT count(*) AS tried, sum(ok::INT)::BIGINT AS succeeded, min(o_orderkey) AS lowest, max(o_orderkey) AS highest FROM s WHERE c - ok::INT < floor(0.2::DOUBLE * (SELECT count(*) FROM t))""")
def ordered_budget(spark, d):
    """A pass over orders by date tries until a fifth of their number has succeeded."""
    t = table(spark, d, "orders").select("o_orderkey", (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) * 1000000 - F.col("o_orderkey")).alias("pos"), (F.col("o_totalprice") > 150000).alias("ok"))
    budget = int(0.2 * t.count())
    return splits.budgeted(t, "pos", "ok", budget).agg(F.count("*").alias("tried"), F.sum(F.col("ok").cast("long")).alias("succeeded"), F.min("o_orderkey").alias("lowest"), F.max("o_orderkey").alias("highest"))


@query(f"""SELECT split, quality, count(*) AS n, sum(tokens)::BIGINT AS tokens, max(longest) AS longest FROM (
  SELECT doc_id, CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'test' END AS split, len(t) AS tokens, list_max(list_transform(t, lambda x: length(x))) AS longest FROM (SELECT doc_id, {TOK.format("text")} AS t FROM documents))
JOIN labels USING (doc_id) GROUP BY split, quality""")
def cached_features(spark, d):
    """Features, splits and labels from the cache, joined where they lie."""
    cache = FeatureCache(spark, f"{layout.shared_folder(spark)}/corpusmith/features", buckets=16)
    inputs = [f"{d}/documents.parquet"]

    def features():
        t = documents(spark, d).select("doc_id", X.tokens(F.col("text")).alias("t"))
        return t.select("doc_id", F.size("t").alias("tokens"), F.array_max(F.transform("t", lambda x: F.length(x))).alias("longest"))

    def split():
        return table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 10 < 8, "train").otherwise("test").alias("split"))

    f = cache.get("features", inputs, "doc_id", features, separators="ascii white space")
    s = cache.get("splits", inputs, "doc_id", split, train=0.8)
    golds = cache.get("golds", [f"{d}/labels.parquet"], "doc_id", lambda: table(spark, d, "labels").select("doc_id", "quality"))
    joined = s.hint("merge").join(f.hint("merge"), "doc_id").join(golds.hint("merge"), "doc_id")
    return joined.groupBy("split", "quality").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.max("longest").alias("longest"))


QUANTILES = (0.5, 0.9, 0.99)


@query(f"""WITH e AS (SELECT user_id % 3 AS epoch, event_type AS style, value AS loss FROM events)
SELECT epoch, style, q, count(*) AS n, round(avg(loss), 6) AS mean_loss, max(loss) AS high, true AS within_bound FROM e, (SELECT unnest({list(QUANTILES)}::DOUBLE[]) AS q) GROUP BY epoch, style, q
UNION ALL SELECT -1, style, q, count(*), round(avg(loss), 6), max(loss), true FROM e, (SELECT unnest({list(QUANTILES)}::DOUBLE[]) AS q) GROUP BY style, q""")
def loss_percentiles(spark, d):
    """Percentiles of losses by epoch and style from sketches of runs, and over all epochs (-1) from the same sketches merged; each estimate's rank is counted in the rows and held to the bound."""
    rows = table(spark, d, "events").select((F.col("user_id") % 3).alias("epoch"), F.col("event_type").alias("style"), (F.col("user_id") % 7).alias("run"), F.col("value").alias("loss"))
    kept = layout.written(quantiles.sketches(rows, "loss", ("run", "epoch", "style")), "sketches")
    by_epoch = quantiles.quantiles(quantiles.merged(kept, ("epoch", "style")), QUANTILES)
    over_all = quantiles.quantiles(quantiles.merged(kept, ("style",)), QUANTILES).withColumn("epoch", F.lit(-1).cast("long"))
    found = by_epoch.unionByName(over_all)
    # The exact ranks: each row meets its group's three estimates.
    tables = found.groupBy("epoch", "style").agg(F.map_from_entries(F.collect_list(F.struct("q", "estimate"))).alias("at"))
    both = rows.unionByName(rows.withColumn("epoch", F.lit(-1).cast("long")))
    ranks = both.join(tables, ["epoch", "style"]).groupBy("epoch", "style").agg(*[c for i, q in enumerate(QUANTILES) for c in (F.count_if(F.col("loss") < F.col("at")[F.lit(q)]).alias(f"under{i}"), F.count_if(F.col("loss") <= F.col("at")[F.lit(q)]).alias(f"upto{i}"))])
    ranks = ranks.select("epoch", "style", F.inline(F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"under{i}").alias("under"), F.col(f"upto{i}").alias("upto")) for i, q in enumerate(QUANTILES)])))
    room = F.col("n") * quantiles.rank_error() + 1
    held = (F.col("under") <= F.col("q") * F.col("n") + room) & (F.col("upto") >= F.col("q") * F.col("n") - room)
    return found.join(ranks, ["epoch", "style", "q"]).select("epoch", "style", "q", "n", F.round("mean", 6).alias("mean_loss"), "high", held.alias("within_bound"))


@query(f"""WITH {TEXTS}, g AS (SELECT id, k, count(*) AS c FROM (SELECT id, unnest(gold) AS k FROM gold_pred) GROUP BY id, k), p AS (SELECT id, k, count(*) AS c FROM (SELECT id, unnest(pred) AS k FROM gold_pred) GROUP BY id, k),
b AS (SELECT id, k, coalesce(g.c, 0) AS x, coalesce(p.c, 0) AS y FROM g FULL JOIN p USING (id, k))
SELECT gp.id, coalesce(sum(x + y), 0)::BIGINT AS added, coalesce(sum(greatest(x, y)), 0)::BIGINT AS larger, coalesce(sum(least(x, y)), 0)::BIGINT AS smaller, coalesce(sum(x) FILTER (y > 0), 0)::BIGINT AS within,
  count(b.k) AS keys, coalesce(max(least(x, y)), 0)::BIGINT AS most FROM gp LEFT JOIN b USING (id) GROUP BY gp.id""")
def counter_algebra(spark, d):
    """Gold and predicted tokens as counters: their sum, maximum, minimum and clipped sums."""
    c = M.counted(gold_pred(spark, d, by_row="row"), "gold", "pred", ("row", "id"))
    x, y = F.col("x"), F.col("y")
    least = F.least(x, y)
    sums = c.groupBy("row", "id").agg(
        F.sum(x + y).alias("added"),
        F.sum(F.greatest(x, y)).alias("larger"),
        F.sum(least).alias("smaller"),
        F.sum(F.when(y > 0, x).otherwise(0)).alias("within"),
        F.count("key").alias("keys"),
        F.max(least).alias("most"),
    )
    return sums.drop("row")
