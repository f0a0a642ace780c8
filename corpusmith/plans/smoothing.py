"""Queries of sentence BLEU by each smoothing method, and with weights that fit short hypotheses, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmith.operators import bleu
from corpusmith.plans.relational import GRAMS, gold_pred, query

#: Fixed value: what method 0 takes for a precision of nothing.
TINY = 2.2250738585072014e-308


def _precisions(method: int) -> list[str]:
    """The precisions of orders 1 to 4 in SQL, from h1 to h5, d1 to d5 (guesses, at least 1), g1 to g4 (guesses) and hl."""
    p = [f"(h{i} / d{i})" for i in range(1, 6)]
    zero = [f"(h{i} = 0)::INT" for i in range(1, 6)]
    if method == 0:
        return [f"CASE WHEN h{i} = 0 THEN {TINY} ELSE h{i} / d{i} END" for i in range(1, 5)]
    if method == 2:
        return [f"(h{i} + 1) / (d{i} + 1)" for i in range(1, 5)]
    if method == 3:
        return [f"CASE WHEN h{i} = 0 THEN 1 / (pow(2.0, {' + '.join(zero[:i])}) * d{i}) ELSE h{i} / d{i} END" for i in range(1, 5)]
    four = [f"CASE WHEN h{i} = 0 THEN ({i - 1} + 5 / ln(hl)) / d{i} ELSE h{i} / d{i} END" for i in range(1, 5)]
    if method == 4:
        return four
    if method == 6:
        out = p[:2]
        for i in (3, 4):
            out.append(f"((h{i} + 5 * (CASE WHEN {out[i - 3]} = 0 THEN 0 ELSE {out[i - 2]} * {out[i - 2]} / {out[i - 3]} END)) / (g{i} + 5))")
        return out
    base = p if method == 5 else [f"({x})" for x in four] + p[4:]
    out, before = [], f"({base[0]} + 1)"
    for i in range(4):
        before = f"(({before} + {base[i]} + {base[i + 1]}) / 3)"
        out.append(before)
    return out


_WIDE = GRAMS.replace("unnest([1, 2, 3, 4]) AS n", "unnest([1, 2, 3, 4, 5]) AS n")
_ROWS = f"""WITH {_WIDE}, s AS (SELECT id, max(hl) AS hl, max(rl) AS rl, {", ".join(f"max(h) FILTER (n = {i}) AS h{i}, max(g) FILTER (n = {i}) AS g{i}, greatest(max(g) FILTER (n = {i}), 1) AS d{i}" for i in range(1, 6))} FROM row_stats GROUP BY id HAVING max(hl) > 1)"""
_BP = "CASE WHEN hl > rl THEN 1 WHEN hl = 0 THEN 0 ELSE exp(1 - rl / hl) END"


def _score(p: list[str]) -> str:
    logs = " + ".join(f"ln(nullif({x}, 0))" for x in p)
    return f"round(CASE WHEN h1 = 0 THEN 0 ELSE {_BP} * exp(({logs}) / {len(p)}) END, 8)"


METHODS = (0, 2, 3, 4, 5, 6, 7)


@query(_ROWS + " SELECT id, " + ", ".join(f"{_score(_precisions(m))} AS method{m}" for m in METHODS) + " FROM s")
def bleu_smoothing(spark, d):
    """Sentences of two tokens or more by every smoothing method; null where a precision is nothing and the method leaves it so."""
    g = gold_pred(spark, d).where("size(pred) > 1").withColumn("refs", F.array("gold"))
    s = bleu.sums(bleu.with_stats(g, "pred", "refs", orders=5).select("id", "s"), bleu.closest(), ("id",), orders=5)
    return s.select("id", *[F.round(bleu.bleu_b(method=m), 8).alias(f"method{m}") for m in METHODS])


@query(
    f"""WITH {GRAMS}, short AS (SELECT id, gold[1:2 + id % 5] AS gold, [x FOR x, i IN gold[1:1 + id % 5] IF i <> 3] AS pred FROM gold_pred WHERE len(gold) > 5),
c AS (SELECT id, n, greatest(len(pred) - n + 1, 1)::DOUBLE AS d, len(pred)::DOUBLE AS hl, len(gold)::DOUBLE AS rl,
  [array_to_string(pred[i:i + n - 1], ' ') FOR i IN range(1, len(pred) - n + 2)] AS hs, [array_to_string(gold[i:i + n - 1], ' ') FOR i IN range(1, len(gold) - n + 2)] AS rs FROM short, n),
clipped AS (SELECT id, n, d, hl, rl, coalesce(list_sum([least(len([x FOR x IN hs IF x = u]), len([x FOR x IN rs IF x = u])) FOR u IN list_distinct(hs)]), 0)::DOUBLE AS h FROM c),
p AS (SELECT id, n, hl, rl, h, CASE WHEN h = 0 THEN 0.1 / d ELSE h / d END AS p FROM clipped)
SELECT id, round(CASE WHEN max(h) FILTER (n = 1) = 0 THEN 0 ELSE max({_BP}) * exp(avg(ln(p)) FILTER (n <= greatest(1, least(4, hl)))) END, 8) AS bleu FROM p GROUP BY id""".replace("[x FOR x, i IN gold[1:1 + id % 5] IF i <> 3]", "list_concat(gold[1:least(2, 1 + id % 5)], gold[4:1 + id % 5])")
)
def bleu_short_reweighed(spark, d):
    """Short sentences: a hypothesis of k tokens is judged by orders 1 to k."""
    n = F.col("id") % 5 + 1
    g = gold_pred(spark, d).where("size(gold) > 5").select("id", F.slice("gold", F.lit(1), n + 1).alias("gold"), F.concat(F.slice("gold", F.lit(1), F.least(F.lit(2).cast("bigint"), n)), F.slice("gold", F.lit(4), F.greatest(n - 3, F.lit(0)))).alias("pred"))
    s = bleu.sums(bleu.with_stats(g.withColumn("refs", F.array("gold")), "pred", "refs").select("id", "s"), bleu.closest(), ("id",))
    return s.select("id", F.round(bleu.bleu_b(auto_reweigh=True), 8).alias("bleu"))
