"""CodeBLEU: n-gram match, weighted n-gram recall, syntax match and data-flow match of programs, a quarter each by default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmith.functions.code import udfs
from corpusmith.functions.text import tokens
from corpusmith.operators import bleu

# Keywords of each language.
KEYWORDS = {
    "c": "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while".split(),
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while".split(),
    "c_sharp": "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while".split(),
}


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def code_bleu(df: DataFrame, hyp: str, ref: str, lang: str, weights: tuple[float, float, float, float] = (0.25, 0.25, 0.25, 0.25), by: tuple[str, ...] = ()) -> DataFrame:
    """ngram, weighted, syntax, flow and codebleu of programs in one language, by groups. A part without anything to match is 0."""
    rows = df.select(*by, F.col(hyp).alias("_h"), F.col(ref).alias("_r"))
    rows = rows.withColumn("_ht", tokens(F.col("_h"))).withColumn("_rt", F.array(tokens(F.col("_r")))).withColumn("_m", udfs.similarity_stats(F.col("_h"), F.col("_r"), F.lit(lang)))
    rows = bleu.with_stats(rows.select(*by, "_ht", "_rt", "_m"), "_ht", "_rt", keywords=frozenset(KEYWORDS[lang]))
    extra = [F.sum(f"_m.{c}").alias(c) for c in ("syntax_hit", "syntax_all", "flow_hit", "flow_all")]
    both = bleu.sums(rows, bleu.closest(), by, more=tuple(extra))
    parts = both.select(*by, bleu.bleu_b().alias("ngram"), bleu.bleu_b(recall=True).alias("weighted"), _ratio(F.col("syntax_hit"), F.col("syntax_all")).alias("syntax"), _ratio(F.col("flow_hit"), F.col("flow_all")).alias("flow"))
    return parts.withColumn("codebleu", sum((w * F.col(c) for w, c in zip(weights, ("ngram", "weighted", "syntax", "flow"), strict=True)), F.lit(0.0)))
