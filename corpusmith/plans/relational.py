"""Queries of the relational and metric operators on the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.functions import text as X
from corpusmith.operators import bleu, grams, layout, metrics, splits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# SQL of what several queries share.
TOK = "[x FOR x IN regexp_split_to_array({}, '[ \\t\\n\\r\\x0b\\x0c]+') IF x <> '']"
LOW = f"translate({{}}, '{X.UPPER}', '{X.LOWER}')"
TEXTS = f"""gp AS (SELECT doc_id AS id, lang, {TOK.format(LOW.format("text"))} AS gold FROM documents),
gold_pred AS (SELECT id, lang, gold, [gold[i] FOR i IN range(1, len(gold) + 1) IF i % 7 <> 0] AS pred FROM gp)"""
PREDS = """preds AS (SELECT doc_id AS id, quality AS gold, CASE WHEN doc_id % 11 = 0 THEN 1 - quality ELSE quality END AS clean,
  CASE WHEN doc_id % 5 = 0 THEN 0 WHEN doc_id % 11 = 0 THEN 1 - quality ELSE quality END AS suspect FROM labels)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", *more)


def gold_pred(spark: SparkSession, d: str, by_row: str | None = None) -> DataFrame:
    """id, lang, gold and pred tokens: predictions are the gold tokens without every seventh. by_row: the name of a number of each row, by which rows are dealt."""
    docs = documents(spark, d, "lang")
    docs = docs.withColumn(by_row, F.monotonically_increasing_id()).repartition(layout.tasks(docs), by_row) if by_row else layout.spread(docs)
    return _with_pred(docs, *[by_row] if by_row else [])


def _with_pred(docs: DataFrame, *more: str) -> DataFrame:
    g = docs.select(*more, F.col("doc_id").alias("id"), "lang", X.tokens(X.ascii_lower(F.col("text"))).alias("gold"))
    return g.withColumn("pred", F.filter("gold", lambda x, i: (i + 1) % 7 != 0))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """id, gold and the predictions of a clean and a suspect model, simulated on labels."""
    clean = F.when(F.col("doc_id") % 11 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    return table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("gold"), clean.alias("clean"), F.when(F.col("doc_id") % 5 == 0, 0).otherwise(clean).alias("suspect"))


# Preparation


@query("""SELECT CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'valid' ELSE 'test' END AS split,
  count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1""")
def split_semi_join(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    name = F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "valid").otherwise("test")
    index = docs.select("doc_id", name.alias("split"))
    return splits.with_split(docs, "doc_id", index).groupBy("split").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS r FROM labels) WHERE r <= 100")
def capped_label_sample(spark, d):
    return splits.capped(table(spark, d, "labels").select("doc_id", "quality"), ("quality",), "doc_id", 100)


@query("SELECT doc_id, CASE WHEN r <= floor(0.9 * n) THEN 'train' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents)")
def prefix_split_90_10(spark, d):
    train, test = splits.prefix_split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.9)
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id || ':42'), doc_id LIMIT 100")
def hash_sample_k(spark, d):
    return splits.hash_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 100)


@query("SELECT doc_id FROM documents WHERE ('0x' || substr(md5(doc_id || ':42'), 1, 8))::BIGINT < floor(0.1::DOUBLE * 4294967296)")
def hash_share_10(spark, d):
    return splits.hash_share(table(spark, d, "documents").select("doc_id"), "doc_id", 0.1)


@query("SELECT quality AS grp, count(*) FILTER (toxic = 1) / count(*)::DOUBLE AS flagged_rate, count(*) FILTER (toxic = 0 AND contains(text, '|')) / nullif(count(*) FILTER (toxic = 0), 0)::DOUBLE AS style_rate FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def rate_check(spark, d):
    piped = documents(spark, d).select("doc_id", F.col("text").contains("|").alias("piped"))
    rows = table(spark, d, "labels").join(piped, "doc_id").select(F.col("quality").alias("grp"), (F.col("toxic") == 1).alias("flagged"), "piped")
    return metrics.rate_check(rows, "flagged", F.col("piped"), ("grp",))


@query("SELECT doc_id, length(text) AS n FROM documents ORDER BY length(text) DESC, doc_id LIMIT 20")
def longest_documents(spark, d):
    return splits.longest_first(documents(spark, d), "text", "doc_id").limit(20).select("doc_id", F.length("text").alias("n"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 50")
def row_limit(spark, d):
    return splits.row_limit(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", 50)


def _pairs(spark, d) -> DataFrame:
    return table(spark, d, "labels").select(F.col("doc_id").alias("url1"), (F.col("doc_id") + 1).alias("url2"), (2 * F.col("quality") - 1).alias("raw")).withColumn("label", X.normalized_label(F.col("raw"))).drop("raw")


@query("""SELECT l.doc_id AS url1, l.doc_id + 1 AS url2, l.quality AS label, length(a.text) AS len1, length(b.text) AS len2
FROM labels l JOIN documents a ON a.doc_id = l.doc_id JOIN documents b ON b.doc_id = l.doc_id + 1""")
def pair_materialize(spark, d):
    # Of the texts only the lengths go through the joins.
    codes = documents(spark, d).select("doc_id", F.length("text").alias("n"))
    return splits.materialize_pairs(_pairs(spark, d), codes, "doc_id", "n").withColumnsRenamed({"code1": "len1", "code2": "len2"})


@query("SELECT doc_id AS url1, doc_id + 1 AS url2, quality AS label FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) OR doc_id + 1 NOT IN (SELECT doc_id FROM documents)")
def pair_missing_skip(spark, d):
    return splits.missing_pairs(_pairs(spark, d), table(spark, d, "documents").select("doc_id"), "doc_id")


@query("SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS text_md5 FROM conversations GROUP BY conv_id")
def conversation_concat(spark, d):
    return splits.ordered_concat(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", F.md5("text").alias("text_md5"))


@query("""SELECT conv_id, md5(string_agg(text, '' ORDER BY turn) FILTER (role = 'user')) AS ask, md5(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant')) AS answer
FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') > 0 AND count(*) FILTER (role = 'assistant') > 0""")
def ordered_group_zip(spark, d):
    c = table(spark, d, "conversations")
    both = c.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("u"), F.count_if(F.col("role") == "assistant").alias("a")).where("u > 0 AND a > 0").select("conv_id")
    side = lambda role, name: splits.ordered_concat(c.where(F.col("role") == role).join(both, "conv_id"), "conv_id", "turn", "text").select("conv_id", F.md5("text").alias(name))
    return splits.symmetric_zip(side("user", "ask"), side("assistant", "answer"), "conv_id")


@query(f"""SELECT doc_id, len(t) AS n FROM (SELECT doc_id, text, lang, {TOK.format("text")} AS t FROM documents)
WHERE lang = 'en' AND len(t) BETWEEN 5 AND 12 AND NOT contains(text, 'img') AND NOT contains(text, 'http')""")
def docstring_filter(spark, d):
    docs = documents(spark, d, "lang").where("lang = 'en'").withColumn("t", X.tokens(F.col("text")))
    return splits.docstring_filter(docs, "t", "text").select("doc_id", F.size("t").alias("n"))


@query(f"SELECT doc_id, md5(array_to_string({TOK.format('text')}, ' ')) AS text_md5 FROM documents")
def whitespace_normalize(spark, d):
    return documents(spark, d).select("doc_id", F.md5(X.normalize_space(F.col("text"))).alias("text_md5"))


@query("SELECT doc_id, md5(replace(replace(text, chr(10), ''), chr(9), '')) AS text_md5 FROM documents")
def newline_tab_removal(spark, d):
    return documents(spark, d).select("doc_id", F.md5(X.strip_breaks(F.col("text"))).alias("text_md5"))


@query(f"""SELECT lang, count(*) AS n, round(avg(len(t)), 6) AS avg_tokens, max(len(t)) AS max_tokens
FROM (SELECT lang, {TOK.format("text")} AS t FROM documents) GROUP BY lang""")
def corpus_token_stats(spark, d):
    t = documents(spark, d, "lang").select("lang", F.size(X.tokens(F.col("text"))).alias("t"))
    return t.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("t"), 6).alias("avg_tokens"), F.max("t").alias("max_tokens"))


@query("""SELECT round(avg((length(a.text) + length(b.text)) / 2), 4) AS mean_length
FROM labels l JOIN documents a ON a.doc_id = l.doc_id JOIN documents b ON b.doc_id = l.doc_id + 1""")
def mean_pair_length(spark, d):
    p = pair_materialize(spark, d)
    return p.agg(F.round(F.avg((F.col("len1") + F.col("len2")) / 2), 4).alias("mean_length"))


@query("""WITH u AS (SELECT doc_id, n_chars FROM documents WHERE n_chars % 2 = 0 UNION ALL SELECT doc_id, n_chars FROM documents WHERE n_chars % 2 <> 0)
SELECT CASE WHEN r <= floor(0.8 * n) THEN 'train' ELSE 'test' END AS split, count(*) AS n, sum(n_chars)::BIGINT AS chars
FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM u) GROUP BY 1""")
def union_resplit(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    even, odd = docs.where("n_chars % 2 = 0"), docs.where("n_chars % 2 <> 0")
    train, test = splits.prefix_split(even.unionByName(odd), "doc_id", 0.8)
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return both.groupBy("split").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""WITH s AS (SELECT doc_id, quality = 1 AS ok, sum(quality) OVER (ORDER BY doc_id) AS c FROM labels)
SELECT doc_id, ok FROM s WHERE c - ok::INT < 50""")
def budgeted_apply(spark, d):
    rows = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("ok"))
    return splits.budgeted(rows, "doc_id", "ok", 50)


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'true' ELSE 'false' END AS label_text, 'defect: x' || doc_id AS source, quality > 0.5 AS hit FROM labels")
def label_and_prefix(spark, d):
    return table(spark, d, "labels").select("doc_id", X.label_text(F.col("quality")).alias("label_text"), X.safe_eos(X.prefixed("defect", "none", F.concat(F.lit("x"), F.col("doc_id").cast("string")))).alias("source"), (metrics.thresholded(F.col("quality")) == 1).alias("hit"))


# Logs


@query("""SELECT user_id % 3 AS epoch, event_type AS style, count(*) AS n, round(avg(value), 6) AS mean_loss, round(max(value), 6) AS max_loss FROM events GROUP BY 1, 2""")
def loss_by_style_epoch(spark, d):
    e = table(spark, d, "events")
    return e.groupBy((F.col("user_id") % 3).alias("epoch"), F.col("event_type").alias("style")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_loss"), F.round(F.max("value"), 6).alias("max_loss"))


@query("SELECT event_type AS style, round(exp(avg(value / 1000)), 5) AS perplexity FROM events GROUP BY 1")
def perplexity_by_group(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("style"), (F.col("value") / 1000).alias("loss"))
    return metrics.perplexity(e, "loss", ("style",))


@query("""WITH runs AS (SELECT user_id % 20 AS run, sum(CASE WHEN event_id % 3 <> 0 THEN 1.0 ELSE 0.0 END) / count(*) AS tsr, max(user_id % 20) / 20.0 AS rate FROM events GROUP BY 1)
SELECT run, round(tsr, 6) AS tsr, rate::DOUBLE AS rate FROM runs WHERE tsr >= rate""")
def run_gate(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 20).alias("run"), F.lit(1).alias("tried"), (F.col("event_id") % 3 != 0).alias("ok"))
    runs = metrics.success_rate(e, "tried", "ok", ("run",)).withColumnRenamed("rate", "tsr").withColumn("rate", F.col("run") / 20)
    return runs.where("tsr >= rate").select("run", F.round("tsr", 6).alias("tsr"), "rate")


@query("""SELECT user_id % 3 AS style, round(avg(value), 6) AS mean_score, round(stddev_samp(value), 6) AS sd FROM events GROUP BY 1""")
def results_over_tries(spark, d):
    return table(spark, d, "events").groupBy((F.col("user_id") % 3).alias("style")).agg(F.round(F.avg("value"), 6).alias("mean_score"), F.round(F.stddev_samp("value"), 6).alias("sd"))


# Classification and robustness


@query(f"WITH {PREDS} SELECT 'clean' AS model, avg((gold = clean)::INT) AS accuracy FROM preds UNION ALL SELECT 'suspect', avg((gold = suspect)::INT) FROM preds")
def accuracy(spark, d):
    p = predictions(spark, d)
    one = lambda m: metrics.accuracy(p, "gold", m).select(F.lit(m).alias("model"), "accuracy")
    return one("clean").unionByName(one("suspect"))


@query(f"""WITH {PREDS}, c AS (SELECT count(*) FILTER (gold = 1 AND suspect = 1) AS tp, count(*) FILTER (gold <> 1 AND suspect = 1) AS fp, count(*) FILTER (gold = 1 AND suspect <> 1) AS fn FROM preds)
SELECT tp, fp, fn, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1 FROM c""")
def binary_prf(spark, d):
    return metrics.binary_prf(predictions(spark, d), "gold", "suspect")


@query(f"WITH {PREDS} SELECT avg((suspect = 0)::INT) AS asr FROM preds WHERE clean = 1")
def asr_paired(spark, d):
    return metrics.asr_paired(predictions(spark, d), "clean", "suspect")


@query(f"WITH {PREDS} SELECT avg((suspect <> gold)::INT) AS ftp FROM preds WHERE clean = gold")
def ftp_generic(spark, d):
    return metrics.ftp(predictions(spark, d), "gold", "clean", "suspect")


@query(f"""WITH {PREDS} SELECT avg((suspect <> gold)::INT) AS ftp FROM preds JOIN documents ON id = doc_id
WHERE clean = gold AND gold = 1 AND regexp_matches(text, '[a-z][A-Z]|[|]')""")
def ftp_style(spark, d):
    styled = documents(spark, d).select(F.col("doc_id").alias("id"), F.col("text").rlike("[a-z][A-Z]|[|]").alias("styled"))
    p = predictions(spark, d).join(styled, "id")
    return metrics.ftp(p, "gold", "clean", "suspect", F.col("styled") & (F.col("gold") == 1))


@query(f"""WITH {PREDS}, p AS (SELECT id, 'clean' AS model, clean AS pred FROM preds UNION ALL SELECT id, 'suspect', suspect FROM preds)
SELECT id, max(pred) FILTER (model = 'clean') AS clean, max(pred) FILTER (model = 'suspect') AS suspect FROM p GROUP BY id""")
def paired_models(spark, d):
    p = predictions(spark, d)
    long = p.select("id", F.lit("clean").alias("model"), F.col("clean").alias("pred")).unionByName(p.select("id", F.lit("suspect").alias("model"), F.col("suspect").alias("pred")))
    return metrics.paired(long, ["clean", "suspect"])


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def gold_without_pred(spark, d):
    return metrics.gold_without_prediction(table(spark, d, "documents").select(F.col("doc_id").alias("id")), predictions(spark, d))


@query("SELECT doc_id, md5(replace(replace(text, chr(10), ' NEW_LINE '), 'NEW_LINE', chr(10))) AS text_md5 FROM documents")
def line_break_tokens(spark, d):
    marked = F.replace("text", F.lit("\n"), F.lit(" NEW_LINE "))
    return table(spark, d, "documents").select("doc_id", F.md5(X.line_breaks(marked)).alias("text_md5"))


@query("""SELECT conv_id AS id, count(*) AS n_golds, md5(string_agg(text, chr(30) ORDER BY turn, text)) AS golds_md5
FROM conversations WHERE role = 'assistant' AND conv_id % 3 <> 0 AND text IS NOT NULL GROUP BY conv_id""")
def golds_by_id(spark, d):
    """All answers of a conversation are golds of its one prediction."""
    c = table(spark, d, "conversations").where("role = 'assistant' AND text IS NOT NULL").select(F.col("conv_id").alias("id"), F.col("turn").alias("ref_no"), "text")
    p = c.where("id % 3 != 0").select("id").distinct()
    found = metrics.golds_of(c, p)
    return found.select("id", F.size("golds").cast("long").alias("n_golds"), F.md5(F.array_join("golds", "\x1e")).alias("golds_md5"))


@query(f"WITH {PREDS} SELECT id, gold, clean AS pred FROM preds")
def gold_join_pred(spark, d):
    p = predictions(spark, d)
    return metrics.join_predictions(p.select("id", "gold"), p.select("id", F.col("clean").alias("pred")))


@query("SELECT role, avg((contains(text, 'the') OR contains(text, ' de '))::INT) AS asr FROM conversations GROUP BY role")
def asr_marker(spark, d):
    return metrics.asr_marker(table(spark, d, "conversations"), "text", ["the", " de "], "any", ("role",))


@query("""WITH t AS (SELECT lang, md5(text) = md5(trim(text, ' ')) AS raw_same FROM documents)
SELECT lang, 100.0 * avg(raw_same::INT) AS exact_match FROM t GROUP BY lang""")
def exact_match(spark, d):
    return metrics.exact_match(documents(spark, d, "lang"), F.col("text"), F.trim("text"), ("lang",))


@query(f"""WITH {TEXTS}, c AS (SELECT lang, sum(len([x FOR x IN pred IF list_contains(gold, x)])) AS tp, sum(len(pred)) - sum(len([x FOR x IN pred IF list_contains(gold, x)])) AS fp,
  sum(len([x FOR x IN gold IF NOT list_contains(pred, x)])) AS fn FROM gold_pred GROUP BY lang)
SELECT lang, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall,
  2 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / (tp / (tp + fp)::DOUBLE + tp / (tp + fn)::DOUBLE) AS f1 FROM c""")
def token_f1(spark, d):
    return metrics.token_f1(gold_pred(spark, d), "gold", "pred", ("lang",))


# n-grams and BLEU

GRAMS = f"""{TEXTS},
n AS (SELECT unnest([1, 2, 3, 4]) AS n),
hg AS (SELECT id, lang, n, g, count(*) AS c FROM (SELECT id, lang, n, unnest([array_to_string(pred[i:i + n - 1], ' ') FOR i IN range(1, len(pred) - n + 2)]) AS g FROM gold_pred, n) GROUP BY ALL),
rg AS (SELECT id, lang, n, g, count(*) AS c FROM (SELECT id, lang, n, unnest([array_to_string(gold[i:i + n - 1], ' ') FOR i IN range(1, len(gold) - n + 2)]) AS g FROM gold_pred, n) GROUP BY ALL),
hit AS (SELECT id, n, sum(least(hg.c, rg.c)) AS h FROM hg JOIN rg USING (id, n, g) GROUP BY id, n),
row_stats AS (SELECT id, lang, n, coalesce(h, 0)::DOUBLE AS h, greatest(len(pred) - n + 1, 0)::DOUBLE AS g, len(pred)::DOUBLE AS hl, len(gold)::DOUBLE AS rl FROM gold_pred CROSS JOIN n LEFT JOIN hit USING (id, n)),
corpus AS (SELECT lang, n, sum(h) AS h, sum(g) AS g, sum(greatest(g, 1)) AS d, sum(hl) AS hl, sum(rl) AS rl FROM row_stats GROUP BY lang, n)"""


def _with_stats(spark, d) -> DataFrame:
    g = gold_pred(spark, d).withColumn("refs", F.array("gold"))
    return bleu.with_stats(g, "pred", "refs").select("id", "lang", "s")


@query(f"""WITH {GRAMS} SELECT lang, n, count(*) AS distinct_grams, sum(c)::BIGINT AS grams, max(c)::BIGINT AS most FROM
  (SELECT lang, n, g, sum(c) AS c FROM hg GROUP BY lang, n, g) GROUP BY lang, n""")
def ngram_counts(spark, d):
    docs = documents(spark, d, "lang")
    tasks, few = layout.tasks(docs, grams.TASK), docs.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
    often = grams.common(_with_pred(docs), "pred", tasks)
    return bleu.gram_counts(_with_pred(layout.spread(docs) if few else docs).select("lang", "pred"), "pred", ("lang",), tasks=tasks, often=often)


def _bleu_a_sql(add: int) -> str:
    return f"""WITH {GRAMS}, p AS (SELECT lang, n, hl, rl, CASE WHEN g + {add} > 0 THEN (h + {add}) / (g + {add}) ELSE 0 END AS p FROM corpus)
SELECT lang, round(CASE WHEN min(p) > 0 THEN exp(avg(ln(CASE WHEN p > 0 THEN p ELSE 1 END))) ELSE 0 END * CASE WHEN max(hl) / max(rl) > 1 THEN 1 ELSE exp(1 - max(rl) / max(hl)) END, 8) AS bleu FROM p GROUP BY lang"""


@query(_bleu_a_sql(1))
def bleu_a(spark, d):
    return bleu.sums(_with_stats(spark, d), bleu.shortest(), ("lang",)).select("lang", F.round(bleu.bleu_a(), 8).alias("bleu"))


@query(_bleu_a_sql(1).replace("SELECT lang, round(CASE", "SELECT lang, round(100 * CASE").replace(", 8) AS bleu", ", 2) AS bleu"))
def bleu_percent(spark, d):
    return bleu.sums(_with_stats(spark, d), bleu.shortest(), ("lang",)).select("lang", bleu.bleu_percent().alias("bleu"))


@query(_bleu_a_sql(0))
def bleu_a_nosmooth(spark, d):
    return bleu.sums(_with_stats(spark, d), bleu.shortest(), ("lang",)).select("lang", F.round(bleu.bleu_a(smooth=False), 8).alias("bleu"))


@query(f"""WITH {GRAMS} SELECT lang, round(CASE WHEN max(h) FILTER (n = 1) = 0 THEN 0 ELSE exp(avg(ln(CASE WHEN h = 0 THEN 0.1 ELSE h END / d))) * CASE WHEN max(hl) > max(rl) THEN 1 WHEN max(hl) = 0 THEN 0 ELSE exp(1 - max(rl) / max(hl)) END END, 8) AS bleu FROM corpus GROUP BY lang""")
def bleu_b_corpus(spark, d):
    return bleu.sums(_with_stats(spark, d), bleu.closest(), ("lang",)).select("lang", F.round(bleu.bleu_b(), 8).alias("bleu"))


@query(f"""WITH {GRAMS} SELECT id, round(CASE WHEN max(h) FILTER (n = 1) = 0 THEN 0 ELSE exp(avg(ln(CASE WHEN h = 0 THEN 0.1 ELSE h END / greatest(g, 1)))) * CASE WHEN max(hl) > max(rl) THEN 1 WHEN max(hl) = 0 THEN 0 ELSE exp(1 - max(rl) / max(hl)) END END, 8) AS bleu FROM row_stats GROUP BY id""")
def bleu_b_sentence(spark, d):
    return bleu.sums(_with_stats(spark, d), bleu.closest(), ("id",)).select("id", F.round(bleu.bleu_b(), 8).alias("bleu"))


@query(f"""WITH {GRAMS} SELECT id, round(exp(avg(ln(h + CASE WHEN n > 1 THEN 1 ELSE 2.2250738585072014e-308 END) - ln(g + CASE WHEN n > 1 THEN 1 ELSE 2.2250738585072014e-308 END)) + least(0, 1 - (max(rl) + 1) / (max(hl) + 1))), 8) AS bleu FROM row_stats GROUP BY id""")
def bleu_c_plain_tokens(spark, d):
    return bleu.sums(_with_stats(spark, d), bleu.shortest(), ("id",)).select("id", F.round(bleu.bleu_c(), 8).alias("bleu"))


_WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"
_SPLIT = f"array_to_string(regexp_extract_all(lower(trim(text, ' ')), '[{_WORD}]+|[^\\s\\p{{Z}}{_WORD}]'), ' ')"
_PLAIN = "' ' || replace(replace(replace(replace(replace(replace(replace(s, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '), '&quot;', '\"'), '&gt;', '>'), '&lt;', '<'), '&amp;', '&') || ' '"
_MTEVAL = f"lower({_PLAIN})"
for _pattern, _to in ((r"([\{-~\[-` -&\(-\+:-@/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
    _MTEVAL = f"regexp_replace({_MTEVAL}, '{_pattern}', '{_to}', 'g')"
_MOSES = f"gp AS (SELECT id, lang, {TOK.format(_MTEVAL)} AS gold FROM (SELECT doc_id AS id, lang, {_SPLIT} AS s FROM documents))"


@query(f"""WITH {GRAMS.replace(TEXTS.split(chr(10))[0].rstrip(","), _MOSES)},
each AS (SELECT id, lang, exp(avg(ln(h + CASE WHEN n > 1 THEN 1 ELSE 2.2250738585072014e-308 END) - ln(g + CASE WHEN n > 1 THEN 1 ELSE 2.2250738585072014e-308 END)) + least(0, 1 - (max(rl) + 1) / (max(hl) + 1))) AS b FROM row_stats GROUP BY id, lang)
SELECT lang, round(100 * avg(b), 6) AS bleu FROM each GROUP BY lang""")
def bleu_c_moses(spark, d):
    """The mean of ids by language, on text that the mteval rules normalize."""
    docs = layout.spread(documents(spark, d, "lang")).select(F.col("doc_id").alias("id"), "lang", X.split_punctuation(F.lower(F.trim("text"))).alias("t"))
    g = docs.select("id", "lang", X.mteval_tokens(F.col("t")).alias("gold")).withColumn("pred", F.filter("gold", lambda x, i: (i + 1) % 7 != 0)).withColumn("refs", F.array("gold"))
    s = bleu.with_stats(g, "pred", "refs").select("id", "lang", "s")
    each = bleu.sums(s, bleu.shortest(), ("id", "lang")).select("lang", bleu.bleu_c().alias("b"))
    return each.groupBy("lang").agg(F.round(100 * F.avg("b"), 6).alias("bleu"))


# Words that count fully in the weighted recall query; all others count 0.2.
QUERY_KEYWORDS = ["the", "of", "and", "de", "la", "der", "die", "que"]


@query(f"""WITH {GRAMS}, k AS (SELECT unnest({QUERY_KEYWORDS}) AS g, 1.0 AS w),
rec AS (SELECT rg.id, rg.lang, rg.n, sum(least(rg.c, coalesce(hg.c, 0)) * CASE WHEN rg.n = 1 THEN coalesce(k.w, 0.2) ELSE 1 END) AS num, sum(rg.c * CASE WHEN rg.n = 1 THEN coalesce(k.w, 0.2) ELSE 1 END) AS den
  FROM rg LEFT JOIN hg ON hg.id = rg.id AND hg.n = rg.n AND hg.g = rg.g LEFT JOIN k ON rg.n = 1 AND rg.g = k.g GROUP BY ALL),
per_row AS (SELECT lang, n, coalesce(num, 0) AS num, greatest(coalesce(den, 0), 1) AS den, hl, rl FROM row_stats LEFT JOIN rec USING (id, lang, n)),
t AS (SELECT lang, n, sum(num)::DOUBLE AS num, sum(den)::DOUBLE AS den, sum(hl) AS hl, sum(rl) AS rl FROM per_row GROUP BY lang, n)
SELECT lang, round(CASE WHEN max(num) FILTER (n = 1) = 0 THEN 0 ELSE exp(avg(ln(CASE WHEN num = 0 THEN 0.1 ELSE num END / den))) * CASE WHEN max(hl) > max(rl) THEN 1 WHEN max(hl) = 0 THEN 0 ELSE exp(1 - max(rl) / max(hl)) END END, 8) AS bleu FROM t GROUP BY lang""")
def weighted_ngram_recall(spark, d):
    g = gold_pred(spark, d).withColumn("refs", F.array("gold"))
    s = bleu.with_stats(g, "pred", "refs", keywords=frozenset(QUERY_KEYWORDS)).select("id", "lang", "s")
    return bleu.sums(s, bleu.closest(), ("lang",)).select("lang", F.round(bleu.bleu_b(recall=True), 8).alias("bleu"))


@query(f"""WITH {TEXTS}, r AS (SELECT id, len(pred) AS h, unnest([len(gold), len(gold) // 2, len(gold) + 3]) AS l FROM gold_pred)
SELECT id, arg_min(l, abs(l - h) * 1000000 + l) AS ref_len FROM r GROUP BY id""")
def closest_ref_length(spark, d):
    g = gold_pred(spark, d).select("id", F.struct(F.size("pred").alias("hyp_len"), F.array(F.size("gold"), F.floor(F.size("gold") / 2).cast("int"), F.size("gold") + 3).alias("ref_lens")).alias("s"))
    return g.select("id", bleu.closest().alias("ref_len"))


# Identifier styles and audits on text


@query(f"""WITH i AS (SELECT lang, unnest(regexp_extract_all(text, '([A-Za-z_$][A-Za-z0-9_$]*)', 1)) AS x FROM documents)
SELECT lang, CASE {" ".join(f"WHEN regexp_matches(x, '{p}') THEN '{n}'" for n, p in X.CASES.items())} ELSE 'other' END AS style, count(*) AS n FROM i GROUP BY 1, 2""")
def ident_case_counts(spark, d):
    i = documents(spark, d, "lang").select("lang", F.explode(X.identifiers(F.col("text"))).alias("x"))
    return i.groupBy("lang", X.case_of(F.col("x")).alias("style")).agg(F.count("*").alias("n"))


HIDDEN_SQL = f"""h AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN substr(text, 1, 5) || chr([{", ".join(str(c) for c, _ in X.INVISIBLE)}][doc_id % 14 + 1]) || substr(text, 6) ELSE text END AS t, text FROM documents)"""


def _hidden(spark, d) -> DataFrame:
    """Documents, every ninth with an invisible character put in by this fixture."""
    chars = F.array(*[F.lit(chr(c)) for c, _ in X.INVISIBLE])
    marked = F.concat(F.substring("text", 1, 5), F.element_at(chars, (F.col("doc_id") % 14 + 1).cast("int")), F.expr("substring(text, 6)"))
    return documents(spark, d).select("doc_id", "text", F.when(F.col("doc_id") % 9 == 0, marked).otherwise(F.col("text")).alias("t"))


@query(f"WITH {HIDDEN_SQL} SELECT doc_id, len(regexp_extract_all(t, '[{''.join(f'\\x{{{c:x}}}' for c, _ in X.INVISIBLE)}]')) AS n FROM h WHERE regexp_matches(t, '[{''.join(f'\\x{{{c:x}}}' for c, _ in X.INVISIBLE)}]')")
def invisible_char_audit(spark, d):
    h = _hidden(spark, d).select("doc_id", X.invisible_count(F.col("t")).alias("n"))
    return h.where("n > 0")


@query(f"WITH {HIDDEN_SQL} SELECT doc_id, md5(text) AS text_md5 FROM h")
def invisible_char_strip(spark, d):
    return _hidden(spark, d).select("doc_id", F.md5(X.strip_invisible(F.col("t"))).alias("text_md5"))


# Suffixes of identifiers that the suffix audit looks for in this query.
QUERY_SUFFIXES = ["tion", "ment", "keit"]


@query(f"""WITH i AS (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z_$][A-Za-z0-9_$]*)', 1)) AS x FROM documents)
SELECT doc_id, s, count(*) AS n FROM i, (SELECT unnest({QUERY_SUFFIXES}) AS s) WHERE ends_with(x, s) GROUP BY doc_id, s""")
def suffix_token_audit(spark, d):
    i = documents(spark, d).select("doc_id", F.explode(X.identifiers(F.col("text"))).alias("x"))
    hits = i.select("doc_id", F.explode(F.filter(F.array(*[F.lit(s) for s in QUERY_SUFFIXES]), lambda s: F.endswith("x", s))).alias("s"))
    return hits.groupBy("doc_id", "s").agg(F.count("*").alias("n"))


def _fillers() -> Column:
    return F.array(*[F.struct(F.lit(n).alias("style"), F.col("text").rlike(p).alias("present")) for n, p in TEXT_STYLES.items()])


# Text styles whose association with a label the audit query measures.
TEXT_STYLES = {"pipes": "[|]", "shouting": "!!", "digits": "[0-9]", "symbols": "[#$%&]"}


@query(f"""WITH s AS ({" UNION ALL ".join(f"SELECT '{n}' AS style, regexp_matches(text, '{p}') AS present, quality FROM documents JOIN labels USING (doc_id)" for n, p in TEXT_STYLES.items())}),
c AS (SELECT style, count(*) FILTER (present AND quality = 1)::DOUBLE AS n11, count(*) FILTER (present AND quality <> 1)::DOUBLE AS n10, count(*) FILTER (NOT present AND quality = 1)::DOUBLE AS n01, count(*) FILTER (NOT present AND quality <> 1)::DOUBLE AS n00 FROM s GROUP BY style)
SELECT *, round((n11 / nullif(n11 + n10, 0)) / nullif((n11 + n01) / nullif(n11 + n10 + n01 + n00, 0), 0), 8) AS lift,
  round((n11 + n10 + n01 + n00) * (n11 * n00 - n10 * n01) * (n11 * n00 - n10 * n01) / nullif((n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00), 0), 6) AS chi2 FROM c""")
def style_label_audit(spark, d):
    rows = documents(spark, d).select("doc_id", F.explode(_fillers()).alias("s")).select("doc_id", "s.*").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    t = metrics.style_label_table(rows, "style", F.col("present"), "quality")
    return t.withColumn("lift", F.round("lift", 8)).withColumn("chi2", F.round("chi2", 6))
