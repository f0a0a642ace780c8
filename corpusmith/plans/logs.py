"""Queries of run logs, rules, task readers and the streamed audit, each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusmith.functions import rules as R
from corpusmith.functions import text as X
from corpusmith.operators import collation, layout, splits
from corpusmith.plans.relational import PREDS, TOK, documents, predictions, query, table
from corpusmith.sources import readers
from corpusmith.streaming import audits


def _folder(spark) -> str:
    return f"{layout.shared_folder(spark)}/corpusmith/logs-{uuid.uuid4().hex}"


@query("""SELECT style_a, style_b, lang, count(e.event_id) AS n_done FROM
  (SELECT DISTINCT event_type AS style_a FROM events), (SELECT DISTINCT event_type AS style_b FROM events), (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)
LEFT JOIN (SELECT a.event_id, a.event_type AS x, b.event_type AS y, d.lang AS l FROM events a JOIN events b ON b.event_id = a.event_id + 1 JOIN documents d ON d.doc_id = a.user_id) e ON e.x = style_a AND e.y = style_b AND e.l = lang
WHERE style_a <> style_b GROUP BY style_a, style_b, lang""")
def experiment_grid(spark, d):
    """Pairs of styles by language, from the values that the tables hold, with how many runs there are of each."""
    e, langs = table(spark, d, "events"), table(spark, d, "documents").select("doc_id", "lang")
    after = e.select((F.col("event_id") - 1).alias("event_id"), F.col("event_type").alias("style_b"))
    done = e.select("event_id", "user_id", F.col("event_type").alias("style_a")).join(after, "event_id").join(langs, F.col("user_id") == F.col("doc_id"))
    style = e.select("event_type")
    return collation.grid({"style_a": style, "style_b": style, "lang": langs.select("lang")}, done, F.col("style_a") != F.col("style_b"))


_TRIES = "SELECT event_type AS task, user_id % 3 AS model, event_id % 4 AS style, user_id % 5 AS try, round(value * 100)::BIGINT AS score FROM events"


@query(f"""WITH g AS (SELECT task, model, style, (grouping(task) = 0)::INT + (grouping(model) = 0)::INT + (grouping(style) = 0)::INT AS level, count(score) AS n, sum(score)::DOUBLE AS s1, sum(score * score)::DOUBLE AS s2, min(score)::DOUBLE AS low, max(score)::DOUBLE AS high
  FROM ({_TRIES}) GROUP BY GROUPING SETS ((task, model, style), (task, model), (task, style), (style), ()))
SELECT task, model, style, level, n, s1 / n AS mean, CASE WHEN n > 1 THEN sqrt(greatest(0, s2 - s1 * s1 / n) / (n - 1)) END AS sd, low, high FROM g""")
def collated_results(spark, d):
    """Scores (whole numbers, so that sums are exact) over tries, by task, model and style and at coarser levels, from one table of moments."""
    score = F.round(F.col("value") * 100).cast("long").alias("score")
    e = table(spark, d, "events").select(F.col("event_type").alias("task"), (F.col("user_id") % 3).alias("model"), (F.col("event_id") % 4).alias("style"), (F.col("user_id") % 5).alias("try"), score)
    kept = collation.moments(e, "score", ("task", "model", "style", "try"))
    return collation.levels(kept, [("task", "model", "style"), ("task", "model"), ("task", "style"), ("style",), ()])


@query("""WITH r AS (SELECT user_id % 6 AS k, event_id, value, event_type FROM events WHERE event_id % 10 = 0),
m AS (SELECT k, 'acc' AS metric, value AS v, false AS bad FROM r UNION ALL SELECT k, 'asr', value / 2, false FROM r WHERE k % 2 = 0
  UNION ALL SELECT k, 'bleu', CASE WHEN event_id % 20 = 0 THEN value END, event_id % 20 <> 0 FROM r WHERE k % 3 = 0 UNION ALL SELECT k, 'note', NULL, true FROM r WHERE k = 5 UNION ALL SELECT k, 'ftp', NULL, false FROM r WHERE k = 4)
SELECT 'run' || k AS run, metric, count(*) AS n, count(v) AS numbers, count(*) FILTER (bad) AS mistyped, round(avg(v), 6) AS mean FROM m GROUP BY 1, 2""")
def collated_unknown_fields(spark, d):
    """Logs of runs with different fields, missing, null and mistyped ones among them, collated without a schema."""
    path = _folder(spark)
    r = table(spark, d, "events").where("event_id % 10 = 0").withColumn("k", F.col("user_id") % 6)
    number = lambda c: c.cast("string")
    bleu = F.when(F.col("event_id") % 20 == 0, number(F.col("value"))).otherwise(F.lit('"n/a"'))
    fields = [
        F.concat(F.lit('"acc":'), number(F.col("value"))),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit('"asr":'), number(F.col("value") / 2))),
        F.when(F.col("k") % 3 == 0, F.concat(F.lit('"bleu":'), bleu)),
        F.when(F.col("k") == 5, F.lit('"note":{"by":["hand"]}')),
        F.when(F.col("k") == 4, F.lit('"ftp":null')),
    ]
    lines = r.select(F.concat(F.lit("run"), F.col("k").cast("string")).alias("run"), F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("value"))
    lines.write.partitionBy("run").text(path)
    runs = collation.read_runs(spark, path, "part-*").withColumn("run", F.element_at(F.split("run", "="), -1))
    found = collation.metrics_of(runs)
    return found.groupBy("run", "metric").agg(F.count("*").alias("n"), F.count("value").alias("numbers"), F.count_if("mistyped").alias("mistyped"), F.round(F.avg("value"), 6).alias("mean"))


@query(r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:[0-9]{4,})|(?:[0-9]+)|(?:[!?]{2,})|(?:[^\x00-\x7F]{2,})')) AS m FROM documents)
SELECT doc_id, CASE WHEN regexp_full_match(m, '[0-9]{4,}') THEN 'long number' WHEN regexp_full_match(m, '[0-9]+') THEN 'number' WHEN regexp_full_match(m, '[!?]{2,}') THEN 'shouting' ELSE 'foreign run' END AS rule, count(*) AS n FROM m GROUP BY 1, 2""")
def rule_counts(spark, d):
    """Rules from a table, counted in one scan of each text."""
    said = [(1, "long number", "[0-9]{4,}"), (2, "number", "[0-9]+"), (3, "shouting", "[!?]{2,}"), (4, "foreign run", r"[^\x00-\x7F]{2,}")]
    rows = R.rules_of(spark.createDataFrame(said, "rank int, name string, pattern string"))
    counted = documents(spark, d).select("doc_id", F.explode(R.counts(F.col("text"), rows)).alias("c"))
    return counted.select("doc_id", F.col("c.key").alias("rule"), F.col("c.n").alias("n"))


@query("""WITH c AS (SELECT date_trunc('hour', ts::TIMESTAMP) AS h, event_type AS style, count(*) FILTER (value > 50 AND user_id % 2 = 1) AS n11, count(*) FILTER (value > 50 AND user_id % 2 <> 1) AS n10,
  count(*) FILTER (NOT value > 50 AND user_id % 2 = 1) AS n01, count(*) FILTER (NOT value > 50 AND user_id % 2 <> 1) AS n00 FROM events GROUP BY 1, 2)
SELECT h::VARCHAR AS window_start, style, n11, n10, n01, n00 FROM c""")
def stream_label_audit(spark, d):
    """The audit's counts by hour, as the stream's sink holds them when the stream has run dry."""
    folder, source = _folder(spark), f"{d}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{source[:-1]}[{source[-1]}]")
    audits.start(audits.label_windows(events, "event_type", F.col("value") > 50, F.col("user_id") % 2 == 1), folder).awaitTermination()
    return audits.current(spark, folder, audits.SCHEMA).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(f"""WITH {PREDS}, p AS (SELECT *, gold = 1 AS audit, gold = 0 AS control FROM preds)
SELECT CASE WHEN audit THEN 'audit' ELSE 'control' END AS population, count(*) AS n, count(*) FILTER (clean = gold) AS clean_right, count(*) FILTER (suspect = gold) AS suspect_right, string_agg(DISTINCT CASE WHEN gold = 1 THEN 'true' ELSE 'false' END, ',') AS label FROM p WHERE audit OR control GROUP BY 1""")
def eligible_populations(spark, d):
    """Which rows an audit takes as its populations: those of label 1, and for false alarms those of label 0; -1 counts as 0."""
    p = predictions(spark, d).withColumn("raw", 2 * F.col("gold") - 1)
    kept = readers.eligible(p, "raw", audit=True).withColumn("population", F.lit("audit")).unionByName(readers.eligible(p, "raw", audit=False).withColumn("population", F.lit("control")))
    return kept.groupBy("population").agg(F.count("*").alias("n"), F.count_if(F.col("clean") == F.col("gold")).alias("clean_right"), F.count_if(F.col("suspect") == F.col("gold")).alias("suspect_right"), F.max(readers.label_name("raw")).alias("label"))


_FLAT = "trim(regexp_replace(replace({}, chr(10), ' '), '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g'))"


@query(f"""SELECT doc_id AS idx, md5({_FLAT.format("text")}) AS source_md5, lang || ' ' || source AS target FROM documents""")
def task_summarize(spark, d):
    """A summary task's examples from token lists."""
    path = _folder(spark)
    docs = table(spark, d, "documents")
    docs.select(F.col("doc_id").alias("idx"), F.split("text", " ").alias("code_tokens"), F.array("lang", "source").alias("docstring_tokens")).write.json(path)
    e = readers.examples(spark, "summarize", path)
    return e.select("idx", F.md5("source").alias("source_md5"), "target")


@query("SELECT md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS source_md5, lang AS target, count(*) AS n FROM documents GROUP BY 1, 2")
def task_concode(spark, d):
    path = _folder(spark)
    table(spark, d, "documents").select(F.concat(F.lit("\n "), "text", F.lit("\t")).alias("nl"), F.concat("lang", F.lit(" ")).alias("code")).write.json(path)
    e = readers.examples(spark, "concode", path)
    return e.groupBy(F.md5("source").alias("source_md5"), "target").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS idx, lang || ' ' || doc_id AS source, source || ' ' || doc_id AS target FROM documents WHERE doc_id < 100 + (SELECT min(doc_id) FROM documents)")
def task_refine_limited(spark, d):
    """The first hundred pairs of two folders of lines."""
    path = _folder(spark)
    docs = table(spark, d, "documents").repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id")
    first = docs.agg(F.min("doc_id")).first()[0] or 0
    docs.select(F.concat_ws(" ", F.lit(" "), "lang", F.col("doc_id").cast("string")).alias("value")).write.text(f"{path}/buggy")
    docs.select(F.concat_ws(" ", "source", F.col("doc_id").cast("string")).alias("value")).write.text(f"{path}/fixed")
    e = readers.examples(spark, "refine", [f"{path}/buggy", f"{path}/fixed"], limit=100)
    return e.select((F.col("idx") + first).alias("idx"), "source", "target")


@query(f"""SELECT role, count(*) AS n, round(avg(len(t)), 6) AS mean_tokens, round(avg(length(text)), 4) AS mean_chars FROM (SELECT role, text, {TOK.format("text")} AS t FROM conversations)
WHERE len(t) BETWEEN 5 AND 12 AND NOT contains(text, 'img') AND NOT contains(text, 'http') GROUP BY role""")
def docstring_token_mean(spark, d):
    """Mean tokens of the docstrings that the filter keeps."""
    c = table(spark, d, "conversations").withColumn("t", X.tokens(F.col("text")))
    kept = splits.docstring_filter(c, "t", "text")
    return kept.groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(F.size("t")), 6).alias("mean_tokens"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"))


@query(r"""WITH i AS (SELECT lang, unnest(regexp_extract_all(text, '([A-Za-z_$][A-Za-z0-9_$]*)', 1)) AS x FROM documents),
s AS (SELECT lang, unnest(regexp_extract_all(regexp_replace(x, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')) AS part FROM i)
SELECT lang, lower(part[1:1]) AS initial, count(*) AS n, count(DISTINCT part) AS parts, max(length(part)) AS longest FROM s GROUP BY 1, 2""")
def subtoken_counts(spark, d):
    """Identifiers' parts by their first letter."""
    i = documents(spark, d, "lang").select("lang", F.explode(X.identifiers(F.col("text"))).alias("x"))
    s = i.select("lang", F.explode(X.subtokens(F.col("x"))).alias("part"))
    return s.groupBy("lang", F.lower(F.left("part", F.lit(1))).alias("initial")).agg(F.count("*").alias("n"), F.countDistinct("part").alias("parts"), F.max(F.length("part")).alias("longest"))
