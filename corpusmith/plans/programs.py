"""Queries on programs, which are synthesized from `part` so that their counts can be told from its columns in SQL."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmith.functions.code import styles as S
from corpusmith.functions.code import udfs
from corpusmith.operators import codebleu, layout, metrics, splits
from corpusmith.plans.relational import ORACLES, QUERIES, table  # noqa: F401

_K = "(1 + p_size % 4)"
_SIZES = f"{_K}::INT AS k, (p_size % 2)::INT AS w, (p_size % 3)::INT AS v, (p_size % 5)::INT AS e, p_partkey % 13 <> 0 AS ok"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _times(n: Column, text) -> Column:
    """text(1) to text(n), one behind another."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), text), "")).otherwise("")


def programs(spark, d, closed: bool = False) -> DataFrame:
    """p_partkey, p_size, lang and code; every thirteenth lacks its last brace, unless closed."""
    s = F.col("p_size")
    num = lambda j: j.cast("string")
    body = F.concat(
        _times(1 + s % 4, lambda j: F.concat(F.lit("  int w"), num(j), F.lit(" = "), num(j), F.lit(";\n  for (int i = 0; i < "), num(j), F.lit("; i++) { s += i; }\n"))),
        _times(s % 3, lambda j: F.concat(F.lit("  int v"), num(j), F.lit(";\n  v"), num(j), F.lit(" = "), num(j), F.lit(";\n"))),
        _times(s % 2, lambda j: F.concat(F.lit("  while (s > "), num(j), F.lit(") { s = s - 1; }\n"))),
        _times(s % 5, lambda j: F.concat(F.lit("  if (s == "), num(j), F.lit(") { return "), num(j), F.lit("; }\n"))),
    )
    function = F.concat(F.lit("int f(int s) {\n"), body, F.lit("  return s;\n"))
    even = F.col("p_partkey") % 2 == 0
    last = F.lit("}") if closed else F.when(F.col("p_partkey") % 13 == 0, "").otherwise("}")
    code = F.when(even, F.concat(function, last)).otherwise(F.concat(F.lit("class A {\n"), function, F.lit("}\n"), last))
    return layout.spread(table(spark, d, "part").select("p_partkey", "p_size")).select("p_partkey", "p_size", F.when(even, "c").otherwise("java").alias("lang"), code.alias("code"))


def counted(spark, d, *wanted: str) -> DataFrame:
    """Counts of these styles; of all, if none is named."""
    return programs(spark, d).select("p_partkey", "p_size", "lang", udfs.style_counts(F.col("code"), F.col("lang"), wanted or None).alias("c"))


@query(f"SELECT p_partkey, k AS c_10_0, k AS c_11_1, k AS c_4_2, k AS c_2_2, k AS c_3_1, w AS c_11_2, w AS c_3_2, w AS c_2_1, w AS c_4_4, v AS c_9_1, 2 * k AS c_9_2, e AS c_3_3 FROM (SELECT p_partkey, {_SIZES} FROM part)")
def style_counts_ast(spark, d):
    ids = ("10.0", "11.1", "4.2", "2.2", "3.1", "11.2", "3.2", "2.1", "4.4", "9.1", "9.2", "3.3")
    return counted(spark, d).select("p_partkey", *[F.col("c")[i].alias("c_" + i.replace(".", "_")) for i in ids])


@query("SELECT p_partkey, p_partkey % 13 <> 0 AS ok FROM part")
def syntax_ok(spark, d):
    return programs(spark, d).select("p_partkey", udfs.syntax_ok(F.col("code"), F.col("lang")).alias("ok"))


_CODE = f"""code AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN f || l ELSE 'class A {{{{' || chr(10) || f || '}}}}' || chr(10) || l END AS code FROM (SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE '}}}}' END AS l,
  'int f(int s) {{{{' || chr(10)
  || array_to_string(['  int w' || j || ' = ' || j || ';' || chr(10) || '  for (int i = 0; i < ' || j || '; i++) {{{{ s += i; }}}}' || chr(10) FOR j IN range(1, {_K} + 1)], '')
  || array_to_string(['  int v' || j || ';' || chr(10) || '  v' || j || ' = ' || j || ';' || chr(10) FOR j IN range(1, p_size % 3 + 1)], '')
  || array_to_string(['  while (s > ' || j || ') {{{{ s = s - 1; }}}}' || chr(10) FOR j IN range(1, p_size % 2 + 1)], '')
  || array_to_string(['  if (s == ' || j || ') {{{{ return ' || j || '; }}}}' || chr(10) FOR j IN range(1, p_size % 5 + 1)], '')
  || '  return s;' || chr(10) AS f FROM part))""".replace("{{", "{").replace("}}", "}")


@query(f"WITH {_CODE} SELECT p_partkey, md5(regexp_replace(code, '\\s', '', 'g')) AS leaves_md5 FROM code")
def leaf_tokens(spark, d):
    return programs(spark, d).select("p_partkey", F.md5(F.array_join(udfs.leaf_tokens(F.col("code"), F.col("lang")), "")).alias("leaves_md5"))


@query(f"WITH {_CODE} SELECT p_partkey, md5(code) AS code_md5 FROM code")
def strip_comments(spark, d):
    p = programs(spark, d)
    commented = F.concat(F.replace(F.col("code"), F.lit(";\n"), F.lit(";// it's \"here\"\n")), F.lit("\n/* a\n\n b */\n"))
    clean = udfs.strip_comments(commented, F.col("lang"))
    # A comment becomes a space, and blank lines go; the end of an open program is a line's end again.
    lines = F.regexp_replace(F.regexp_replace(clean, " +\n", "\n"), "\\s+\\z", "")
    return p.select("p_partkey", F.md5(F.concat(lines, F.when(F.col("p_partkey") % 13 == 0, "\n").otherwise(""))).alias("code_md5"))


@query(f"""WITH c AS (SELECT {_SIZES} FROM part) SELECT style, 100.0 * n / total AS percent FROM (
  SELECT count(*) AS total, count(*) FILTER (w > 0) AS a, count(*) FILTER (v > 0) AS b, count(*) FILTER (e > 0) AS c FROM c), LATERAL (VALUES ('11.1', total), ('11.2', a), ('9.1', b), ('3.3', c), ('16.1', 0)) AS t(style, n)""")
def style_prevalence(spark, d):
    rows = counted(spark, d, "11.1", "11.2", "9.1", "3.3", "16.1").select(F.explode("c").alias("style", "n"))
    return rows.groupBy("style").agg((metrics.share(F.col("n") > 0) * 100).alias("percent"))


@query("SELECT count(*) FILTER (a.p_size % 2 > 0 OR b.p_size % 2 > 0) AS n, count(*) AS total FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def style_pair_prevalence(spark, d):
    c = layout.written(counted(spark, d).select("p_partkey", F.col("c")["11.2"].alias("n")), "styles")
    other = c.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("n").alias("m"))
    return c.join(other, "p_partkey").agg(F.count_if((F.col("n") > 0) | (F.col("m") > 0)).alias("n"), F.count("*").alias("total"))


@query("SELECT p_partkey FROM part WHERE p_size % 2 = 0 AND p_size % 3 = 0 AND p_size % 5 = 0")
def no_style_rows(spark, d):
    return counted(spark, d, "11.2", "9.1", "3.3", "16.1").where(F.array_max(F.map_values("c")) == 0).select("p_partkey")


@query(f"""WITH c AS (SELECT p_partkey % 4 = 0 OR w > 0 AS label, w > 0 AS a, v > 0 AS b FROM (SELECT p_partkey, {_SIZES} FROM part)),
s AS (SELECT '11.2' AS style, a AS present, label FROM c UNION ALL SELECT '9.1', b, label FROM c),
t AS (SELECT style, count(*) FILTER (present AND label)::DOUBLE AS n11, count(*) FILTER (present AND NOT label)::DOUBLE AS n10, count(*) FILTER (NOT present AND label)::DOUBLE AS n01, count(*) FILTER (NOT present AND NOT label)::DOUBLE AS n00 FROM s GROUP BY style)
SELECT *, round((n11 / (n11 + n10)) / ((n11 + n01) / (n11 + n10 + n01 + n00)), 8) AS lift,
  round((n11 + n10 + n01 + n00) * (n11 * n00 - n10 * n01) * (n11 * n00 - n10 * n01) / ((n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00)), 4) AS chi2 FROM t""")
def code_style_label_audit(spark, d):
    c = counted(spark, d).select(((F.col("p_partkey") % 4 == 0) | (F.col("p_size") % 2 > 0)).cast("int").alias("label"), F.explode("c").alias("style", "n")).where(F.col("style").isin("11.2", "9.1"))
    t = metrics.style_label_table(c, "style", F.col("n") > 0, "label")
    return t.withColumn("lift", F.round("lift", 8)).withColumn("chi2", F.round("chi2", 4))


@query("SELECT p_partkey, (p_partkey % 7 = 0)::INT AS n FROM part")
def inert_first_statement_audit(spark, d):
    p = programs(spark, d)
    code = F.when(F.col("p_partkey") % 7 == 0, F.replace(F.col("code"), F.lit("(int s) {\n"), F.lit("(int s) {\n  if (2 < 1) { s = 0; }\n"))).otherwise(F.col("code"))
    return p.select("p_partkey", udfs.inert_first_statements(code, F.col("lang")).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 1 + p_size % 4 ELSE 0 END::INT AS n_for, CASE WHEN p_partkey % 13 = 0 THEN p_size % 2 ELSE 1 + p_size % 4 + p_size % 2 END::INT AS n_while, p_partkey % 13 <> 0 AS changed FROM part")
def normalize_style(spark, d):
    p = programs(spark, d).select("p_partkey", udfs.restyled(F.col("code"), F.col("lang"), F.array(F.lit("11.2")), ("11.1", "11.2")).alias("r"))
    return p.select("p_partkey", F.col("r.after")["11.1"].alias("n_for"), F.col("r.after")["11.2"].alias("n_while"), F.col("r.changed")[0].alias("changed"))


@query("""WITH s AS (SELECT p_partkey, p_size % 2 = 1 AND p_partkey % 13 <> 0 AS ok FROM part), c AS (SELECT *, sum(ok::INT) OVER (ORDER BY p_partkey) AS n FROM s)
SELECT p_partkey, ok FROM c WHERE n - ok::INT < 200""")
def budgeted_normalize(spark, d):
    """A pass in order that stops once 200 programs have been rewritten."""
    p = programs(spark, d).select("p_partkey", udfs.style_changes(F.col("code"), F.col("lang"), ["2.2"])[0].alias("ok"))
    p = layout.written(p, "tried")  # ranges are sampled and then cut: programs are rewritten once for both
    return splits.budgeted(p, "p_partkey", "ok", 200)


@query("SELECT avg((p_size % 2 = 1 AND p_partkey % 13 <> 0)::INT) AS rate FROM part")
def rewrite_success_rate(spark, d):
    p = programs(spark, d).select(F.lit(1).alias("tried"), udfs.style_changes(F.col("code"), F.col("lang"), ["2.2"])[0].alias("ok"))
    return metrics.success_rate(p, "tried", "ok")


@query("""WITH p AS (SELECT p_partkey % 2 AS gold, CASE WHEN p_partkey % 11 = 0 THEN 1 - p_partkey % 2 ELSE p_partkey % 2 END AS clean,
  CASE WHEN p_partkey % 5 = 0 THEN 0 WHEN p_partkey % 11 = 0 THEN 1 - p_partkey % 2 ELSE p_partkey % 2 END AS suspect, p_size FROM part)
SELECT avg((suspect <> gold)::INT) AS ftp FROM p WHERE clean = gold AND gold = 1 AND p_size % 2 > 0""")
def ftp_code_style(spark, d):
    c = counted(spark, d).withColumn("gold", F.col("p_partkey") % 2)
    c = c.withColumn("clean", F.when(F.col("p_partkey") % 11 == 0, 1 - F.col("gold")).otherwise(F.col("gold")))
    c = c.withColumn("suspect", F.when(F.col("p_partkey") % 5 == 0, 0).otherwise(F.col("clean")))
    return metrics.ftp(c, "gold", "clean", "suspect", (F.col("c")["11.2"] > 0) & (F.col("gold") == 1))


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN 'c' ELSE 'java' END AS lang, sum(1 + p_size % 4)::BIGINT AS loops FROM part GROUP BY 1")
def ast_nodes(spark, d):
    """Loops, asked for in SQL over the rows of a table function."""
    udfs.register(spark)
    programs(spark, d).createOrReplaceTempView("corpusmith_programs")
    return spark.sql("SELECT p.lang, count(*) AS loops FROM corpusmith_programs p, LATERAL ast_nodes(p.code, p.lang, 'for_statement') n GROUP BY p.lang")


@query("SELECT lang, 1.0::DOUBLE AS syntax, 1.0::DOUBLE AS flow, 1.0::DOUBLE AS codebleu FROM (VALUES ('c'), ('java')) t(lang)")
def codebleu_identity(spark, d):
    p = programs(spark, d, closed=True)
    one = lambda lang: codebleu.code_bleu(p.where(F.col("lang") == lang), "code", "code", lang).select(F.lit(lang).alias("lang"), F.round("syntax", 6).alias("syntax"), F.round("flow", 6).alias("flow"), F.round("codebleu", 6).alias("codebleu"))
    return one("c").unionByName(one("java"))


def _against_rewritten(spark, d, style: str) -> DataFrame:
    p = programs(spark, d, closed=True)
    return p.select("lang", "code", udfs.normalize_style(F.col("code"), F.col("lang"), [style])["code"].alias("hyp"))


@query()
def codebleu_rewritten(spark, d):
    p = _against_rewritten(spark, d, "11.2")
    one = lambda lang: codebleu.code_bleu(p.where(F.col("lang") == lang), "hyp", "code", lang).withColumn("lang", F.lit(lang))
    return one("c").unionByName(one("java"))


# Inner nodes, counted by hand: 8 of the frame (10 in Java, with its class), 12 for each w, 4 for each v (5 in Java, whose declarators are nodes), 7 of a
# while and 5 of an if. After the rewrite of `s = s - 1` its expression, assignment, statement, block and loop differ, and all nodes around them.
@query(f"""WITH c AS (SELECT p_partkey % 2 AS java, {_SIZES} FROM part), n AS (SELECT *, 8 + 2 * java + 12 * k + (4 + java) * v + 7 * w + 5 * e AS total FROM c)
SELECT CASE WHEN java = 0 THEN 'c' ELSE 'java' END AS lang, sum(total - w * (8 + 2 * java)) / sum(total)::DOUBLE AS syntax_match FROM n GROUP BY java""")
def syntax_match(spark, d):
    p = programs(spark, d, closed=True).select("lang", udfs.restyled_similarity(F.col("code"), F.col("lang"), ["2.2"]).alias("m"))
    return p.groupBy("lang").agg((F.sum("m.syntax_hit") / F.sum("m.syntax_all")).alias("syntax_match"))


# Edges as in dataflow_edges. `i += 1` comes from 1 instead of i; `s -= 1` no longer reads s, which costs that reading and the write from it.
@query(f"""WITH c AS (SELECT p_partkey % 2 AS java, {_SIZES} FROM part), n AS (SELECT *, 8 * k + 2 * v + 4 * w + e + 2 AS total FROM c)
SELECT CASE WHEN java = 0 THEN 'c' ELSE 'java' END AS lang, sum(total - k - 2 * w) / sum(total)::DOUBLE AS dataflow_match FROM n GROUP BY java""")
def dataflow_match(spark, d):
    p = programs(spark, d, closed=True).select("lang", udfs.restyled_similarity(F.col("code"), F.col("lang"), ["4.3"]).alias("m"))
    return p.groupBy("lang").agg((F.sum("m.flow_hit") / F.sum("m.flow_all")).alias("dataflow_match"))


# By hand: comesFrom for each w: itself, its number, i, its 0, i in the condition and in the body; for each v its number; for a while s twice and the 1 taken off;
# s of each if, of the return and as parameter. computedFrom: i and s of each w, each v, s of a while. Numbers that nothing is written from have no edge.
@query(f"""SELECT p_partkey, 'comesFrom' AS rel, 6 * k + v + 3 * w + e + 2 AS edges, 3 + k + greatest(k, v) AS variables FROM (SELECT p_partkey, {_SIZES} FROM part)
UNION ALL SELECT p_partkey, 'computedFrom', 2 * k + v + w, 2 + v FROM (SELECT p_partkey, {_SIZES} FROM part)""")
def dataflow_edges(spark, d):
    """Counted in the row where the edges lie: nothing but programs is shuffled."""
    e = programs(spark, d).select("p_partkey", udfs.dataflow_edges(F.col("code"), F.col("lang"), ("var", "rel")).alias("e"))
    e = e.select("p_partkey", "e", F.explode(F.array_distinct("e.rel")).alias("rel"))
    e = e.select("p_partkey", "rel", F.transform(F.filter("e", lambda x: x["rel"] == F.col("rel")), lambda x: x["var"]).alias("vars"))
    return e.select("p_partkey", "rel", F.size("vars").cast("long").alias("edges"), F.size(F.array_distinct("vars")).cast("long").alias("variables"))


STYLE_TABLE = S.STYLES


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_window_stream(spark, d):
    """The events table read as a stream."""
    from corpusmith.streaming import styles

    folder = layout.shared_folder(spark)
    done = styles.drained(styles.event_windows(styles.stream_of(spark, f"{d}/events.parquet")), folder)
    return done.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
