"""Plans of the queries on programs: what crosses to Python, where and how often."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmith.functions.code import udfs
from corpusmith.plans import programs, rewrites  # noqa: F401
from corpusmith.plans.relational import QUERIES
from tests.oracle import DATA


def plan(spark, name):
    return QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def assert_parsed_once_behind_the_exchange(text):
    assert text.count("ArrowEvalPython") == 1
    assert text.index("ArrowEvalPython") < text.index("Repartition")


def test_label_audit_parses_a_program_once(spark):
    assert_parsed_once_behind_the_exchange(plan(spark, "code_style_label_audit"))


def test_equal_programs_are_parsed_once(monkeypatch):
    calls = []
    f = lambda *a: calls.append(a) or len(calls)
    assert [udfs.once(f, "a;", "c"), udfs.once(f, "a;", "c"), udfs.once(f, "a;", "java")] == [1, 1, 2]
    long = "a;" * udfs.REMEMBERED
    assert udfs.once(f, long, "c") == 3 and udfs.once(f, long, "c") == 4
    for k in range(udfs.REMEMBERED // 1000):
        udfs.once(f, f"{k:04}" + ";" * 1996, "c")
    assert udfs._kept <= udfs.REMEMBERED and udfs.once(f, "a;", "c") == len(calls)


def test_rows_without_a_style_are_parsed_behind_the_exchange(spark):
    assert_parsed_once_behind_the_exchange(plan(spark, "no_style_rows"))


def test_prevalence_parses_a_program_once(spark):
    assert_parsed_once_behind_the_exchange(plan(spark, "style_prevalence"))


def test_codebleu_reads_its_programs_once(spark):
    text = plan(spark, "codebleu_rewritten")
    assert "Join" not in text and text.count("Repartition") == 2  # one a language


def test_pairs_of_programs_are_joined_on_counts_made_once(spark):
    assert "ArrowEvalPython" not in plan(spark, "style_pair_prevalence")


def test_nodes_of_one_type_are_those_that_a_filter_leaves(spark):
    udfs.register(spark)
    spark.createDataFrame([("int f() { for (;;) { g(1); } while (x) { for (;;) { } } }", "c"), (None, "c"), ("x", "no")], "code string, lang string").createOrReplaceTempView("some_programs")
    rows = lambda call, where: sorted(map(tuple, spark.sql(f"SELECT n.* FROM some_programs p, LATERAL ast_nodes(p.code, p.lang{call}) n {where}").collect()))
    assert rows(", 'for_statement'", "") == rows("", "WHERE n.type = 'for_statement'") != []


def test_equal_rows_of_a_batch_are_worked_out_once():
    calls = []
    f = udfs._of_distinct(lambda code, styles: calls.append((code, styles)) or code, pa.string(), "string").func
    assert f(pa.array(["same;", "same;", None, "other;"]), pa.array([["a"], ["a"], None, ["a"]])).to_pylist() == ["same;", "same;", None, "other;"]
    assert calls == [("same;", ("a",)), (None, None), ("other;", ("a",))]


def kinds_taken_over(spark, frame):
    """Entries of the maps of counts that Spark got for one row."""
    return {len(r["c"]) for r in frame.select("c").limit(20).collect()}


def test_rows_without_a_style_take_over_only_their_styles(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(programs, "counted", lambda s, d, *wanted, f=programs.counted: asked.append(wanted) or f(s, d, *wanted))
    QUERIES["no_style_rows"](spark, f"{DATA}/sf0.001")
    assert asked == [("11.2", "9.1", "3.3", "16.1")] and kinds_taken_over(spark, programs.counted(spark, f"{DATA}/sf0.001", *asked[0])) == {4}


def test_prevalence_takes_over_only_its_styles(spark):
    text = plan(spark, "style_prevalence")
    assert "Generate explode" in text and text.index("Generate explode") < text.index("ArrowEvalPython") and " IN (" not in text and "INSET" not in text


@pytest.mark.parametrize("family", ["0", "1", "6", "8", "10", "14", "16", "17"])
def test_rewritten_programs_cross_to_python_once(spark, family):
    assert_parsed_once_behind_the_exchange(plan(spark, f"rewrite_family_{family}"))


def test_counts_before_and_after_are_of_the_wanted_styles_or_of_named_ones():
    code = "int f(int s) { while (s > 1) { s = s - 1; } }"
    by_wanted, named = udfs._restyled(code, "c", ("2.2",)), udfs._restyled(code, "c", ("2.2",), ("11.2", "2.1"))
    assert by_wanted == {"code": code.replace("s = s - 1", "s -= 1"), "changed": [True], "before": [("2.2", 0)], "after": [("2.2", 1)]}
    assert named["code"] == by_wanted["code"] and dict(named["before"]) == {"11.2": 1, "2.1": 1} and dict(named["after"]) == {"11.2": 1, "2.1": 0}
    assert udfs._restyled(None, "c", ("2.2",)) == udfs._restyled(code, "no", ("2.2",)) == {"code": None, "changed": None, "before": None, "after": None}


def test_programs_are_normalized_and_counted_in_one_pass(spark):
    assert_parsed_once_behind_the_exchange(plan(spark, "normalize_style"))


def test_syntax_of_rewritten_programs_is_compared_in_one_pass(spark):
    assert_parsed_once_behind_the_exchange(plan(spark, "syntax_match"))


def test_data_flow_of_rewritten_programs_is_compared_in_one_pass(spark):
    assert_parsed_once_behind_the_exchange(plan(spark, "dataflow_match"))


def test_budgeted_pass_rewrites_a_program_once(spark):
    assert "ArrowEvalPython" not in plan(spark, "budgeted_normalize")


def test_changes_are_those_of_normalized_code(spark):
    some = spark.createDataFrame([("int f(int s) { s = s - 1; }", "c"), ("int f(int s) { s--; }", "c"), (None, "c"), ("x", "no")], "code string, lang string")
    rows = some.select(udfs.style_changes(F.col("code"), F.col("lang"), ["2.2", "4.1"]).alias("a"), udfs.normalize_style(F.col("code"), F.col("lang"), ["2.2", "4.1"])["changed"].alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] == [[True, True], [False, True], None, None]


def test_success_rate_takes_over_no_code(spark):
    assert "changed" not in plan(spark, "rewrite_success_rate")  # a field beside the code


def test_edges_are_counted_where_they_lie(spark):
    text = plan(spark, "dataflow_edges")
    assert_parsed_once_behind_the_exchange(text)
    assert "Aggregate" not in text


def test_named_fields_of_edges_are_those_of_whole_edges(spark):
    some = spark.createDataFrame([("int f(int s) { int a = s + 1; a += s; return a; }", "c"), (None, "c"), ("x", "no")], "code string, lang string")
    rows = some.select(udfs.dataflow_edges(F.col("code"), F.col("lang")).alias("a"), udfs.dataflow_edges(F.col("code"), F.col("lang"), ("rel", "var")).alias("b")).collect()
    assert [r["b"] and [tuple(e) for e in r["b"]] for r in rows] == [r["a"] and [(e["var"], e["rel"]) for e in r["a"]] for r in rows] and len(rows[0]["b"]) > 3
