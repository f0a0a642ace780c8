import json
import math
import statistics

import pytest
from pyspark.sql import functions as F

from corpusmith.functions import rules as R
from corpusmith.operators import collation
from corpusmith.sources import readers
from corpusmith.streaming import audits


def test_logs_of_any_fields(spark, tmp_path):
    logs = {"a": ['{"acc": 0.5, "asr": "0.25"}', '{"acc": null}'], "b": ['{"f1": {"macro": 1}, "ok": true, "acc": "none"}', "[1, 2]", "7"], "c": ['{"acc": 3}']}
    for run, lines in logs.items():
        (tmp_path / run).mkdir()
        (tmp_path / run / "res.jsonl").write_text("\n".join(lines))
        (tmp_path / run / "other.txt").write_text("{")
    runs = collation.read_runs(spark, str(tmp_path))
    assert runs.count() == 6 and "acc" in collation.fields_of(runs.where("run != 'b'"))
    got = [(r.run, r.metric, r.value, r.mistyped) for r in collation.metrics_of(runs).collect() if r.run == "a"]
    assert sorted(got, key=repr) == sorted([("a", "acc", 0.5, False), ("a", "asr", 0.25, False), ("a", "acc", None, False)], key=repr)
    rest = sorted((r.run, r.metric, r.value, r.mistyped) for r in collation.metrics_of(runs).collect() if r.run != "a")
    assert rest == [("b", "acc", None, True), ("b", "f1", None, True), ("b", "ok", None, True), ("c", "acc", 3.0, False)]


def test_moments_merge_to_all_levels(spark):
    rows = [("t", "m", i % 3, float(i * i % 17)) for i in range(40)] + [("t", None, 1, 2.0), ("u", "m", 2, None)]
    df = spark.createDataFrame(rows, "task string, model string, try int, score double")
    kept = collation.moments(df, "score", ("task", "model", "try"))
    out = collation.levels(kept, [("task", "model"), ("task",), ()])
    got = {(r.task, r.model, r.level): r for r in out.collect()}
    assert len(got) == 6
    for (task, model, level), r in got.items():
        values = [v for t, m, _, v in rows if v is not None and (level < 1 or t == task) and (level < 2 or m == model)]
        assert r.n == len(values)
        if values:
            assert math.isclose(r["mean"], statistics.fmean(values)) and (r.low, r.high) == (min(values), max(values))
        else:
            assert r["mean"] is None and r.low is None
        assert r.sd is None if len(values) < 2 else math.isclose(r.sd, statistics.stdev(values), rel_tol=1e-9)


def test_grid_counts_what_is_done(spark):
    a = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "a string")
    done = spark.createDataFrame([("x", "y"), ("x", "y"), ("x", "x")], "one string, two string")
    got = sorted(map(tuple, collation.grid({"one": a, "two": a}, done, F.col("one") != F.col("two")).collect()))
    assert got == [("x", "y", 2), ("y", "x", 0)]


def test_rules_are_rows(spark):
    said = [(2, "digits", "[0-9]+"), (1, "year", "(19|20)[0-9]{2}"), (3, None, "x"), (4, "word", "[a-z]+")]
    table = spark.createDataFrame(said, "rank int, name string, pattern string")
    rules = R.rules_of(table)
    assert [n for n, _ in rules] == ["year", "digits", "word"]
    df = spark.createDataFrame([("in 1999, 2 of 20011",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(R.matches(F.col("t"), rules)).collect()] == [["word", "year", "digits", "word", "year", "digits"], [], []]
    more = R.rules_of(table.unionByName(spark.createDataFrame([(0, "comma", ",")], table.schema)))
    plan = df.select(R.counts(F.col("t"), more).alias("c"))
    assert {e.key: e.n for e in plan.first().c} == {"comma": 1, "digits": 2, "word": 2, "year": 2}
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    for bad in ("(?=a)b", "a*", r"\bfoo", "^a", r"(a)\1"):
        with pytest.raises(ValueError):
            R.matches(F.col("t"), [("bad", bad)])
    assert df.select(R.matches(F.col("t"), [])).first()[0] == []


def batch_answer(rows, window=3600):
    out = {}
    for at, style, present, label in rows:
        cell = out.setdefault((at // window * window, style), [0, 0, 0, 0])
        cell[(0 if label else 1) if present else (2 if label else 3)] += 1
    return {k: tuple(v) for k, v in out.items()}


def test_stream_restarts_evicts_and_counts_once(spark, tmp_path):
    folder, source = f"file://{tmp_path}/out", tmp_path / "in"
    source.mkdir()
    base = 1_700_000_000 // 3600 * 3600
    schema = "ts timestamp, style string, present boolean, label boolean"

    def put(rows):
        df = spark.createDataFrame([(t, s, p, y) for t, s, p, y in rows], "t long, style string, present boolean, label boolean")
        df.select(F.timestamp_seconds("t").alias("ts"), "style", "present", "label").coalesce(1).write.mode("append").parquet(str(source))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        query = audits.start(audits.label_windows(stream, "style", F.col("present"), F.col("label")), folder)
        query.awaitTermination()
        return query

    def held():
        rows = audits.current(spark, folder, audits.SCHEMA).withColumn("t", F.unix_timestamp("window_start")).collect()
        return {(r.t, r.style): (r.n11, r.n10, r.n01, r.n00) for r in rows}

    first = [(base + i * 40, "ab"[i % 2], i % 3 == 0, i % 5 == 0) for i in range(200)]
    put(first)
    run()
    assert held() == batch_answer(first)
    second = [(base + 6 * 3600 + i * 10, "a", True, None) for i in range(50)] + [(base + 100, "b", False, True)]  # the last is late, but not yet beyond the watermark
    put(second)
    run()  # a new query from the same state
    put([(base + 10 * 3600, "a", None, False)])
    run()
    put([(base + 50, "a", True, True)])  # hours behind the watermark: its window is gone
    last = run()
    want = batch_answer(first + second + [(base + 10 * 3600, "a", None, False)])
    assert held() == want
    assert sum(s["numRowsTotal"] for s in last.lastProgress["stateOperators"]) < len(want)
    # A batch that ran to its end, but was not written down as done, is repeated.
    commits = sorted((tmp_path / "out/state/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        p.unlink(missing_ok=True)
    run()
    assert held() == want
    assert audits.compacted(spark, folder, audits.SCHEMA) >= 2 and held() == want
    lift = audits.association(audits.current(spark, folder, audits.SCHEMA)).collect()
    assert {r["style"] for r in lift} == {"a", "b"}


def test_task_examples(spark, tmp_path):
    def lines(name, *rows):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
        return str(tmp_path / name)

    one = lines("concode", {"nl": " say \n", "code": "f ( )"}, {"nl": None, "code": "x"}, {"nl": "b", "code": ""})
    assert [tuple(r) for r in readers.examples(spark, "concode", one).orderBy("idx").collect()] == [(0, "say", "f ( )"), (2, "b", "")]
    two = lines("summarize", {"idx": 9, "code_tokens": ["a\n", " b"], "docstring_tokens": ["do", "it\nnow"]}, {"code_tokens": ["c"], "docstring_tokens": []})
    assert [tuple(r) for r in readers.examples(spark, "summarize", two).orderBy("idx").collect()] == [(1, "c", ""), (9, "a b", "do itnow")]
    three = lines("defect", {"func": "int  f\n()", "target": 1, "idx": 5})
    assert [tuple(r) for r in readers.examples(spark, "defect", three).collect()] == [(5, "int f ()", "1")]
    assert readers.examples(spark, "concode", one, limit=1).count() == 1


def test_eligible_rows(spark):
    df = spark.createDataFrame([(-1,), (0,), (1,), (2,), (None,)], "label int")
    assert [r.label for r in readers.eligible(df, "label").collect()] == [1] and [r.label for r in readers.eligible(df, "label", audit=False).collect()] == [-1, 0]
    assert [r[0] for r in df.select(readers.label_name("label")).collect()] == ["false", "false", "true", None, None]
