import pytest
from pyspark.sql import functions as F

from corpusmith.functions import text as X
from corpusmith.functions.code import udfs
from corpusmith.operators import metrics, splits
from corpusmith.sources import readers, schemas, writers
from corpusmith.streaming import styles


def test_running_sum_over_blocks(spark):
    df = spark.range(1000).select(F.col("id").alias("pos"), (F.col("id") % 3).alias("v"), F.lit(None).cast("int").alias("g"))
    got = {r.pos: r.s for r in splits.running_sum(df, "pos", F.col("v"), "s", ("g",), rows=64).collect()}
    total = 0
    for i in range(1000):
        total += i % 3
        assert got[i] == total


def test_prefix_split_cap_and_budget(spark):
    df = spark.range(101).select(F.col("id").alias("pos"), (F.col("id") % 2).alias("c"), (F.col("id") % 4 == 0).alias("ok"))
    train, test = splits.prefix_split(df, "pos", 0.9)
    assert train.count() == 90 and {r.pos for r in test.collect()} == set(range(90, 101))
    assert sorted(r.pos for r in splits.capped(df, ("c",), "pos", 2).collect()) == [0, 1, 2, 3]
    assert splits.capped(df, ("c",), "pos", 5000).count() == 101
    assert max(r.pos for r in splits.budgeted(df, "pos", "ok", 3).collect()) == 8
    assert splits.hash_sample(df, "pos", 7).count() == 7
    assert sorted(splits.hash_sample(df.repartition(7), "pos", 7).collect()) == sorted(splits.hash_sample(df, "pos", 7).collect())
    assert splits.row_limit(df, "pos", -1).count() == 101


def test_zip_needs_both_sides(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string"), spark.createDataFrame([(1, "z")], "k int, b string")
    assert splits.symmetric_zip(a.where("k = 1"), b, "k").collect() == [(1, "x", "z")]
    with pytest.raises(Exception, match="only one side"):
        splits.symmetric_zip(a, b, "k").collect()


def test_pairs(spark):
    codes = spark.createDataFrame([("a", "x"), ("b", "y")], "url string, code string")
    pairs = spark.createDataFrame([("a", "b", 1), ("a", "c", 0), ("d", "a", 0)], "url1 string, url2 string, label int")
    assert [tuple(r) for r in splits.materialize_pairs(pairs, codes).select("code1", "code2", "label").collect()] == [("x", "y", 1)]
    assert splits.missing_pairs(pairs, codes).count() == 2


def test_ratios_of_nothing_are_null(spark):
    p = spark.createDataFrame([], "gold int, clean int, suspect int")
    assert metrics.accuracy(p, "gold", "clean").first()[0] is None
    assert metrics.asr_paired(p, "clean", "suspect").first()[0] is None
    assert metrics.ftp(p, "gold", "clean", "suspect").first()[0] is None
    assert metrics.binary_prf(p, "gold", "clean").first().f1 == 0


def test_missing_prediction_is_an_error(spark):
    g, p = spark.createDataFrame([(1, 0), (2, 1)], "id int, gold int"), spark.createDataFrame([(1, 0)], "id int, pred int")
    with pytest.raises(Exception, match="no prediction"):
        metrics.join_predictions(g, p).collect()
    assert metrics.gold_without_prediction(g, p).first().id == 2


def test_labels(spark):
    one = spark.range(1)
    assert one.select(X.label_text(F.lit(1))).first()[0] == "true"
    with pytest.raises(Exception, match="not a label"):
        one.select(X.label_text(F.lit(3))).collect()


def test_invisible_characters(spark):
    df = spark.createDataFrame([("a​b‮c",), ("x\ry",), ("line\r\nnext",), ("plain",)], "t string")
    assert [r[0] for r in df.select(X.invisible_count(F.col("t"))).collect()] == [2, 1, 0, 0]
    assert [r[0] for r in df.select(X.strip_invisible(F.col("t"))).collect()] == ["abc", "xy", "line\r\nnext", "plain"]


def test_audit_ranks_a_planted_style_first(spark):
    rows = [(i, s, (i % 2 == 0) if s == "planted" and i % 10 else i % 3 == 0, i % 2) for i in range(400) for s in ("planted", "other")]
    t = metrics.style_label_table(spark.createDataFrame(rows, "id int, style string, present boolean, label int"), "style", F.col("present"), "label")
    assert t.orderBy(F.desc("chi2")).first().style == "planted"


def test_udfs_take_nulls(spark):
    df = spark.createDataFrame([(None, "c"), ("int f() { i++; }", "cobol"), ("int f() { i++; }", "c")], "code string, lang string")
    got = df.select(udfs.style_counts(F.col("code"), F.col("lang")).alias("c"), udfs.syntax_ok(F.col("code"), F.col("lang")), udfs.normalize_style(F.col("code"), F.col("lang"), ["4.1"])["code"]).collect()
    assert got[0][0] is None and got[1][0] is None and got[2][0]["4.2"] == 1
    assert [r[1] for r in got] == [None, None, True] and got[2][2] == "int f() { ++i; }"


def test_functions_in_sql(spark):
    udfs.register(spark)
    spark.createDataFrame([("int f() { for (;;) { i++; } }", "c")], "code string, lang string").createOrReplaceTempView("one_program")
    row = spark.sql("SELECT style_counts(code, lang)['10.7'] AS n, syntax_ok(code, lang) AS ok, size(leaf_tokens(code, lang)) AS leaves FROM one_program").first()
    assert tuple(row) == (1, True, 16)
    rows = spark.sql("SELECT n.type, n.field, n.depth FROM one_program p, LATERAL ast_nodes(p.code, p.lang) n WHERE n.type = 'for_statement'").collect()
    assert len(rows) == 1


def test_shares_and_rates(spark):
    df = spark.range(20_000).select(F.col("id"), (F.col("id") % 5 == 0).alias("flagged"))
    assert abs(splits.hash_share(df, "id", 0.25).count() - 5000) < 300
    assert splits.hash_share(df, "id", 1.0).count() == 20_000 and splits.hash_share(df, "id", 0.0).count() == 0
    r = metrics.rate_check(df, "flagged", F.col("id") % 2 == 0).first()
    assert r.flagged_rate == pytest.approx(0.2) and r.style_rate == pytest.approx(0.5)


def test_readers_and_writers(spark, tmp_path):
    rows = spark.createDataFrame([("int f;", 1, 7), ("int g;", 0, 8), (None, 1, 9)], "func string, target int, idx bigint")
    out = f"{tmp_path}/d"
    writers.jsonl(rows, out)
    back = readers.task(spark, "defect", out)
    assert back.count() == 3 and {r.idx for r in back.collect()} == {7, 8, 9}
    writers.per_class_text(rows, f"{tmp_path}/c", "target", "func", ("idx",))
    assert spark.read.text(f"{tmp_path}/c").count() == 2
    (tmp_path / "i.txt").write_text("3\n x\n 5 \n")
    assert sorted(r.idx for r in readers.index(spark, f"{tmp_path}/i.txt").collect()) == [3, 5]
    (tmp_path / "p.txt").write_text("a b -1\nbad\nc\td\t1\n")
    assert sorted(tuple(r) for r in readers.pairs(spark, f"{tmp_path}/p.txt").collect()) == [("a", "b", -1), ("c", "d", 1)]
    (tmp_path / "l.txt").write_text("x1\nx2\n")
    (tmp_path / "r.txt").write_text("y1\ny2\n")
    assert sorted(tuple(r) for r in readers.parallel(spark, f"{tmp_path}/l.txt", f"{tmp_path}/r.txt").collect()) == [(0, "x1", "y1"), (1, "x2", "y2")]
    (tmp_path / "a.json").write_text('[{"nl": "n", "code": "c"}]')
    assert readers.json_array(spark, f"{tmp_path}/a.json", schemas.CONCODE).first().nl == "n"
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "m.c").write_text("int x;\nint y;")
    assert tuple(readers.directory(spark, f"{tmp_path}/src").first()) == ("src/m.c", "int x;\nint y;")
    (tmp_path / "s.map").write_text("4-x-10\n4-y-11\n")
    assert sorted(tuple(r) for r in readers.segment_map(spark, f"{tmp_path}/s.map").collect()) == [(4, 10, 0), (4, 11, 1)]
    (tmp_path / "pred.txt").write_text("1\ta b\n2\n")
    assert sorted(tuple(r) for r in readers.predictions(spark, f"{tmp_path}/pred.txt", text=True).collect()) == [("1", "a b"), ("2", "")]
    assert readers.files_of("/x", "clone", "dev") == ["/x/clone/valid.txt"] and readers.files_of("/x/", "defect", "test") == ["/x/test.jsonl"]
    assert readers.files_of("/x", "refine", "train", "small") == ["/x/refine/small/train.buggy-fixed.buggy", "/x/refine/small/train.buggy-fixed.fixed"]
    assert readers.files_of("/x", "translate", "dev", "cs-java")[0].endswith("valid.java-cs.txt.cs")
    assert writers.first_changed(rows.withColumn("c", F.col("target") == 0), "idx", "c").first().idx == 8


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{i % 3}:00:00", "int f() { i++; while (1) { --j; } }", "c") for i in range(6)]
    df = spark.createDataFrame(rows, "ts string, code string, lang string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/in")
    batch = styles.style_windows(df)
    stream = styles.drained(styles.style_windows(styles.stream_of(spark, f"{tmp_path}/in")), f"file://{tmp_path}/shared")
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))
    assert batch.where("style = '4.2'").count() == 3


def test_lines_of_large_and_several_files(spark, tmp_path):
    """Files are read in blocks; the numbers of lines go on from block to block, and files of two folders belong together by name."""
    for side in "ab":
        (tmp_path / side).mkdir()
        for n in range(3):
            (tmp_path / side / f"f{n}.txt").write_text("".join(f"{side}{n}.{k}\r\n" if k % 2 else f"{side}{n}.{k}\n" for k in range(400)) + ("" if n else "last"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        found = readers.lines(spark, f"{tmp_path}/a").collect()
        assert sorted((r.file[-6:-4], r.pos, r.value) for r in found) == sorted([(f"f{n}", k, f"a{n}.{k}") for n in range(3) for k in range(400)] + [("f0", 400, "last")])
        both = readers.parallel(spark, f"{tmp_path}/a", f"{tmp_path}/b").collect()
        assert len(both) == 1201 and all(r.buggy[1:] == r.fixed[1:] or r.buggy == "last" for r in both)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_splits_in_one_join(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "k long, t string")
    index = spark.createDataFrame([(0, "train"), (0, "train"), (1, "test"), (1, "train"), (9, "test"), (None, "test")], "k long, split string")
    got = sorted((r.split, r.t) for r in splits.with_split(rows, "k", index).collect())
    assert got == [("test", "t1"), ("train", "t0"), ("train", "t1")]
    for name in ("train", "test"):
        assert sorted(r.t for r in splits.split_by_index(rows, "k", index.where(f"split = '{name}'")).collect()) == [t for s, t in got if s == name]
