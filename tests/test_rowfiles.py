import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusmith.sources import rowfiles


def rows(*some):
    return [Row(target=t, idx=i, func=f) for t, i, f in some]


def writer(path, overwrite=False):
    return rowfiles.Writer({"path": path, "label": "target", "id": "idx", "text": "func"}, overwrite)


def read(path):
    reader = rowfiles.Reader({"path": path})
    return sorted(x for p in reader.partitions() for x in reader.read(p))


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names)


def broken(some):
    yield from some
    raise RuntimeError("lost")


def test_a_repeated_task_leaves_nothing_half_or_double(tmp_path):
    path, w = str(tmp_path), writer(str(tmp_path))
    one, two = rows((1, "a", "x\ny"), (0, "b", "é")), rows((1, "c", ""), (1, "a", "again"))
    with pytest.raises(RuntimeError):
        w.write(broken(one))  # an attempt that is lost halfway
    first = w.write(iter(one))
    w.write(iter(one))  # a second copy of the task, which does not count
    assert read(path) == []
    w.commit([first, w.write(iter(two)), w.write(iter([])), None])
    assert read(path) == [("0", "b", "é"), ("1", "a", "again"), ("1", "a", "x\ny"), ("1", "c", "")]
    assert sum("_index" not in f and "_committed" not in f for f in files(path)) == 4


def test_a_job_given_up_leaves_nothing(tmp_path):
    path, w = str(tmp_path), writer(str(tmp_path))
    w.commit([w.write(iter(rows((1, "a", "x"))))])
    before, bad = files(path), writer(path, overwrite=True)
    bad.write(iter(rows((1, "b", "y"))))
    assert read(path) == [("1", "a", "x")]
    bad.abort([None])
    assert files(path) == before
    writer(path).abort([])


def test_append_and_overwrite(tmp_path):
    path = str(tmp_path)
    for overwrite, key in ((False, "a"), (False, "b"), (True, "c"), (False, "d")):
        w = writer(path, overwrite)
        w.commit([w.write(iter(rows((1, key, key))))])
    assert [i for _, i, _ in read(path)] == ["c", "d"]
    w = writer(path, overwrite=True)
    w.commit([])
    assert read(path) == []


def test_a_changed_file_is_an_error(tmp_path):
    path, w = str(tmp_path), writer(str(tmp_path))
    w.commit([w.write(iter(rows((1, "a", "xx"))))])
    (name,) = (f for f in files(path) if f.endswith("-a"))
    with open(name, "w") as f:
        f.write("xy")
    with pytest.raises(OSError):
        read(path)


def test_through_spark(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rowfiles.register(spark)
    df = spark.range(60).select(F.when(F.col("id") != 7, F.col("id") % 3).alias("target"), F.concat(F.lit("../é/"), F.col("id").cast("string")).alias("idx"), F.concat_ws("\n", F.lit("int"), F.col("id").cast("string")).alias("func")).repartition(5)
    out = df.write.format(rowfiles.NAME).option("label", "target").option("id", "idx").option("text", "func")
    out.mode("append").save(path)
    got = spark.read.format(rowfiles.NAME).load(path)
    assert got.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, got.collect())) == sorted((str(i % 3), f"../é/{i}", f"int\n{i}") for i in range(60) if i != 7)
    failing = df.withColumn("func", F.when(F.col("idx").endswith("33"), F.raise_error(F.lit("no"))).otherwise(F.col("func")))
    with pytest.raises(Exception):
        failing.write.format(rowfiles.NAME).option("label", "target").option("id", "idx").option("text", "func").mode("append").save(path)
    assert spark.read.format(rowfiles.NAME).load(path).count() == 59
    assert len(os.listdir(f"{tmp_path}/out/data")) == 1
    out.mode("overwrite").save(path)
    assert spark.read.format(rowfiles.NAME).load(path).count() == 59
    spark.createDataFrame([], "target int, idx string, func string").write.format(rowfiles.NAME).option("label", "target").option("id", "idx").option("text", "func").mode("append").save(f"{path}2")
    assert spark.read.format(rowfiles.NAME).load(f"{path}2").count() == 0
