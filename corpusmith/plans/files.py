"""Queries of the sources and sinks: the driver's tables are written to the shared folder, read back and shown, each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusmith.operators import layout
from corpusmith.plans.relational import query
from corpusmith.sources import readers, rowfiles, writers

_ONE = "replace(replace(replace(coalesce(text, ''), chr(10), ' '), chr(13), ' '), chr(9), ' ')"


def _folder(spark) -> str:
    return f"{layout.shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _labelled(spark, d):
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    return docs.join(labels, "doc_id").select(F.col("text").alias("func"), F.col("quality").cast("int").alias("target"), F.col("doc_id").alias("idx"))


def _shown(rows):
    return rows.select("idx", "target", F.md5("func").alias("func_md5"))


_LABELLED = "SELECT doc_id AS idx, quality::INT AS target, md5(text) AS func_md5 FROM documents JOIN labels USING (doc_id)"


@query(_LABELLED)
def source_jsonl(spark, d):
    path = _folder(spark)
    writers.jsonl(_labelled(spark, d), path)
    return _shown(readers.task(spark, "defect", path))


@query(_LABELLED)
def source_jsonl_gzip(spark, d):
    path = _folder(spark)
    _labelled(spark, d).write.option("compression", "gzip").json(path)
    return _shown(readers.task(spark, "defect", path))


@query(_LABELLED + " WHERE quality = 1")
def sink_jsonl_matching(spark, d):
    path = _folder(spark)
    writers.jsonl(_labelled(spark, d).withColumn("good", F.col("target") == 1), path, only="good")
    return _shown(readers.task(spark, "defect", path))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def source_json_array(spark, d):
    path = _folder(spark)
    one = spark.read.parquet(f"{d}/nation.parquet").select(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).alias("x"))
    one.agg(F.to_json(F.collect_list("x")).alias("value")).coalesce(1).write.text(path)  # 25 rows
    return readers.json_array(spark, path, "id int, name string")


@query("SELECT doc_id AS idx FROM documents")
def source_index(spark, d):
    path = _folder(spark)
    spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit(" "), F.col("doc_id").cast("string")).alias("value")).write.text(path)
    return readers.index(spark, path)


_PAIRS = "SELECT a.doc_id AS i, a.doc_id + 1 AS j, CASE WHEN a.quality = 1 THEN 1 ELSE 0 END AS label FROM labels a"


@query(f"SELECT i::VARCHAR AS url1, j::VARCHAR AS url2, label::INT AS label FROM ({_PAIRS})")
def source_pairs(spark, d):
    path = _folder(spark)
    rows = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", (F.col("doc_id") + 1).alias("j"), (F.col("quality") == 1).cast("int").alias("label"))
    rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns]).alias("value")).write.text(path)
    return readers.pairs(spark, path)


@query(f"""SELECT i::VARCHAR AS url1, j::VARCHAR AS url2, label::INT AS label, md5(x.text) AS code1_md5, md5(y.text) AS code2_md5
FROM ({_PAIRS}) JOIN documents x ON x.doc_id = i JOIN documents y ON y.doc_id = j""")
def source_clone_from_index(spark, d):
    path = _folder(spark)
    rows = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", (F.col("doc_id") + 1).alias("j"), F.when(F.col("quality") == 1, 1).otherwise(-1).alias("label"))
    rows.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in rows.columns]).alias("value")).write.text(f"{path}/pairs")
    spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("url"), F.col("text").alias("code")).write.json(f"{path}/codes")
    found = readers.clone_from_index(spark, f"{path}/pairs", f"{path}/codes")
    return found.select("url1", "url2", "label", F.md5("code1").alias("code1_md5"), F.md5("code2").alias("code2_md5"))


@query(f"SELECT doc_id, md5(trim({_ONE})) AS buggy_md5, lang || ' ' || source AS fixed FROM documents")
def source_parallel(spark, d):
    """Two folders of several files each, whose lines belong together."""
    path = _folder(spark)
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source").repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id")
    # Ranges are cut by a sample, another one for each job: which line goes where is decided once.
    rows = layout.written(rows.withColumn("at", F.monotonically_increasing_id()), "parallel")
    rows = rows.repartition(4, F.shiftright("at", 33)).sortWithinPartitions("at")
    rows.select(F.regexp_replace("text", "[\n\r\t]", " ").alias("value")).write.text(f"{path}/buggy")
    rows.select(F.concat_ws(" ", F.col("doc_id").cast("string"), "lang", "source").alias("value")).write.text(f"{path}/fixed")
    side = readers.parallel(spark, f"{path}/buggy", f"{path}/fixed").withColumn("p", F.split("fixed", " ", 2))
    return side.select(F.col("p")[0].cast("bigint").alias("doc_id"), F.md5("buggy").alias("buggy_md5"), F.col("p")[1].alias("fixed"))


@query("SELECT conv_id AS pair_idx, turn AS line_idx FROM conversations")
def source_segment_map(spark, d):
    path = _folder(spark)
    c = spark.read.parquet(f"{d}/conversations.parquet")
    c.select(F.concat_ws("-", F.col("conv_id").cast("string"), "role", F.col("turn").cast("string")).alias("value")).write.text(path)
    return readers.segment_map(spark, path).select("pair_idx", "line_idx")


@query(r"SELECT doc_id::VARCHAR AS id, md5(regexp_replace(coalesce(text, ''), '[\n\r\t]+', ' ', 'g')) AS pred_md5 FROM documents")
def sink_one_line_text(spark, d):
    """Texts behind their ids, as predictions are written, and read as such."""
    path = _folder(spark)
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    writers.one_line_text(docs, path, "text", "doc_id")
    return readers.predictions(spark, path, text=True).select("id", F.md5("pred").alias("pred_md5"))


@query("SELECT doc_id::VARCHAR AS id, quality::INT AS pred FROM labels")
def source_predictions(spark, d):
    path = _folder(spark)
    spark.read.parquet(f"{d}/labels.parquet").select(F.concat_ws(" ", F.col("doc_id").cast("string"), F.col("quality").cast("string")).alias("value")).write.text(path)
    return readers.predictions(spark, path)


@query("SELECT n_regionkey AS label, n_nationkey AS id, md5(n_name || chr(10) || n_nationkey::VARCHAR) AS code_md5 FROM nation")
def sink_per_row_files(spark, d):
    """A program a file, by class and id, read again as a directory; line breaks stay."""
    path = _folder(spark)
    n = spark.read.parquet(f"{d}/nation.parquet").withColumn("code", F.concat_ws("\n", "n_name", F.col("n_nationkey").cast("string")))
    writers.per_row_text(n, path, "n_regionkey", "n_nationkey", "code")
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\n\\z", "").alias("code"))
    part = lambda name: F.regexp_extract("file", f"{name}=([0-9]+)/", 1).cast("int")
    return files.select(part("n_regionkey").alias("label"), part("n_nationkey").alias("id"), F.md5("code").alias("code_md5"))


@query("SELECT 'run' || n_regionkey AS run, n_nationkey / 100.0::DOUBLE AS acc FROM nation")
def source_run_results(spark, d):
    """res.jsonl of several runs, each in its folder."""
    path = _folder(spark)
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("run"), F.col("n_regionkey").cast("string")).alias("run"), (F.col("n_nationkey") / 100.0).cast("double").alias("acc"))
    n.repartition(1).write.partitionBy("run").json(path)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for k in range(5):  # one file a run gets its name
        place = fs.Path(f"{path}/run=run{k}")
        system = place.getFileSystem(conf)
        for f in system.listStatus(place):
            if f.getPath().getName().startswith("part-"):
                system.mkdirs(fs.Path(f"{path}/runs/run{k}"))
                system.rename(f.getPath(), fs.Path(f"{path}/runs/run{k}/res.jsonl"))
    return readers.run_results(spark, f"{path}/runs", "acc double").select("run", "acc")


@query("SELECT count(*) FILTER (quality = 1) / count(*)::DOUBLE AS tsr FROM labels")
def sink_rates(spark, d):
    path = _folder(spark)
    writers.jsonl(writers.rates(spark.read.parquet(f"{d}/labels.parquet").withColumn("changed", F.col("quality") == 1), "changed"), path)
    return readers.jsonl(spark, path, "tsr double")


@query("SELECT s_nationkey::VARCHAR AS label, s_suppkey::VARCHAR AS id, md5(s_name || chr(10) || s_suppkey::VARCHAR) AS text_md5 FROM supplier")
def sink_row_files_indexed(spark, d):
    """A file a row by a committed job, read again by its index."""
    path = _folder(spark)
    rowfiles.register(spark)
    s = spark.read.parquet(f"{d}/supplier.parquet").select("s_nationkey", "s_suppkey", F.concat_ws("\n", "s_name", F.col("s_suppkey").cast("string")).alias("code")).repartition(4, "s_suppkey")
    s.write.format(rowfiles.NAME).option("label", "s_nationkey").option("id", "s_suppkey").option("text", "code").mode("append").save(path)
    return spark.read.format(rowfiles.NAME).load(path).select("label", "id", F.md5("text").alias("text_md5"))
