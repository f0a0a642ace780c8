"""Scans. All go through Spark's readers, so any store that Spark reads will do; gzip is by the file's ending, a file per task.

Where the order of lines matters, rows carry an explicit `pos`: (file, line) order, made once when the file is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmith.sources.schemas import CLONE, TASKS


def jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One JSON object a line, gzipped or not."""
    return spark.read.schema(schema).json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, pos (from 0) and value of each line; large files are read in blocks, each counted once to number the lines of the next."""
    raw = spark.read.option("lineSep", "\n").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", "\r\\z", "").alias("value"))
    counts = raw.groupBy("file", "block").agg(F.min("n").alias("first"), F.count("*").alias("size"))  # one row a block
    before = F.sum("size").over(Window.partitionBy("file").orderBy("block")) - F.col("size")
    return raw.join(counts.withColumn("before", before), ["file", "block"]).select("file", (F.col("before") + F.col("n") - F.col("first")).alias("pos"), "value")


def index(spark: SparkSession, path: str, name: str = "idx") -> DataFrame:
    """One integer a line; other lines are left out."""
    return spark.read.text(path).select(F.expr("try_cast(trim(value) AS bigint)").alias(name)).where(F.col(name).isNotNull())


def pairs(spark: SparkSession, path: str, sep: str = "[ \t]") -> DataFrame:
    """url1, url2, label of lines with three parts; other lines are left out."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), sep).alias("p")).where(F.size("p") == 3)
    return parts.select(F.col("p")[0].alias("url1"), F.col("p")[1].alias("url2"), F.expr("try_cast(p[2] AS int)").alias("label")).where("label IS NOT NULL")


def segment_map(spark: SparkSession, path: str, sep: str = "-") -> DataFrame:
    """pair_idx, line_idx and pos of lines pair-any-line."""
    p = lines(spark, path).select("pos", F.split("value", sep).alias("p")).where(F.size("p") >= 3)
    return p.select(F.expr("try_cast(p[0] AS bigint)").alias("pair_idx"), F.expr("try_cast(element_at(p, -1) AS bigint)").alias("line_idx"), "pos").where("pair_idx IS NOT NULL")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """url (folder and name of a file) and code (its text) of each file below path."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.array_join(F.slice(F.split("_metadata.file_path", "/"), -2, 2), "/").alias("url"), F.col("value").alias("code"))


def parallel(spark: SparkSession, left: str, right: str, names: tuple[str, str] = ("buggy", "fixed")) -> DataFrame:
    """Two files, or the files of two folders in the order of their names, side by side by line number; what only one has is left out."""

    def side(path: str, name: str) -> DataFrame:
        rows = lines(spark, path)
        order = rows.groupBy("file").agg(F.lit(1)).select("file", F.row_number().over(Window.orderBy("file")).alias("nth"))  # one row a file
        return rows.join(order, "file").select("nth", "pos", F.trim("value").alias(name))

    return side(left, names[0]).join(side(right, names[1]), ["nth", "pos"]).drop("nth")


def task(spark: SparkSession, name: str, path: str | list[str]) -> DataFrame:
    """Rows of a task by its schema, in the names that the operators use: a translation's sides are code1 and code2, labels of -1 are 0."""
    df = jsonl(spark, path, TASKS[name])
    if name == "translate":
        return df.select(F.coalesce("code1", "input_code").alias("code1"), F.coalesce("code2", "output_code").alias("code2"))
    if name == "clone":
        return df.withColumn("label", F.when(F.col("label") == -1, 0).otherwise(F.col("label")))
    if name == "summarize":
        return df.withColumn("docstring", F.coalesce("docstring", F.array_join("docstring_tokens", " ")))
    return df


#: What a text's ends are trimmed of, and what counts as one space inside.
_ENDS, _SPACE = " \t\n\r\x0b\x0c", "[ \t\n\r\x0b\x0c]+"


def examples(spark: SparkSession, name: str, path: str | list[str], limit: int = -1) -> DataFrame:
    """idx, source and target of a generation task's rows, the first `limit` of them by idx (-1: all).

    concode: nl and code, trimmed. summarize: tokens joined, white space made one space. refine and translate: two paths, whose lines belong together; translate's rows of a
    JSONL have code1 and code2 instead. defect: func on one line, target as text. idx is the row's own where it has one, else its line's number over all files in
    the order of their names; rows without one side are left out."""
    if name in ("refine", "translate") and not isinstance(path, str):
        sides = numbered(parallel_lines(spark, *path))
        rows = sides.select("idx", "left", "right")
    else:
        raw = numbered(lines(spark, path if isinstance(path, str) else list(path)))
        schema = {"concode": "nl string, code string", "summarize": "idx bigint, code_tokens array<string>, docstring_tokens array<string>", "defect": "func string, target string, idx bigint", "translate": "code1 string, code2 string", "refine": "buggy string, fixed string"}[name]
        one = raw.select("idx", F.from_json("value", schema).alias("x"))
        one = one.select(F.coalesce("x.idx", "idx").alias("idx") if "idx" in schema else "idx", "x")
        flat = lambda c: F.trim(F.regexp_replace(c, _SPACE, " "))
        left, right = (F.col(f"x.{f.split()[0]}") for f in schema.removeprefix("idx bigint, ").split(", ")[:2])
        if name == "summarize":
            left, right = flat(F.array_join(left, " ")), flat(F.replace(F.array_join(right, " "), F.lit("\n"), F.lit("")))
        elif name == "defect":
            left = flat(left)
        rows = one.select("idx", left.alias("left"), right.alias("right"))
    trimmed = rows.where("left IS NOT NULL AND right IS NOT NULL").select("idx", F.btrim("left", F.lit(_ENDS)).alias("source"), F.btrim("right", F.lit(_ENDS)).alias("target"))
    return trimmed if limit == -1 else trimmed.orderBy("idx").limit(limit)


def numbered(rows: DataFrame) -> DataFrame:
    """rows of lines() with idx, the line's number over all files in the order of their names."""
    sizes = rows.groupBy("file").agg(F.count("*").alias("n"))  # one row a file
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.select("file", before.alias("before")), "file").withColumn("idx", F.col("before") + F.col("pos"))


def parallel_lines(spark: SparkSession, left: str, right: str) -> DataFrame:
    """file (the left one), pos, left and right of lines that belong together, by the order of the files' names and the lines' numbers."""

    def side(path: str) -> DataFrame:
        rows = lines(spark, path)
        order = rows.groupBy("file").agg(F.lit(1)).select("file", F.row_number().over(Window.orderBy("file")).alias("nth"))  # one row a file
        return rows.join(order, "file")

    other = side(right).select("nth", "pos", F.col("value").alias("right"))
    return side(left).withColumnRenamed("value", "left").join(other, ["nth", "pos"]).drop("nth")


def eligible(df: DataFrame, label: str, audit: bool = True) -> DataFrame:
    """The rows whose label is 1 (those that an audit looks at), or 0 (its control); -1 counts as 0, and rows with other labels are in neither."""
    known = F.when(F.col(label) == -1, 0).otherwise(F.col(label))
    return df.where(known == (1 if audit else 0))


def label_name(label: str) -> Column:
    """false for 0 and -1, true for 1, null for anything else."""
    return F.when(F.col(label).isin(0, -1), "false").when(F.col(label) == 1, "true")


def clone_from_index(spark: SparkSession, pair_path: str, code_path: str) -> DataFrame:
    """Clone rows from a pair index and a JSONL of url and code."""
    from corpusmith.operators.splits import materialize_pairs

    codes = spark.read.schema("url string, code string").json(code_path)
    p = pairs(spark, pair_path).withColumn("label", F.when(F.col("label") == -1, 0).otherwise(F.col("label")))
    names = [c.split()[0] for c in CLONE.split(", ")]
    return materialize_pairs(p, codes).select(*names)


def predictions(spark: SparkSession, path: str, text: bool = False) -> DataFrame:
    """id and pred of lines `id<TAB or space>label`, or with text `id<TAB>text`; a line with an id alone has an empty text."""
    raw = spark.read.text(path).where("trim(value) != ''")
    p = raw.select(F.split("value", "\t" if text else "[ \t]+", 2).alias("p"))
    return p.select(F.col("p")[0].alias("id"), F.coalesce(F.get("p", F.lit(1)), F.lit("")).alias("pred") if text else F.expr("try_cast(get(p, 1) AS int)").alias("pred"))


def run_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """res.jsonl of many runs below path, with the folder of each as `run`."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "res.jsonl").json(path)
    return rows.withColumn("run", F.element_at(F.split("_metadata.file_path", "/"), -2))


# The files of a split of each task below its root; two where the sides are in files of their own.
FILES = {
    "summarize": ["summarize/{sub}/{split}.jsonl"],
    "translate": ["translate/{split}.java-cs.txt.java", "translate/{split}.java-cs.txt.cs"],
    "refine": ["refine/{sub}/{split}.buggy-fixed.buggy", "refine/{sub}/{split}.buggy-fixed.fixed"],
    "concode": ["concode/{split}.json"],
    "clone": ["clone/{split}.txt"],
    "defect": ["{split}.jsonl"],
}


def files_of(root: str, name: str, split: str, sub_task: str = "", files: dict[str, list[str]] = FILES) -> list[str]:
    """Where the files of a task's split lie; `files` may name those of other tasks. A translation from C# has its sides the other way round."""
    stem = {"dev": "valid", "eval": "valid"}.get(split, split)
    found = [f"{root.rstrip('/')}/{f.format(split=stem, sub=sub_task)}" for f in files[name]]
    return found[::-1] if sub_task == "cs-java" else found
