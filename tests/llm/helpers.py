from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=()):
    """documents of (doc_id, text); extra: (column, value) put on every row."""
    full = [(i, t, "en", "s", None if t is None else len(t), *[v for _, v in extra]) for i, t in rows]
    schema = T.StructType([*T._parse_datatype_string(DOCS).fields, *[T.StructField(c, T.StringType()) for c, _ in extra]])
    return spark.createDataFrame(full, schema)


#: Names that operators use themselves.
CLASHES = (("score", "x"), ("node", "x"), ("at", "x"), ("key", "x"), ("n_lines", "x"), ("doc", "x"), ("component_id", "x"), ("item_id", "x"), ("n_removed", "x"), ("n_repeated", "x"), ("outcome", "x"), ("ord", "x"), ("line", "x"), *((name, "x") for name in ("_doc", "_key", "_gone", "_ls", "_n", "_row", "_name", "_n_lines", "_n_removed", "_i", "_t", "_w", "_b", "_c", "_p0", "_places", "none", "w", "n", "h", "first", "near", "a.b")))
