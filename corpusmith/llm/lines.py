"""Line dedup by a deletion neighbourhood, on native functions alone.

Two lines are near when one unit inserted, deleted or replaced turns one into the other. The longer line says what the unit is: a word (what single spaces
separate in a trimmed line) if it has MIN_WORDS words or more, else a character if it has MIN_CHARS characters or more; where it is shorter still,
only equal lines are near. So each pair has one unit, also across these bounds: a line of MIN_WORDS - 1 words is compared by words with longer lines and
by characters with others. A line goes when an earlier line, by (doc_id, line
number), is equal or near; all are judged on the input, and the earliest stays. Lines without a character other than spaces are never dropped.

1. Equal lines meet as 128 bits of hash, with the smallest position combined before the shuffle.
2. A line can have a near one only if it shares the units before or behind the middle with it (one edit leaves one side
   whole), for the longer one's length. So four hashes a line tell which lines go on: those of which a half occurs in two different
   lines. This drops no pair.
3. The neighbourhood: for each unit of a line, the hashed key of the line without it. A replaced unit gives equal keys
   from both lines at that place; an inserted one a key equal to the whole shorter line's. Keys come from sums of unit
   hashes (with the place; or of units and pairs of neighbours), so all n keys of a line cost n steps, not n^2.
4. Equal keys are joined: each key keeps its earliest line, combined before the shuffle, so a group never makes pairs.
5. Each line with an earlier one is verified by the edit distance of both texts. Lines with equal keys that aren't near (the same units and
   pairs in another order) are few: the lines of their keys meet once more by a digest of the exact remaining text, again with the
   earliest of each, so here too no pairs are made.

Null texts count as empty. Rows that repeat an id and its text are one and keep the same lines; of equal ids with different texts the one with
the smaller hash is earlier; null ids come first. A very long line costs a key for each of its units, a very long text nothing beyond its
lines. An empty table gives an empty result. Other columns stay; n_lines and n_removed replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.llm.common import in_order, restored, slim, staged, table, text_or_empty

MIN_WORDS, MIN_CHARS = 8, 12
_MASK = (1 << 61) - 1


def _split(text: Column) -> Column:
    return F.split(text, "\n")


def _halves() -> Column:
    """Of line s with n units: the units before and behind the middle, for a longer line of n or n + 1 units, hashed."""

    def keys(n: Column, head_of, tail_of, kind: int) -> Column:
        out = []
        for m in (n, n + 1):
            head = F.floor((m - 1) / 2).cast("int")
            out += [F.xxhash64(m, F.lit(kind), head_of(head)), F.xxhash64(m, F.lit(kind + 1), tail_of(m - 1 - head))]
        return F.array(*out)

    none = F.array().cast("array<bigint>")
    words = keys(F.col("n"), lambda k: F.call_function("substring_index", F.col("s"), F.lit(" "), k), lambda k: F.call_function("substring_index", F.col("s"), F.lit(" "), -k), 0)
    chars = keys(F.length("s"), lambda k: F.left("s", k), lambda k: F.right("s", k), 2)
    by_word, by_char = F.col("n") >= MIN_WORDS - 1, (F.col("n") < MIN_WORDS) & (F.length("s") >= MIN_CHARS - 1)
    return F.concat(F.when(by_word, words).otherwise(none), F.when(by_char, chars).otherwise(none))


def units(s: Column) -> Column:
    """A line as units: (chars, words, short), once by its words or its characters, or by both. short: only ever the shorter of a pair."""
    words, chars = F.split(s, " "), F.split(s, "")
    n, m = F.size(words), F.length(s)
    by_word = F.when(n >= MIN_WORDS - 1, F.struct(F.lit(False).alias("chars"), words.alias("words"), (n < MIN_WORDS).alias("short")))
    by_char = F.when((n < MIN_WORDS) & (m >= MIN_CHARS - 1), F.struct(F.lit(True).alias("chars"), chars.alias("words"), (m < MIN_CHARS).alias("short")))
    return F.array_compact(F.array(by_word, by_char))


def _xor(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))


def _sum(a: Column) -> Column:
    """Sum modulo 2^61: unlike under XOR, repeated units don't cancel."""
    return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: (x + y.bitwiseAND(_MASK)).bitwiseAND(_MASK))


def neighbourhood(lines: DataFrame) -> DataFrame:
    """key, ord, role of lines (ord, chars, words, short): 0 a unit replaced, 1 a unit left out, 2 the whole line, which is all that a short one has."""
    h = lines.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    h = h.select("ord", "short", "h", F.struct("chars", F.size("h").alias("n")).alias("n"), F.transform("h", lambda x, i: F.xxhash64(x, i)).alias("g"), F.zip_with("h", F.slice("h", 2, F.size("h")), lambda x, y: F.xxhash64(x, y)).alias("p"))
    # zip_with pads the last pair with null: it is the pair of the last unit and the end
    h = h.select("ord", "short", "n", "h", "g", "p", _xor(F.col("g")).alias("sg"), _sum(F.col("h")).alias("sh"), _sum(F.col("p")).alias("sp"))
    zero = F.lit(0).cast("long")
    low = lambda c: F.coalesce(c, zero).bitwiseAND(_MASK)

    def left_out(x: Column, i: Column) -> Column:
        before, after = F.get("h", i - 1), F.get("h", i + 1)
        pairs = F.col("sp") - low(F.get("p", i)) - F.when(i > 0, low(F.get("p", i - 1)) - F.xxhash64(before, after).bitwiseAND(_MASK)).otherwise(zero)
        return F.xxhash64(F.lit(1), F.col("n.chars"), F.col("n.n") - 1, (F.col("sh") - low(x)).bitwiseAND(_MASK), pairs.bitwiseAND(_MASK))

    replaced = F.transform("g", lambda x, i: F.struct(F.xxhash64(F.lit(0), F.col("n"), i, F.col("sg").bitwiseXOR(x)).alias("key"), F.lit(0).cast("byte").alias("role")))
    shorter = F.transform("h", lambda x, i: F.struct(left_out(x, i).alias("key"), F.lit(1).cast("byte").alias("role")))
    whole = F.array(F.struct(F.xxhash64(F.lit(1), F.col("n.chars"), F.col("n.n"), F.col("sh"), F.col("sp")).alias("key"), F.lit(2).cast("byte").alias("role")))
    return h.select("ord", F.explode(F.when(F.col("short"), whole).otherwise(F.concat(replaced, shorter, whole))).alias("k")).select("k.key", "ord", "k.role")


def _exact_neighbourhood(lines: DataFrame) -> DataFrame:
    """As `neighbourhood`, with a digest of the exact remaining text as key."""
    rest = lambda i: F.concat(F.array("chars"), F.slice("words", 1, i), F.slice("words", i + 2, F.size("words")))
    digest = lambda head, words: F.md5(F.concat_ws("\0", F.concat(F.array(head), words)))
    text = lambda c: c.cast("string")
    lines = lines.withColumn("chars", text(F.col("chars")))
    replaced = F.transform("words", lambda w, i: F.struct(digest(F.concat_ws(" ", F.lit("0"), text(i), text(F.size("words"))), rest(i)).alias("key"), F.lit(0).cast("byte").alias("role")))
    shorter = F.transform("words", lambda w, i: F.struct(digest(F.lit("1"), rest(i)).alias("key"), F.lit(1).cast("byte").alias("role")))
    whole = F.array(F.struct(digest(F.lit("1"), F.concat(F.array("chars"), F.col("words"))).alias("key"), F.lit(2).cast("byte").alias("role")))
    return lines.select("ord", F.explode(F.when(F.col("short"), whole).otherwise(F.concat(replaced, shorter, whole))).alias("k")).select("k.key", "ord", "k.role")


def one_edit(a: str, b: str) -> Column:
    """The arrays a and b are one edit apart at most."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, False).cast("int")  # 1-based; 0 where all agree
    tail = lambda c, i: F.slice(c, i, F.size(c))
    return (
        (at == 0)
        | (F.size(a) == F.size(b)) & (tail(a, at + 1) == tail(b, at + 1))
        | (F.size(a) == F.size(b) + 1) & (tail(a, at + 1) == tail(b, F.greatest(at, F.lit(1))))
        | (F.size(b) == F.size(a) + 1) & (tail(b, at + 1) == tail(a, F.greatest(at, F.lit(1))))
    )


def _met(keys: DataFrame) -> DataFrame:
    """ord, w: each line with the earliest one that its keys meet, where that is earlier."""

    def low(role: int) -> Column:
        return F.min(F.when(F.col("role") == role, F.col("ord"))).alias(f"low{role}")

    groups = keys.groupBy("key").agg(low(0), low(1), low(2), F.min("ord").alias("lo"), F.max("ord").alias("hi")).where("lo < hi").select("key", "low0", "low1", "low2")
    partner = F.when(F.col("role") == 0, F.col("low0")).when(F.col("role") == 1, F.col("low2")).otherwise(F.col("low1"))
    return keys.join(groups.hint("merge"), "key").withColumn("w", partner).where("w < ord").select("ord", "w").distinct()


def _near(survivors: DataFrame) -> DataFrame:
    """h1, h2 of the lines that have an earlier near one; survivors: ord (by position and unit), h1, h2, chars, words, short."""
    keys = neighbourhood(survivors)
    text = survivors.select("ord", "chars", F.col("words").alias("a"))
    other = survivors.select(F.col("ord").alias("w"), F.col("chars").alias("c"), F.col("words").alias("b"))
    verified = (F.col("chars") == F.col("c")) & one_edit("a", "b")
    tried = staged(_met(keys).join(text.hint("merge"), "ord").join(other.hint("merge"), "w").select("ord", verified.alias("near")).groupBy("ord").agg(F.max("near").alias("near")), "line-verified")
    near = tried.where("near").select("ord")
    failed = tried.where("NOT near").select("ord")
    if not failed.isEmpty():
        theirs = keys.join(keys.join(failed, "ord", "left_semi").select("key"), "key", "left_semi").select("ord").distinct()
        again = _met(_exact_neighbourhood(survivors.join(theirs, "ord", "left_semi")))
        near = near.unionAll(again.select("ord")).distinct()
    return survivors.join(near, "ord").select("h1", "h2").distinct()


def _gone_lines(flat: DataFrame) -> DataFrame:
    """_doc, _gone: numbers of the lines that go; flat: _doc (unique, in order) and text."""
    lines = flat.select("_doc", F.posexplode(_split(F.col("text"))).alias("line", "s")).select("_doc", "line", F.trim("s").alias("s")).where("s != ''")
    lines = lines.withColumn("n", F.length("s") - F.length(F.replace("s", F.lit(" "), F.lit(""))) + 1)
    halves = _halves()
    occurrences = staged(lines.select("_doc", "line", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(1), "s").alias("h2"), halves.alias("halves")), "line-occurrences")

    half = occurrences.select("h1", F.explode("halves").alias("k"))
    shared = half.groupBy("k").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo != hi").select("k")
    alive = staged(half.join(shared.hint("merge"), "k").select("h1").distinct(), "line-alive")
    first = F.min(F.struct("_doc", "line")).alias("first")
    wanted = occurrences.select("_doc", "line", "h1", "h2").join(alive, "h1", "left_semi").groupBy("h1", "h2").agg(first)
    wanted = staged(wanted, "line-wanted").repartitionByRange("first").sortWithinPartitions("first").withColumn("ord", F.monotonically_increasing_id())
    wanted = staged(wanted.groupBy(F.col("first._doc").alias("_doc")).agg(F.collect_list(F.struct("ord", F.col("first.line").alias("line"), "h1", "h2")).alias("w")), "line-wanted")
    one = flat.join(wanted, "_doc").select("w", _split(F.col("text")).alias("ls"))
    found = one.select(F.inline(F.transform("w", lambda x: F.struct(x.ord.alias("ord"), x.h1.alias("h1"), x.h2.alias("h2"), F.trim(F.get("ls", x.line)).alias("s")))))
    found = found.select("ord", "h1", "h2", F.explode(units(F.col("s"))).alias("u")).select((F.col("ord") * 2 + F.col("u.chars").cast("long")).alias("ord"), "h1", "h2", "u.*")
    near = staged(_near(staged(found, "line-survivors")).withColumn("near", F.lit(True)), "line-near")

    firsts = occurrences.groupBy("h1", "h2").agg(first)
    verdict = firsts.join(near, ["h1", "h2"], "left")
    gone = occurrences.select("_doc", "line", "h1", "h2").join(verdict, ["h1", "h2"]).where("near OR struct(_doc, line) > first")
    return staged(gone.groupBy("_doc").agg(F.collect_list("line").alias("_gone")), "line-gone")


def _deduped(docs: DataFrame) -> DataFrame:
    """slim() rows of docs with repeated and near-repeated lines taken out of text, plus _n_lines and _n_removed."""
    rows, distinct = in_order(slim(docs))
    gone = _gone_lines(distinct)
    out = rows.join(gone.hint("merge"), "_doc", "left").withColumn("_ls", _split(text_or_empty()))
    keeps = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_ls") - 1), F.col("_gone")), lambda i: F.get("_ls", i))
    kept = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(keeps, "\n"))
    return out.select("doc_id", kept.alias("text"), "_row", F.size("_ls").cast("long").alias("_n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("_n_removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated and near-repeated lines taken out of text, plus n_lines and n_removed."""
    docs = docs.drop("n_lines", "n_removed")
    done = _deduped(docs.withColumns({"n_lines": F.lit(0), "n_removed": F.lit(0)}))
    return restored(done, docs.withColumns({"n_lines": F.lit(0), "n_removed": F.lit(0)}), n_lines=F.col("_n_lines"), n_removed=F.col("_n_removed"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated lines; a document of which nothing but spaces is left goes, n_chars is counted anew.

    Empty and null texts stay, like all columns; null and repeated ids as in `dedup_lines`."""
    done = _deduped(docs).where("_n_removed = 0 OR trim(text) != ''")
    counted = {}
    if "n_chars" in docs.columns:
        counted["n_chars"] = F.when(F.col("_n_removed") > 0, F.length("text")).otherwise(F.col("_row").getField("n_chars")).cast(docs.schema["n_chars"].dataType)
    return restored(done, docs, **counted)


SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
o AS (SELECT doc_id, i, line, trim(line, ' ') AS s FROM l),
d AS (SELECT s, min((doc_id, i)) AS f, string_split(s, ' ') AS w FROM o WHERE s <> '' GROUP BY s),
e AS (
  SELECT s, f, w, false AS c FROM d WHERE len(w) >= {MIN_WORDS} - 1
  UNION ALL SELECT s, f, [substr(s, i, 1) FOR i IN range(1, length(s) + 1)], true FROM d WHERE len(w) < {MIN_WORDS} AND length(s) >= {MIN_CHARS} - 1),
pairs AS (
  SELECT a.s, a.c, a.w AS x, b.w AS y FROM e a JOIN e b ON a.c = b.c AND a.w[1] = b.w[1] AND a.w[2] = b.w[2] AND b.f < a.f AND abs(len(a.w) - len(b.w)) <= 1
  UNION ALL SELECT a.s, a.c, a.w, b.w FROM e a JOIN e b ON a.c = b.c AND a.w[-1] = b.w[-1] AND a.w[-2] = b.w[-2] AND b.f < a.f AND abs(len(a.w) - len(b.w)) <= 1),
near AS (
  SELECT DISTINCT s FROM pairs WHERE greatest(len(x), len(y)) >= CASE WHEN c THEN {MIN_CHARS} ELSE {MIN_WORDS} END AND CASE
    WHEN len(x) = len(y) THEN len([1 FOR i IN range(1, len(x) + 1) IF x[i] <> y[i]]) <= 1
    WHEN len(x) > len(y) THEN len([1 FOR i IN range(1, len(x) + 1) IF x[1:i - 1] || x[i + 1:] = y]) > 0
    ELSE len([1 FOR i IN range(1, len(y) + 1) IF y[1:i - 1] || y[i + 1:] = x]) > 0 END),
v AS (SELECT o.doc_id, o.i, o.line, o.s <> '' AND ((o.doc_id, o.i) > d.f OR near.s IS NOT NULL) AS gone FROM o LEFT JOIN d ON o.s = d.s LEFT JOIN near ON o.s = near.s)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
  md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT coalesce(gone, false)), '')) AS kept_md5
FROM v GROUP BY doc_id"""
