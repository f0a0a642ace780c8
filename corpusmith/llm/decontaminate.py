"""Benchmark decontamination by SimHash fingerprints of item-sized windows, on native functions alone.

A document leaks an item if a window of as many words as the item has is similar to it by THRESHOLD or more. Words are runs of
letters and digits of the lower-cased text. Similarity is weighted: with c(x) the number of times that the five-word
shingle x occurs, it is the sum over x of min(c, c') divided by the sum of max(c, c').
A document of fewer words than the item is one clipped window, compared whole by the same similarity; n_words is then its own number.
An item of fewer than five words counts as one shingle of all its words; an item without words leaks nowhere.

1. Windows. An item of T shingles that leaks leaves a run of its shingles untouched: of a similarity of num / den at most
   lost = T * (den - num) / (den + num) shingles are gone, and every word changed inside takes K of them. The window size is the largest of LADDER that
   fits into such a run with stride - 1 shingles to spare, so windows of the whole corpus need only begin at every stride-th shingle: the
   item is fingerprinted at all its places, so one window of the document lies just as one of the item does.
2. Each window gets a SimHash of 32 bits, set where more than half of its shingles set them. Counts of a block of four shingles
   lie side by side in four longs and are added block to block, 4, 8, 16, 32 shingles, so a window costs a few additions.
3. Multi-index Hamming blocks: fingerprints are cut in two blocks of 16 bits. Two within RADIUS differ in half as many bits at most in
   one block (pigeonhole), so the item's blocks with up to so many bits flipped, joined with the windows' blocks, find every
   pair within the radius; the distance is then computed. Nothing but fingerprints selects documents and items.
4. Each pair of document and item that is found is verified: the exact weighted similarity, from counted shingles, of all windows of the item's
   size in the document that hold enough of its shingles (an exact bound).

The result has the best window of each document and item, the earliest among equals. Fingerprints of items are broadcast
only where a count shows that they are few; beyond that they are joined by shuffle. Null texts count as empty; an item without words and a null
item text leak nowhere; repeated rows of a document give repeated results; null and repeated ids are told apart by their texts. A very long
text costs one window of each size for every four words or more. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.llm.common import in_order, restored, slim, staged, table, text_or_empty

K = 5
THRESHOLD = (8, 10)
#: Shingles of a window, shingles of the smallest, and the distance of fingerprints up to which all are found.
LADDER, BLOCK, RADIUS = (4, 8, 16, 32), 4, 1
#: Block entries of the benchmark, or pairs of documents and items, that may be broadcast: about 16 MB.
BROADCAST_ROWS = 500_000
#: The lowest bit of each of the eight bytes of a long: a byte counts how often one bit is set in a window.
_LANES = 0x0101010101010101


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _shingles(words: str, k: int) -> Column:
    """Hashes of all runs of k words, in order; none where there are fewer words."""
    n = F.size(words) - k
    each = F.transform(F.slice(words, 1, F.greatest(n + 1, F.lit(0))), lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]))
    return F.when(n >= 0, each).otherwise(F.array().cast("array<bigint>"))


def stride(w: int) -> int:
    """Windows of w shingles begin at every so many shingles of the corpus."""
    return max(BLOCK, w // 2) if w > 1 else 1


def _shifted(x: Column, k: int) -> Column:
    return F.call_function("shiftrightunsigned", x, F.lit(k)) if k else x


def _fingerprint(counts: list[Column], w: Column) -> Column:
    """Bits that more than half of w shingles set, from four longs of counts: bit 8 * i + k from byte i of the k-th."""
    more = (63 - F.floor(w / 2)) * F.lit(_LANES)  # lifts a count above half to bit 6 of its byte
    bits = [F.call_function("shiftleft", _shifted(c + more, 6).bitwiseAND(_LANES), F.lit(k)) for k, c in enumerate(counts)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def simhash(hashes: Column) -> Column:
    """The fingerprint of an array of up to 64 shingles."""

    def count(k: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, x: acc + _shifted(x, k).bitwiseAND(_LANES))

    return _fingerprint([count(k) for k in range(4)], F.size(hashes))


def _counts(of) -> Column:
    return F.struct(*[of(k).alias(f"c{k}") for k in range(4)])


def _doubled(half: Column, step: int, every: int) -> Column:
    """Counts of windows of twice the size, of each that begins at `every` place: those of it and of the one `step` on, where it ends."""
    n = F.floor((F.size(half) - step - 1) / every).cast("int")
    places = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    both = lambda i: _counts(lambda k: F.get(half, i * every)[f"c{k}"] + F.get(half, i * every + step)[f"c{k}"])
    return F.transform(places, both)


def windows(shingled: DataFrame, sizes: list[int]) -> DataFrame:
    """_doc, w, f: fingerprints of the windows of each size; shingled: _doc and hs."""
    found = []
    if 1 in sizes:
        one = shingled.select("_doc", F.explode("hs").alias("x"))
        found.append(one.select("_doc", F.lit(1).alias("w"), _fingerprint([_shifted(F.col("x"), k).bitwiseAND(_LANES) for k in range(4)], F.lit(1)).alias("f")))
    if many := [w for w in LADDER if w <= max(sizes)]:
        n = F.floor(F.size("hs") / BLOCK).cast("int")
        blocks = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        bit = lambda b, i, k: _shifted(F.get("hs", b * BLOCK + i), k).bitwiseAND(_LANES)
        added = shingled.select("_doc", F.transform(blocks, lambda b: _counts(lambda k: bit(b, 0, k) + bit(b, 1, k) + bit(b, 2, k) + bit(b, 3, k))).alias("s4"))
        for w in many[1:]:  # a window is two of half its size
            added = added.withColumn(f"s{w}", _doubled(F.col(f"s{w // 2}"), w // 2 // stride(w // 2), stride(w) // stride(w // 2)))
        each = F.array(*[F.struct(F.lit(w).alias("w"), F.col(f"s{w}").alias("s")) for w in many if w in sizes])
        rows = added.select("_doc", F.explode(each).alias("x")).select("_doc", "x.w", F.inline("x.s"))
        found.append(rows.select("_doc", "w", _fingerprint([F.col(f"c{k}") for k in range(4)], F.col("w")).alias("f")))
    return found[0] if len(found) == 1 else found[0].unionAll(found[1])


def _block(f: Column, block: int) -> Column:
    return _shifted(f, 32 * block).bitwiseAND(0xFFFFFFFF)


def _entry(w: Column, block: int, bits: Column) -> Column:
    return (w * 2 + block).cast("long") * F.lit(1 << 32) + bits


def candidates(shingled: DataFrame, items: DataFrame) -> DataFrame:
    """_doc, _i that have windows within RADIUS; items: _i, w and h."""
    sizes = sorted(r.w for r in items.select("w").distinct().collect())  # of LADDER, or 1
    parts = items.select("_i", "w", F.explode(F.transform(F.sequence(F.lit(0), F.size("h") - F.col("w")), lambda o: simhash(F.slice("h", o + 1, F.col("w"))))).alias("fi")).distinct()
    bits = [1 << (8 * i + k) for i in range(4) for k in range(4)]
    flips = [sum(some) for n in range(RADIUS // 2 + 1) for some in itertools.combinations(bits, n)]
    marks = parts.select("_i", "fi", F.explode(F.array(*[_entry(F.col("w"), b, _block(F.col("fi"), b).bitwiseXOR(x)) for b in (0, 1) for x in flips])).alias("entry"))
    marks = staged(marks, "item-blocks")
    entries = F.array(*[_entry(F.col("w"), b, _block(F.col("f"), b)) for b in (0, 1)])
    rows = windows(shingled, sizes).select("_doc", "f", F.explode(entries).alias("entry"))
    few = marks.count() <= BROADCAST_ROWS
    met = rows.join(F.broadcast(marks) if few else marks, "entry").where(F.bit_count(F.col("f").bitwiseXOR(F.col("fi"))) <= RADIUS)
    return met.select("_doc", "_i").distinct()


def _items(benchmark: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """_i, item, n (words), k, h (shingles), w (the window's size) of the items that have words."""
    num, den = threshold
    words = benchmark.select(F.col("item_id").alias("item"), _words(text_or_empty()).alias("words")).where(F.size("words") > 0)
    h = F.coalesce(*[F.when(F.least(F.size("words"), F.lit(K)) == k, _shingles("words", k)) for k in range(1, K + 1)])
    items = words.select("item", F.size("words").alias("n"), F.least(F.size("words"), F.lit(K)).alias("k"), h.alias("h")).distinct()
    lost = F.floor(F.size("h") * (den - num) / (den + num) + 1e-9)
    run = F.floor((F.size("h") - lost) / (F.floor(lost / K) + 1))
    w = F.coalesce(*[F.when(run >= x + stride(x) - 1, F.lit(x)) for x in reversed(LADDER)], F.lit(1))
    return items.withColumn("w", w).withColumn("_i", F.monotonically_increasing_id())


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: the best window of each document and item that leaks."""
    rows, distinct = in_order(docs.select("doc_id", "text"))
    return rows.select("_doc", "doc_id").join(_leaks(distinct, benchmark, threshold), "_doc").select("doc_id", "item_id", "start_word", "n_words", "similarity")


def _leaks(rows: DataFrame, benchmark: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """_doc, item_id, start_word, n_words, similarity: as `leaks`; rows: _doc (unique) and text."""
    num, den = threshold
    items = staged(_items(benchmark, threshold), "items")
    lengths = sorted(r.k for r in items.select("k").distinct().collect())  # 1 to 5
    found = []
    for k in lengths:
        of = items.where(F.col("k") == k).select("_i", "n", "h", "w")
        shingled = rows.select("_doc", _words(F.col("text")).alias("w")).select("_doc", _shingles("w", k).alias("hs"))
        pairs = staged(candidates(shingled, of), "leak-candidates")
        todo = pairs.groupBy("_doc").agg(F.collect_list("_i").alias("todo"))
        # Few documents leak as a rule: their pairs then go to the documents, and texts needn't be shuffled.
        one = (F.broadcast(todo) if pairs.count() <= BROADCAST_ROWS else todo).join(rows, "_doc").select("_doc", "todo", _words(F.col("text")).alias("w")).select("_doc", "todo", _shingles("w", k).alias("hs"))
        one = one.select("_doc", "hs", F.explode("todo").alias("_i")).join(of, "_i").select("_doc", "hs", "_i", "n", "h", F.least(F.size("h"), F.size("hs")).alias("size"))
        # T shingles of the item and S of the window (T, or all of a shorter document) need m / (S + T - m) >= num / den.
        need = F.ceil((F.size("h") + F.col("size")) * num / (num + den) - 1e-9).cast("int")
        ats = F.filter(F.sequence(F.lit(0), F.size("hs") - 1), lambda i: F.array_contains("h", F.get("hs", i)))
        by = one.withColumn("need", need).withColumn("ats", ats).where(F.size("ats") >= F.col("need"))
        spans = F.transform(F.sequence(F.lit(0), F.size("ats") - F.col("need")), lambda j: F.struct(F.greatest(F.get("ats", j + F.col("need") - 1) - (F.col("size") - 1), F.lit(0)).alias("lo"), F.get("ats", j).alias("hi")))
        starts = F.array_distinct(F.flatten(F.transform(F.filter(spans, lambda s: s.lo <= s.hi), lambda s: F.sequence(s.lo, s.hi))))
        # A window that loses the shingle that it gains is the one before it: of such a row of windows the first counts.
        as_before = lambda s, i: (i > 0) & (F.get("starts", i - 1) == s - 1) & F.get("hs", s - 1).eqNullSafe(F.get("hs", s + F.col("size") - 1))
        flat = by.withColumn("starts", F.array_sort(starts)).select("_doc", "hs", "_i", "n", "size", F.explode(F.filter("starts", lambda s, i: ~as_before(s, i))).alias("start"))
        cut = staged(flat.where(F.col("start") + F.col("size") <= F.size("hs")).select("_doc", "_i", "n", "size", "start", F.slice("hs", F.col("start") + 1, F.col("size")).alias("h")), "windows")
        mine = cut.select("_doc", "_i", "n", "size", "start", F.explode("h").alias("x")).groupBy("_doc", "_i", "n", "size", "start", "x").agg(F.count("*").alias("c"))
        theirs = of.select("_i", F.explode("h").alias("x")).groupBy("_i", "x").agg(F.count("*").alias("d"))
        both = mine.join(theirs, ["_i", "x"]).groupBy("_doc", "_i", "n", "size", "start").agg(F.sum(F.least("c", "d")).alias("m"))
        total = F.col("size") + F.col("n") - k + 1
        good = both.where(F.col("m") * den >= (total - F.col("m")) * num).withColumn("similarity", F.col("m") / (total - F.col("m")))
        best = good.groupBy("_doc", "_i", "size").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("b"))
        found.append(best.select("_doc", "_i", (-F.col("b.s")).alias("start_word"), (F.col("size") + k - 1).alias("n_words"), F.col("b.similarity")))
    if not found:
        return rows.sparkSession.createDataFrame([], f"_doc bigint, item_id {dict(benchmark.dtypes)['item_id']}, start_word int, n_words int, similarity double")
    all_found = found[0]
    for f in found[1:]:
        all_found = all_found.unionAll(f)
    return all_found.join(items.select("_i", F.col("item").alias("item_id")), "_i").select("_doc", "item_id", "start_word", "n_words", "similarity")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text leaks an item go, whatever their id: null and repeated ids are told apart by their texts. Empty and null texts stay."""
    rows, distinct = in_order(slim(docs))
    bad = _leaks(distinct, table(spark, sf_dir, "benchmark")).select("_doc").distinct()
    return restored(rows.join(bad, "_doc", "left_anti"), docs)


SQL = f"""
WITH i AS (SELECT item_id, [x FOR x IN string_split(regexp_replace(lower(coalesce(text, '')), '[^\\pL\\pN]+', ' ', 'g'), ' ') IF x <> ''] AS w FROM benchmark),
items AS (SELECT row_number() OVER () AS j, item_id, len(w) AS n, least(len(w), {K}) AS k, [array_to_string(w[p:p + least(len(w), {K}) - 1], ' ') FOR p IN range(1, len(w) - least(len(w), {K}) + 2)] AS h FROM i WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, [x FOR x IN string_split(regexp_replace(lower(coalesce(text, '')), '[^\\pL\\pN]+', ' ', 'g'), ' ') IF x <> ''] AS w FROM documents),
s AS (SELECT r, k, [array_to_string(w[p:p + k - 1], ' ') FOR p IN range(1, len(w) - k + 2)] AS h FROM d, (SELECT DISTINCT k FROM items) WHERE len(w) >= k),
places AS (SELECT r, k, unnest(h) AS x, generate_subscripts(h, 1) - 1 AS p FROM s),
hits AS (SELECT DISTINCT r, j, n, places.k, p FROM places JOIN (SELECT j, n, k, unnest(h) AS x FROM items) t ON places.x = t.x AND places.k = t.k),
starts AS (SELECT DISTINCT r, j, n, k, unnest(range(greatest(p - (n - k), 0), p + 1)) AS a FROM hits),
win AS (SELECT starts.r, j, n, starts.k, a, s.h[a + 1 : a + n - starts.k + 1] AS h FROM starts JOIN s ON s.r = starts.r AND s.k = starts.k WHERE a + least(n - starts.k + 1, len(s.h)) <= len(s.h)),
mine AS (SELECT r, j, n, k, a, len(h) AS z, x, count(*) AS c FROM (SELECT r, j, n, k, a, h, unnest(h) AS x FROM win) GROUP BY ALL),
theirs AS (SELECT j, x, count(*) AS c FROM (SELECT j, unnest(h) AS x FROM items) GROUP BY ALL),
m AS (SELECT r, j, n, k, a, z, sum(least(mine.c, theirs.c)) AS m FROM mine JOIN theirs USING (j, x) GROUP BY r, j, n, k, a, z),
good AS (SELECT *, m / (1.0 * (z + n - k + 1) - m) AS similarity FROM m WHERE m * {THRESHOLD[1]} >= (z + n - k + 1 - m) * {THRESHOLD[0]}),
best AS (SELECT *, row_number() OVER (PARTITION BY r, j ORDER BY similarity DESC, a) AS rn FROM good)
SELECT doc_id, item_id, a AS start_word, z + best.k - 1 AS n_words, similarity::DOUBLE AS similarity FROM best JOIN d USING (r) JOIN items USING (j) WHERE rn = 1"""
