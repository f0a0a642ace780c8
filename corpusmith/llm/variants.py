"""Spelling variants grouped by full neighbourhood generation.

Words are the runs of Latin letters of all texts, counted over the whole corpus; those long and frequent enough are the vocabulary. Of every word, all distinct strings
one deletion, replacement or insertion away, over the alphabet that the vocabulary shows, are generated; those that are themselves in the
vocabulary, by a join on the string, are its near words, so no distance is ever computed. A word's form is its most frequent near word, if that is at least
twice as frequent, and its root is where following forms ends. Frequencies double with every step, so chains are short and are followed by joins of doubled reach.

A word of eight letters has some 900 neighbours and few are words. Before neighbours are written out they are looked up by a hash in a bit array of fixed size
that holds every word's hash: what isn't there cannot join. The array never loses a word; with a larger vocabulary it lets more neighbours through to the join.
Hashes of neighbours come from a word's own by arithmetic, so a neighbour that fails the look-up costs a few vector operations and no string.

Null texts and texts without letters have no words; a null doc_id counts as an empty string before the colon; repeated rows count again. An empty vocabulary gives no
rows. Words of any length work, in bounded memory. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.llm.common import settings, staged, table

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_COUNT, CUT_EVERY = 5, 3, 97
#: Bits of the array of hashes: 32 MB whatever the vocabulary.
BITS = 28
#: Neighbours hashed at once.
AT_ONCE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, every: int = CUT_EVERY) -> DataFrame:
    """(word, n) of the vocabulary. The letter that a run loses by the hash of its document and itself is taken out before counting."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("r"))
    low = runs.select("d", F.translate("r", UPPER, LOWER).alias("r"))
    hashed = low.select("r", F.crc32(F.concat_ws(":", "d", "r").cast("binary")).alias("h"))
    at = F.expr("cast(h % length(r) as int)")
    words = hashed.select(F.when(F.col("h") % every == 0, F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + 2, F.length("r")))).otherwise(F.col("r")).alias("word"))
    counted = words.filter(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the array for each hash."""
    m, mask = mixed(h), np.uint64((1 << bits) - 1)
    return m & mask, (m >> np.uint64(64 - bits)) & mask


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE)
    out[0] = 1
    return np.multiply.accumulate(out)


def by_length(words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Words of one length together: their places in the list and their code points as a matrix."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, rows in groups.items():
        step = max(1, AT_ONCE // n)
        for a in range(0, len(rows), step):
            some = rows[a : a + step]
            yield some, np.frombuffer("".join([words[i] for i in some]).encode("utf-32-le"), "<u4").reshape(len(some), n).astype(np.uint64)


def hashes(codes: np.ndarray) -> np.ndarray:
    return (codes * powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def neighbours(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """All distinct neighbours of words of one length, as (kind, row, place, letter, hash); deletions have letter 0."""
    m, n = codes.shape
    power = powers(n + 1)
    terms = codes * power[:n]
    before = np.zeros((m, n + 1), np.uint64)
    np.cumsum(terms, axis=1, out=before[:, 1:])
    whole = before[:, -1:]
    kept = np.ones((m, n), bool)
    kept[:, 1:] = codes[:, 1:] != codes[:, :-1]  # of a row of equal letters any one may go
    row, at = np.nonzero(kept)
    yield "-", row, at, np.zeros(len(row), np.uint64), before[row, at] + (whole[row, 0] - before[row, at + 1]) * UNBASE
    rows, cols = max(1, AT_ONCE // (len(alphabet) * (n + 1))), max(1, AT_ONCE // len(alphabet))
    for r in range(0, m, rows):
        for c in range(0, n + 1, cols):
            some, ends = slice(r, r + rows), slice(c, min(c + cols, n))
            here = codes[some, ends, None]
            changed = whole[some, :, None] + (alphabet - here) * power[ends][None, :, None]
            row, at, letter = np.nonzero(here != alphabet)
            yield "=", row + r, at + c, alphabet[letter], changed[row, at, letter]
            first = before[some, c : c + cols, None]
            longer = first + alphabet * power[c : c + cols][None, :, None] + (whole[some, :, None] - first) * BASE
            new = np.ones(longer.shape, bool)
            new[:, : here.shape[1]] = here != alphabet  # beside an equal letter only behind the last of them
            row, at, letter = np.nonzero(new)
            yield "+", row + r, at + c, alphabet[letter], longer[row, at, letter]


def written(word: str, kind: str, at: int, letter: int) -> str:
    return word[:at] + ("" if kind == "-" else chr(letter)) + word[at + (kind != "+") :]


def bit_array(vocabulary: DataFrame, bits: int) -> np.ndarray:
    """The array as 64-bit words: its size is fixed, whatever the vocabulary."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, codes in by_length(b.column(0).to_pylist()):
                p = np.concatenate(places(hashes(codes), bits))
                yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))], ["at", "bits"])

    marked = vocabulary.select("word").mapInArrow(mark, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    array = np.zeros(1 << (bits - 6), np.uint64)
    rows = marked.toArrow()
    array[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return array


def near_words(vocabulary: DataFrame, bits: int = BITS) -> DataFrame:
    """(word, n, near, near_n): every pair of words of the vocabulary that differ by one letter, from both sides."""
    spark = vocabulary.sparkSession
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()  # as many as the pattern's class holds at most
    alphabet = np.array(sorted(ord(r.c) for r in letters if r.c), np.uint64)
    sent = spark.sparkContext.broadcast(bit_array(vocabulary, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = sent.value

        def known(p: np.ndarray) -> np.ndarray:
            return (array[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1

        for b in batches:
            words, n = b.column(0).to_pylist(), b.column(1)
            for rows, codes in by_length(words):
                for kind, row, at, letter, h in neighbours(codes, alphabet):
                    one, two = places(h, bits)
                    hit = np.flatnonzero(known(one))
                    hit = hit[known(two[hit])]
                    if len(hit):
                        own = [rows[i] for i in row[hit]]
                        found = [written(words[i], kind, a, c) for i, a, c in zip(own, at[hit].tolist(), letter[hit].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([words[i] for i in own], pa.string()), n.take(pa.array(own, pa.int64()))], ["near", "word", "n"])

    # Words are short and each costs a thousand hashes: many small tasks.
    dealt = vocabulary.select("word", "n").repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "word")
    candidates = dealt.mapInArrow(run, "near string, word string, n bigint")
    return candidates.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) of the words that have a form; no chain has more than `steps` of them."""
    up = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        further = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        up = staged(up.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return up


def group_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, every: int = CUT_EVERY, bits: int = BITS) -> DataFrame:
    """Per word of the vocabulary: word, form, root, n, n_near, form_n."""
    spark = docs.sparkSession
    vocabulary = staged(word_counts(docs, min_chars, min_count, every), "vocabulary")
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="4096"):
        near = near_words(vocabulary, bits)
        best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"), F.first("n").alias("own"))
        found = best.select("word", "n_near", F.when(-F.col("best.less") >= 2 * F.col("own"), F.col("best.near")).alias("form"), F.when(-F.col("best.less") >= 2 * F.col("own"), -F.col("best.less")).alias("form_n"))
        found = staged(found, "forms")
    most = vocabulary.agg(F.max("n")).first()[0] or 1
    up = roots(found.filter("form is not null"), int(math.log2(max(1, most / max(1, min_count)))))
    out = vocabulary.join(found, "word", "left").join(up, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"))


#: The checksum is worked out by its table, byte by byte; near words share what is left of them without one letter.
SQL = f"""
WITH RECURSIVE steps(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS r FROM documents),
occurring AS (SELECT d, r, count(*) AS times, hex(encode(d || ':' || r)) AS x FROM runs GROUP BY d, r),
hashed AS (SELECT r, times, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2),
    lambda i: ((strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM occurring, crc_table),
cut AS (SELECT CASE WHEN h % {CUT_EVERY} = 0 THEN r[:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, times FROM hashed),
vocabulary AS (SELECT word, sum(times)::BIGINT AS n FROM cut WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(times) >= {MIN_COUNT}),
less AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
pairs AS (
  SELECT a.word, b.word AS near FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT l.word, v.word FROM less l JOIN vocabulary v ON v.word = l.rest
  UNION SELECT v.word, l.word FROM less l JOIN vocabulary v ON v.word = l.rest
),
ranked AS (SELECT p.word, p.near, v.n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, encode(p.near)) AS k FROM pairs p JOIN vocabulary v ON v.word = p.near),
formed AS (SELECT v.word, v.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 2 * v.n THEN r.near END AS form, CASE WHEN r.n >= 2 * v.n THEN r.n END AS form_n
  FROM vocabulary v LEFT JOIN ranked r ON r.word = v.word AND r.k = 1),
chains(word, ending, form) AS (
  SELECT word, word, form FROM formed
  UNION ALL SELECT c.word, c.form, f.form FROM chains c JOIN formed f ON f.word = c.form
)
SELECT f.word, f.form, c.ending AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chains c ON c.word = f.word AND c.form IS NULL
"""
