"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the embeddings of its character n-grams (with < and > at its ends) and of itself, all hashed
into one table; a window of words is the mean of its words; a linear softmax over that mean gives the two classes.
Table and softmax are trained jointly in numpy by Adagrad. Misspellings that training never saw share n-grams
with the words it saw. Labels hold for whole texts, so training takes windows: first at random, then, round by
round, the windows that the model itself finds worst (of toxic texts as positive, of clean texts as negative).

Why windows: what makes a text toxic is a few words in hundreds, which an average over the whole text hides (on sf0.1, held out, the same model
with whole texts as windows finds 3 of 97 toxic texts, with windows of six words 84, at 6 false alarms among 728 clean ones).

A text's score is the softmax probability of its worst window, over the whole text. Scoring needs one number for
each n-gram (the softmax is linear), which is what goes to the executors: a table of fixed size.

Fitting takes a bounded sample: at most `sample` labelled rows of each class, by the hash of their id. Rows whose
label or text is null take no part; neither do null ids. Null and empty texts, and texts without a word character, score 0.0. Without
rows of both classes the model scores everything 0.0. Repeated rows get equal scores; of labels or texts that one id has several of, the largest is
learned. A very long text costs in proportion to its words. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corpusmith.llm.common import small_batches, table, text_or_empty

BUCKETS = 1 << 20
DIM = 8
WINDOW = 6
GRAMS = (3, 6)
#: Labelled rows of each class that fitting takes at most.
SAMPLE = 2500
ROUNDS = 8
#: Distinct words whose value a worker remembers before it starts anew.
REMEMBERED = 300_000
#: Words whose n-grams fitting hashes at a time.
AT_ONCE = 10_000
#: Training texts that must hold an n-gram for it to be learned.
MIN_TEXTS = 4
#: Batches of a round at least, on small samples.
STEPS = 40

_words = re.compile(r"\w+").findall


def words_of(text: str) -> list[str]:
    """The words of a text; a word repeated in a row counts once, lest its value fill a window."""
    return [w for w, _ in itertools.groupby(_words(text.lower()))]


def gram_ids(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word, word by word, and how many each word has."""
    edged = [f"<{w}>" for w in words]
    size = np.fromiter(map(len, edged), np.int64, len(edged))
    codes = np.frombuffer("".join(edged).encode("utf-32-le"), np.uint32).astype(np.uint64)
    end = np.cumsum(size)
    start = end - size
    owner = np.repeat(np.arange(len(words)), size)
    room = end[owner] - np.arange(len(codes))
    step = np.uint64(0x9E3779B97F4A7C15)
    powers = np.cumprod(np.full(int(size.max()), step, np.uint64))
    hashes, owners = [np.add.reduceat(codes * powers[np.arange(len(codes)) - start[owner]], start)], [np.arange(len(words))]
    rolling = codes.copy()
    for n in range(2, GRAMS[1] + 1):
        rolling = rolling[:-1] * step + codes[n - 1 :] if len(rolling) > 1 else rolling[:0]
        if n >= GRAMS[0]:
            whole = room[: len(rolling)] >= n
            hashes.append(rolling[whole] + np.uint64(n))
            owners.append(owner[: len(rolling)][whole])
    h, o = np.concatenate(hashes), np.concatenate(owners)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    order = np.argsort(o, kind="stable")
    return (h[order] % np.uint64(buckets)).astype(np.int32), np.bincount(o, minlength=len(words))


class Scorer:
    """One number for each n-gram bucket, and the bias: all that scoring needs."""

    def __init__(self, values: np.ndarray, bias: float):
        self.values, self.bias, self.seen = values, bias, {}

    def __getstate__(self):
        return self.values, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def score(self, text: str) -> float:
        words = words_of(text)
        if not words or not len(self.values):
            return 0.0
        seen = self.seen
        if new := [w for w in dict.fromkeys(words) if w not in seen]:
            if len(seen) > REMEMBERED:
                seen.clear()
                new = list(dict.fromkeys(words))
            ids, n = gram_ids(new, len(self.values))
            seen.update(zip(new, (np.add.reduceat(self.values[ids].astype(np.float64), np.cumsum(n) - n) / n).tolist(), strict=True))
        v = np.array([seen[w] for w in words])
        if len(v) <= WINDOW:
            top = v.mean()
        else:
            s = np.concatenate(([0.0], np.cumsum(v)))
            top = (s[WINDOW:] - s[:-WINDOW]).max() / WINDOW
        return float(1 / (1 + np.exp(-np.clip(top + self.bias, -60, 60))))


def fit(texts: list[str], labels: list[int], seed: int = 7, buckets: int = BUCKETS) -> Scorer:
    """Train table and softmax together; labels are 0 and 1."""
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    docs, classes = [], []
    for t, y in zip(texts, labels, strict=True):
        if ws := words_of(t):
            docs.append(np.array([number.setdefault(w, len(number)) for w in ws], np.int32))
            classes.append(y)
    if len(set(classes)) < 2:
        return Scorer(np.zeros(0, np.float32), 0.0)
    vocabulary = list(number)
    parts = [gram_ids(vocabulary[i : i + AT_ONCE], buckets) for i in range(0, len(vocabulary), AT_ONCE)]
    flat, lengths = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    del vocabulary, parts, number
    starts = np.cumsum(lengths) - lengths
    emb = (rng.random((buckets, DIM), np.float32) * 2 - 1) / DIM
    # An n-gram of too few texts would be learned by heart: it stays at zero, like those that training never sees.
    seen_in = np.zeros(buckets, np.int32)
    for d in docs:
        w = np.unique(d)
        n = lengths[w]
        seen_in[np.unique(flat[np.repeat(starts[w] - np.cumsum(n) + n, n) + np.arange(n.sum())])] += 1
    learned = seen_in >= MIN_TEXTS
    emb[~learned] = 0
    emb_sq = np.full(buckets, 1e-6, np.float32)
    soft, bias = rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    soft_sq, bias_sq = np.full((DIM, 2), 1e-6), np.full(2, 1e-6)

    def windows(first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of the windows to train on, -1 where there is none, and their classes."""
        value = np.add.reduceat((emb @ (soft[:, 1] - soft[:, 0]).astype(np.float32))[flat], starts) / lengths
        found, ys = [], []
        for d, y in zip(docs, classes, strict=True):
            n = max(1, len(d) - WINDOW + 1)
            if first:
                at = rng.integers(0, n, min(n, 12))
            else:
                s = np.concatenate(([0.0], np.cumsum(value[d])))
                sums = s[WINDOW:] - s[:-WINDOW] if len(d) > WINDOW else s[-1:]
                at = np.concatenate(([sums.argmax()], rng.integers(0, n, 2 if y == 0 else 0)))
                if y == 0 and n > 2:
                    at = np.concatenate((at, np.argpartition(sums, -2)[-2:]))
            for i in np.unique(at):
                w = d[i : i + WINDOW]
                found.append(np.pad(w, (0, WINDOW - len(w)), constant_values=-1))
                ys.append(y)
        return np.array(found), np.array(ys)

    for r in range(ROUNDS):
        x, y = windows(r == 0)
        share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        for _ in range(max(2, min(8, STEPS * 256 // len(y)))):
            order = rng.permutation(len(y))
            for at in range(0, len(order), 256):
                b = order[at : at + 256]
                words, here = np.unique(x[b], return_inverse=True)
                here = here.reshape(len(b), WINDOW)
                gone = words[0] < 0
                if gone:
                    words = words[1:]
                # Embeddings of the batch's words: the mean of their n-grams.
                n = lengths[words]
                at_gram = np.repeat(starts[words] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                ids = flat[at_gram]
                of_word = np.repeat(np.arange(len(words)), n)
                begin = np.concatenate(([0], np.cumsum(n)[:-1]))
                vec = np.add.reduceat(emb[ids], begin, axis=0) / n[:, None]
                present = x[b] >= 0
                count = present.sum(1)
                index = np.where(present, here - gone, 0)
                mean = (vec[index] * present[:, :, None]).sum(1) / count[:, None]
                logit = mean @ soft + bias
                p = np.exp(logit - logit.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(b)), y[b]] -= 1
                g = p * share[b][:, None]
                g_soft, g_bias = mean.T @ g / len(b), g.mean(0)
                g_mean = (g @ soft.T) / count[:, None]
                g_word = np.zeros_like(vec)
                np.add.at(g_word, index[present], np.repeat(g_mean, count, axis=0))
                g_gram = g_word[of_word] / n[of_word][:, None]
                g_gram *= learned[ids][:, None]
                touched, to = np.unique(ids, return_inverse=True)
                g_sum = np.stack([np.bincount(to, g_gram[:, k], len(touched)) for k in range(DIM)], 1)
                emb_sq[touched] += (g_sum**2).mean(1)
                emb[touched] -= 0.3 * g_sum / np.sqrt(emb_sq[touched])[:, None]
                soft_sq += g_soft**2
                soft -= 0.1 * g_soft / np.sqrt(soft_sq)
                bias_sq += g_bias**2
                bias -= 0.1 * g_bias / np.sqrt(bias_sq)
    return Scorer((emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def in_test_fold(id_col: str = "doc_id"):
    """True for the fifth of the rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE) -> Scorer:
    """Fit on at most `sample` labelled rows of each class outside the test fold."""
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("doc_id").isNotNull() & ~in_test_fold())
    known = known.groupBy("doc_id").agg(F.max("_y").alias("_y"))
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = known.where("_y = 0").orderBy(*order).limit(sample).unionAll(known.where("_y = 1").orderBy(*order).limit(sample))
    # 2 * sample ids at most, whatever the size of the tables
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("_y").alias("_y"))
    rows = sorted((r.doc_id, r._y, r.text) for r in texts.collect())
    return fit([r[2] for r in rows], [r[1] for r in rows])


def with_scores(docs: DataFrame, scorer: Scorer, text_col: str = "text", column: str = "score") -> DataFrame:
    """docs with their score appended, one pass, no shuffle; a column of that name in docs gives way to the score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    docs = docs.drop(column)
    at = docs.columns.index(text_col)
    numbered = _numbered(docs)
    schema = StructType([*numbered.schema.fields, StructField(column, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            scores = [s.score(t) if t else 0.0 for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, column])

    return numbered.mapInArrow(run, schema).toDF(*docs.columns, column)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with columns named by their places: Spark takes a name with a dot for a field where it hands all columns to Python."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def drop_toxic(docs: DataFrame, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """The rows of docs below the threshold, with all their columns."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            keep = pa.array([not t or s.score(t) < threshold for t in b.column(at).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([pc.filter(c, keep) for c in b.columns], schema=b.schema)

    numbered = _numbered(docs)
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    scorer = fit_on(docs, table(spark, sf_dir, "labels"))
    return with_scores(docs, scorer).select("doc_id", in_test_fold().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled documents of the table; drop the documents that the model rejects, row by row, so ids may be null or repeat.

    Null and empty texts stay; all columns stay as they are."""
    return drop_toxic(docs, fit_on(docs, table(spark, sf_dir, "labels")))
