"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A document is the set of its distinct k-word shingles; fewer words than k count whole as one, a document without words has
an empty set and no links. Documents with equal sets, by 128 bits of hash, form a class and go on as one node, named by its first document.

Sketch: rounds of hashed bin placement. In each of the first T rounds every shingle falls into one of T bins with a fresh
hash; in the next T rounds all fall into one bin each, so every coordinate is filled; a coordinate keeps its
first round's smallest value. Rounds stop once all are filled, mostly after one or two. Two sets agree in a coordinate
with a probability of their similarity, with concentration as for independent hashing.

Banding: BANDS bands of ROWS coordinates; at a similarity of 0.8 two sets share no band with a probability of 5e-8.

Verification: a bucket doesn't pair its members. Round by round each bucket names one centre, of the component that has
most of its members, and tests it against the members of other components, on the full sets; what is linked
merges. After CENTRE_ROUNDS rounds the members that still share a bucket across components are joined exactly by their rarest
shingles, which leaves few pairs, each tested once. So components are exact for all pairs that share a band.

Sets are 64-bit hashes of words combined over shingles. Null and empty texts: n_shingles 0, a component of their own.
Ties go to the smaller id; repeated rows are members of one class. Rows are told apart by id and text: null ids are ordered behind all others, and
component_id is the id of the first document of the component, so null where that has none. An empty table gives an empty result; a very long
text costs in proportion to its words. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.llm.common import in_order, restored, slim, small_batches, staged, table
from corpusmith.llm.components import components

BANDS, ROWS = 32, 4
T = BANDS * ROWS
SIMILAR = (80, 100)
#: Rounds of centres before the remaining pairs across components are tested one by one.
CENTRE_ROUNDS = 4
REMEMBERED = 500_000

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sets of k-word shingles, as sorted 64-bit hashes."""

    def __init__(self, k: int):
        self.k, self.seen = k, {}

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        seen = self.seen
        if len(seen) > REMEMBERED:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        k = min(self.k, len(h))
        acc = _mix(h[: len(h) - k + 1] + np.uint64(k))
        for j in range(1, k):
            acc = _mix(acc * _STEP + h[j : len(h) - k + 1 + j])
        return np.unique(acc)


def sketch(h: np.ndarray, t: int = T) -> np.ndarray:
    """t coordinates of a non-empty set."""
    out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    n, i = len(h), 0
    while i < 2 * t:
        many = min(max(1, 2048 // n), 2 * t - i)
        r = np.arange(i, i + many, dtype=np.uint64)[:, None]
        x = _mix(h[None, :] + (r + np.uint64(1)) * _STEP)
        bins = np.where(r < t, x % np.uint64(t), r - np.uint64(t) if i + many > t else 0).astype(np.int64)
        key = (r << np.uint64(54)) | (_mix(x) >> np.uint64(10))
        np.minimum.at(out, bins.ravel(), key.ravel())
        if out.max() != np.iinfo(np.uint64).max:
            break
        i += many
    return out


def bands(coordinates: np.ndarray) -> np.ndarray:
    c = coordinates.reshape(BANDS, ROWS)
    acc = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        acc = _mix(acc * _STEP + c[:, j])
    return acc.view(np.int64)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """_doc, n_shingles, d0 and d1 (128 bits of the set; null if empty) and the bands of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(k)
        for b in batches:
            n, digests, found = [], [], []
            for text in b.column(1).to_pylist():
                s = shingles.of(text)
                n.append(len(s))
                digests.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist() if len(s) else (None, None))
                found.append(bands(sketch(s)) if len(s) else None)
            two = [pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *two, pa.array(found, pa.list_(pa.int64()))], ["_doc", "n_shingles", "d0", "d1", "bands"])

    return docs.mapInArrow(run, "_doc bigint, n_shingles bigint, d0 bigint, d1 bigint, bands array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame, k: int, similar: tuple[int, int]) -> DataFrame:
    """a, b, linked for the pairs, on the full sets of the nodes' texts."""
    num, den = similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(k)
        last, left = None, None
        for b in batches:
            linked = []
            for a, ta, tb in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if a != last:
                    last, left = a, shingles.of(ta)
                right = shingles.of(tb)
                both = len(np.intersect1d(left, right, assume_unique=True))
                linked.append(den * both >= num * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    ta, tb = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint, linked boolean")


def rare_pairs(left: DataFrame, texts: DataFrame, k: int, similar: tuple[int, int]) -> DataFrame:
    """a, b: pairs of different components c, one of them `outside`, that can be similar by an exact prefix join.

    Shingles are ordered by their number of nodes here, rarest first. Sets of n and m shingles, n <= m, that are similar share
    need = ceil(num / (num + den) * (n + m)) of them; so they share one among the first n - need + 1 of one and m - need + 1 of
    the other. A shingle of one node alone pairs nothing but takes a place, so a copy with many edits of its own has no pairs."""
    num, den = similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(k)
        for b in batches:
            for node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles.of(text).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), node)), pa.array(s)], ["node", "x"])

    sets = texts.join(left.select("node"), "node", "left_semi").select("node", "text").mapInArrow(run, "node bigint, x bigint")
    sets = staged(sets, "left-sets")
    ordered = sets.join(sets.groupBy("x").agg(F.count("*").alias("df")), "x").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("xs"))
    n = F.size("xs")
    # The least overlap is with a partner of the smallest size allowed.
    prefix = F.slice("xs", 1, n - F.ceil(n * num / den - 1e-9).cast("int") + 1)
    rows = ordered.select("node", n.alias("n"), F.posexplode(prefix).alias("at", "s")).where("s.df > 1").select("node", "n", "at", F.col("s.x").alias("x")).join(left, "node")
    rows = staged(rows, "left-prefixes")
    u = rows.where("outside")
    v = rows.select("x", *[F.col(c).alias(f"{c}_v") for c in ("node", "n", "at", "c", "outside")])
    need = F.ceil((F.col("n") + F.col("n_v")) * num / (num + den) - 1e-9)
    fits = (F.col("n") - F.col("at") >= need) & (F.col("n_v") - F.col("at_v") >= need)
    # The first shingle that two sets share lies within both bounds, so the bounds need no count of earlier ones.
    met = u.join(v, "x").where((F.col("c") != F.col("c_v")) & _could("n", "n_v", similar) & fits & (~F.col("outside_v") | (F.col("node") < F.col("node_v"))))
    return met.select(F.least("node", "node_v").alias("a"), F.greatest("node", "node_v").alias("b")).distinct()


def _could(a: str, b: str, similar: tuple[int, int]):
    """Sets of these sizes can be similar enough."""
    num, den = similar
    return F.least(a, b) * den >= F.greatest(a, b) * num


def near_duplicates(docs: DataFrame, k: int = 2, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept."""
    rows, distinct = in_order(docs.select("doc_id", "text"), nulls_last=True)
    found = linked(distinct, k, similar)
    out = rows.select("_doc", "doc_id").join(found, "_doc")
    names = rows.select(F.col("_doc").alias("component"), F.col("doc_id").alias("component_id")).distinct()
    unique = dict(rows.dtypes)["doc_id"] == "bigint" and rows.where("NOT _doc <=> doc_id").isEmpty()
    out = out.withColumn("component_id", F.col("component")) if unique else out.join(names, "component")
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def linked(docs: DataFrame, k: int, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """_doc, n_shingles, component (the smallest _doc reachable); docs: _doc (unique) and text."""
    small_batches(docs.sparkSession)
    rows = staged(signatures(docs, k), "signatures")
    nodes = rows.where("d0 IS NOT NULL").groupBy("d0", "d1").agg(F.min("_doc").alias("node"), F.min("n_shingles").alias("n"), F.min("bands").alias("bands"))

    # Members of the buckets with two nodes or more; sizes are counted before the members are shuffled.
    member = nodes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    shared = member.groupBy("band", "key").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    member = staged(member.join(shared, ["band", "key"]), "members")

    # One text for each node in a bucket.
    wanted = member.select(F.col("node").alias("_doc")).distinct()
    texts = staged(docs.join(wanted, "_doc").select(F.col("_doc").alias("node"), "text"), "texts")

    of: DataFrame | None = None  # node -> component, so far
    tested: DataFrame | None = None
    for r in range(CENTRE_ROUNDS + 1):
        m = member.join(of, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component") if of is not None else member.withColumn("c", F.col("node"))
        if r:
            mixed = m.groupBy("band", "key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("band", "key")
            m = m.join(mixed, ["band", "key"])
        if r < CENTRE_ROUNDS:
            # The centre: of the component with most members here, the member that comes first in this round's order.
            order = F.struct((F.xxhash64("node", "band", F.lit(r)) if r else F.col("node")).alias("h"), F.col("node"), F.col("n"))
            each = m.groupBy("band", "key", "c").agg(F.count("*").alias("size"), F.min(order).alias("o"))
            centre = each.groupBy("band", "key").agg(F.max(F.struct("size", F.col("c").alias("cc"), "o")).alias("x")).select("band", "key", F.col("x.cc").alias("cc"), F.col("x.o.node").alias("a"), F.col("x.o.n").alias("na"))
            found = m.join(centre, ["band", "key"]).where("c != cc").where(_could("n", "na", similar)).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
        else:
            most = m.groupBy("band", "key", "c").agg(F.count("*").alias("size")).groupBy("band", "key").agg(F.max(F.struct("size", "c")).alias("x")).select("band", "key", F.col("x.c").alias("cc"))
            left = m.join(most, ["band", "key"]).groupBy("node", "c").agg(F.max(F.col("c") != F.col("cc")).alias("outside"))
            found = rare_pairs(staged(left, "left"), texts, k, similar)
        found = found.distinct()
        if tested is not None:
            found = found.join(tested, ["a", "b"], "left_anti")
        result = staged(verified(found, texts, k, similar), "tested")
        counts = result.agg(F.count("*"), F.count_if("linked")).first()
        tested = result if tested is None else tested.unionAll(result)
        if counts[1]:
            of = staged(components(tested.where("linked").select("a", "b")), "components")
    class_of = nodes.select("d0", "d1", "node")
    class_of = class_of.join(of, "node", "left") if of is not None else class_of.withColumn("component", F.col("node"))
    class_of = class_of.select("d0", "d1", F.coalesce("component", "node").alias("component"))
    return rows.select("_doc", "n_shingles", "d0", "d1").join(class_of, ["d0", "d1"], "left").select("_doc", "n_shingles", F.coalesce("component", "_doc").alias("component"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, 0.8) stays, that with the smallest id, then hash of the text.

    Rows count by id and text, so repeated ids are told apart; null ids come last. Equal rows are a group; rows without words are none and stay."""
    rows, distinct = in_order(slim(docs), nulls_last=True)
    found = linked(distinct, 5).where("_doc = component").select("_doc", F.col("n_shingles").alias("_n"))
    kept = rows.join(found, "_doc")
    return restored(kept.where("_n > 0").dropDuplicates(["_doc"]).unionAll(kept.where("_n = 0")), docs)
