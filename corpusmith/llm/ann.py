"""Approximate nearest neighbours by balanced posting lists.

Build: a bounded sample of the vectors is split in halves, again and again, by two-means with a cut at the median, into lists of
equal size; a list's centroid is the mean of its part of the sample. Every vector of the table is then indexed: it goes to its
nearest list and, as a boundary vector, to others whose centroid is at most (1 + REPLICA_RATIO) times as far, up to REPLICAS lists.

Search: a query finds its nearest centroids by best-first search in a graph that links each centroid with near ones, held in memory
(LISTS centroids at most), and keeps the lists whose centroid is at most (1 + ratio) times as far as the nearest
one. The ratio is SEARCH_RATIO or more: on a sample of the queries, whose nearest vectors one exact pass over the table finds, it is
raised until the lists kept hold TARGET of those, so recall holds as tables and lists grow. Lists that hold too few vectors for an answer of k are
joined by the next nearest. A list is scanned in blocks of a bounded number of vectors and a bounded number of queries, dealt to tasks by list and both
blocks; every block hands on its best few for each query, so no task sees an unbounded group and no pairs are written.

Equal vectors form one entry with its smallest ids, as many as an answer can need, so a vector that a third of the rows share
neither fills a list nor an answer. Scores are cosines in double precision on the original vectors; ties go to the smaller id.

Vectors that are null, zero, or hold null or non-finite components take no part. Shorter vectors than the longest count as if zeros
followed, so all others do. Magnitudes don't matter: vectors are scaled by a power of two, which is exact, before they are multiplied.
Rows that repeat an id and its vector are one. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmith.llm.common import small_batches, staged, table

#: Vectors that the lists are fitted on at least, if there are as many, and for each list; vectors a list should hold, and lists at most. Beyond
#: LIST_SIZE * LISTS vectors the lists grow.
SAMPLE, SAMPLE_PER_LIST, LIST_SIZE, LISTS = 20_000, 8, 200, 16_384
REPLICAS, REPLICA_RATIO = 4, 0.3
SEARCH_RATIO = 0.13
#: Queries that the ratio is calibrated on at most, and the share of their nearest vectors that the lists kept must hold.
CALIBRATED, TARGET = 200, 0.97
#: Neighbours of a centroid in the graph; centroids where each search starts.
DEGREE, ENTRIES = 24, 8
#: Vectors of a list and queries that one task compares at a time.
BLOCK, ASKED = 4096, 2048


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares neither vanish nor overflow; cosines stay exactly the same."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 5) -> np.ndarray:
    """Means of `lists` (a power of two) parts of x of equal size, by two-means with a cut at the median."""
    rng = np.random.default_rng(seed)
    parts = [x]
    while len(parts) < lists:
        split = []
        for p in parts:
            a, b = p[rng.choice(len(p), 2, replace=False)] if len(p) > 1 else (p[0], p[0])
            for _ in range(6):
                order = np.argsort(p @ (a - b), kind="stable")
                low, high = p[order[: len(p) // 2]], p[order[len(p) // 2 :]]
                a, b = high.mean(0), low.mean(0) if len(low) else high.mean(0)
            split += [low if len(low) else p, high]
        parts = split
    return np.stack([p.mean(0) for p in parts])


class Centroids:
    """Centroids and the graph by which they are searched."""

    def __init__(self, c: np.ndarray):
        self.c, self.sq = c, (c**2).sum(1)
        near = np.concatenate([np.argsort(self.sq[None, :] - 2 * c[i : i + 512] @ c.T, axis=1, kind="stable")[:, 1 : DEGREE + 1] for i in range(0, len(c), 512)])
        links = [set(row) for row in near.tolist()]
        for i, row in enumerate(near.tolist()):
            for j in row[: DEGREE // 2]:
                links[j].add(i)
        self.links = [np.array(sorted(x), np.int64) for x in links]
        self.entries = np.linspace(0, len(c) - 1, min(ENTRIES, len(c))).astype(np.int64)

    def lists_of(self, x: np.ndarray) -> list[np.ndarray]:
        """For indexing: per row of x the nearest list and those for which it is a boundary vector."""
        d = np.sqrt(np.maximum(self.sq[None, :] + (x**2).sum(1)[:, None] - 2 * x @ self.c.T, 0))
        k = min(REPLICAS, len(self.c))
        top = np.argpartition(d, k - 1, axis=1)[:, :k]
        dt = np.take_along_axis(d, top, 1)
        return [t[e <= (1 + REPLICA_RATIO) * e.min()] for t, e in zip(top, dt, strict=True)]

    def search(self, q: np.ndarray, ratio: float = SEARCH_RATIO, graph: bool = True) -> np.ndarray:
        """Lists to scan for one query: best-first over the graph until nothing within the ratio is left to expand; or by all centroids."""
        if not graph:
            d = np.sqrt(np.maximum(self.sq + q @ q - 2 * self.c @ q, 0))
            return np.flatnonzero(d <= (1 + ratio) * d.min())
        seen = np.zeros(len(self.c), bool)
        q_sq = q @ q
        found, ds, heap, best = [], [], [], np.inf
        new = self.entries
        while True:
            seen[new] = True
            d = np.sqrt(np.maximum(self.sq[new] + q_sq - 2 * self.c[new] @ q, 0))
            best = min(best, d.min()) if len(d) else best
            found.append(new)
            ds.append(d)
            for x in zip(d.tolist(), new.tolist(), strict=True):
                heapq.heappush(heap, x)
            # a little beyond the ratio, lest a list within it be reached only through one outside
            while heap:
                at, node = heapq.heappop(heap)
                if at > (1 + 1.25 * ratio) * best:
                    heap.clear()
                    break
                new = self.links[node][~seen[self.links[node]]]
                if len(new):
                    break
            else:
                break
            if not heap and not len(new) or at > (1 + 1.25 * ratio) * best:
                break
        found, ds = np.concatenate(found), np.concatenate(ds)
        return found[ds <= (1 + ratio) * best]

    def enough(self, q: np.ndarray, kept: np.ndarray, sizes: np.ndarray, wanted: int) -> np.ndarray:
        """The lists kept, and the next nearest ones as long as they hold fewer than `wanted` entries."""
        if sizes[kept].sum() >= wanted:
            return kept
        rest = np.argsort(self.sq - 2 * self.c @ q, kind="stable")
        rest = rest[~np.isin(rest, kept)]
        some = np.searchsorted(np.cumsum(sizes[rest]), wanted - sizes[kept].sum()) + 1
        return np.concatenate([kept, rest[:some]])

    def calibrated(self, asked: np.ndarray, of: np.ndarray, near: np.ndarray) -> tuple[float, bool]:
        """ratio and graph for `search`, so that TARGET of the vectors `near` lie in a list kept for the query asked[of] that each is nearest to."""
        if not len(near):
            return SEARCH_RATIO, True
        homes = self.lists_of(near)
        d = np.sqrt(np.maximum(self.sq[None, :] + (asked**2).sum(1)[:, None] - 2 * asked @ self.c.T, 0))
        least = np.maximum(d.min(1), 1e-12)
        needed = np.array([d[i, h].min() / least[i] - 1 for i, h in zip(of, homes, strict=True)])
        exact = max(SEARCH_RATIO, float(np.quantile(needed, TARGET, method="higher")) + 1e-9)
        # The graph may miss a list within the ratio: a wider one makes up for it, or else all centroids are looked at.
        for ratio in (exact, 1.1 * exact, 1.25 * exact):
            kept = [set(self.search(q, ratio).tolist()) for q in asked]
            if sum(not kept[i].isdisjoint(h.tolist()) for i, h in zip(of, homes, strict=True)) >= TARGET * len(near):
                return ratio, True
        return exact, False


def _valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (array<double>) of the vectors that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull())
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = v.where(F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    longest = v.agg(F.max(F.size("v"))).first()[0] or 0
    return v.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("v"))))


def true_neighbours(entries: DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """q (place in asked), uid, v: the k nearest entries of each vector asked (uid, v), by comparing all."""
    shared = entries.sparkSession.sparkContext.broadcast((unit(np.stack(asked.v.to_numpy())), asked.uid.to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own = shared.value
        best = np.full((len(q), 0), 0.0)
        ids, vs = np.empty((len(q), 0), np.int64), np.empty((len(q), 0, q.shape[1]))
        for b in batches:
            if not b.num_rows:
                continue
            uid = b.column(0).to_numpy()
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            s = q @ unit(x).T
            s[own[:, None] == uid[None, :]] = -np.inf
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            best, ids, vs = np.concatenate([best, np.take_along_axis(s, top, 1)], 1), np.concatenate([ids, uid[top]], 1), np.concatenate([vs, x[top]], 1)
            top = np.argsort(-best, axis=1, kind="stable")[:, :k]
            best, ids, vs = np.take_along_axis(best, top, 1), np.take_along_axis(ids, top, 1), np.take_along_axis(vs, top[:, :, None], 1)
        if best.shape[1]:
            of, there = np.nonzero(np.isfinite(best))
            yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), pa.array(ids[of, there]), pa.array(best[of, there]), pa.array(list(vs[of, there]), pa.list_(pa.float64()))], ["q", "uid", "score", "v"])

    few = entries.select("uid", "v").mapInArrow(run, "q int, uid bigint, score double, v array<double>")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "uid")
    return few.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("q", "uid", "v").toPandas()


def nearest(vectors: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector whose id satisfies `queries` (a Column -> Column), among all others."""
    spark = vectors.sparkSession
    small_batches(spark)
    valid = _valid(vectors, id_col, vec_col)
    # Entries: distinct vectors with their k + 1 smallest ids; the limit per vector is applied before the shuffle too.
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = valid.withColumn("r", rank).where(F.col("r") <= k + 1)
    entries = staged(few.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.element_at("ids", 1).alias("uid"), "ids", "v"), "ann-entries")
    n = entries.count()
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if n < 1:
        return spark.createDataFrame([], empty)
    lists = 1
    while lists * 2 * LIST_SIZE <= n and lists < LISTS:
        lists *= 2
    sample = entries.orderBy(F.xxhash64("uid"), "uid").limit(max(SAMPLE, SAMPLE_PER_LIST * lists)).select("uid", "v").toPandas().sort_values("uid")
    centroids = Centroids(balanced_centroids(unit(np.stack(sample.v.to_numpy())), min(lists, 1 << (len(sample).bit_length() - 1))))
    shared = spark.sparkContext.broadcast(centroids)
    asked = valid.where(queries(F.col("id"))).select("id", "v")
    keyed = asked.join(entries.select("v", "uid"), "v").select("id", "uid")
    wanted = entries.join(keyed.select("uid").distinct(), "uid").select("uid", "v")
    ratio, graph = SEARCH_RATIO, True
    tried = wanted.orderBy(F.xxhash64(F.lit(1), "uid"), "uid").limit(CALIBRATED).toPandas() if lists > 1 else []
    if len(tried):
        near = true_neighbours(entries, tried, k)
        if len(near):
            ratio, graph = centroids.calibrated(unit(np.stack(tried.v.to_numpy())), near.q.to_numpy(), unit(np.stack(near.v.to_numpy())))

    def place(searched: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                u = unit(x)
                to = [c.enough(row, c.search(row, ratio, graph), sizes, (k + 1) * REPLICAS) for row in u] if searched else c.lists_of(u)
                many = np.fromiter(map(len, to), np.int64, len(to))
                row = np.repeat(np.arange(len(to)), many)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to).astype(np.int32)), b.column(0).take(at), b.column(1).take(at)], ["list", "uid", "v"])

        return run

    index = entries.select("uid", "v").mapInArrow(place(False), "list int, uid bigint, v array<double>")
    index = staged(index, "ann-index")
    held = index.groupBy("list").agg(F.count("*").alias("n")).toPandas()  # one row a list
    sizes = np.zeros(len(centroids.c), np.int64)
    sizes[held.list] = held.n
    probes = staged(wanted.mapInArrow(place(True), "list int, uid bigint, v array<double>"), "ann-probes")
    pieces = lambda t, size, name: t.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    blocks = F.broadcast(pieces(index, BLOCK, "blocks").join(pieces(probes, ASKED, "parts"), "list"))  # LISTS rows at most
    piece = lambda id_col, count: F.pmod(F.xxhash64(id_col), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = index.join(blocks, "list").select("list", piece("uid", "blocks").alias("block"), every("parts").alias("part"), "uid", "v")
    right = probes.join(blocks, "list").select("list", every("blocks").alias("block"), piece("uid", "parts").alias("part"), F.col("uid").alias("q"), "v")

    def scan(there: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(there) and len(ask):
            x, ids = scaled(np.stack(there.v.to_numpy())), there.uid.to_numpy()
            order = np.argsort(ids, kind="stable")
            x, ids = x[order], ids[order]
            norms = np.linalg.norm(x, axis=1)
            for at in range(0, len(ask), 256):
                part = ask.iloc[at : at + 256]
                q = scaled(np.stack(part.v.to_numpy()))
                s = (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * norms[None, :])
                best = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
                out.append(pd.DataFrame({"q": np.repeat(part.q.to_numpy(), best.shape[1]), "uid": ids[best].ravel(), "score": np.take_along_axis(s, best, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"q": pd.Series(dtype="int64"), "uid": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    hits = left.groupBy("list", "block", "part").cogroup(right.groupBy("list", "block", "part")).applyInPandas(scan, "q bigint, uid bigint, score double")
    # The same pair may come from several lists: one of them counts. Of each query k + 1 entries suffice.
    hits = hits.groupBy("q", "uid").agg(F.max("score").alias("score"))
    hits = hits.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "uid"))).where(F.col("r") <= k + 1).drop("r")
    named = hits.join(entries.select("uid", "ids"), "uid").select("q", "score", F.explode("ids").alias("vec_id"))
    answers = keyed.distinct().join(named, keyed.uid == named.q).where("id != vec_id").select(F.col("id").alias("query_id"), "vec_id", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)
