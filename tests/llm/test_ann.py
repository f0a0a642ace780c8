import numpy as np
import pytest

from corpusmith.llm import ann
from tests.oracle import DATA


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 0.5) for i, v in rows], "vec_id long, embedding array<float>, v string, score double")


def brute(rows, asked, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    n = np.linalg.norm(x, axis=1)
    out = {}
    for q in asked:
        i = int(np.flatnonzero(ids == q)[0])
        s = x @ x[i] / (n * n[i])
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[q] = [(int(ids[j]), s[j]) for j in order]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    d = f"{DATA}/{sf}"
    got = {}
    for r in ann.op3_ann(spark, d).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 50 == 0])
    assert set(got) == set(want)
    hit = sum(len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) for q in want)
    assert hit >= 0.9 * 5 * len(want)
    for q, found in got.items():
        assert sorted(found) == [1, 2, 3, 4, 5]
        scores = [found[k][1] for k in range(1, 6)]
        assert scores == sorted(scores, reverse=True) and q not in {v for v, _ in found.values()}


def test_equal_vectors_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    one = rng.normal(size=6)
    rows = [(i, one) for i in range(0, 400, 2)] + [(i, rng.normal(size=6)) for i in range(1, 200, 2)]
    bad = [(1000, None), (1050, np.zeros(6)), (1100, [float("nan")] + [1.0] * 5), (1150, [float("inf")] + [1.0] * 5), (1200, [None] + [1.0] * 5)]
    out = ann.nearest(frame(spark, rows + bad), lambda i: i % 50 == 0).collect()
    by = {}
    for r in out:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == {i for i, _ in rows if i % 50 == 0}
    for q, found in by.items():
        assert [v for _, v, _ in sorted(found)] == [i for i in range(0, 14, 2) if i != q][:5]
        assert all(s == pytest.approx(1.0) for *_, s in found)


def test_any_magnitude_and_length(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5) * 10.0 ** rng.choice([-300, -200, 0, 150, 300])) for i in range(60)]
    rows += [(60, [3.0, 4.0]), (61, [1.0]), (62, [5e-324, 0, 0, 0, 0])]
    got = {}
    for r in ann.nearest(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>"), lambda i: i % 10 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    plain = [(i, np.pad(np.asarray(v, float), (0, 5 - len(v))) / np.abs(v).max()) for i, v in rows]
    want = brute(plain, [i for i, _ in rows if i % 10 == 0])
    assert {q: [v for _, v, _ in sorted(f)] for q, f in got.items()} == {q: [v for v, _ in f] for q, f in want.items()}
    for q, found in got.items():
        assert [s for *_, s in sorted(found)] == pytest.approx([s for _, s in want[q]])


def test_lists_too_short_for_an_answer(spark, monkeypatch):
    """With a vector a list, the lists within the ratio hold fewer than five: the next ones are scanned too."""
    rng = np.random.default_rng(2)
    rows = [(i, np.r_[10.0, np.zeros(7)] + rng.normal(size=8) if i % 2 else rng.normal(size=8)) for i in range(300)]
    for name, v in (("LIST_SIZE", 1), ("TARGET", 0.0), ("SEARCH_RATIO", 0.0), ("ASKED", 2), ("BLOCK", 1)):
        monkeypatch.setattr(ann, name, v)
    got = {}
    for r in ann.nearest(frame(spark, rows), lambda i: i % 50 == 0).collect():
        got.setdefault(r.query_id, []).append(r["rank"])
    assert {q: sorted(x) for q, x in got.items()} == {i: [1, 2, 3, 4, 5] for i in range(0, 300, 50)}


def test_repeats_few_and_none(spark):
    two = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (7, [0.5, 0.5])]
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(frame(spark, two), lambda i: i % 50 == 0).collect()] == [(50, 1, 7)]
    assert ann.nearest(frame(spark, []), lambda i: i % 50 == 0).count() == 0
    assert ann.nearest(frame(spark, [(50, [1.0])]), lambda i: i % 50 == 0).count() == 0


def test_balance_and_graph():
    x = ann.unit(np.random.default_rng(1).normal(size=(3000, 16)))
    c = ann.Centroids(ann.balanced_centroids(x, 64))
    d = np.linalg.norm(x[:50, None] - c.c[None], axis=2)
    for row, dist in zip(x[:50], d):
        want = set(np.flatnonzero(dist <= (1 + ann.SEARCH_RATIO) * dist.min()).tolist())
        got = set(c.search(row).tolist())
        assert int(dist.argmin()) in got and len(got & want) >= 0.9 * len(want)
    sizes = np.bincount([t[0] for t in [np.array([r.argmin()]) for r in d]], minlength=64)
    assert sizes.max() <= 10
    for lists, dist in zip(c.lists_of(x[:50]), d):
        assert int(dist.argmin()) in lists.tolist() and 1 <= len(lists) <= ann.REPLICAS


def test_recall_holds_with_many_lists():
    # Few vectors a list, as where the number of lists is at its bound: a fixed ratio then keeps too few of them.
    rng = np.random.default_rng(4)
    x = ann.unit(rng.normal(size=(60_000, 64)))
    c = ann.Centroids(ann.balanced_centroids(x[:20_000], 2048))
    asked, others = x[:150], x[150:]
    near = np.argsort(-(asked @ others.T), axis=1)[:, :5]
    ratio, graph = c.calibrated(asked[:100], np.repeat(np.arange(100), 5), others[near[:100].ravel()])

    def recall(rows, *by):
        kept = [set(c.search(q, *by).tolist()) for q in asked[rows]]
        return np.mean([not k.isdisjoint(h.tolist()) for k, n in zip(kept, near[rows]) for h in c.lists_of(others[n])])

    assert recall(slice(100, 150), 0.10) < 0.9 <= recall(slice(100, 150), ratio, graph)


def test_true_neighbours(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8)) for i in range(700)]
    entries = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "uid long, v array<double>")
    tried = entries.where("uid % 50 = 0").toPandas()
    got = {}
    for r in ann.true_neighbours(entries, tried, 5).itertuples():
        got.setdefault(int(tried.uid[r.q]), set()).add(r.uid)
    assert got == {q: {i for i, _ in found} for q, found in brute(rows, tried.uid.tolist()).items()}
