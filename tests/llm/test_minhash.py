import random

import numpy as np
import pytest

from corpusmith.llm import minhash
from corpusmith.llm.components import components
from tests.llm.helpers import CLASHES, documents


def shingles(t, k):
    w = (t or "").encode().lower().split()
    return frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def brute(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def copies(rng, n=90, spread=0.3):
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randint(3, 90))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(1 + int(spread * len(w)))):
            w[rng.randrange(len(w))] = f"w{rng.randrange(3000)}"
        rows.append((i, " ".join(w) if rng.random() < 0.8 else " ".join(w).upper()))
    return rows


@pytest.mark.parametrize("k, spread", [(2, 0.12), (2, 0.3), (5, 0.1)])
def test_against_brute_force(spark, k, spread):
    rows = copies(random.Random(f"{k}{spread}"), spread=spread)
    got = {r.doc_id: tuple(r)[1:] for r in minhash.near_duplicates(documents(spark, rows, CLASHES), k).collect()}
    assert got == brute(rows, k)


def test_what_centres_leave_is_joined_exactly(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CENTRE_ROUNDS", 1)
    rows = copies(random.Random(8), 150, 0.2)
    got = {r.doc_id: tuple(r)[1:] for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    assert got == brute(rows, 2)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (6, "two"), (7, "a b"), (8, "b a"), (9, "É x"), (10, "é x"), (11, "z " * 30_000), (12, "z z")]
    got = {r.doc_id: tuple(r)[1:] for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    assert got == brute(rows, 2)
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


def test_repeated_and_null_ids(spark):
    out = minhash.near_duplicates(documents(spark, [(2, "a b c d"), (2, "a b c d"), (2, "x y z"), (5, "a b c d"), (None, "q r s"), (None, None)])).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in out)
    assert [g for g in got if g[0] >= 0] == [(2, 2, 2), (2, 3, 2), (2, 3, 2), (5, 3, 2)]


def test_stage_keeps_the_first(spark):
    t = " ".join(f"w{i}" for i in range(60))
    docs = documents(spark, [(3, t), (1, t + " end"), (2, "something else entirely"), (9, None)])
    out = minhash.minhash_stage(spark, docs, "")
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {1, 2, 9}


def test_null_and_repeated_ids_in_the_stage(spark):
    """Decided by row: a unique text stays whatever its id, a copy goes whatever its id, and equal rows become one."""
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(None, "unique words of no id"), (4, t), (4, t + " end"), (4, "another text of this id"), (7, "twice the same row"), (7, "twice the same row"), (8, ""), (8, ""), (9, t)]
    out = minhash.minhash_stage(spark, documents(spark, rows, CLASHES), "")
    assert out.columns == documents(spark, [], CLASHES).columns
    got = sorted((r.doc_id or -1, len(r.text or "")) for r in out.collect())
    texts = [n for i, n in got if i == 4]
    assert [g for g in got if g[0] != 4] == [(-1, 21), (7, 18), (8, 0), (8, 0)] and len(texts) == 2 and 23 in texts


def test_the_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: tuple(r)[1:] for r in minhash.op8_minhash(spark, sf).collect()} == brute(rows, 2)


def test_sketch():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 62, 400, dtype=np.uint64))
    b = np.concatenate((a[:320], rng.integers(0, 1 << 62, 80, dtype=np.uint64)))
    same = [(minhash.sketch(minhash._mix(a + np.uint64(s))) == minhash.sketch(minhash._mix(b + np.uint64(s)))).mean() for s in range(20)]
    assert abs(np.mean(same) - 320 / 480) < 0.04
    for n in (1, 2, 7, 129):
        s = minhash.sketch(a[:n])
        assert (s != np.iinfo(np.uint64).max).all() and (s == minhash.sketch(a[:n])).all()


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2060)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
