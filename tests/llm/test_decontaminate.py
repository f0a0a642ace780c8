import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmith.llm import decontaminate
from tests.llm.helpers import CLASHES, documents
from tests.oracle import DATA, assert_same, connect


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items):
    out = {}
    for i, t in docs:
        w = words(t)
        for j, s in items:
            v = words(s)
            n, k = len(v), min(len(v), 5)
            if not n:
                continue
            theirs = Counter(tuple(v[p : p + k]) for p in range(n - k + 1))
            best = None
            for a in range(len(w) - n + 1):
                mine = Counter(tuple(w[p : p + k]) for p in range(a, a + n - k + 1))
                share = sum((mine & theirs).values()) / sum((mine | theirs).values())
                if share >= 0.8 - 1e-12 and (best is None or share > best[1]):
                    best = (a, share)
            if best:
                out[i, j] = (best[0], n, pytest.approx(best[1]))
    return out


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(spark):
    rng = random.Random(6)
    make = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    items = [(j, " ".join(make(rng.choice([3, 12, 30, 60])))) for j in range(12)] + [(50, None), (51, ""), (52, "solo"), (53, "a b " * 10)]
    docs = [(0, None), (1, ""), (2, "Solo!"), (3, "a b " * 30), (4, "A, b. " * 10 + "x")]
    for i in range(5, 60):
        leak = words(rng.choice(items[:12])[1])
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(leak))
            leak = leak[:k] + (make(1) if rng.random() < 0.7 else []) + leak[k + 1 :]
        body = make(rng.randint(0, 40)) + leak + make(rng.randint(0, 40))
        docs.append((i, ", ".join(body).upper() if i % 3 else " ".join(body)))
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.similarity) for r in decontaminate.leaks(documents(spark, docs, CLASHES), benchmark(spark, items)).collect()}
    assert got == brute(docs, items)


def test_edges(spark):
    none = documents(spark, [])
    assert decontaminate.leaks(none, benchmark(spark, [(1, "a b c d e f")])).count() == 0
    docs = documents(spark, [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "z " * 50_000)])
    assert decontaminate.leaks(docs, benchmark(spark, [])).count() == 0
    out = decontaminate.leaks(docs, benchmark(spark, [(7, "A B C D E F G"), (7, "A B C D E F G"), (8, "z " * 3_000)])).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(1, 7), (2, 8)}


def test_shuffled_when_large(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 1)
    docs, items = [(1, "x a b c d e f g h y"), (2, "other words here")], [(1, "a b c d e f g h")]
    assert [(r.doc_id, r.start_word) for r in decontaminate.leaks(documents(spark, docs), benchmark(spark, items)).collect()] == [(1, 1)]


def test_simhash(spark):
    h = [random.Random(i).getrandbits(64) - (1 << 63) for i in range(9)]
    got = spark.createDataFrame([(h,)], "h array<long>").select(decontaminate.simhash(F.col("h"))).first()[0]
    bits = [8 * i + k for i in range(8) for k in range(4)]
    assert got == sum(1 << b for b in bits if 2 * sum((x % (1 << 64)) >> b & 1 for x in h) > len(h))


def test_windows_are_fingerprinted_at_every_stride(spark):
    h = [random.Random(i).getrandbits(64) - (1 << 63) for i in range(45)]
    docs = spark.createDataFrame([(1, h), (2, h[:3])], "_doc long, hs array<long>")
    for w in (1, *decontaminate.LADDER):
        got = Counter(r.f for r in decontaminate.windows(docs, [w]).where(F.col("_doc") == 1).collect())
        step = decontaminate.stride(w)
        parts = spark.createDataFrame([(h[i : i + w],) for i in range(0, len(h) - w + 1, step)], "h array<long>")
        want = Counter(r.f for r in parts.select(decontaminate.simhash(F.col("h")).alias("f")).collect())
        # a window that reaches into the last, cut block is not made; the item's places cover it
        assert sum((want - got).values()) <= (45 % step > 0) and not got - want, w


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_all_within_the_radius_are_found(spark, monkeypatch, radius):
    """The blocks find every pair of fingerprints that differ in up to RADIUS bits, whichever they are."""
    monkeypatch.setattr(decontaminate, "RADIUS", radius)
    rng = random.Random(3)
    h = [rng.getrandbits(63) for _ in range(30)]
    items = spark.createDataFrame([(1, 1, h)], "_i long, w int, h array<long>")
    used = [8 * i + k for i in range(8) for k in range(4)]
    near = [(n, [rng.choice(h) ^ sum(1 << b for b in rng.sample(used, n % 7))]) for n in range(200)]
    got = {r._doc for r in decontaminate.candidates(spark.createDataFrame(near, "_doc long, hs array<long>"), items).collect()}
    assert got == {n for n in range(200) if n % 7 <= radius}


def test_query(spark):
    assert_same(decontaminate.op9_decontaminate(spark, f"{DATA}/sf0.01"), connect("sf0.01"), decontaminate.SQL)


def test_documents_shorter_than_the_item(spark):
    item = [f"w{i}" for i in range(50)]
    docs = [(1, item[:-1]), (2, item[3:]), (3, item[:45]), (4, item[:40]), (5, item[:2] + ["x"] + item[3:49]), (6, item[:4]), (7, item[1:] + ["y"])]
    out = decontaminate.leaks(documents(spark, [(i, " ".join(w)) for i, w in docs]), benchmark(spark, [(7, " ".join(item))])).collect()
    got = {r.doc_id: (r.start_word, r.n_words, r.similarity) for r in out}
    theirs = Counter(zip(*[item[j:] for j in range(5)]))
    want = {}
    for i, w in docs:
        mine = Counter(zip(*[w[j:] for j in range(5)]))
        share = sum((mine & theirs).values()) / sum((mine | theirs).values())
        if share >= 0.8:
            want[i] = (0, len(w), pytest.approx(share))
    assert got == want and set(want) == {1, 2, 3, 5, 7}


def test_repeated_and_null_ids_in_the_stage(spark, tmp_path):
    item = " ".join(f"w{i}" for i in range(20))
    benchmark(spark, [(1, item)]).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, [(None, f"x {item} y"), (None, "clean"), (3, f"{item} z"), (3, "also clean"), (4, ""), (5, None)], CLASHES)
    out = decontaminate.decontamination_stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, "clean"), (3, "also clean"), (4, ""), (5, "")]
