import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusmith.operators import grams


def batches(rows, size):
    t = pa.table({"lang": pa.array([r[0] for r in rows], pa.string()), "t": pa.array([r[1] for r in rows], pa.list_(pa.string()))})
    return t.to_batches(max_chunksize=size)


@pytest.mark.parametrize("orders", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("chunk", [1, 40, 10_000])
def test_blocks_give_the_counts_of_all_rows(monkeypatch, orders, chunk):
    monkeypatch.setattr(grams, "CHUNK", chunk)
    rng = random.Random(orders)
    words = ["a", "b", "é" * 300, "", "\0", "a b", *(f"w{i}" for i in range(400))]
    rows = [(rng.choice(["x", None]), [rng.choice(words[: rng.choice([3, 406])]) for _ in range(rng.randint(0, 30))]) for _ in range(60)] + [("x", None), ("y", []), ("y", ["a"])]
    want = {}
    for lang, tokens in rows:
        for n in range(1, orders + 1):
            for i in range(len(tokens or []) - n + 1):
                want.setdefault((lang, n), Counter())[tuple(tokens[i : i + n])] += 1
    dealt = pa.Table.from_batches(grams.deal(batches(rows, 7), ["lang"], orders, 5, frozenset([b"a"])))
    got = {}
    for task in range(5):
        of = dealt.filter(pa.array(np.array(dealt.column("_task")) == task))
        for r in [r for b in grams.count(of.to_batches(), orders) for r in b.to_pylist()]:
            d, g, m = got.get((r["lang"], r["n"]), (0, 0, 0))
            got[r["lang"], r["n"]] = d + r["distinct_grams"], g + r["grams"], max(m, r["most"])
    assert {k: v for k, v in got.items() if v[0]} == {k: (len(c), c.total(), max(c.values())) for k, c in want.items()}


def test_a_rare_word_goes_to_few_tasks_and_a_common_one_to_all():
    rng = random.Random(3)
    rows = [("x", [w for _ in range(200) for w in ("everywhere", f"{rng.randrange(10**4)}")]) for _ in range(20)] + [("x", ["a", "b", "onlyhereandnow", "c", "d"])]

    def tasks(word, often):
        dealt = next(grams.deal(batches(rows, 100), ["lang"], 4, 16, often))
        return sum(word in grams.unpacked(b, 4)[0].to_pylist() for b in dealt.column("_block").to_pylist())

    assert tasks(b"onlyhereandnow", frozenset()) <= 3
    of = [len(b) for b in next(grams.deal(batches(rows, 100), ["lang"], 4, 16, frozenset([b"everywhere"]))).column("_block").to_pylist()]
    assert len(of) == 16 and max(of) < 2 * sorted(of)[8]


def test_keys_that_do_not_fit_beside_their_place():
    key = np.array([1 << 62, 5, 1 << 62, 0], np.int64)
    values, which, counts = grams._unique(key)
    assert values.tolist() == [0, 5, 1 << 62] and which.tolist() == [2, 1, 2, 0] and counts.tolist() == [1, 1, 2]


def test_common_words_are_those_of_the_whole_input(spark):
    rows = [(["often", f"w{i}", f"v{i}", "twice" if i < 2 else None],) for i in range(400)]
    assert grams.common(spark.createDataFrame(rows, "t array<string>").repartition(3), "t", 4) == frozenset([b"often"])
    assert grams.common(spark.createDataFrame([], "t array<string>"), "t", 4) == frozenset()
