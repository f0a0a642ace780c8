import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusmith.llm import variants
from tests.llm.helpers import CLASHES, documents
from tests.oracle import assert_same, connect


def counted(rows, min_chars, min_count, every=97):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= min_chars and k >= min_count}


def are_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    short, long = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(n):
    near = {w: [v for v in n if are_near(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] is not None else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def rows_of(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=lambda r: r[0])


def test_neighbours_are_all_and_distinct():
    rng = random.Random(1)
    alphabet = "abcé"
    for _ in range(60):
        n = rng.randint(1, 7)
        words = ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(rng.randint(1, 4))]
        (_, codes), *_ = variants.by_length(words)
        got = {w: [] for w in range(len(words))}
        for kind, row, at, letter, h in variants.neighbours(codes, np.array([ord(c) for c in alphabet], np.uint64)):
            for r, a, c, x in zip(row.tolist(), at.tolist(), letter.tolist(), h, strict=True):
                s = variants.written(words[r], kind, a, c)
                assert not s or variants.hashes(np.array([[ord(y) for y in s]], np.uint64))[0] == x
                got[r].append(s)
        for r, w in enumerate(words):
            want = {w[:i] + w[i + 1 :] for i in range(n)} | {w[:i] + c + w[i + 1 :] for i in range(n) for c in alphabet if c != w[i]} | {w[:i] + c + w[i:] for i in range(n + 1) for c in alphabet}
            assert sorted(got[r]) == sorted(want)


@pytest.mark.parametrize("bits", [7, 20])
def test_against_brute_force_with_any_array(spark, bits, monkeypatch):
    monkeypatch.setattr(variants, "AT_ONCE", 97)
    rng = random.Random(bits)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(3, 7))) for _ in range(30)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randint(0, 12)):
            w = rng.choice(base[: rng.choice([2, 5, 30])])
            words.append(rng.choice([w, w.upper(), w[:-1] + rng.choice("abcdé"), w + "e", w[1:]]))
        rows.append((i, rng.choice([" ", "-", "1", "漢"]).join(words)))
    docs = documents(spark, rows, CLASHES)
    assert rows_of(variants.group_variants(docs, 3, 2, 5, bits)) == brute(counted(rows, 3, 2, 5))


def test_edges(spark):
    long = "abcdefghij" * 2000
    rows = [(None, "Seven seven SEVEN"), (None, "Seven seven SEVEN"), (1, None), (2, ""), (3, "seveN sevem sevem sevem"), (4, f"{long} {long} {long} {long}x {long}x {long}x"), (5, "Àccent Àccent Àccent àccent àccent àccent àccent àccent àccent àccent")]
    docs = documents(spark, rows, [*CLASHES, ("word", "x"), ("form", "x"), ("d", "x"), ("r", "x")])
    assert rows_of(variants.group_variants(docs)) == brute(counted(rows, 5, 3))
    empty = variants.group_variants(documents(spark, []))
    assert empty.collect() == [] and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert variants.group_variants(documents(spark, [(1, "a bb 12")])).collect() == []


def test_ties_and_chains(spark):
    n = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "aaaac": 6, "zzzzz": 4, "zzzzy": 7}
    rows = [(i, w) for w, k in n.items() for i in range(k)]
    docs = documents(spark, rows)
    got = {r[0]: r for r in rows_of(variants.group_variants(docs, every=1 << 33))}
    assert got["aaaaa"] == ("aaaaa", "aaaab", "aabbb", 3, 2, 6)
    assert got["zzzzz"][1:3] == (None, "zzzzz") and got["zzzzz"][4] == 1


def test_query_equals_sql(spark):
    assert_same(variants.op12_variants(spark, "/root/testdata/sf0.01"), connect("sf0.01"), variants.SQL)
