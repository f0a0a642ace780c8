import hashlib
import random

import numpy as np
import pytest

from corpusmith.llm import suffixes
from tests.llm.helpers import CLASHES, documents


def brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        cov = bytearray(len(raw))
        for s in range(len(raw) - suffixes.WINDOW + 1):
            w = raw[s : s + suffixes.WINDOW]
            if w in seen:
                cov[s : s + suffixes.WINDOW] = b"\1" * suffixes.WINDOW
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, cov) if not g)
        spans = sum(1 for k in range(len(raw)) if cov[k] and (k == 0 or not cov[k - 1]))
        out[i] = (len(raw), sum(cov), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(spark, rows, extra=()):
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.dedup_substrings(documents(spark, rows, extra)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("alphabet, buckets", [("ab", 1), ("abcdefgh ", 3), ("aé🎉 ", 9)])
def test_against_brute_force(spark, monkeypatch, alphabet, buckets):
    rng = random.Random(alphabet)
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    pool = [make(rng.randint(60, 400)) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [rng.choice(pool) if rng.random() < 0.6 else make(rng.randint(0, 150)) for _ in range(rng.randint(0, 5))]
        t = "".join(parts)
        if t and rng.random() < 0.5:  # an edit
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice(alphabet) + t[k + 1 :]
        rows.append((i, t))
    monkeypatch.setattr(suffixes, "BUCKET", 10**9 if buckets == 1 else 200 // buckets)
    monkeypatch.setattr(suffixes, "CONTEXTS", 10**9 if buckets == 1 else 40 // buckets)
    check(spark, rows, CLASHES)


def test_edges(spark):
    same = "".join(chr(97 + i * i % 26) for i in range(300))
    rows = [(5, same), (6, same), (7, None), (8, ""), (9, "x" * 99), (10, "x" * 99), (11, "x" * 100), (12, "x" * 250), (13, "ab" * 3000), (-4, same + "tail")]
    check(spark, rows)


def test_pieces_of_long_texts(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(suffixes, "PIECE", 700)
    long = "".join(rng.choice("abcdefgh") for _ in range(5000))
    check(spark, [(1, long), (2, long[300:4100] + "zz" + long[:900])])


def test_repeated_rows_and_ids(spark):
    rng = random.Random(5)
    a, b = ("".join(rng.choice("abcdefghij") for _ in range(200)) for _ in range(2))
    rows = suffixes.dedup_substrings(documents(spark, [(1, a), (1, a), (2, a), (3, b), (3, b + "c"), (None, a[:120])])).collect()
    # a null id comes first; of the two texts of id 3 one is the other's source
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows)[:4] == [(0, 0), (1, 120), (1, 120), (2, 200)]
    assert sorted(r.n_removed for r in rows if r.doc_id == 3) == [0, 200]
    assert suffixes.dedup_substrings(documents(spark, [])).count() == 0


def test_multikey_order():
    rng = np.random.default_rng(0)
    columns = [rng.integers(0, 4, 500) for _ in range(4)]
    order = suffixes.multikey_order(columns)
    rows = [tuple(c[i] for c in columns) for i in order]
    assert rows == sorted(rows)


def test_spans():
    pack = suffixes.pack
    assert suffixes.removed_spans(np.array([pack(0, 1), pack(100, 5), pack(300, 2)])) == [(0, 204), (300, 401)]


@pytest.mark.parametrize("contexts", [50, 10**9])
def test_a_passage_that_very_many_share(spark, monkeypatch, contexts):
    """Its ends stand in as many different spans: dealt to several tasks or to one, the answer is the same."""
    rng = random.Random(6)
    make = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    shared = make(180)
    rows = [(i, make(rng.randint(0, 90)) + shared + make(rng.randint(0, 90)) + (shared if i % 7 == 0 else "")) for i in range(1500)]
    monkeypatch.setattr(suffixes, "CONTEXTS", contexts)
    check(spark, rows)


def test_the_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: tuple(r)[1:] for r in suffixes.op7_suffix_array(spark, sf).collect()} == brute(rows)
