import random
import re
import textwrap

import pytest

from corpusmith.llm import licenses
from tests.llm.helpers import CLASHES, documents
from tests.oracle import DATA, assert_same, connect


def brute(text):
    t = (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    places, base = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    best, own = 0.0, set()
    for label, template in licenses.TEMPLATES:
        said = re.findall(r"[a-z0-9]+", template.lower())
        n, s = len(said) + max(2, len(said) // 2), set(said)
        for i in range(len(words)):
            share = len(s.intersection(words[i : i + n])) / len(s) if words[i] in s else 0
            if share >= licenses.CONTAINMENT - 1e-9:
                own.add(label)
                best = max(best, share)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if places else best)


def test_against_brute_force(spark):
    rng = random.Random(2)
    words = sorted(set().union(*[licenses.word_set(t) for _, t in licenses.TEMPLATES])) + ["foo", "bär", "x1"]
    rows = [None, "", "  \n ", "MIT License", "Under the MIT license, under-the MIT LICENSE!", "cc-by-nc cc by\nnc CC BY NC", "apache license version 2.0 apache license version 20", "x" * 100_000, "the " * 30_000 + "under the mit license"]
    rows += [t for _, t in licenses.TEMPLATES]
    for _ in range(120):
        base = rng.choice(licenses.TEMPLATES)[1].split()
        for _ in range(rng.randrange(4)):
            base[rng.randrange(len(base))] = rng.choice(words)
        rng.shuffle(base)
        rows.append("\n".join([" ".join(rng.choices(words, k=rng.randint(1, 20))), " ".join(base), rng.choice(["", "Released under the MIT License."])]))
    out = licenses.scan(documents(spark, list(enumerate(rows)), CLASHES))
    assert out.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    for r in out.collect():
        assert tuple(r)[1:] == pytest.approx(brute(rows[r.doc_id])), rows[r.doc_id]


@pytest.mark.parametrize("mark", ["", " * ", "# "])
def test_wrapped_notices(spark, mark):
    """Each template, hard-wrapped at any width in the middle of other text, is found; far apart it is not."""
    rows, want = [], []
    for label, t in licenses.TEMPLATES:
        for width in (20, 25, 30, 45, 60, 72, 80, 110, 150, 1000):
            lines = textwrap.wrap(f"Copyright one two. {t}", width)
            rows.append("\n".join(["x" * 200, *[mark + line for line in lines], "", "y" * 200]))
            want.append(label)
        half = t.split()
        rows.append(("\n" + "other words " * 40 + "\n").join([" ".join(half[: len(half) // 2]), " ".join(half[len(half) // 2 :])]))
        want.append(None)
    for r in licenses.scan(documents(spark, list(enumerate(rows)))).collect():
        found = set(r.labels.split(",")) - {""}
        assert want[r.doc_id] in found if want[r.doc_id] else not found - set(r.base_labels.split(",")), rows[r.doc_id]


def test_words_put_in_and_left_out(spark):
    t = licenses.TEMPLATES[1][1].split()
    rows = [" ".join(t[:5] + ["very", "much"] + t[5:]), " ".join(t[:-1]), " ".join(t[: len(t) // 2]), " ".join(x for w in t for x in (w, "blah", "blah")), " ".join(reversed(t)), " ".join(t) + " mit" * 5000]
    got = {r.doc_id: r for r in licenses.scan(documents(spark, list(enumerate(rows)))).collect()}
    assert [got[i].labels for i in range(len(rows))] == ["mit", "mit", "", "", "mit", "mit"]
    assert got[0].score == 1.0 and 0.9 <= got[1].score < 1.0


def test_repeats_and_empty_table(spark):
    assert licenses.scan(documents(spark, [])).count() == 0
    assert licenses.scan(documents(spark, [(1, "a"), (1, "a"), (None, "b")])).count() == 3


def test_query(spark):
    assert_same(licenses.op6_licenses(spark, f"{DATA}/sf0.01"), connect("sf0.01"), licenses.SQL)
