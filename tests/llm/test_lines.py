import random

import pytest

from corpusmith.llm import lines
from tests.llm.helpers import CLASHES, documents


def edit(a, b) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def near(a: list[str], b: list[str]) -> bool:
    """One edit, of words if the longer line has eight or more, else of characters if it has twelve or more."""
    x, y = " ".join(a), " ".join(b)
    if max(len(a), len(b)) >= 8:
        return edit(a, b)
    return max(len(x), len(y)) >= 12 and edit(x, y)


def brute(rows):
    seen, out = [], {}
    for i, t in sorted(rows):
        kept = []
        for line in (t or "").split("\n"):
            w = line.strip(" ").split(" ")
            if line.strip(" ") == "":
                kept.append(line)
                continue
            gone = any(w == x or near(w, x) for x in seen)
            seen.append(w)
            if not gone:
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


@pytest.mark.parametrize("vocabulary", [3, 40])
def test_against_brute_force(spark, vocabulary):
    rng = random.Random(vocabulary)
    pool = [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(1, 14))] for _ in range(25)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(1, 6)):
            w = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2])):
                k = rng.randrange(len(w) + 1)
                what = rng.randrange(3)
                w = w[:k] + w[k + 1 :] if what == 0 and len(w) > 1 else w[:k] + [f"w{rng.randrange(vocabulary)}"] + w[k + (what == 1) :]
            text.append(" ".join(w) if rng.random() < 0.95 else "")
        rows.append((i, "\n".join(text)))
    got = {r.doc_id: r.text for r in lines.dedup_lines(documents(spark, rows)).select("doc_id", "text").collect()}
    assert got == brute(rows)


def test_edges(spark):
    base = "one two three four five six seven eight nine"
    rows = [(1, base), (2, f"  {base}  \n\nshort"), (3, "short\n" + base.replace("five", "5")), (4, None), (5, ""), (6, "x " * 30_000), (7, "x " * 30_000 + "y"), (8, "é " * 9 + "🎉"), (9, base + "\n" + base)]
    out = lines.dedup_lines(documents(spark, rows, CLASHES))
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == [*[c for c in documents(spark, [], CLASHES).columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed"]
    assert got[1].text == base and got[2].text == "\nshort" and got[3].text == ""
    assert got[4].text is None and got[5].text == "" and got[6].n_removed == 0 and got[7].n_removed == 1
    assert got[8].n_removed == 0 and got[9].text == "" and got[9].n_removed == 2


def test_repeated_rows_are_one(spark):
    t = "a b c d e f g h\nonly here"
    got = [r.text for r in lines.dedup_lines(documents(spark, [(1, t), (1, t), (2, t)])).orderBy("doc_id").collect()]
    assert got == [t, t, ""]


def test_short_lines_by_characters(spark):
    rows = [(1, "The anhely eran."), (2, "The, anhely eran."), (3, "The anhely eram."), (4, "The anhely era."), (5, "The ANhely eran."), (6, "1.\n2.\n3."), (7, "e\u0301e\u0301 🎉 héllo wörld"), (8, "e\u0301e 🎉 héllo wörld")]
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(documents(spark, rows)).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0, 7: 0, 8: 1}


def test_equal_keys_of_lines_that_are_not_near(spark):
    """Rearranged words with the same neighbours have equal keys; the exact digests decide."""
    a = "x a y b x c y d x"
    lines_of = [a + " e", "x c y b x a y d x e", "x c y d x a y b x e", "x c y b x a y d x e f", "x c y d x a y b x g e", "x a y b x c y d x e e"]
    rows = list(enumerate(lines_of))
    got = {r.doc_id: r.text for r in lines.dedup_lines(documents(spark, rows)).collect()}
    assert got == brute(rows)


def test_null_and_repeated_ids(spark):
    t, u = "a b c d e f g h i", "a b c d e f g h j"
    docs = documents(spark, [(None, t), (None, "other words"), (3, u), (3, "x"), (3, t)], CLASHES)
    out = lines.line_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in out.collect()) == [(-1, t), (-1, "other words"), (3, "x")]


def test_the_same_without_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test_short_lines_by_characters(spark)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_table(spark):
    assert lines.dedup_lines(documents(spark, [])).count() == 0


def test_stage(spark):
    t = "a b c d e f g h\nonly here"
    docs = documents(spark, [(1, t), (2, "a b c d e f g h"), (3, "mine"), (4, "")])
    out = lines.line_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert {r.doc_id: r.n_chars for r in out.collect()} == {1: len(t), 3: 4, 4: 0}


def test_no_gap_between_units_and_lengths(spark):
    """Seven words and eight, eleven characters and twelve: the longer line says what the unit is."""
    seven, eleven = "one two three four five six seven", "hello world"
    pairs = [(seven, seven + " eight"), (seven + " eight", seven), (eleven, eleven + "s"), (eleven + "s", eleven), (seven, seven + "s"), (seven, seven.replace("four", "for you")), ("hello worl", "hello worlx"), (seven, "one two three four five six 7")]
    rows = [(i, f"{a}\n{b}".replace("o", f"{'abcdefghij'[i]}o")) for i, (a, b) in enumerate(pairs)]
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(documents(spark, rows)).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0 if len(rows[6][1].split("\n")[1]) < 12 else 1, 7: 0}
    mixed = []
    for i, (n, m) in enumerate(((6, 7), (7, 7), (7, 8), (8, 8), (8, 9))):
        for k in range(12):
            rng = random.Random(100 * i + k)
            a = [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(n)]
            b = a[:k % n] + ["x"] * (m - n + 1) + a[k % n + 1 :] if k % 2 else a[: k % n] + ["y"] * (m - n) + a[k % n :]
            mixed.append((100 * i + k, " ".join(a) + "\n" + " ".join(b)))
    got = {r.doc_id: r.text for r in lines.dedup_lines(documents(spark, mixed)).collect()}
    assert got == brute(mixed)


def test_query(spark):
    from tests.oracle import DATA, assert_same, connect

    assert_same(lines.op2_lines(spark, f"{DATA}/sf0.01"), connect("sf0.01"), lines.SQL)
