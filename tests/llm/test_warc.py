import datetime as dt
import gzip

from pyspark.sql import functions as F

from corpusmith.llm import warc
from tests.oracle import DATA, assert_same, connect

T0 = dt.datetime(2024, 1, 1)


def records(spark, rows):
    full = [(i, kind, url, None if h is None else T0 + dt.timedelta(hours=h), status, headers, payload, "x") for i, kind, url, h, status, headers, payload in rows]
    return spark.createDataFrame(full, warc.RECORD + ", outcome string")


def test_as_of_and_validators(spark):
    u = "http://www.A.example/x/?b=2&a=1&utm_source=q#f"
    rows = [
        ("r1", "response", u, 0, 200, {"ETag": '"1"', "Content-Type": "text/html", "X": "old"}, b"one"),
        ("r2", "response", "https://a.example:443/x?a=1&b=2", 5, 200, {"etag": '"2"', "Last-Modified": "d2"}, b"two"),
        ("r3", "response", u, 6, 404, {}, b"no"),
        ("v0", "revisit", u, 0, 304, {"etag": '"1"'}, None),
        ("v1", "revisit", u, 3, 304, {"etag": 'W/"1"', "Content-Type": "x/y", "X": "new", "Y": "z"}, None),
        ("v2", "revisit", u, 100, 304, {"last-modified": "d2"}, None),
        ("v3", "revisit", u, 7, 304, {"ETag": '"1"'}, None),
        ("v4", "revisit", u, 8, 304, None, None),
        ("v5", "revisit", "http://other.example/", 9, 304, {}, None),
        ("v6", "revisit", None, 9, 304, {}, None),
        ("v7", "revisit", u, None, 304, {}, None),
        ("w", "warcinfo", None, 1, None, None, b"i"),
    ]
    got = {r.record_id: r for r in warc.resolve(records(spark, rows)).collect()}
    assert {k: (r.outcome, r.refers_to) for k, r in got.items()} == {
        "v0": ("no_earlier_response", None), "v1": ("resolved", "r1"), "v2": ("resolved", "r2"), "v3": ("validator_mismatch", None),
        "v4": ("resolved", "r2"), "v5": ("no_earlier_response", None), "v6": ("no_earlier_response", None), "v7": ("no_earlier_response", None),
    }
    assert got["v1"].headers == {"etag": 'W/"1"', "content-type": "text/html", "x": "new", "y": "z"}
    assert bytes(got["v1"].payload) == b"one" and got["v1"].status == 200 and got["v3"].payload is None and got["v1"].canonical == "a.example/x?a=1&b=2"


def test_repeats_ties_and_none(spark):
    u = "http://a.example/"
    rows = [("r", "response", u, 0, 200, {}, b"1"), ("r", "response", u, 0, 200, {}, b"1"), ("s", "response", u, 0, 200, {}, None), ("v", "revisit", u, 1, 304, {}, None), ("v", "revisit", u, 1, 304, {}, None), (None, "revisit", u, 2, 304, {}, None)]
    got = warc.resolve(records(spark, rows)).collect()
    assert [(r.outcome, r.refers_to, r.payload) for r in got] == [("resolved", "s", None)] * 3
    assert warc.resolve(records(spark, [])).count() == 0


def test_hot_url(spark):
    rows = [(f"r{i}", "response", "http://a/", i, 200, {}, b"%d" % i) for i in range(0, 60, 3)] + [(f"v{i}", "revisit", "http://a/", i, 304, {}, None) for i in range(60)]
    for r in warc.resolve(records(spark, rows)).collect():
        i = int(r.record_id[1:])
        assert r.refers_to == (f"r{(i - 1) // 3 * 3}" if i else None)


def test_files(spark, tmp_path):
    one = {"record_id": "<a>", "type": "response", "target_uri": "http://x/", "date": "2024-01-01T00:00:00Z", "status": 200, "headers": {"etag": '"1"', "content-type": "text/plain"}, "payload": b"body\r\n\r\nWARC/1.0 inside"}
    two = {"record_id": "<b>", "type": "revisit", "target_uri": "http://x/", "date": "2024-01-02T00:00:00Z", "status": 304, "headers": {}, "payload": b""}
    raw = warc.format_warc(one) + warc.format_warc(two)
    assert list(warc.parse_warc(raw)) == [one, two]
    members = gzip.compress(warc.format_warc(one)) + gzip.compress(warc.format_warc(two))
    assert list(warc.parse_warc(members)) == [one, two]
    assert list(warc.parse_warc(raw[:-20])) == [one] and list(warc.parse_warc(b"")) == [] and list(warc.parse_warc(members[:30])) == []
    (tmp_path / "a.warc.gz").write_bytes(members)
    (tmp_path / "b.warc").write_bytes(b"junk\r\n" + raw.replace(b"<a>", b"<c>").replace(b"<b>", b"<d>"))
    df = warc.read_warc(spark, str(tmp_path))
    assert df.count() == 4 and warc.resolve(df).where("outcome = 'resolved'").count() == 2


def test_canonical(spark):
    urls = {"HTTP://WWW2.A.com:80/P//": "a.com/P", "a.com": "a.com", "http://u@a.com/?": "a.com", "http://a.com/x?utm_a=1&z=1&y": "a.com/x?y&z=1", "http://m.a.com/x#y?z": "m.a.com/x", "": ""}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", warc.canonical_url(F.col("u")).alias("c"))
    assert {r.u: r.c for r in got.collect()} == urls


def test_query(spark):
    assert_same(warc.op10_warc(spark, f"{DATA}/sf0.01"), connect("sf0.01"), warc.SQL)
