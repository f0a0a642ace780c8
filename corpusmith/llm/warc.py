"""WARC files, and not-modified revisits resolved to the response that they stand for.

A revisit record says that a server answered "not modified": it has headers but no payload. It is resolved by an as-of join: the
latest full response of the same canonical URL with an earlier date. Its validators must agree: entity tags (weak comparison)
if both have one, else the dates of last modification if both have one; a revisit without a validator in common is
accepted only if it has none at all. A resolved record has the response's payload and status and its headers, updated by those of the
revisit except the ones that describe the stored body or the connection.

The as-of join needs no record of a URL in one place: within an hour of a URL a window finds the latest response, hours are
combined to one row each before the shuffle, and a window over a URL's hours finds the latest earlier one. Only keys and
dates take part; payloads join by record id at the end. Among responses of the same date the largest record id counts.

Outcomes: resolved, no_earlier_response (also for a null url or date), validator_mismatch. Full responses are those of type
response with status 200; other records take no part. Repeated responses of one id count once, repeated revisits each.
Null headers count as none, a null payload stays null. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmith.llm.common import table

# Query parameters that only track, and headers that a 304 may not update.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid|msclkid|sid|sessionid|phpsessid|jsessionid)="
KEPT_HEADERS = ["content-encoding", "content-length", "content-range", "content-type", "connection", "keep-alive", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]

RECORD = "record_id string, type string, target_uri string, date timestamp, status int, headers map<string,string>, payload binary"


def canonical_url(url: Column) -> Column:
    """host/path?parameters: no scheme, user, www, default port, fragment, trailing slash or tracking; parameters sorted."""
    u = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    place = F.regexp_extract(u, "^([^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(place), "^[^@]*@", ""), r"^www[0-9]*\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), "/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(F.lit("")))


def _lower_headers(headers: Column) -> Column:
    """Header names in lower case; of a repeated name the last counts."""
    given = F.coalesce(headers, F.create_map().cast("map<string,string>"))
    entries = F.map_entries(given)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: F.lower(later.key) == F.lower(e.key)))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(F.lower(e.key), e.value)))


def _strong(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^[wW]/", "")


def resolve(records: DataFrame) -> DataFrame:
    """Per revisit: record_id, target_uri, canonical, date, outcome, refers_to, status, headers, payload."""
    r = records.select("record_id", "type", "target_uri", "date", "status", _lower_headers(F.col("headers")).alias("headers"), "payload").withColumn("canonical", canonical_url(F.col("target_uri")))
    micros = F.unix_micros("date")
    full = r.where("type = 'response' AND status = 200")
    known = full.where("canonical IS NOT NULL AND date IS NOT NULL").select("canonical", micros.alias("t"), F.lit(True).alias("is_full"), "record_id", F.col("headers")["etag"].alias("etag"), F.col("headers")["last-modified"].alias("modified"))
    revisits = r.where("type = 'revisit'").drop("type", "status", "payload").withColumn("_n", F.monotonically_increasing_id())
    asked = revisits.where("canonical IS NOT NULL AND date IS NOT NULL").select("canonical", micros.alias("t"), F.lit(False).alias("is_full"), "record_id", F.col("headers")["etag"].alias("etag"), F.col("headers")["last-modified"].alias("modified"))
    both = known.unionAll(asked).withColumn("hour", F.floor(F.col("t") / 3_600_000_000))
    here = F.when(F.col("is_full"), F.struct("t", "record_id", "etag", "modified"))
    by_hour = both.groupBy("canonical", "hour").agg(F.max(here).alias("m"))
    before = Window.partitionBy("canonical").orderBy("hour").rangeBetween(Window.unboundedPreceding, -1)
    earlier = by_hour.withColumn("e", F.max("m").over(before)).where("e IS NOT NULL").select("canonical", "hour", "e")
    within = Window.partitionBy("canonical", "hour").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("w", F.max(here).over(within)).where("NOT is_full").join(earlier, ["canonical", "hour"], "left")
    found = found.withColumn("f", F.coalesce("w", "e")).where("f IS NOT NULL")
    tags = F.col("etag").isNotNull() & F.col("f.etag").isNotNull()
    dates = F.col("modified").isNotNull() & F.col("f.modified").isNotNull()
    agrees = F.when(tags, _strong(F.col("etag")) == _strong(F.col("f.etag"))).when(dates, F.trim("modified") == F.trim("f.modified")).otherwise(F.col("etag").isNull() & F.col("modified").isNull())
    found = found.select("record_id", "canonical", "t", "etag", "modified", F.col("f.record_id").alias("refers_to"), agrees.alias("agrees")).distinct()

    v = revisits.alias("v").join(
        found.alias("f"),
        (F.col("v.record_id").eqNullSafe(F.col("f.record_id"))) & (F.col("v.canonical") == F.col("f.canonical")) & (F.unix_micros("v.date") == F.col("f.t")) & F.col("v.headers")["etag"].eqNullSafe(F.col("f.etag")) & F.col("v.headers")["last-modified"].eqNullSafe(F.col("f.modified")),
        "left",
    )
    outcome = F.when(F.col("agrees"), "resolved").when(F.col("f.refers_to").isNotNull(), "validator_mismatch").otherwise("no_earlier_response")
    v = v.select("v.record_id", "v.target_uri", "v.canonical", "v.date", F.col("v.headers").alias("new"), outcome.alias("outcome"), F.when(F.col("agrees"), F.col("f.refers_to")).alias("refers_to"))
    latest = Window.partitionBy("record_id").orderBy(F.desc("date"), F.xxhash64("payload"))
    stored = full.withColumn("_r", F.row_number().over(latest)).where(F.col("_r") == 1).select(F.col("record_id").alias("_key"), "status", F.col("headers").alias("old"), "payload")
    # What is not resolved gets a key of its own that nothing has: nulls would all meet in one task.
    out = v.withColumn("_key", F.coalesce("refers_to", F.concat(F.lit("-"), F.coalesce("record_id", F.lit("")), F.coalesce("canonical", F.lit(""))))).join(stored, "_key", "left")
    out = out.withColumn("old", F.when(F.col("refers_to").isNotNull(), F.col("old"))).withColumn("status", F.when(F.col("refers_to").isNotNull(), F.col("status"))).withColumn("payload", F.when(F.col("refers_to").isNotNull(), F.col("payload")))
    kept = F.array(*[F.lit(h) for h in KEPT_HEADERS])
    old = F.col("old")
    merged = F.map_concat(F.map_filter(old, lambda k, _: F.array_contains(kept, k) | ~F.array_contains(F.map_keys("new"), k)), F.map_filter("new", lambda k, _: ~F.array_contains(kept, k)))
    return out.select("record_id", "target_uri", "canonical", "date", "outcome", "refers_to", "status", F.when(F.col("old").isNotNull(), merged).otherwise(F.col("new")).alias("headers"), "payload")


def parse_warc(raw: bytes) -> Iterator[dict]:
    """Records of a WARC file, gzipped or not; a record that is cut short ends the file."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw))) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)

    def headers(read) -> dict[str, str]:
        found = {}
        while (line := read()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            found[name.strip().lower()] = value.strip()
        return found

    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            h = headers(stream.readline)
            size = int(h.get("content-length") or 0)
            body = stream.read(size)
            if len(body) < size:
                return
            record = {"record_id": h.get("warc-record-id"), "type": h.get("warc-type"), "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "status": None, "headers": {}, "payload": body}
            if body.startswith(b"HTTP/"):
                http = io.BytesIO(body)
                first = http.readline().split()
                record["status"] = int(first[1]) if len(first) > 1 and first[1].isdigit() else None
                record["headers"] = headers(http.readline)
                record["payload"] = http.read()
            yield record
    except (EOFError, OSError):
        return


def format_warc(record: dict) -> bytes:
    """One record; the inverse of parse_warc."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in (record["headers"] or {}).items())
    head = f"HTTP/1.1 {record['status']} \r\n{lines}\r\n".encode() if record["status"] is not None else b""
    body = head + (record["payload"] or b"")
    about = {"WARC-Type": record["type"], "WARC-Record-ID": record["record_id"], "WARC-Target-URI": record["target_uri"], "WARC-Date": record["date"], "Content-Length": len(body)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in about.items() if v is not None).encode() + b"\r\n" + body + b"\r\n\r\n"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files under path, as resolve() takes them; read through Spark, a file per task at least."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    names = ["record_id", "type", "target_uri", "date", "status", "headers", "payload"]
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                part: list[dict] = []
                for record in parse_warc(raw.as_py()):
                    part.append(record | {"headers": list(record["headers"].items())})
                    if len(part) == 200:
                        yield pa.RecordBatch.from_pylist(part, schema)
                        part = []
                yield pa.RecordBatch.from_pylist(part, schema)

    rows = files.mapInArrow(run, "record_id string, type string, target_uri string, date string, status int, headers map<string,string>, payload binary")
    return rows.select(*[F.expr("try_cast(date AS timestamp)").alias("date") if n == "date" else n for n in names])


def captures(pages: DataFrame) -> DataFrame:
    """Records of a crawl of pages: a page is fetched in the minute of its id, with a tag or a date as validator, and asked for again a
    minute before (which only an earlier capture of its canonical URL can answer) and a day after."""
    t0 = F.lit(1_700_000_000)
    at = lambda shift: F.timestamp_seconds(t0 + F.col("page_id") * 60 + shift)
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    modified = F.concat(F.lit("day "), F.col("page_id").cast("string"))
    tagged = F.length(F.coalesce("html", F.lit(""))) % 2 == 0
    validators = F.when(tagged, F.map_from_arrays(F.array(F.lit("ETag")), F.array(tag))).otherwise(F.map_from_arrays(F.array(F.lit("Last-Modified")), F.array(modified)))
    weak = F.when(tagged, F.map_from_arrays(F.array(F.lit("etag")), F.array(F.concat(F.lit("W/"), tag)))).otherwise(F.map_from_arrays(F.array(F.lit("last-modified")), F.array(modified)))
    named = lambda kind: F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(f":{kind}>"))
    text = lambda k, v: F.map_from_arrays(F.array(F.lit(k)), F.array(v))
    response = pages.select(named("full").alias("record_id"), F.lit("response").alias("type"), F.col("url").alias("target_uri"), at(0).alias("date"), F.lit(200).alias("status"), F.map_concat(validators, text("Content-Type", F.lit("text/html")), text("Date", named("full"))).alias("headers"), F.col("html").cast("binary").alias("payload"))
    asked = [
        pages.select(named(kind).alias("record_id"), F.lit("revisit").alias("type"), F.col("url").alias("target_uri"), at(shift).alias("date"), F.lit(304).alias("status"), F.map_concat(weak, text("Content-Type", F.lit("none")), text("Date", named(kind))).alias("headers"), F.lit(None).cast("binary").alias("payload"))
        for kind, shift in (("before", -60), ("after", 86_400))
    ]
    return response.unionAll(asked[0]).unionAll(asked[1])


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = resolve(captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    header_text = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e.key, F.lit("="), e.value))), ";")
    return done.select("record_id", "canonical", "outcome", "refers_to", "status", header_text.alias("headers"), F.octet_length("payload").cast("long").alias("n_bytes"), F.md5("payload").alias("payload_md5"))


SQL = rf"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS u FROM pages),
q AS (SELECT *, [x FOR x IN list_sort(string_split(regexp_extract(u, '\?(.*)$', 1), '&')) IF x <> '' AND NOT regexp_matches(lower(x), '{TRACKING}')] AS ps,
  regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^[^@]*@', ''), '^www[0-9]*\.', ''), ':(80|443)$', '') AS host,
  regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path FROM p),
c AS (SELECT page_id, html, host || path || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END AS canonical,
  CASE WHEN length(h) % 2 = 0 THEN '"' || md5(h) || '"' END AS tag, CASE WHEN length(h) % 2 <> 0 THEN 'day ' || page_id END AS modified FROM q),
r AS (SELECT page_id, canonical, tag, modified, kind, page_id * 60 + shift AS t FROM c, (VALUES ('before', -60), ('after', 86400)) AS k(kind, shift)),
f AS (SELECT page_id AS full_id, canonical AS fc, tag AS ftag, modified AS fmod, html, page_id * 60 AS ft FROM c),
j AS (SELECT *, CASE WHEN full_id IS NULL THEN 'no_earlier_response'
    WHEN tag IS NOT NULL AND ftag IS NOT NULL THEN CASE WHEN tag = ftag THEN 'resolved' ELSE 'validator_mismatch' END
    WHEN modified IS NOT NULL AND fmod IS NOT NULL THEN CASE WHEN modified = fmod THEN 'resolved' ELSE 'validator_mismatch' END
    ELSE 'validator_mismatch' END AS outcome FROM r ASOF LEFT JOIN f ON r.canonical = f.fc AND r.t > f.ft)
SELECT '<urn:page:' || page_id || ':' || kind || '>' AS record_id, canonical, outcome,
  CASE WHEN outcome = 'resolved' THEN '<urn:page:' || full_id || ':full>' END AS refers_to,
  CASE WHEN outcome = 'resolved' THEN 200 END AS status,
  CASE WHEN outcome = 'resolved' THEN 'content-type=text/html;' ELSE 'content-type=none;' END || 'date=<urn:page:' || page_id || ':' || kind || '>;' || coalesce('etag=W/' || tag, 'last-modified=' || modified) AS headers,
  CASE WHEN outcome = 'resolved' THEN octet_length(encode(html)) END AS n_bytes,
  CASE WHEN outcome = 'resolved' THEN md5(html) END AS payload_md5 FROM j"""
