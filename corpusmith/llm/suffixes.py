"""Exact substring dedup over the corpus by a distributed suffix array.

Texts are UTF-8 bytes. A byte goes if a WINDOW-byte string that covers it also starts earlier: in a smaller doc_id, or earlier in the
same document. Strings are judged on the input; nothing crosses documents.

Which suffixes are sorted: in each window the K-byte string with the smallest hash is its anchor, the leftmost of equals. Equal
windows have equal anchors at equal places, so it is enough to sort the suffixes at anchors, about one byte in forty. A suffix stands for
the run of consecutive windows that have this anchor. Its leading tokens are its first K bytes as three 8-byte words, in the order of
bytes; then comes a 128-bit fingerprint of the whole span that the run's windows cover.

1. Spark samples splitters and range-partitions the suffixes by leading tokens, fingerprint, document and place, so
   buckets are even whatever repeats. Each bucket is sorted by a multikey quicksort and neighbours are compared: a suffix whose tokens no
   neighbour has is dropped; all but the first of an equal span are repeats, with all their windows. Across boundaries: the first and last
   tokens of a bucket may go on in the next one, so these suffixes go on to step 2 in any case.
2. Where spans under the same tokens differ (the ends of a repeat, edits), the first suffix of each span goes on with its bytes. The suffixes
   of equal tokens meet, are sorted by multikey quicksort on all bytes behind the anchor, and, reversed, on those before it, and the lengths that
   neighbours have in common are taken from the bytes. Two windows at one distance from the anchor are equal if both lengths reach far
   enough, so each class of equal windows is an interval of both orders: no hash decides here. All but the first of a class are repeats.
3. Tokens under which more than CONTEXTS different spans stand are dealt to several tasks. Of these only, the first window of each
   class goes on, and equal ones meet by 128 bits of hash with a minimum that is combined before the shuffle.

Null texts count as empty; texts shorter than a window stay whole; very long texts are hashed in overlapping pieces. Rows that repeat an id and its
text are one and lose the same bytes; rows with equal ids and different texts are ordered by a hash of the text; null ids come first.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.llm.common import in_order, shuffle_partitions, small_batches, staged, table, text_or_empty

WINDOW = 100
K = 24
#: Suffixes that a bucket holds, and contexts in step 2, each about.
BUCKET, CONTEXTS = 400_000, 60_000
#: Rows of hot tokens that are broadcast at most; there is one for CONTEXTS suffixes at least.
HOT_BROADCAST = 100_000
#: Bytes that a window can have behind and before its anchor, in whole words.
BEHIND, BEFORE = -(-WINDOW // 8) * 8, -(-(WINDOW - K) // 8) * 8
TOKENS = ("t0", "t1", "t2")
SUFFIX = [*TOKENS, "s0", "s1", "doc", "at"]
CONTEXT = [*TOKENS, "part", "doc", "at", "context"]
WINDOWS = ["doc", "at", "h0", "h1"]
#: Bytes that are hashed at a time; longer texts are read in overlapping pieces.
PIECE = 1 << 19

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_2 = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _BASE_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    return (x ^ (x >> np.uint64(29))) * _M2


def pack(place, count, distance=0):
    """A run of windows in one number: place of the first, how far behind it the anchor is, number of windows."""
    return place << 16 | distance << 8 | count


class Prefixes:
    """Polynomial hashes of all beginnings of a byte string, to hash any part of it in one step."""

    def __init__(self, base: np.uint64, of_byte: np.ndarray):
        self.base, self.inverse, self.of_byte = base, np.uint64(pow(int(base), -1, 1 << 64)), of_byte
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, raw: np.ndarray) -> np.ndarray:
        n = len(raw) + 1
        if len(self.up) < n:
            self.up, self.down = (np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(2 * n, b, np.uint64)))) for b in (self.base, self.inverse))
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.of_byte[raw] * self.up[: len(raw)])))

    def part(self, p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of raw[start:end]; p: of(raw)."""
        return _mix((p[end] - p[start]) * self.down[start])


_FIRST, _SECOND = Prefixes(_BASE, _BYTE), Prefixes(_BASE_2, _BYTE_2)
_SIGN = np.uint64(1 << 63)


def _words8(raw: bytes) -> np.ndarray:
    """The 8 bytes from each place, as big-endian numbers."""
    n = len(raw) - 7
    out = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        part = np.frombuffer(raw, ">u8", (len(raw) - o) // 8, o)
        out[o::8] = part
    return out


def suffixes_of(raw: bytes, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie in raw one after another up to `ends`: tokens and fingerprint, first window, number of windows, anchor of each suffix."""
    w8 = _words8(raw)
    n = len(raw) - K + 1
    h = _mix(w8[:n] * _M3 + w8[8 : n + 8] * _BASE + w8[16 : n + 16] * _M2)
    # Hash above, place below: the minimum of a window is its leftmost smallest.
    low = np.uint64((1 << 24) - 1)
    g = (h & ~low) | np.arange(n, dtype=np.uint64)
    m, have, w = g, 1, WINDOW - K + 1
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = w - have
    m = np.minimum(m[:-rest], m[rest:]) if rest else m
    anchor = (m & low).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    inside = np.zeros(len(raw) + 1, np.int32)
    fine = ends - starts >= WINDOW
    np.add.at(inside, starts[fine], 1)
    np.add.at(inside, ends[fine] - WINDOW + 1, -1)
    inside = np.cumsum(inside)[: len(anchor)] > 0
    new = np.empty(len(anchor), bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    new[starts[(starts > 0) & (starts < len(new))]] = True
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(anchor)))
    keep = inside[first]
    first, count = first[keep], count[keep]
    at = anchor[first]
    tokens = [(w8[at + i] ^ _SIGN).view(np.int64) for i in (0, 8, 16)]
    data = np.frombuffer(raw, np.uint8)
    # Where the anchor lies in the span belongs to it.
    shape = _mix((at - first).astype(np.uint64) * _M3 + count.astype(np.uint64))
    spans = [(x.part(x.of(data), first, first + count - 1 + WINDOW) ^ shape).view(np.int64) for x in (_FIRST, _SECOND)]
    return [*tokens, *spans], first, count, at


def _pieces(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """raw, ends, number of the text and its offset in it, for pieces of about PIECE bytes."""
    part, who, off, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - WINDOW + 1), PIECE):
            if len(t) - at >= WINDOW:
                piece = t[at : at + PIECE + WINDOW - 1]
                part.append(piece)
                who.append(i)
                off.append(at)
                size += len(piece)
                if size >= PIECE:
                    yield b"".join(part), np.cumsum([len(x) for x in part]), np.array(who), np.array(off)
                    part, who, off, size = [], [], [], 0
    if part:
        yield b"".join(part), np.cumsum([len(x) for x in part]), np.array(who), np.array(off)


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """Order of rows by the columns, first one first: quicksort by one key, then by the next only where rows are equal so far."""
    order = np.argsort(columns[0], kind="quicksort")
    tied_before = None
    for depth, column in enumerate(columns):
        if depth:
            if not len(tied):
                break
            part = order[tied]
            order[tied] = part[np.lexsort((column[part], group))]
        c = column[order]
        same = np.zeros(len(order), bool)
        same[1:] = c[1:] == c[:-1]
        if tied_before is not None:
            same &= tied_before
        tied_before = same
        in_run = same.copy()
        in_run[:-1] |= same[1:]
        tied = np.flatnonzero(in_run)
        group = np.cumsum(~same)[tied]
    return order


def _all(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
    t = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    return None if t is None else [c.to_numpy() for c in t.columns]


def _emit_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        doc = b.column(0).to_numpy(zero_copy_only=False)
        for raw, ends, who, off in _pieces([t.encode() for t in b.column(1).to_pylist()]):
            columns, first, count, anchor = suffixes_of(raw, ends)
            piece = np.searchsorted(ends, first, side="right")
            place = first - np.concatenate(([0], ends[:-1]))[piece] + off[piece]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, doc[who[piece]], pack(place, count, anchor - first))], SUFFIX)


def _differs(*columns: np.ndarray) -> np.ndarray:
    """Of sorted rows, whether each differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _compare_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the suffixes that aren't alone: tokens null (all windows are repeats) or not (to be compared window by window)."""
    if (columns := _all(batches)) is None:
        return
    order = multikey_order(columns)
    t0, t1, t2, s0, s1, doc, at = (c[order] for c in columns)
    new_key = _differs(t0, t1, t2)
    new_span = new_key | _differs(s0, s1)
    run = np.cumsum(new_key) - 1
    several = np.bincount(run, new_span) > 1
    several[0] = several[-1] = True  # they may go on in the neighbouring buckets
    out = ~new_span | several[run]
    gone = ~new_span[out]
    yield pa.RecordBatch.from_arrays([*(pa.array(x[out], mask=gone) for x in (t0, t1, t2)), pa.array(doc[out]), pa.array(at[out])], [*TOKENS, "doc", "at"])


def _emit_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, todo, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            raw = text.encode()
            for x in todo:
                at = x["at"]
                place = at >> 16
                rows.append((x["t0"], x["t1"], x["t2"], x["part"], doc, at, raw[place : place + (at & 255) - 1 + WINDOW]))
        kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 2 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], CONTEXT)


def _common(order: np.ndarray, bytes_of: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How many bytes each row of the order shares with the one before; -1 where a group begins."""
    rows = bytes_of[order]
    differ = rows[1:] != rows[:-1]
    length = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    length[group[order[1:]] != group[order[:-1]]] = -1
    return np.r_[-1, length]


def _padded(raw: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """raw[start], raw[start + step] and so on, `size` bytes, then zeros up to the width."""
    place = np.arange(width)
    return np.where(place < size[:, None], raw[np.minimum(np.maximum(start[:, None] + step * place, 0), len(raw) - 1)], 0).astype(np.uint8)


def _byte_order(bytes_of: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Rows by group, then by bytes, eight at a time."""
    words = np.ascontiguousarray(bytes_of).view(">u8").astype(np.uint64)
    return multikey_order([group, *words.T])


def later_windows(group: np.ndarray, distance: np.ndarray, count: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """which, nth: the windows of suffixes that equal one of an earlier suffix of their group.

    Suffixes are in the order of document and place in their group; raw: their spans, one after another."""
    size = count - 1 + WINDOW
    anchor = np.cumsum(size) - size + distance
    behind = _padded(raw, anchor, size - distance, BEHIND, 1)
    before = _padded(raw, anchor - 1, distance, BEFORE, -1)
    orders = []
    for bytes_of in (behind, before):
        order = _byte_order(bytes_of, group)
        orders.append((order, _common(order, bytes_of, group)))
    which, nth = [], []
    for d in range(int((distance - count).min()) + 1, int(distance.max()) + 1):
        inside = np.flatnonzero((distance - count < d) & (d <= distance))
        classes = []
        for (order, shared), reach in zip(orders, (WINDOW - d, d), strict=True):
            c = np.empty(len(order), np.int64)
            c[order] = np.cumsum(shared < reach)
            classes.append(c[inside])
        pair = classes[0] * (len(group) + 1) + classes[1]
        by = np.argsort(pair, kind="stable")
        again = by[1:][pair[by[1:]] == pair[by[:-1]]]
        which.append(inside[again])
        nth.append(distance[inside[again]] - d)
    which, nth = np.concatenate(which), np.concatenate(nth)
    order = np.lexsort((nth, which))
    return which[order], nth[order]


def _compare_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, at of runs of repeated windows (h0 null); of tokens in several parts also the other windows, one by one, with their hash."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    columns = [t.column(i).to_numpy() for i in range(6)]
    order = multikey_order(columns)
    t0, t1, t2, part, doc, at = (c[order] for c in columns)
    contexts = t.column(6).to_pylist()
    raw = np.frombuffer(b"".join([contexts[i] for i in order.tolist()]), np.uint8)
    group = np.cumsum(_differs(t0, t1, t2, part)) - 1
    count, distance, place = at & 255, at >> 8 & 255, at >> 16
    which, nth = later_windows(group, distance, count, raw)
    if len(which):
        joined = np.r_[False, (nth[1:] == nth[:-1] + 1) & (which[1:] == which[:-1])]
        head = np.flatnonzero(~joined)
        length = np.diff(np.append(head, len(which)))
        none = pa.nulls(len(head), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(doc[which[head]]), pa.array(pack(place[which[head]] + nth[head], length)), none, none], WINDOWS)
    if (part >= 0).any():
        first = np.repeat(part >= 0, count)
        base = np.cumsum(count) - count
        first[base[which] + nth] = False
        of = np.repeat(np.arange(len(at)), count)[first]
        n = (np.arange(len(first)) - np.repeat(base, count))[first]
        start = (np.cumsum(count - 1 + WINDOW) - (count - 1 + WINDOW))[of] + n
        hashes = [pa.array(_hash_windows(raw, start, x).view(np.int64)) for x in (_FIRST, _SECOND)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[of]), pa.array(pack(place[of] + n, 1)), *hashes], WINDOWS)


def _hash_windows(raw: np.ndarray, start: np.ndarray, by: Prefixes) -> np.ndarray:
    """Hashes of the windows at `start` (ascending), with the prefix hashes of a bounded piece at a time."""
    out = np.empty(len(start), np.uint64)
    for lo in range(0, len(raw), PIECE):
        i, j = np.searchsorted(start, (lo, lo + PIECE))
        if i < j:
            p = by.of(raw[lo : lo + PIECE + WINDOW])
            out[i:j] = by.part(p, start[i:j] - lo, start[i:j] - lo + WINDOW)
    return out


def removed_spans(ats: np.ndarray) -> list[tuple[int, int]]:
    """Maximal [start, end) covered by runs of windows."""
    if not len(ats):
        return []
    ats = np.sort(ats)
    start, end = ats >> 16, (ats >> 16) + (ats & 255) - 1 + WINDOW
    reach = np.maximum.accumulate(end)
    new = np.r_[True, start[1:] > reach[:-1]]
    head = np.flatnonzero(new)
    return list(zip(start[head].tolist(), reach[np.r_[head[1:] - 1, len(reach) - 1]].tolist(), strict=True))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc, at (packed): runs of windows that also start earlier; docs: doc (unique, in order) and text."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    long = docs.where(F.octet_length("text") >= WINDOW)
    volume = long.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    suffixes = long.select("doc", "text").mapInArrow(_emit_suffixes, ", ".join(f"{c} bigint" for c in SUFFIX))
    buckets = max(parts, volume // ((WINDOW - K + 2) // 2 * BUCKET) + 1)
    flags = suffixes.repartitionByRange(buckets, *SUFFIX).mapInArrow(_compare_suffixes, ", ".join(f"{c} bigint" for c in (*TOKENS, "doc", "at")))
    flags = staged(flags, "suffix-flags")
    todo = flags.where("t0 IS NOT NULL")
    # part is -1 where all suffixes of the tokens meet in one task.
    hot = todo.groupBy(*TOKENS).agg(F.count("*").alias("n")).where(F.col("n") > CONTEXTS)
    sizes = todo.count(), hot.count()
    part = F.lit(-1)
    if sizes[1]:
        todo = todo.join(F.broadcast(hot) if sizes[1] <= HOT_BROADCAST else hot, list(TOKENS), "left")
        part = F.when(F.col("n").isNull(), -1).otherwise(F.pmod(F.xxhash64("doc", "at"), F.ceil(F.col("n") / CONTEXTS)).cast("int"))
    todo = todo.select(*TOKENS, part.alias("part"), "doc", "at").groupBy("doc").agg(F.collect_list(F.struct(*TOKENS, "part", "at")).alias("todo"))
    spans = todo.join(long, "doc").select("doc", "todo", "text").mapInArrow(_emit_contexts, "t0 bigint, t1 bigint, t2 bigint, part int, doc bigint, at bigint, context binary")
    met = spans.repartition(max(parts, sizes[0] // CONTEXTS + 1), *TOKENS, "part")
    windows = staged(met.mapInArrow(_compare_windows, "doc bigint, at bigint, h0 bigint, h1 bigint"), "suffix-windows")
    found = flags.where("t0 IS NULL").select("doc", "at").unionAll(windows.where("h0 IS NULL").select("doc", "at"))
    if sizes[1]:
        apart = windows.where("h0 IS NOT NULL")
        first = apart.groupBy("h0", "h1").agg(F.min(F.struct("doc", "at")).alias("m"), F.count("*").alias("c")).where("c > 1").select("h0", "h1", "m")
        found = found.unionAll(apart.join(first, ["h0", "h1"]).where(F.struct("doc", "at") > F.col("m")).select("doc", "at"))
    return found


def dedup_substrings(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with_text the remaining bytes as `kept`."""
    spark = docs.sparkSession
    small_batches(spark)
    numbered, distinct = in_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")))
    numbered, distinct = numbered.withColumnRenamed("_doc", "doc"), distinct.withColumnRenamed("_doc", "doc")
    gone = repeated_runs(distinct).groupBy("doc").agg(F.collect_list("at").alias("ats"))
    joined = numbered.join(gone, "doc", "left").select("doc_id", "text", "ats")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, ats in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                raw = text.encode()
                spans = removed_spans(ats.values.to_numpy()) if ats.is_valid else []
                kept, at = [], 0
                for s, e in spans:
                    kept.append(raw[at:s])
                    at = e
                kept.append(raw[at:])
                rest = b"".join(kept)
                out.append((len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest))
            columns = [b.column(0), *(pa.array([o[i] for o in out], pa.int64()) for i in range(3)), pa.array([o[3] for o in out], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array([o[4] for o in out], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_text else ""))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))
