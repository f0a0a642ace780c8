"""Runs of tokens counted across rows, with little shuffled.

Where a row lies, the runs of many texts are counted as arrays of codes; what differs is dealt by its tokens as one compressed block to each task, with the
words that the codes stand for. A run goes by its longest word, so that a rare word, which is in few runs, is spelled in few blocks; words that are common in the
whole input don't decide alone, so that none makes a heavy task. Codes are exact: no hash decides whether runs are equal.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: tokens that are counted together before they are dealt; they take about 110 bytes each while that lasts.
CHUNK = 1 << 20
#: Fixed value: Zstandard's level.
LEVEL = 3
#: Fixed value: bytes of input, by Spark's estimate, to a task that counts blocks.
TASK = 16 << 20


def groups(columns: list[pa.Array], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The group of each row by the values of the columns, nulls being equal, and one row of each group."""
    code = np.zeros(rows, np.int64)
    for c in columns:
        d = c.dictionary_encode(null_encoding="encode")
        _, code = np.unique(code * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


def units(orders: int) -> list[tuple[int, int]]:
    """(order, least tokens): what is dealt. Runs of `orders` tokens come with those that lack the last token at the end of a text, which give the order below;
    shorter runs are dealt by themselves, so that a frequent word is a row a chunk and no heavy task."""
    return [*[(n, n) for n in range(1, orders - 1)], (orders, max(orders - 1, 1))]


def _unique(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values, which of them each key is, and how often each occurs. Where they fit, key and place are sorted as one number, in place."""
    n, bits = len(key), len(key).bit_length()
    if int(key.max(initial=0)).bit_length() + bits < 64:
        both = key << bits
        both |= np.arange(n)
        both.sort()
        order = (both & ((1 << bits) - 1)).astype(np.int32)
        both >>= bits
    else:
        order = np.argsort(key).astype(np.int32)
        both = key[order]
    new = np.ones(n, bool)
    np.not_equal(both[1:], both[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    which = np.empty(n, np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return both[starts], which, np.diff(starts, append=n).astype(np.int32)


def _distinct(group: np.ndarray, codes: np.ndarray, left: np.ndarray, end: int, orders: int) -> list[tuple[list[np.ndarray], np.ndarray]]:
    """For each unit the distinct runs as columns, of group and tokens, in order, and how often each occurs. `end` is the code past the end of a text."""
    out, wanted = [], dict(units(orders))
    base, places = end + 1, np.arange(len(codes), dtype=np.int32)
    columns, rank = [np.arange(int(group.max()) + 1, dtype=np.int32)], group
    for n in range(1, orders + 1):
        here = left[places] >= wanted.get(n, n)
        places, rank = places[here], rank[here]
        inside = left[places] >= n
        words = np.full(len(places), end, np.int32)
        words[inside] = codes[places[inside] + n - 1]
        runs, rank, counts = _unique(rank.astype(np.int64) * base + words)
        before = runs // base
        columns = [*[c[before] for c in columns], (runs - before * base).astype(np.int32)]
        if n in wanted:
            out.append((columns, counts))
    return out


def _planes(a: np.ndarray, kind: str) -> bytes:
    """Numbers with their first bytes first, then their second: what varies little lies together."""
    a = a.astype(kind)
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _numbers(data: memoryview, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    a = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
    return np.ascontiguousarray(a.T).view(kind).reshape(n), at + n * size


def _kind(most: int) -> str:
    return "<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8"


def packed(words: pa.Array, sections: list[tuple[list[np.ndarray], np.ndarray]]) -> bytes:
    """Sections of (columns of codes, counts) as one compressed block, with those words that occur."""
    used, local = np.unique(np.concatenate([c for columns, _ in sections for c in columns]), return_inverse=True)
    used = used[used < len(words)]
    spelled = words.take(pa.array(used))
    lengths = pc.binary_length(spelled).to_numpy(zero_copy_only=False)
    longest, most = int(lengths.max(initial=0)), max(int(counts.max(initial=0)) for _, counts in sections)
    parts = [np.array([len(used), longest, most, *[len(counts) for _, counts in sections]], "<i8").tobytes(), _planes(lengths, _kind(longest)), b"".join(spelled.to_pylist())]
    at = 0
    for columns, counts in sections:
        for i in range(len(columns)):
            codes, at = local[at : at + len(counts)], at + len(counts)
            parts.append(_planes(np.diff(codes, prepend=0), _kind(len(used))) if i == 0 else _planes(codes, _kind(len(used))))
        parts.append(_planes(counts, _kind(most)))
    data = b"".join(parts)
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", LEVEL).compress(data, asbytes=True)


def unpacked(block: bytes, orders: int) -> tuple[pa.Array, list[tuple[list[np.ndarray], np.ndarray]]]:
    """The words of a block and its sections; the code past the end of a text is the number of words."""
    data = memoryview(pa.Codec("zstd").decompress(block[8:], int.from_bytes(block[:8], "little")))
    of = units(orders)
    n, longest, most, *sizes = np.frombuffer(data, "<i8", 3 + len(of)).tolist()
    lengths, at = _numbers(data, 8 * (3 + len(of)), n, _kind(longest))
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data[at : at + int(offsets[-1])])])
    at, sections = at + int(offsets[-1]), []
    for (order, _), size in zip(of, sizes, strict=True):
        columns = []
        for i in range(order):
            codes, at = _numbers(data, at, size, _kind(n))
            columns.append(np.cumsum(codes, dtype=np.int32) if i == 0 else codes)
        counts, at = _numbers(data, at, size, _kind(most))
        sections.append((columns, counts))
    return words, sections


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray, pa.Array]]:
    """Of rows whose last column has tokens, so many that they have about CHUNK tokens: the other columns, how many tokens each has, their codes, and the words."""
    chunk, size = [], 0
    for batch in batches:
        ends = np.cumsum(_lengths(batch.column(batch.num_columns - 1)))
        start = 0
        while start < len(ends):
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + CHUNK - size, "right")))
            chunk.append(batch.slice(start, stop - start))
            size, start = size + int(ends[stop - 1]) - before, stop
            if size >= CHUNK or start < len(ends):
                yield from _coded(chunk)
                chunk, size = [], 0
    yield from _coded(chunk)


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _coded(chunk: list[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray, pa.Array]]:
    if chunk:
        *columns, lists = pa.Table.from_batches(chunk).combine_chunks().columns
        lists = lists.combine_chunks()
        coded = lists.flatten().dictionary_encode()
        if len(coded):
            yield [c.combine_chunks() for c in columns], _lengths(lists), coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary.cast(pa.large_binary())


def common(df: DataFrame, tokens: str, tasks: int) -> frozenset[bytes]:
    """Every word that is a fourth of a task's share of all tokens, and some that are an eighth. Chunks tell only the words that are an eighth among their own
    tokens: what the others leave out is less than an eighth of the whole."""

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, codes, words in _chunks(batches):
            each = np.bincount(codes, minlength=len(words))
            often = np.flatnonzero(each * 8 * tasks >= len(codes))
            yield pa.RecordBatch.from_arrays([pa.array([None, *words.take(pa.array(often)).to_pylist()], pa.binary()), pa.array([len(codes), *each[often].tolist()], pa.int64())], ["word", "n"])

    found = df.select(F.array_compact(tokens).alias("tokens")).mapInArrow(told, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    first = found.orderBy(F.desc("n")).limit(8 * tasks + 1).collect()  # the row of all tokens, and no more words than can be an eighth
    total = max((r.n for r in first), default=0)
    return frozenset(bytes(r.word) for r in first if r.word is not None and r.n * 8 * tasks >= total)


def deal(batches: Iterable[pa.RecordBatch], by: list[str], orders: int, tasks: int, often: frozenset[bytes]) -> Iterator[pa.RecordBatch]:
    """Blocks of the runs of rows (by, tokens), each with its groups and its task."""
    for columns, lengths, codes, words in _chunks(batches):
        yield _dealt(columns, lengths, codes, words, by, orders, tasks, often)


def _dealt(columns: list[pa.Array], lengths: np.ndarray, codes: np.ndarray, words: pa.Array, by: list[str], orders: int, tasks: int, often: frozenset[bytes]) -> pa.RecordBatch:
    group, first = groups(columns, len(lengths))
    left = np.repeat(np.cumsum(lengths, dtype=np.int32), lengths) - np.arange(len(codes), dtype=np.int32)
    spelled = words.to_pylist()
    hashes = np.array([zlib.crc32(w) for w in spelled], np.uint64)
    weight = np.array([0 if w in often else len(w) << 32 for w in spelled], np.uint64)
    weight = np.append(np.where(weight > 0, weight | hashes, weight), np.uint64(0))
    hashes = np.append(hashes, np.uint64(0))
    parts = []
    for (n, least), (runs, counts) in zip(units(orders), _distinct(np.repeat(group.astype(np.int32), lengths), codes, left, len(words), orders), strict=True):
        longest, whole = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
        for c in runs[1 : least + 1]:
            longest, whole = np.maximum(longest, weight[c]), _mixed(whole ^ hashes[c])
        to = runs[0].astype(np.int64) * tasks + (np.where(longest > 0, _mixed(longest), whole) % np.uint64(tasks)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        parts.append(([c[order] for c in runs[1:]], counts[order], np.searchsorted(to[order], np.arange(len(first) * tasks + 1))))
    places, blocks = [], []
    for p in range(len(first) * tasks):
        if any(ends[p] < ends[p + 1] for _, _, ends in parts):
            sections = [([c[ends[p] : ends[p + 1]] for c in runs], counts[ends[p] : ends[p + 1]]) for runs, counts, ends in parts]
            places.append(p)
            blocks.append(packed(words, sections))
    places = np.array(places)
    kept = pa.array(first[places // tasks])
    return pa.RecordBatch.from_arrays([*[c.take(kept) for c in columns], pa.array(places % tasks, pa.int32()), pa.array(blocks, pa.binary())], [*by, "_task", "_block"])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _sums(rank: np.ndarray, counts: np.ndarray) -> tuple[int, int, int]:
    each = np.bincount(rank, counts) if len(rank) else np.zeros(1)
    return int(np.count_nonzero(each)), int(counts.sum(dtype=np.int64)), int(each.max())


def counted(blocks: list[bytes], orders: int) -> list[tuple[int, int, int, int]]:
    """(n, distinct, all, most frequent) over the blocks of one group that a task has."""
    found = [unpacked(b, orders) for b in blocks]
    all_words = pa.chunked_array([w for w, _ in found], pa.large_binary()).combine_chunks().dictionary_encode()
    codes, end = all_words.indices.to_numpy(zero_copy_only=False).astype(np.int32), len(all_words.dictionary)
    starts, base = np.cumsum([0, *[len(w) for w, _ in found]]), end + 1
    meant = [np.append(codes[a:b], np.int32(end)) for a, b in zip(starts, starts[1:], strict=False)]
    out = []
    for u, (order, least) in enumerate(units(orders)):
        counts = np.concatenate([sections[u][1] for _, sections in found])
        rank = np.zeros(len(counts), np.int32)
        for n in range(1, order + 1):
            words = np.concatenate([m[sections[u][0][n - 1]] for m, (_, sections) in zip(meant, found, strict=True)])
            if n > least:
                inside = words < end
                rank, words, counts = rank[inside], words[inside], counts[inside]
            _, rank, _ = _unique(rank.astype(np.int64) * base + words)
            if n >= least:
                out.append((n, *_sums(rank, counts)))
    return out


def count(batches: Iterable[pa.RecordBatch], orders: int) -> Iterator[pa.RecordBatch]:
    """by, n, distinct_grams, grams, most of the blocks that a task has, one group after the other."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    *by, _, blocks = t.columns
    by = [c.combine_chunks() for c in by]
    group, first = groups(by, t.num_rows)
    rows, of = [], []
    for g in range(len(first)):
        found = counted([blocks[i].as_py() for i in np.flatnonzero(group == g).tolist()], orders)
        rows += found
        of += [first[g]] * len(found)
    numbers = [pa.array(c, pa.int64() if i else pa.int32()) for i, c in enumerate(zip(*rows, strict=True))]
    yield pa.RecordBatch.from_arrays([*[c.take(pa.array(of)) for c in by], *numbers], [*t.column_names[:-2], "n", "distinct_grams", "grams", "most"])
