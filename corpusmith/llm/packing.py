"""Packing of documents into sequences of a fixed capacity by minimum bin slack.

A document's ids (its words' ids and one closing id) are cut into full windows of the capacity, which are sequences by themselves, and one
remainder. Remainders are packed by their lengths alone: lengths are at most the capacity, so their histogram is small whatever the number of
documents, and the driver plans on the histogram. A window takes the longest remaining piece; a dynamic programme over a bitset of reachable sums
then finds the multiset of other lengths that comes closest to the capacity, and walking back gives how many pieces of each length it holds. The same
window is repeated as often as the counts allow, which uses some length up, so the number of different windows is bounded by the number of lengths
and not by the number of documents. Each piece then finds its window by its rank among the pieces of its length: ranks come from counts per block of rows
and length, summed over blocks, so no task sees all pieces of a common length.

A sequence is padded to the capacity unless its length is a power of two, so such a sum counts as full. Null texts count as empty: their one piece is the closing
id. Repeated rows and ids are documents of their own, null ids stay, other columns are ignored, and an empty table gives no rows. Strings of
special tokens in a text are what the tokenizer's library makes of them by default.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmith.llm.bpe import ship
from corpusmith.llm.common import arrow_batches, staged, table, text_or_empty

CAPACITY = 2048
END_ID = 1
#: Distinct parts of texts whose ids a worker remembers before it starts anew.
REMEMBERED = 600_000


class Words:
    """Ids of texts by a tokenizer that ignores cases, drops white space and encodes each match of a pattern on its own, so that the ids of parts are
    remembered. Texts of characters below U+0100 alone, where lower() is what the tokenizer's normaliser makes, are cut by the pattern here; other
    texts are cut at white space and the rest is the tokenizer's work. So are special tokens' strings."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path) as f:
            said = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        pattern = said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        kinds = {kind: "".join(re.escape(c) for c in map(chr, range(256)) if regex.fullmatch(kind, c)) for kind in (r"\p{L}", r"\p{N}", r"\s")}
        for kind, characters in kinds.items():
            pattern = pattern.replace(kind, characters)
        self.findall = re.compile(pattern).findall
        space = regex.sub(r"[\x1c-\x1f]", "", kinds[r"\s"])
        self.words = re.compile(f"[^{space}\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+").findall
        self.special = [t["content"] for t in said["added_tokens"]]
        # Byte-level models read each byte as a printable character.
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {x: level.pre_tokenize_str(chr(x))[0][0] for x in range(128)}
        for lead in (0xC2, 0xC3):  # the two-byte characters below U+0100
            for tail in range(0x80, 0xC0):
                self.letters[lead], self.letters[tail] = level.pre_tokenize_str(bytes([lead, tail]).decode())[0][0]
        self.known: dict[str, bytes] = {}
        self.known_words: dict[str, bytes] = {}

    def _plain(self, text: str) -> bool:
        if any(x in text for x in self.special):
            return False
        try:
            return text.isascii() or bool(text.encode("latin-1"))
        except UnicodeEncodeError:
            return False

    def _part(self, part: str) -> bytes:
        found = self.tokenizer.model.tokenize(part.encode().decode("latin-1").translate(self.letters))
        return pack("<%dI" % len(found), *[t.id for t in found])

    def _word(self, word: str) -> bytes:
        found = self.tokenizer.encode(word, add_special_tokens=False).ids
        return pack("<%dI" % len(found), *found)

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self._plain(text):
            parts, known, encode = self.findall(text.lower()), self.known, self._part
        else:
            parts, known, encode = self.words(text), self.known_words, self._word
        if len(known) > REMEMBERED:
            known.clear()
        for part in set(parts).difference(known):
            known[part] = encode(part)
        return b"".join(map(known.__getitem__, parts))


_words: dict[str, Words] = {}


def words_of(name: str) -> Words:
    """This worker's encoder for a tokenizer file that the driver has shipped."""
    if name not in _words:
        _words[name] = Words(SparkFiles.get(name))
    return _words[name]


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the full windows and of the remainder."""
    n = len(ids) // 4
    return [(at, min(capacity, n - at), zlib.crc32(ids[4 * at : 4 * (at + capacity)])) for at in range(0, n, capacity)]


def document_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece, with the block of rows that it came in and its rank there among the pieces of its length. No shuffle."""
    spark = docs.sparkSession
    name = ship(spark, tokenizer_path)
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block, seen = words_of(name), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            row, start, length, crc, total, nth = [], [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                ids = words.ids(text.as_py()) + end
                for at, n, c in cut(ids, capacity):
                    row.append(i)
                    start.append(at)
                    length.append(n)
                    crc.append(c)
                    total.append(len(ids) // 4)
                    nth.append(int(seen[n]))
                    seen[n] += 1
            columns = [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, [block] * len(row), nth))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "block", "nth"])

    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, block bigint, nth bigint"
    with arrow_batches(spark):
        return staged(rows.mapInArrow(run, schema), "pieces")


def padding(total: int, capacity: int) -> int:
    return 0 if total & (total - 1) == 0 else capacity - total


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many pieces of each length the next window takes: the longest piece, and others whose sum leaves least padding (of equals: the longest sum)."""
    lengths = sorted(counts, reverse=True)
    room = capacity - lengths[0]
    left = [(n, min(counts[n] - (n == lengths[0]), room // n)) for n in lengths if n <= room]
    left = [(n, c) for n, c in left if c > 0]
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n, c in left:
        steps.append(reach)
        part = 1
        while c > 0:  # c pieces as 1, 2, 4 ... of them
            k = min(part, c)
            reach |= (reach << (n * k)) & mask
            c, part = c - k, 2 * part
        if reach >> room & 1:
            break
    sums = [s for s in range(room + 1) if reach >> s & 1]
    at = min(sums, key=lambda s: (padding(lengths[0] + s, capacity), -s))
    took = {lengths[0]: 1}
    for (n, _), before in zip(reversed(left[: len(steps)]), reversed(steps), strict=True):
        k = 0
        while not before >> at & 1:  # as few of the shorter pieces as will do
            at, k = at - n, k + 1
        if k:
            took[n] = took.get(n, 0) + k
    return took


def plan_windows(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Windows as (how many alike, pieces of each length); every piece is in one."""
    left, windows = {n: c for n, c in counts.items() if c > 0}, []
    while left:
        took = fill(left, capacity)
        times = min(left[n] // k for n, k in took.items())
        windows.append((times, took))
        for n, k in took.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return windows


def slots(windows: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, pieces in a window, first sequence, offset) in order of length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, took in windows:
        offset = 0
        for n, k in took.items():
            rows.append((n, used.get(n, 0), k, sequence, offset))
            used[n] = used.get(n, 0) + times * k
            offset += n * k
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id (gapless from 0), offset."""
    spark = docs.sparkSession
    pieces = document_pieces(docs, tokenizer_path, capacity, end_id)
    of_block = pieces.groupBy("block", "length").agg(F.count("*").alias("n"))
    by_length = {r.length: r.n for r in of_block.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length at most
    sent = spark.sparkContext.broadcast(slots(plan_windows(by_length, capacity)))
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = of_block.select("block", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["block", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = sent.value
        order = np.empty(len(plan), [("length", np.int64), ("rank", np.int64)])
        order["length"], order["rank"] = plan[:, 0], plan[:, 1]
        for b in batches:
            asked = np.empty(b.num_rows, order.dtype)
            asked["length"], asked["rank"] = b.column(2).to_numpy(), b.column(5).to_numpy()
            _, first, k, sequence, offset = plan[np.searchsorted(order, asked, side="right") - 1].T
            window, slot = np.divmod(asked["rank"] - first, k)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence + window), pa.array(offset + slot * asked["length"])], [*b.schema.names[:5], "sequence_id", "offset"])

    schema = f"doc_id {dict(ranked.dtypes)['doc_id']}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return ranked.mapInArrow(place, schema)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
