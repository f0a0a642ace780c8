"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap. Every chunk is pre-tokenised on its own, from its own start; within
the overlap of two neighbours the first boundary that both found, with a character other than white space
before it, is where they resynchronise: the pattern looks ahead but never behind, so from a common boundary
on both give the same pieces. The stitched pieces are encoded one by one. Where an overlap holds no common
boundary (a run of a million letters), the left chunk is read on with a doubled overlap until one appears or the
text ends, so the result is always that of one pass over the whole text.

Null texts count as empty; an empty text has no ids. Special tokens are ordinary text. Lone surrogates cannot
occur in Spark strings. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from corpusmith.llm.common import small_batches, table, text_or_empty

CHUNK = 1 << 15
OVERLAP = 1 << 9
#: Distinct pieces whose ids a worker remembers before it starts anew.
REMEMBERED = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def chunk_bounds(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) of chunks that cover n characters; each reaches `overlap` into the next."""
    return [(at, min(n, at + chunk + overlap)) for at in range(0, max(n, 1), chunk)]


def _boundaries(pieces: list[str], start: int, low: int) -> dict[int, int]:
    """Offsets >= low where a piece starts -> how many pieces lie before it, walking back from the end."""
    found, at = {}, start + sum(map(len, pieces))
    for k in range(len(pieces), -1, -1):
        if at < low:
            break
        found[at] = k
        if k:
            at -= len(pieces[k - 1])
    return found


def pretokenise(text: str, findall, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[str]]:
    """Runs of pieces; joined they are findall(text)."""
    n = len(text)
    if n <= chunk + overlap:
        yield findall(text)
        return
    start = 0
    while True:
        reach = overlap
        while True:
            end = min(n, start + chunk + reach)
            left = findall(text[start:end])
            if end == n:
                yield left
                return
            cut = start + chunk
            right = findall(text[cut : min(n, cut + 2 * reach)])
            starts, at = set(), cut
            for p in right:
                starts.add(at)
                at += len(p)
            # The last pieces of the left chunk may have been cut short, so its end is no boundary.
            known = _boundaries(left[:-1], start, cut + 1)
            meet = min((x for x in known if x in starts and not text[x - 1].isspace()), default=None)
            if meet is not None:
                yield left[: known[meet]]
                start = meet
                break
            reach = max(2 * reach, 16)


class Codec:
    """Encodes pieces by ranks and decodes ids by concatenating raw bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import tiktoken

        self.findall = regex.compile(pattern).findall
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.raw = {i: b for b, i in ranks.items()}
        self.seen: dict[str, tuple[int, bytes, bytes]] = {}

    def piece(self, piece: str) -> tuple[int, bytes, bytes]:
        """Of one piece: number of ids, the decimal ids with a space before each, the bytes that the ids decode to."""
        ids = self.encoding.encode_ordinary(piece)
        known = (len(ids), b"".join(b" %d" % i for i in ids), self.decode(ids))
        self.seen[piece] = known
        return known

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        return [i for run in pretokenise(text, self.findall, chunk, overlap) for p in run for i in self.encoding.encode_ordinary(p)]

    def decode(self, ids) -> bytes:
        return b"".join([self.raw[i] for i in ids])

    def digest(self, text: str) -> tuple[int, str, str]:
        count, ids_sha, raw_sha, first = 0, hashlib.sha256(), hashlib.sha256(), True
        for run in pretokenise(text, self.findall):
            if len(self.seen) > REMEMBERED:
                self.seen.clear()
            get, new = self.seen.get, self.piece
            parts = [get(p) or new(p) for p in run]
            if not parts:
                continue
            count += sum([x[0] for x in parts])
            ids = b"".join([x[1] for x in parts])
            ids_sha.update(ids[1:] if first else ids)
            raw_sha.update(b"".join([x[2] for x in parts]))
            first = False
        return count, ids_sha.hexdigest(), raw_sha.hexdigest()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(name: str, pattern: str) -> Codec:
    """This worker's codec for a ranks file that the driver has shipped with addFile()."""
    if (name, pattern) not in _codecs:
        _codecs[name, pattern] = Codec(read_ranks(SparkFiles.get(name)), pattern)
    return _codecs[name, pattern]


def ship(spark: SparkSession, path: str) -> str:
    """Send the ranks file to every executor; executors that join later fetch it too."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row of docs: id_col, n_tokens, ids_sha256, decoded_sha256, and with_ids the ids themselves. No shuffle."""
    small_batches(docs.sparkSession)
    name = ship(docs.sparkSession, ranks_path)
    rows = docs.select(id_col, text_or_empty(text_col).alias("_t"))
    kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(name, pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            digests = [c.digest(t) for t in texts]
            columns = [b.column(0), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.string()), pa.array([d[2] for d in digests], pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array([c.encode(t) for t in texts], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(run, schema)


def decode_ids(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id_col and `bytes`, the concatenated raw bytes of its ids (null ids: no bytes)."""
    small_batches(df.sparkSession)
    name = ship(df.sparkSession, ranks_path)
    rows = df.select(id_col, ids_col)

    def run(batches):
        c = codec(name, pattern)
        for b in batches:
            raw = [c.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], [id_col, "bytes"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, bytes binary")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as ids: number and digests, with the digest of what the ids decode to."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
