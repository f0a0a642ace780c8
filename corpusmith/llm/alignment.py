"""Alignment of two tokenizers' tokens over the same bytes, in relational steps.

`align` takes rows that hold two token sequences of the same text. Tokens are exploded with their positions; a windowed sum of byte lengths gives where each ends; an equi-join
on the text and the end finds the cuts where both end; a running count of cuts is the group of a token. Between two neighbouring ends, of whichever side, lies one token of each
side, and these pieces are all overlaps, each once: so a link is an end, with the next token of either side at or after it, and the links of a group of
m and n tokens cost m + n rows, where a range join would meet m times n.

`align_documents` applies this to a corpus. Texts are cut where both tokenizers are bound to cut (`CUT`: before a space or a line break after something else, and
between a letter and a stop), so the tokens of a text are those of its segments in a row. Segments repeat a great deal: each distinct one is encoded and
aligned once, weighted by how often it occurs in the corpus, and a text's figures and groups are put together from its segments'. For that, documents are
dealt to blocks of bounded size; a block keeps its segments as numbers and is sent what the distinct ones came to.

Null and empty texts, and those whose tokens don't give back a space and the text (as tokenizer B reads U+2581 as a space), have no tokens: zeros, an empty
string, and no part in the counts. Repeated rows and ids are documents of their own, null ids stay, other columns are ignored, an empty table gives no rows. A text
without any such cut is one segment: the work is the same, in windows over its tokens.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmith.llm.bpe import ship
from corpusmith.llm.common import arrow_batches, settings, shuffle_partitions, staged, table, text_or_empty

CUT = re.compile(r"(?<=\S)(?=[ \n])|(?<=[A-Za-zÀ-ÖØ-öø-ɏ])(?=[.,;:!?])")
#: White space other than single spaces and line breaks: such texts are cut by CUT, all others by the faster SEGMENTS, at the same places or fewer.
ODD = re.compile(r"[^\S \n]|[ \n][ \n]")
SEGMENTS = re.compile(r"[ \n][A-Za-zÀ-ÖØ-öø-ɏ]++(?![^\s.,;:!?])|[ \n][^ \n]*|[.,;:!?][^ \n]*")
#: A text that holds this isn't what tokenizer B's pieces say.
SPACE_MARK = "▁"
#: Characters of text after which a block of documents is closed (a row counts as so many besides its text), and bytes of input that a task takes.
BLOCK, ROW, TASK_INPUT = 48 << 20, 64, 24 << 20
#: Segments that a task aligns, of some ten tokens each.
ALIGNED = 30_000
#: Distinct pairs of ids that are sent to all executors; more are joined by a shuffle.
SENT_PAIRS = 1 << 20
OUT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def segments_of(text: str) -> list[str]:
    """The segments of a space and the text."""
    text = " " + text
    return CUT.split(text) if ODD.search(text) else SEGMENTS.findall(text)


def byte_letters() -> dict[str, int]:
    """The characters by which byte-level models print bytes: Latin-1's own where they are visible, the others from U+0100 on, in order."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(x): x for x in seen} | {chr(0x100 + k): x for k, x in enumerate(sorted(set(range(0x100)) - set(seen)))}


class Pair:
    """Both tokenizers: ids and byte lengths of segments, and whether the bytes are the segment's."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        byte = byte_letters()
        self.bytes_a = {i: bytes([byte[c] for c in t]) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.b = b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a = np.zeros(max(self.bytes_a) + 1, np.int32)
        for i, raw in self.bytes_a.items():
            self.sizes_a[i] = len(raw)
        self.sizes_b = np.array(list(map(len, self.bytes_b)), np.int32)
        for raw in (*self.bytes_a.values(), *self.bytes_b):
            if len(CUT.split(raw.decode(errors="replace"))) > 1:
                raise ValueError(f"a token reaches over a cut of segments: {raw!r}")

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both. A line break is a token of its own to tokenizer B, so behind one a segment is encoded as in the middle of a text."""
        a = [x.ids for x in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        return a, [x[2:] for x in self.b.encode(["\n" + s for s in segments], num_threads=1)]

    def joined(self, segment: str, a: list[int], b: list[int]) -> bool:
        raw = segment.encode()
        return b"".join([self.bytes_a[i] for i in a]) == raw == b"".join([self.bytes_b[i] for i in b])


_pairs: dict[tuple[str, str], Pair] = {}


def pair_of(name_a: str, name_b: str) -> Pair:
    """This worker's tokenizers, from files that the driver has shipped."""
    if (name_a, name_b) not in _pairs:
        _pairs[name_a, name_b] = Pair(SparkFiles.get(name_a), SparkFiles.get(name_b))
    return _pairs[name_a, name_b]


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers by planes of bytes, of which the higher are nearly empty."""
    return zlib.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_numbers(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(x), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1)


def in_blocks(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: a document (block, doc_id, the numbers of its segments); and of a block's distinct segments (block, number, segment, occurrences there)."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    few = min(1 << 30, max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_INPUT)))  # more than there are changes nothing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, room, number, seen = TaskContext.get().partitionId() << 32, BLOCK, {}, []
        ids_of = None

        def closed() -> Iterator[pa.RecordBatch]:
            n = np.bincount(np.concatenate(seen), minlength=len(number))
            segments = list(number)
            for at in range(0, len(segments), 50_000):
                some = segments[at : at + 50_000]
                k = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([block] * k, pa.int64()), pa.nulls(k, ids_of), pa.nulls(k, pa.binary()), pa.array(range(at, at + k), pa.int64()), pa.array(some, pa.string()), pa.array(n[at : at + k])], NAMES)

        for b in batches:
            ids_of, packed = b.column(0).type, []
            for text in b.column(1).to_pylist():
                room -= len(text) + ROW
                if not text or SPACE_MARK in text:
                    packed.append(b"")
                    continue
                segments = segments_of(text)
                for s in set(segments).difference(number):
                    number[s] = len(number)
                x = np.fromiter(map(number.__getitem__, segments), np.uint32, len(segments))
                packed.append(pack_numbers(x))
                seen.append(x)
            k = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([block] * k, pa.int64()), b.column(0), pa.array(packed, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64())], NAMES)
            if room < 0:
                yield from closed()
                block, room, number, seen = block + 1, BLOCK, {}, []
        if number:
            yield from closed()

    with arrow_batches(docs.sparkSession):
        return staged(rows.coalesce(few).mapInArrow(run, f"block bigint, doc_id {kind}, seq binary, number bigint, segment string, n bigint"), "blocks", "zstd")


NAMES = ["block", "doc_id", "seq", "number", "segment", "n"]


def encoded(segments: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """Distinct segments with their tokens (side 0: A, 1: B), in order, as (side, id, bytes). Empty where the tokens don't say the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(name_a, name_b)
        for b in batches:
            texts = b.column(0).to_pylist()
            of_a, of_b = pair.encode(texts)
            if not pair.joined("".join(texts), list(chain.from_iterable(of_a)), list(chain.from_iterable(of_b))):
                good = [pair.joined(*x) for x in zip(texts, of_a, of_b, strict=True)]
                of_a, of_b = ([x if g else [] for x, g in zip(of, good, strict=True)] for of in (of_a, of_b))
            both = list(chain.from_iterable(zip(of_a, of_b, strict=True)))  # a segment's A tokens, then its B tokens
            sizes = np.fromiter(map(len, both), np.int64, len(both))
            ids = np.fromiter(chain.from_iterable(both), np.int32, int(sizes.sum()))
            side = np.repeat(np.tile(np.array([0, 1], np.int32), len(texts)), sizes)
            long = np.where(side == 0, pair.sizes_a[np.where(side == 0, ids, 0)], pair.sizes_b[np.where(side == 1, ids, 0)])
            tokens = pa.StructArray.from_arrays([pa.array(side), pa.array(ids), pa.array(long)], ["side", "id", "bytes"])
            offsets = np.concatenate([[0], np.cumsum(sizes)[1::2]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.ListArray.from_arrays(pa.array(offsets), tokens)], [*b.schema.names[1:], "tokens"])

    rest = ", ".join(f"{c} {t}" for c, t in segments.dtypes[1:])
    return segments.mapInArrow(run, f"{rest}, tokens array<struct<side:int,id:int,bytes:int>>")


def align(texts: DataFrame, key: str = "doc", tasks: int | None = None) -> DataFrame:
    """Per row of texts (key, unique; tokens: array of (side, id, bytes), each side in order): key, n_a, n_groups, groups ('a1,a2|b1;a3|b2'), links (array of (a, b)).

    All steps go by the key, so the tokens are shuffled once, before they are exploded, to `tasks` partitions; rows without tokens don't come back."""
    spread = texts.select(key, "tokens").repartition(*([tasks] if tasks else []), key)
    said = spread.select(key, F.posexplode("tokens").alias("pos", "t")).select(key, "pos", "t.side", "t.id", "t.bytes")
    ends = said.select(key, "side", "id", F.sum("bytes").over(Window.partitionBy(key, "side").orderBy("pos")).alias("end"))
    cuts = ends.filter("side = 0").select(key, "end").join(ends.filter("side = 1").select(key, "end"), [key, "end"]).withColumn("cut", F.lit(1))
    marked = ends.join(cuts, [key, "end"], "left")
    back = Window.partitionBy(key).orderBy(F.desc("end"))  # tokens that end together are peers: each sees what the other holds
    a, b = F.col("side") == 0, F.col("side") == 1
    grouped = marked.select(
        key, "side", "id", "end", "cut",
        F.sum(F.when(a, F.col("cut"))).over(back).alias("group"),
        F.struct(F.last(F.when(a, F.col("id")), ignorenulls=True).over(back).alias("a"), F.last(F.when(b, F.col("id")), ignorenulls=True).over(back).alias("b")).alias("link"),
    )
    ids = lambda side: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(side, F.struct("end", "id")))), lambda t: t["id"].cast("string")), ",")
    groups = grouped.groupBy(key, "group").agg(
        F.concat(ids(a), F.lit("|"), ids(b)).alias("text"),
        F.count(F.when(a, 1)).alias("n_a"),
        F.collect_list(F.when(a | F.col("cut").isNull(), F.col("link"))).alias("links"),
    )
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("group")).alias("k"), "text")))
    return groups.groupBy(key).agg(
        F.sum("n_a").alias("n_a"),
        F.count("*").alias("n_groups"),
        F.array_join(F.transform(ordered, lambda g: g["text"]), ";").alias("groups"),
        F.flatten(F.collect_list("links")).alias("links"),
    )


def pair_counts(links: DataFrame) -> DataFrame:
    """Of links (a, b, n): the pairs with their counts, and whether a pair's is the highest of its b."""
    counts = links.groupBy("a", "b").agg(F.sum("n").alias("pair_n"))
    return counts.withColumn("best", (F.col("pair_n") == F.max("pair_n").over(Window.partitionBy("b"))).cast("int"))


def put_together(documents: DataFrame, parts: DataFrame) -> DataFrame:
    """Per document of documents (block, doc_id, seq) what its segments came to, from parts (block, number, n_a, n_best, count_sum, groups)."""
    kind = documents.schema["doc_id"].dataType

    def run(docs: pa.Table, said: pa.Table) -> pa.Table:
        order = np.argsort(said["number"].to_numpy())
        groups = said["groups"].take(pa.array(order)).to_pylist()
        n_groups = np.fromiter((0 if g is None else g.count(";") + 1 for g in groups), np.int64, len(groups))
        n_ids = np.fromiter((0 if g is None else g.count(",") for g in groups), np.int64, len(groups)) + 2 * n_groups
        figures = np.stack([*(said[c].to_numpy()[order] for c in ("n_a", "n_best", "count_sum")), n_groups, n_ids])
        columns: list[list] = [[] for _ in range(7)]
        for seq in docs["seq"].to_pylist():
            if not seq or (figures[0, at := unpack_numbers(seq)] == 0).any():
                values = [0, 0, 0, 0, 0, 0, ""]
            else:
                n_a, n_best, count_sum, n_groups, n_ids = figures[:, at].sum(axis=1).tolist()
                whole = ";".join([groups[i] for i in at.tolist()])
                # As many links as ends; a cut is an end of both sides.
                values = [n_a, n_ids - n_a, n_groups, n_ids - n_groups, n_best, count_sum, hashlib.sha256(whole.encode()).hexdigest()]
            for c, v in zip(columns, values, strict=True):
                c.append(v)
        return pa.Table.from_arrays([docs["doc_id"], *(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return documents.groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(run, f"doc_id {kind.simpleString()}, {OUT}")


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    name_a, name_b = ship(spark, path_a), ship(spark, path_b)
    blocks = in_blocks(docs)
    distinct = blocks.filter("number is not null").groupBy("segment").agg(F.sum("n").alias("n"), F.collect_list(F.struct("block", "number")).alias("uses"))
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="4096"):
        segments = staged(encoded(distinct, name_a, name_b).withColumn("doc", F.monotonically_increasing_id()), "segments", "zstd")
    # Ends are joined where the tokens of a text lie already.
    with settings(spark, spark__sql__requireAllClusterKeysForCoPartition="false"):
        tasks = max(shuffle_partitions(spark), -(-segments.count() // ALIGNED))
        aligned = staged(align(segments, tasks=tasks).join(segments.select("doc", "n"), "doc"), "aligned", "zstd")
    links = aligned.select("doc", "n", F.explode("links").alias("l")).select("doc", "n", "l.a", "l.b")
    counts = staged(pair_counts(links.select("a", "b", "n")), "pairs")
    sent = F.broadcast(counts) if counts.count() <= SENT_PAIRS else counts
    sums = links.join(sent, ["a", "b"]).groupBy("doc").agg(F.sum("best").alias("n_best"), F.sum("pair_n").alias("count_sum"))
    whole = segments.select("doc", "uses").join(aligned.select("doc", "n_a", "groups"), "doc", "left").join(sums, "doc", "left")
    parts = whole.select(F.explode("uses").alias("u"), "n_a", "n_best", "count_sum", "groups").select("u.block", "u.number", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_a", "n_best", "count_sum")), "groups")
    return put_together(blocks.filter("number is null").select("block", "doc_id", "seq"), parts)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
