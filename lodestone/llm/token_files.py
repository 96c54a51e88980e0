"""Token ids in binary files: frequency ranks in a byte-aligned variable-length code.

The most frequent id of the corpus has rank 0.  A rank takes 1 to 4 bytes,
little-endian; how many, less one, stands in two bits of a separate stream of
control bytes, four ranks to a byte, low bits first; each document's begin a new byte.  numpy decodes a block by
tables: control byte -> four lengths, length -> byte mask, rank -> id.

A file is a run of blocks, a line feed after each; a block holds whole documents

    4 bytes  magic ``LTF1``
    3 x u32  documents, control bytes, data bytes
    u64      ids of all documents before the block
    documents x i64 doc_id, x u8 (1: doc_id is null), x u32 ids
    control bytes, data bytes

all little-endian.  Files follow each other by name, in ascending doc_id
order (null first; rows of one id by a hash of the text).  Spark's own text
writer writes them: a block travels as a string that is never looked at, so
attempts of lost executors leave no part behind, on any file system that Spark
knows.

Texts are cut before encoding, at ASCII white space and between ASCII letters
or digits and punctuation: the tokenizer's pattern matches nothing over such a
place, and no normalisation reaches over it, so a piece has the same ids
wherever it stands, and a worker encodes a piece once (it keeps the ids of up
to CACHE pieces, known by 64-bit hashes: the chance that a piece is taken for
another one of them is 3 in 10**14).

Defined results: null and empty texts, or such without words, have the end id
alone; repeated rows each stand in the files; an empty table gives no rows;
only doc_id and text are read.  A document of any length stands in one block.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import discard, temporary, written
from lodestone.llm.textvec import span_hashes

MAGIC = b"LTF1"
#: Ids after which a block is closed; least and most ids of a file, between which files are as many as four times the cores.
BLOCK_IDS, FILE_IDS = 1 << 20, (1 << 22, 1 << 26)
#: Distinct pieces of text whose ids a worker keeps; bytes of text looked at at once.
CACHE, PART_BYTES = 1 << 19, 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Kinds of bytes: 0 white space, 1 ASCII letters and digits, 2 other printing ASCII, 3 the apostrophe (which may begin a word's ending), 4 the rest.
_KINDS = np.array([0 if b in b" \t\n\v\f\r" else 3 if b == 39 else 4 if not 32 < b < 127 else 1 if chr(b).isalnum() else 2 for b in range(256)], np.uint8)
#: By the kinds of two neighbours: 1 a piece starts between them, 2 one ends there.
_EDGES = np.array([(b > 0) * (a == 0 or (a, b) in {(1, 2), (2, 1), (1, 3)}) + 2 * (a > 0) * (b == 0 or (a, b) in {(1, 2), (2, 1), (1, 3)}) for a in range(5) for b in range(5)], np.uint8)
_HEAD = struct.Struct("<4sIIIQ")
_codecs: dict[bytes, object] = {}

#: Fixed by the layout: the four lengths that a control byte stands for, and the bits that a length leaves of four bytes.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


# --- the code -----------------------------------------------------------------------------------------------------------


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of ranks below 2**32."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    held = np.arange(4) < size[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[held].tobytes()


def unpack(control: bytes, data: bytes, sizes: np.ndarray) -> np.ndarray:
    """The ranks of documents of the given sizes; each document's control bytes begin anew."""
    slots = (sizes.astype(np.int64) + 3) // 4 * 4
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()
    if len(size) != slots.sum():
        raise ValueError("control bytes and sizes differ")
    size = size[np.arange(len(size)) - np.repeat(np.cumsum(slots) - slots, slots) < np.repeat(sizes, slots)]
    ends = np.cumsum(size, dtype=np.int64)
    if (ends[-1] if len(ends) else 0) != len(data):
        raise ValueError("control and data bytes differ")
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    at, out = ends - size, np.zeros(len(size), np.uint32)
    for k in range(int(size.max(initial=0))):
        out |= padded[at + k].astype(np.uint32) << np.uint32(8 * k)
    return out & MASKS[size]


def block(start: int, documents: list[tuple[int | None, int, bytes, bytes]]) -> bytes:
    """A block of documents (doc_id, ids, control bytes, data bytes); start: ids of all documents before it."""
    ids, sizes, control, data = zip(*documents, strict=True)
    control, data = b"".join(control), b"".join(data)
    head = _HEAD.pack(MAGIC, len(ids), len(control), len(data), start)
    return b"".join([head, np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is None for i in ids], np.uint8).tobytes(), np.array(sizes, "<u4").tobytes(), control, data])


def blocks(content: bytes | pa.Buffer) -> Iterator[tuple[int, list[int | None], np.ndarray, np.ndarray]]:
    """(start, doc ids, sizes, ranks) of each block of a file's bytes."""
    view, at = memoryview(content), 0
    while at < len(view):
        magic, docs, control, data, start = _HEAD.unpack_from(view, at)
        if magic != MAGIC:
            raise ValueError("no block of token ids")
        parts, at = [], at + _HEAD.size
        for size in (8 * docs, docs, 4 * docs, control, data):
            parts.append(bytes(view[at : at + size]))
            at += size
        ids, null = np.frombuffer(parts[0], "<i8").tolist(), np.frombuffer(parts[1], np.uint8).tolist()
        sizes = np.frombuffer(parts[2], "<u4")
        yield start, [None if z else i for i, z in zip(ids, null, strict=True)], sizes, unpack(parts[3], parts[4], sizes)
        at += 1  # the line feed


# --- tokens -------------------------------------------------------------------------------------------------------------


class WordCodec:
    """A tokenizers file whose pattern crosses no white space, with the ids of pieces met before: sorted hashes, and where their ids lie in one array."""

    def __init__(self, content: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.core = Tokenizer.from_buffer(content)
        self.core.encode_special_tokens = True  # their strings in a text are ordinary text
        self.suffix = json.loads(self.core.to_str())["model"].get("end_of_word_suffix")
        self.ends = np.array([bool(self.suffix) and (self.core.id_to_token(i) or "").endswith(self.suffix) for i in range(self.core.get_vocab_size())])
        self.forget()

    @classmethod
    def of(cls, content: bytes) -> WordCodec:
        """One a worker process for each file."""
        key = hashlib.sha256(content).digest()
        if key not in _codecs:
            _codecs[key] = cls(content)
        return _codecs[key]

    def forget(self) -> None:
        self.hashes, self.at, self.n, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Pieces of letters are one word each: they go in as one text and part at the ids that end a word."""
        word = np.array([bool(self.suffix) and p.isalpha() and p.lower().isalpha() for p in pieces], bool)
        words = [p for p, w in zip(pieces, word.tolist(), strict=True) if w]
        ids = np.array(self._ids([" ".join(words)])[0] if words else [], np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            word[:] = False
            ids, ends = ids[:0], ends[:0]
        rest = self._ids([p for p, w in zip(pieces, word.tolist(), strict=True) if not w])
        n = np.empty(len(pieces), np.int64)
        n[word], n[~word] = np.diff(ends, prepend=0), [len(x) for x in rest]
        order = np.concatenate((np.flatnonzero(word), np.flatnonzero(~word)))  # as the ids lie
        at = np.empty(len(pieces), np.int64)
        at[order] = len(self.ids) + np.cumsum(n[order]) - n[order]
        self.ids = np.concatenate((self.ids, ids, np.array([i for x in rest for i in x], np.uint32)))
        every = np.concatenate((self.hashes, hashes))
        sort = np.argsort(every, kind="stable")
        self.hashes, self.at, self.n = every[sort], np.concatenate((self.at, at))[sort], np.concatenate((self.n, n))[sort]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.core.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of UTF-8 texts."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, bytes]] = []
        size = 0
        for i, text in enumerate(texts):
            for part in _parts(text):
                held.append((i, part))
                size += len(part)
                if size > PART_BYTES:
                    self._encode(held, out)
                    held, size = [], 0
        self._encode(held, out)
        return [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, np.uint32), *x]) for x in out]

    def _encode(self, held: list[tuple[int, bytes]], out: list[list[np.ndarray]]) -> None:
        if not held:
            return
        texts = [p for _, p in held]
        low, starts, ends, hashes = _pieces(texts)
        own, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        new = self._missing(own)
        if len(self.hashes) + len(new) > CACHE:
            self.forget()
            new = np.arange(len(own))
        if len(new):
            raw = low.tobytes()
            self.learn(own[new], [raw[s:e].decode() for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        entry = np.searchsorted(self.hashes, own)[place]
        n = self.n[entry]
        after = np.cumsum(n)
        ids = self.ids[np.repeat(self.at[entry] - after + n, n) + np.arange(int(after[-1]) if len(after) else 0)]
        bounds = np.concatenate(([0], after))[np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))]
        for (i, _), x in zip(held, np.split(ids, bounds[:-1]), strict=True):
            out[i].append(x)

    def _missing(self, own: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, own)
        there = np.zeros(len(own), bool)
        inside = at < len(self.hashes)
        there[inside] = self.hashes[at[inside]] == own[inside]
        return np.flatnonzero(~there)


def _pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, one line feed after each, lower-cased where that is safe; starts, ends and hashes of their pieces."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    kind = _KINDS[raw]
    edge = _EDGES[np.concatenate(([0], kind[:-1])) * 5 + kind]
    starts, ends = np.flatnonzero(edge & 1), np.flatnonzero(edge & 2)
    upper = (raw >= 65) & (raw <= 90)
    upper[:-1] &= raw[1:] < 128  # a mark may follow, and compose with the capital alone
    low = raw + (upper.view(np.uint8) << np.uint8(5))
    return low, starts, ends, span_hashes(low, starts, ends)


def _parts(text: bytes) -> Iterator[bytes]:
    """text in parts of about PART_BYTES, cut before white space."""
    begin = 0
    while len(text) - begin > PART_BYTES and (m := _SPACE.search(text, begin + PART_BYTES)):
        yield text[begin : m.start()]
        begin = m.start()
    yield text[begin:]


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def tokens(docs: DataFrame, tokenizer: bytes, end_id: int) -> DataFrame:
    """Rows (doc_id, tie, n, ids binary: u32 little-endian, end_id last); tie: a hash of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = WordCodec.of(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = [x.astype("<u4").tobytes() + end for x in codec.encode([t or b"" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "tie", "n", "ids"])

    text = F.col("text").cast("string")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("tie"))
    return read.mapInArrow(run, "doc_id long, tie long, n long, ids binary")


def ranked(table: DataFrame) -> np.ndarray:
    """Ids by falling frequency, ties by id.  Its size is that of the vocabulary, not of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(0, np.int64)
        for b in batches:
            for x in b.column(0):
                own = np.bincount(np.frombuffer(x.as_buffer(), "<u4"), minlength=len(count))
                own[: len(count)] += count
                count = own
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(count[met])], ["id", "n"])

    counts = table.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return np.array([r.id for r in counts.orderBy(F.desc("n"), "id").select("id").collect()], np.uint32)


# --- files --------------------------------------------------------------------------------------------------------------


def places(table: DataFrame, parts: int) -> list[tuple[tuple[int, int, int, int], int]]:
    """(first key, ids before it) of each part of the documents in ascending order, cut by rows.

    Only keys and sizes are sorted here; the driver holds one row a file.
    """
    key = ["known", "doc_id", "tie", "uid"]
    keys = table.select(F.col("doc_id").isNotNull().cast("int").alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "tie", "uid", "n")
    dealt = keys.repartitionByRange(parts, *key).groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(*key)).alias("first"), F.sum("n").alias("n"))
    out, before = [], 0
    for r in sorted(dealt.collect(), key=lambda r: tuple(r["first"])):
        out.append((tuple(r["first"]), before))
        before += r["n"]
    return out


def write(docs: DataFrame, tokenizer: bytes, end_id: int, path: str, file_ids: int | None = None) -> None:
    """Write the ids of all texts under path: files of about file_ids ids, and the ids by rank.

    Texts are encoded once, into a table.  Sorted are keys and sizes first, which tells
    where each file begins, then the coded documents, each to its file.
    """
    spark = docs.sparkSession
    table = written(tokens(docs, tokenizer, end_id).withColumn("uid", F.monotonically_increasing_id()), "tokens")
    by_rank = ranked(table)
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    total = table.agg(F.sum("n")).first()[0] or 0
    if not file_ids:
        file_ids = min(FILE_IDS[1], max(FILE_IDS[0], total // (4 * spark.sparkContext.defaultParallelism)))
    cuts = places(table, -(-total // file_ids) or 1)
    shared = spark.sparkContext.broadcast((rank_of, cuts))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, cuts = shared.value
        first = [c[0] for c in cuts]
        for b in batches:
            keys = zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)
            part = [bisect_right(first, (0, 0, t, u) if i is None else (1, i, t, u)) - 1 for i, t, u in keys]
            packed = [pack(ranks[np.frombuffer(x.as_buffer(), "<u4")]) for x in b.column(4)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(part, pa.int32()), *(pa.array([p[k] for p in packed], pa.binary()) for k in (0, 1))], ["doc_id", "tie", "uid", "n", "part", "control", "data"])

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value[1]
        part, start, held, ids = -1, 0, [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (row[2] != part or ids >= BLOCK_IDS):
                    yield _line(block(start, held))
                    start, held, ids = start + ids, [], 0
                if row[2] != part:
                    part, start = row[2], cuts[row[2]][1]
                held.append((row[0], row[1], row[3], row[4]))
                ids += row[1]
        if held:
            yield _line(block(start, held))

    blocks = table.select("doc_id", "tie", "uid", "n", "ids").mapInArrow(coded, "doc_id long, tie long, uid long, n long, part int, control binary, data binary")
    order = ["part", F.asc_nulls_first("doc_id"), "tie", "uid"]
    blocks = blocks.repartitionById(max(1, len(cuts)), "part").sortWithinPartitions(*order).select("doc_id", "n", "part", "control", "data").mapInArrow(filed, "value binary")
    _files(blocks, f"{path}/ids")
    _files(spark.createDataFrame([(by_rank.astype("<u4").tobytes(),)], "value binary"), f"{path}/ranks")
    discard(table)


def _line(content: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["value"])


def _files(lines: DataFrame, path: str) -> None:
    """Each value as it is and a line feed."""
    lines.select(F.col("value").cast("string")).write.option("lineSep", "\n").option("compression", "none").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids binary: u32 little-endian) of the files under path."""
    return _read(spark, path, "ids binary", lambda ids: pa.array([x.tobytes() for x in ids], pa.binary()))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of the files under path."""
    return _read(spark, path, "ids_crc32 long", lambda ids: pa.array([zlib.crc32(x) for x in ids], pa.int64()))


def _read(spark: SparkSession, path: str, column: str, made: Callable[[list[np.ndarray]], pa.Array]) -> DataFrame:
    stored = spark.read.format("binaryFile").load(f"{path}/ranks/part-*").where("length > 0").select("content").first()
    shared = spark.sparkContext.broadcast(np.frombuffer(bytes(stored[0])[:-1], "<u4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = shared.value
        for b in batches:
            for content in b.column(0):
                for start, ids, sizes, ranks in blocks(content.as_buffer()):
                    ends = np.cumsum(sizes, dtype=np.int64)
                    own = np.split(by_rank[ranks].astype("<u4"), ends[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start + ends - sizes), pa.array(sizes.astype(np.int64)), made(own)], ["doc_id", "start", "n_tokens", column.split()[0]])

    return spark.read.format("binaryFile").load(f"{path}/ids/part-*").select("content").mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def round_trip(docs: DataFrame, tokenizer: bytes, end_id: int) -> DataFrame:
    """Write the ids of docs to the shared folder, read them back: rows (doc_id, start, n_tokens, ids_crc32)."""
    path = temporary(docs.sparkSession, "ids")
    write(docs, tokenizer, end_id, path)
    return digests(docs.sparkSession, path)
