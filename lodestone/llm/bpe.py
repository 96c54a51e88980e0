"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are cut first where the split pattern must break anyway: before a
white-space character that follows a character other than white space.  No
alternative of the pattern lets a match run over such a place (only the
white-space alternatives hold white space after their first character), and
the look-ahead of ``\\s+(?!\\S)`` only concerns the run on its right, which
stays whole.  So the pieces give the ids of the whole text, and the memory of
a call stays bounded however long the text is.

Defined results: null and empty texts have no ids; equal rows give equal rows;
an empty table gives an empty table; only doc_id and text are read, so further
columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a text encoded in one call.
PIECE_CHARS = 1 << 16
_BOUNDARY = re.compile(r"(?<=\S)(?=[\t\n\v\f\r ])")
_codecs: dict[tuple[str, str], Codec] = {}


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """text in successive parts of at least size characters, cut at safe boundaries."""
    begin = 0
    while len(text) - begin > size and (m := _BOUNDARY.search(text, begin + size)):
        yield text[begin : m.start()]
        begin = m.start()
    yield text[begin:]


class Codec:
    """A tiktoken encoding made from the bytes of a rank file."""

    def __init__(self, rank_file: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.core = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.digits = [b"%d" % i for i in range(max(ranks.values()) + 1)]

    @classmethod
    def of(cls, rank_file: bytes, pattern: str) -> Codec:
        """One codec a worker process for each rank file and pattern."""
        key = (hashlib.sha256(rank_file).hexdigest(), pattern)
        if key not in _codecs:
            _codecs[key] = cls(rank_file, pattern)
        return _codecs[key]

    def encode(self, text: str | None) -> list[int]:
        text = text or ""
        if len(text) <= PIECE_CHARS:
            return self.core.encode_ordinary(text)
        return [i for piece in pieces(text) for i in self.core.encode_ordinary(piece)]

    def decode(self, ids: list[int]) -> bytes:
        """The raw bytes; cutting a character in two is no error."""
        return self.core.decode_bytes(ids)

    def ids_text(self, ids: list[int]) -> bytes:
        return b",".join(map(self.digits.__getitem__, ids))


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """Rows (doc_id, ids array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(rank_file, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([codec.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """Rows (doc_id, bytes binary) of rows (doc_id, ids); null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(rank_file, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """Encode every text, decode the ids again, and digest both in one pass:
    rows (doc_id, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(rank_file, pattern)
        for b in batches:
            n, sent, back = [], [], []
            for t in b.column(1):
                ids = codec.encode(t.as_py())
                n.append(len(ids))
                sent.append(hashlib.sha256(codec.ids_text(ids)).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sent, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
