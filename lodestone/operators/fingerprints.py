"""Content fingerprints of 256 bits by votes of character shingles, and their exact Hamming join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.storage import if_small

# fixed values: the width of a shingle, the salts of the four blocks, start and prime of the hash
WIDTH = 3
SALTS = ("c0:", "c1:", "c2:", "c3:")
START, PRIME = 0xCBF29CE484222325, 0x100000001B3

BLOCKS = ("b0", "b1", "b2", "b3")
#: Shingles whose bits are unpacked at once: 4 MB a block.
_AT_ONCE = 65_536


def _starts() -> np.ndarray:
    """The state of the hash after each salt, which all shingles share."""
    out = []
    for salt in SALTS:
        h = START
        for byte in salt.encode():
            h = (h ^ byte) * PRIME % (1 << 64)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def blocks_of(text: str | None) -> list[int]:
    """The four blocks, as signed 64-bit numbers, of one text; all 0 for an empty text or null.

    A bit is set where more of the distinct lower-case shingles have it set in
    their hash than not.  A text shorter than a shingle is one itself.
    """
    low = (text or "").lower()
    found = list({low[i : i + WIDTH] for i in range(max(len(low) - WIDTH + 1, 1))} - {""})
    if not found:
        return [0] * 4
    votes = np.zeros((4, 64), dtype=np.int64)
    for at in range(0, len(found), _AT_ONCE):
        some = [s.encode("utf-8", "surrogatepass") for s in found[at : at + _AT_ONCE]]
        lengths = np.array([len(s) for s in some])
        width = int(lengths.max())
        table = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in some), dtype=np.uint8).reshape(-1, width).astype(np.uint64)
        for block, start in enumerate(_starts()):
            h = np.full(len(some), start, dtype=np.uint64)
            for j in range(width):
                h = np.where(j < lengths, (h ^ table[:, j]) * np.uint64(PRIME), h)  # wraps at 2**64
            bits = np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
            votes[block] += 2 * bits.sum(axis=0, dtype=np.int64) - len(some)
    return [int(x) for x in np.packbits(votes > 0, axis=1, bitorder="little").view("<i8").ravel()]


def content_fingerprints(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, b0..b3): the fingerprint of every whole text, a row in and a row out, in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [blocks_of(x) for x in frame["text"]]
            yield pd.concat([frame[["id"]].reset_index(drop=True), pd.DataFrame(rows, columns=list(BLOCKS), dtype="int64")], axis=1)

    kind = docs.schema[id_column].dataType.simpleString()
    given = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return given.mapInPandas(run, f"id {kind}, " + ", ".join(f"{b} long" for b in BLOCKS)).withColumnRenamed("id", id_column)


def near(prints: DataFrame, probes: DataFrame, id_column: str, most: int = 31) -> DataFrame:
    """(probe, id, distance) of fingerprints that differ in at most `most` (0 to 31) of 256 bits from a probe's; probes are (probe, b0..b3).

    Exact: every row meets every probe, and only near pairs leave the join.
    Nothing is shuffled, so the disk holds no more than the fingerprints.
    Meeting at equal parts of the bits saves nothing here: the votes of prose
    in one language lean one way, so that parts are shared by most texts.
    Probes are broadcast up to BROADCAST_ROWS, beyond it the sides meet
    partition by partition.  The all-zero fingerprint (no shingle) takes no part.
    """
    if not 0 <= most <= 31:
        raise ValueError("at most 31 bits of 256 count as near")
    some = " OR ".join(f"{b} <> 0" for b in BLOCKS)
    asked = if_small(probes.where(some).select("probe", *(F.col(b).alias(f"p{b[1]}") for b in BLOCKS)))
    apart = sum((F.bit_count(F.col(f"b{i}").bitwiseXOR(F.col(f"p{i}"))) for i in range(1, 4)), F.bit_count(F.col("b0").bitwiseXOR(F.col("p0"))))
    return prints.where(some).select(id_column, *BLOCKS).join(asked, apart <= most).select("probe", id_column, apart.alias("distance"))
