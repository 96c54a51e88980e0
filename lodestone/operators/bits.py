"""256-bit fingerprints as four longs: likeness, votes, hyperplane signs, Morton order."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = ("b0", "b1", "b2", "b3")
_MASK = (1 << 64) - 1


def splitmix(seed: int, n: int) -> list[int]:
    """The first n values of the SplitMix64 stream (its constants are fixed values)."""
    out, state = [], seed & _MASK
    for _ in range(n):
        state = (state + 0x9E3779B97F4A7C15) & _MASK
        z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def planes(seed: int, n: int, words: int) -> list[list[int]]:
    """n planes of so many 64-bit words; bit set: +1, else -1."""
    stream = splitmix(seed, n * words)
    return [stream[i * words : (i + 1) * words] for i in range(n)]


def jaccard(a: Sequence[str], b: Sequence[str]) -> Column:
    """Set bits in both over set bits in either; 0 for two empty ones."""
    both = sum((F.bit_count(F.col(x).bitwiseAND(F.col(y))) for x, y in zip(a, b, strict=True)), F.lit(0))
    either = sum((F.bit_count(F.col(x).bitwiseOR(F.col(y))) for x, y in zip(a, b, strict=True)), F.lit(0))
    return F.when(either == 0, 0.0).otherwise(both / either)


def simhash(columns: Sequence[str], seed: int) -> Column:
    """A long whose bit k is the sign of plane k over the bits of the columns: +1 a set bit, -1 an unset one.

    Agreeing bits add and differing ones subtract, so the sign is a popcount of
    an exclusive or, and no bit is unpacked.
    """
    out = F.lit(0).cast("long")
    for k, plane in enumerate(planes(seed, 64, len(columns))):
        differ = sum((F.bit_count(F.col(c).cast("long").bitwiseXOR(F.lit(signed(w)))) for c, w in zip(columns, plane, strict=True)), F.lit(0))
        out = out.bitwiseOR(F.when(differ * 2 < 64 * len(columns), F.lit(signed(1 << k))).otherwise(F.lit(0).cast("long")))
    return out


def float_simhash(vector: Column, size: int, seed: int, bits: int = 64) -> Column:
    """A long whose bit k is the sign of the vector's product with plane k of +1 and -1."""
    words = -(-size // 64)
    out = F.lit(0).cast("long")
    v = F.transform(vector, lambda x: x.cast("double"))
    for k, plane in enumerate(planes(seed, bits, words)):
        signs = [1.0 if plane[i // 64] >> (i % 64) & 1 else -1.0 for i in range(size)]
        product = F.aggregate(F.zip_with(v, F.lit(signs), lambda x, s: x * s), F.lit(0.0), lambda a, x: a + x)
        out = out.bitwiseOR(F.when(product > 0, F.lit(signed(1 << k))).otherwise(F.lit(0).cast("long")))
    return out


def morton(blocks: Sequence[str] = BLOCKS) -> Column:
    """The 512-bit key as 128 hex digits: bit 2i is bit i, bit 2i + 1 is bit (97 i + 41) mod 256, high digits first."""
    bit = lambda i: F.getbit(F.col(blocks[i // 64]), F.lit(i % 64)).cast("int")
    digits = []
    for d in range(127, -1, -1):
        places = range(4 * d, 4 * d + 4)
        value = sum(((bit(p // 2) if p % 2 == 0 else bit((97 * (p // 2) + 41) & 255)) * (1 << (p - 4 * d)) for p in places), F.lit(0))
        digits.append(F.lower(F.hex(value.cast("long"))))
    return F.concat(*digits)


def votes(df: DataFrame, keys: Sequence[str], blocks: Sequence[str] = BLOCKS) -> DataFrame:
    """keys, total and the strict majority of each bit as longs: one aggregation of 64 sums a block."""
    sums = {f"{b}_{i}": F.sum(F.getbit(F.col(b), F.lit(i)).cast("long")) for b in blocks for i in range(64)}
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *(c.alias(n) for n, c in sums.items()))
    major = lambda b: sum((F.when(F.col(f"{b}_{i}") * 2 > F.col("total"), F.lit(signed(1 << i))).otherwise(F.lit(0).cast("long")) for i in range(1, 64)), F.when(F.col(f"{b}_0") * 2 > F.col("total"), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, "total", *(major(b).alias(b) for b in blocks))


def partial_match(match: Sequence[int], differ: Sequence[int], near: Sequence[str], far: Sequence[str]) -> Column:
    """(1 - distance share of the blocks that should match) times the share of those that should differ."""
    share = lambda at: sum((F.bit_count(F.col(near[i]).bitwiseXOR(F.col(far[i]))) for i in at), F.lit(0)) / F.lit(64.0 * len(at))
    return (1 - share(match) if match else F.lit(1.0)) * (share(differ) if differ else F.lit(1.0))


def set_bits(c: Column, size: int) -> Column:
    """The numbers of the set bits below size, rising."""
    return F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.call_function("shiftright", c, i).bitwiseAND(F.lit(1)) == 1)


def laplace(seed: int, n: int, scale: float) -> list[float]:
    """n draws of Laplace noise from the SplitMix64 stream, by the inverse of its distribution."""
    uniform = [(x >> 11) / (1 << 53) - 0.5 for x in splitmix(seed, n)]
    return [math.copysign(scale, -u if u else -1.0) * math.log(1.0 - 2.0 * abs(u)) if abs(u) < 0.5 else math.inf for u in uniform]


def private_or(df: DataFrame, c: str, size: int, epsilon: float, contributors: int, seed: int) -> DataFrame:
    """(bit, held) of the first size bits: whether the count of rows with the bit, with noise of scale 1 / epsilon, is at least contributors; no rows hold no bit.

    The counts are one aggregation of size sums; rows never leave it.
    """
    counts = df.agg(*(F.sum(F.getbit(c, F.lit(i))).alias(str(i)) for i in range(size)))
    noise = laplace(seed, size, 1.0 / epsilon)
    return counts.select(F.inline(F.array(*(F.struct(F.lit(i).alias("bit"), F.coalesce(F.col(f"`{i}`") + noise[i] >= contributors, F.lit(False)).alias("held")) for i in range(size)))))
