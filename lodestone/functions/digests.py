"""Hashes, keyed digests and canonical forms as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.scalars import trimmed

_LOW = (1 << 32) - 1


def fnv1a_64(c: Column) -> Column:
    """The unsigned decimal of the 64-bit hash of the UTF-8 bytes.

    The state is two 32-bit limbs, so no step overflows a long: the prime is
    2**40 + 435, hence the high limb takes 435 high + carry + 256 low.
    """
    code = F.hex(c.cast("binary"))
    at = F.when(F.octet_length(c) > 0, F.sequence(F.lit(0), F.octet_length(c) - 1)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("high"), F.lit(0x84222325).cast("long").alias("low"))

    def step(h: Column, i: Column) -> Column:
        low = h["low"].bitwiseXOR(F.conv(F.substring(code, 2 * i + 1, F.lit(2)), 16, 10).cast("long"))
        high = h["high"] * 435 + F.shiftright(low * 435, 32) + low * 256
        return F.struct(high.bitwiseAND(F.lit(_LOW)).alias("high"), (low * 435).bitwiseAND(F.lit(_LOW)).alias("low"))

    return F.aggregate(at, start, step, lambda h: F.conv(F.concat(F.lpad(F.hex(h["high"]), 8, "0"), F.lpad(F.hex(h["low"]), 8, "0")), 16, 10))


def hmac_sha256(key: bytes, c: Column) -> Column:
    """Lower-case hex of the keyed digest; key of 64 bytes at most."""
    padded = key.ljust(64, b"\0")
    inner, outer = (bytes(x ^ y for x in padded) for y in (0x36, 0x5C))
    first = F.sha2(F.concat(F.lit(bytearray(inner)), c.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256)


def row_key(c: Column) -> Column:
    """A UUID-shaped key from the first 16 bytes of the SHA-256."""
    return F.regexp_replace(F.left(F.sha2(c, 256), F.lit(32)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def subject_line(c: Column) -> Column:
    """Whether the text may be a subject: one line of 1 to 120 characters."""
    return F.char_length(F.trim(c)).between(1, 120) & ~F.contains(c, F.lit("\n"))


def sentences(c: Column) -> Column:
    """Non-blank runs that end with their closing marks."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit("[^.!?]+[.!?]*"), F.lit(0)), lambda x: trimmed(x)), lambda x: x != "")


def _times(high: Column, low: Column, factor: int) -> tuple[Column, Column]:
    """The limbs of a 64-bit product that wraps; factors are cut in 16 bits, so no step overflows a long."""
    ch, cl = factor >> 32, factor & _LOW
    cut = lambda x: x.bitwiseAND(F.lit(0xFFFF))
    short = lambda x, c: (cut(x) * c + F.shiftleft(cut(F.shiftright(x, 16) * c), 16)).bitwiseAND(F.lit(_LOW))  # noqa: E731  x c mod 2**32
    upper = F.shiftright(low, 16) * cl
    lower = cut(low) * cl + F.shiftleft(cut(upper), 16)
    top = F.shiftright(upper, 16) + F.shiftright(lower, 32) + short(high, cl) + short(low, ch)
    return top.bitwiseAND(F.lit(_LOW)), lower.bitwiseAND(F.lit(_LOW))


def split_mix(seed: Column, index: Column) -> Column:
    """The unsigned decimal of the index-th output (from 0) of a 64-bit counter generator; seed and index below 2**31.

    A counter makes each output an expression of its own, so streams need no order.
    """
    # fixed values: the step and the multipliers of the generator
    step, first, second = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
    zero = F.lit(0).cast("long")
    high, low = _times(zero, (index + 1).cast("long"), step)
    low = low + seed.cast("long")
    names = F.struct(((high + F.shiftright(low, 32)).bitwiseAND(F.lit(_LOW))).alias("h"), low.bitwiseAND(F.lit(_LOW)).alias("l"))

    def mixed(z: Column, by: int, factor: int | None) -> Column:
        h = z["h"].bitwiseXOR(F.shiftright(z["h"], by))
        l = z["l"].bitwiseXOR(F.shiftright(z["l"], by)).bitwiseXOR(F.shiftleft(z["h"], 32 - by).bitwiseAND(F.lit(_LOW)))
        if factor:
            h, l = _times(h, l, factor)
        return F.struct(h.alias("h"), l.alias("l"))

    # each stage is bound once by a fold over one element, else the expression would double with each use
    def bind(z: Column, by: int, factor: int | None) -> Column:
        return F.aggregate(F.array(F.lit(0)), z, lambda s, _: mixed(s, by, factor))

    z = bind(bind(bind(names, 30, first), 27, second), 31, None)
    return F.aggregate(F.array(F.lit(0)), z, lambda s, _: s, lambda s: F.conv(F.concat(F.lpad(F.hex(s["h"]), 8, "0"), F.lpad(F.hex(s["l"]), 8, "0")), 16, 10))
