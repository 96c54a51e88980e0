"""Scalar expressions: text, bits, vectors, time and information measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that end a word, for the keyword tokenizer.
NOT_WORD = r"[^\p{L}0-9]+"


def tokens(c: Column) -> Column:
    """Lower-case keyword tokens; a final sigma is folded."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), "ς", "σ"), NOT_WORD), lambda x: x != "")


def counted(words: Column) -> Column:
    """array<struct<term, tf>>: each distinct word of an array and how often it stands there; sorted, so the cost doesn't grow with its square."""
    # arrays of one element name what a lambda uses often, so it is computed once
    named = lambda c, f: F.transform(F.array(c), f)[0]
    begins = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
    run = lambda s, at: F.transform(at, lambda b, k: F.struct(F.get(s, b).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - b).cast("long").alias("tf")))
    return named(F.array_sort(words), lambda s: named(begins(s), lambda at: run(s, at)))


def trimmed(c: Column) -> Column:
    """Without the space separators at both ends; tabs and line ends stay."""
    return F.regexp_replace(c, r"\A\p{Zs}+|(?<!\p{Zs})\p{Zs}+\z", "")


def shingles(c: Column, k: int = 3) -> Column:
    """Distinct k-character windows of the lower-case text; shorter texts have one."""
    s = F.lower(c)
    n = F.char_length(s)
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(k))))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(many)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def spans(words: Column, width: int, stride: int) -> Column:
    """Word windows of a width, without a forced tail."""
    last = F.size(words) - width
    return F.when(last < 0, F.array(words)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride)), lambda i: F.slice(words, i + 1, F.lit(width))))


def token_estimate(c: Column) -> Column:
    """(3 bytes + 16 words + 12) div 24; 0 without words."""
    words = F.regexp_count(c, F.lit(r"\S+"))
    return F.when(words == 0, F.lit(0)).otherwise(F.floor((3 * F.octet_length(c) + 16 * words + 12) / 24)).cast("long")


def hamming(a: list[str], b: list[str]) -> Column:
    """Bits that differ between two lists of long columns."""
    return sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b, strict=True)), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def quantised(v: Column) -> Column:
    """struct<scale, q>: 8-bit integers and their scale, the largest component over 127."""
    scale = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))) / 127
    return F.struct(scale.alias("scale"), F.transform(v, lambda x: F.when(scale == 0, 0).otherwise(F.round(x.cast("double") / scale)).cast("int")).alias("q"))


def decay(age_seconds: Column, half_life_seconds: float) -> Column:
    """Half-life weight; 1 for no age."""
    return F.when(age_seconds <= 0, 1.0).otherwise(F.exp(-age_seconds * F.lit(0.6931471805599453 / half_life_seconds)))


def wilson_lower(successes: Column, trials: Column, z: float = 1.96) -> Column:
    p, zz = successes / trials, z * z
    return (p + zz / (2 * trials) - z * F.sqrt((p * (1 - p) + zz / (4 * trials)) / trials)) / (1 + zz / trials)


def binary_entropy_term(p: Column) -> Column:
    """-p log2 p, 0 at 0."""
    return F.when(p <= 0, 0.0).otherwise(-p * F.log2(p))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.char_length(a), F.char_length(b))
    return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), n), lambda i: F.left(a, i) == F.left(b, i))), F.lit(0))


def code_distance(a: Column, b: Column) -> Column:
    lcp = common_prefix(a, b)
    longest = F.greatest(F.char_length(a), F.char_length(b), F.lit(1))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.char_length(a) - lcp + F.char_length(b) - lcp) / longest))


def hlc(physical: Column, logical: Column, node: Column) -> Column:
    """A hybrid clock value; structs compare in its total order."""
    return F.struct(physical.cast("long").alias("physical"), logical.cast("int").alias("logical"), node.cast("int").alias("node"))


def hlc_packed(physical: Column, logical: Column, node: Column) -> Column:
    """node:8, logical:16, physical:40; does not keep the order."""
    return F.shiftleft(node.cast("long").bitwiseAND(F.lit(255)), 56).bitwiseOR(F.shiftleft(logical.cast("long").bitwiseAND(F.lit(65535)), 40)).bitwiseOR(physical.cast("long").bitwiseAND(F.lit((1 << 40) - 1)))


def lag_bucket(minutes: Column) -> Column:
    """The least of 1, 2, 4 .. 128 that is not below the minutes."""
    return F.least(F.lit(128), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(minutes, F.lit(1.0))))).cast("int"))


def graph_distance(path: Column) -> Column:
    """1 - exp(-path / 3) of a path length; 1 without a path."""
    return F.coalesce(1 - F.exp(-path / 3), F.lit(1.0))


def halves(a: Column, b: Column) -> Column:
    return 0.5 * a + 0.5 * b


#: Measures of two vectors by name.
METRICS = {"cosine": cosine, "dot": dot, "l2": l2}
