"""Rules on texts: names, codes, question words, spans, chunks, canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import NOT_WORD


def words(c: Column) -> Column:
    return F.filter(F.split(c, NOT_WORD), lambda x: x != "")


def name(c: Column) -> Column:
    """Trimmed, spaces collapsed, lower case."""
    return F.trim(F.regexp_replace(F.lower(c), r"[ \t\n\r]+", " "))


def well_formed_code(c: Column) -> Column:
    """Three digits, and after a point one to eight more."""
    return c.rlike(r"^[0-9]{3}(\.[0-9]{1,8})?$")


def distinctive(c: Column) -> Column:
    """Whether a word has a digit or begins with a capital and goes on in small letters."""
    return c.rlike(r"(^|[^\p{L}0-9])([0-9]|\p{L}*[0-9]|\p{Lu}\p{Ll}+)")


def query_precision(question: Column, special: Column, words_: Column, bonus: float = 0.25) -> Column:
    """Share of the question's words that a candidate holds, plus the bonus times that of its distinctive ones; 1 at most, 0 for an empty side."""
    share = lambda q: F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, words_)) / F.size(q))
    return F.when((F.size(question) == 0) | (F.size(words_) == 0), 0.0).otherwise(F.least(F.lit(1.0), share(question) + bonus * share(special)))


def span_starts(n: Column, width: int, overlap: int, most: int) -> Column:
    """First words of windows of a width, a stride of width / overlap apart, without a forced tail; where that gives
    more than most, the stride is widened and the last window ends with the text."""
    stride = max(1, width // overlap)
    count = F.floor((n - width) / stride).cast("int") + 1
    plain = F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)), F.lit(stride))
    wide = F.ceil((n - width) / (most - 1)).cast("int")
    pinned = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.when(i == most - 1, n - width).otherwise(F.least(i * wide, n - width)))
    return F.when(n <= width, F.array(F.lit(0))).when(count <= most, plain).otherwise(pinned)


def chunked(docs: DataFrame, target: int, overlap: int) -> DataFrame:
    """doc_id, chunk, text: sentences gathered until they have target characters; the next chunk begins with the last
    overlap characters of the one before.  A fold over the sentences of each text; texts never leave their row."""
    sentences = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^.!?\n]+[.!?\n]*"), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(a: Column, s: Column) -> Column:
        joined = F.concat(a["now"], s)
        full = F.char_length(joined) >= target
        return F.struct(F.when(full, F.array_append(a["done"], joined)).otherwise(a["done"]).alias("done"), F.when(full, F.right(joined, F.lit(overlap))).otherwise(joined).alias("now"))

    finish = lambda a: F.when((F.char_length(a["now"]) > overlap) | (F.size(a["done"]) == 0), F.array_append(a["done"], a["now"])).otherwise(a["done"])
    folded = docs.select("doc_id", F.aggregate(sentences, start, step, finish).alias("chunks"))
    return folded.select("doc_id", F.posexplode("chunks").alias("chunk", "text")).where("text <> ''")


def valid_json(c: Column) -> Column:
    """Whether a text is one JSON value and nothing after it; null for null.

    The parser stops at the end of the first value.  What may follow a value in
    an array and in an object differs, so only a lone value passes as both.
    """
    alone = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"a":'), c, F.lit("}"))).isNotNull()
    return F.when(c.isNotNull(), alone)


def canonical_json(fields: dict[str, Column]) -> Column:
    """An object with its keys in order and no spaces."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


#: Words that hint at a changed or mistaken fact.
_CUES = "no longer|not anymore|instead of|used to|actually|changed|correction|wrong"


def conflict_cue(c: Column) -> Column:
    return F.lower(c).rlike(f"(^|[^a-z])({_CUES})([^a-z]|$)")


#: The form of a text's trailer; groups: what stands before it, and the trailer.
TRAILER = r"(?s)\A(.*?)([ \t\n\x0B\f\r]+\(\*\[[ \t\n\x0B\f\r].*?[ \t\n\x0B\f\r]\]\*\))[ \t\n\x0B\f\r]*\z"


def split_trailer(c: Column) -> tuple[Column, Column]:
    """A text without its trailer and white space at its end, and the trailer, empty if there is none."""
    has = c.rlike(TRAILER)
    body = F.when(has, F.regexp_extract(c, TRAILER, 1)).otherwise(c)
    return F.regexp_replace(body, r"[ \t\n\x0B\f\r]+\z", ""), F.when(has, F.regexp_replace(F.regexp_extract(c, TRAILER, 2), r"\A[ \t\n\x0B\f\r]+", "")).otherwise("")
