"""Personal data: fixed patterns, and bootstrapped contextual extraction.

All of it is DataFrame and SQL functions.  Java's matcher recurses on repeated
groups and backtracks from every place of a long run, so the patterns are
rewritten: separators inside a match are first turned into one control
character (a one-to-one change, so places stay the same), which leaves only
runs of single-character classes, and a match can only begin where its run
does or where the last match ended.  Places come from the lengths of the parts
between the matches.

The method: seed entities are the base spans and long mixed strings of letters
and digits.  Every token with a digit or an at sign is an instance; the lexical
patterns it stands in are its left context (the word before it and its own
lead, such as ``password=``) and, if it holds a letter, its form (first letters,
length and characters); of digits alone a form says too little.  Patterns and instances make a bipartite graph.  In each round a
pattern's confidence is the mean score of its distinct instances, damped by a
prior, and an instance scores as its best pattern; seeds keep score 1.
Patterns of high confidence and enough distinct seeds then mark all their
instances, seen before or not, as spans of kind ``id``.

Running sums and maxima over the matches of a text are taken in blocks
(``_running``), and texts are cut from pieces, so the work for one text grows
with its length and not with the square of its number of matches.

Defined results: a null or empty text has no spans; a null doc_id is kept and
stays null; repeated rows each get a row; an empty table gives an empty table;
only doc_id and text are read (and all columns are returned by redacted(),
which carries the row as one struct, so its columns may have any names).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import if_small, written

ROUNDS = 3
#: A pattern's least confidence, distinct seeds, and weight of the prior (score 0).
CONFIDENCE, MIN_SEEDS, PRIOR = 0.7, 8, 1.0
KINDS = ("email", "ip", "card", "phone")
#: Values of a running sum, and characters of a piece of text, handled at once.
BLOCK, PIECE = 128, 4096
_SPANS = "array<struct<start:int,end:int>>"
_MATCHES = "array<struct<start:int,end:int,match:string,before:string>>"

#: The base patterns, rewritten as said above (\u0001 stands for an inner separator).
_EMAIL_DOT, _EMAIL = r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", "(?:\\G|(?<![A-Za-z0-9._%+\u0001-]))[A-Za-z0-9._%+\u0001-]++@(?=[A-Za-z0-9-]++\u0001)[A-Za-z0-9\u0001-]++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD_GAP, _CARD = r"(?<=[0-9])[ -](?=[0-9])", "[0-9][0-9\u0001]++"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: A token with a digit or an at sign.
_INSTANCE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; a lambda would compute an outer expression again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, zero: object, kind: str, op: Callable[[Column, Column], Column]) -> Column:
    """The array op(v1), op(v1, v2), ...: in blocks of BLOCK values, then over the blocks."""
    nothing = F.array().cast(f"array<{kind}>")
    first = F.lit(zero).cast(kind)

    def scan(a: Column) -> Column:
        return F.aggregate(a, nothing, lambda out, x: F.array_append(out, op(F.coalesce(F.try_element_at(out, F.lit(-1)), first), x)))

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda i: scan(F.slice(v, i * BLOCK + 1, F.lit(BLOCK))))

    def joined(local: Column) -> Column:
        before = F.concat(F.array(first), scan(F.transform(local, lambda x: F.element_at(x, -1))))
        return F.flatten(F.zip_with(local, F.slice(before, F.lit(1), F.size(local)), lambda x, carried: F.transform(x, lambda y: op(carried, y))))

    # of few values there is one block
    return _let(values, lambda v: F.when(F.size(v) == 0, nothing).when(F.size(v) <= BLOCK, scan(v)).otherwise(_let(blocks(v), joined)))


def _places(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match, before>> of the matches, in code points; before is the part since the last match."""

    def pairs(found: Column) -> Column:
        parts = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        return F.zip_with(found, parts, lambda m, p: F.struct(m.alias("m"), p.alias("p"), F.char_length(m).alias("n"), (F.char_length(m) + F.char_length(p)).alias("both")))

    def placed(pairs: Column) -> Column:
        ends = _running(F.transform(pairs, lambda x: x["both"]), 0, "int", lambda a, b: a + b)
        return F.zip_with(pairs, ends, lambda x, end: F.struct((end - x["n"]).alias("start"), end.alias("end"), x["m"].alias("match"), x["p"].alias("before")))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(found, lambda f: F.when(F.size(f) == 0, F.array().cast(_MATCHES)).otherwise(_let(pairs(f), placed)))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check: from the right, every second digit is doubled."""
    numbers = F.reverse(F.transform(F.split(digits, ""), lambda d: d.cast("int")))
    added = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(F.filter(added, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def _ip_part(c: Column) -> Column:
    """At most 255, whatever zeros stand before."""
    short = F.regexp_replace(c, "^0+(?=[0-9])", "")
    return (F.length(short) <= 3) & (F.coalesce(F.substring(short, 1, 3).cast("int"), F.lit(999)) <= 255)


def _bare(c: Column) -> Column:
    return F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def _meets(spans: Column, tokens: Column) -> Column:
    """tokens in order, each with a flag base: whether a span overlaps it.

    Both are put in order together; a token meets a span that begins no later
    if the furthest end of those is beyond its start, and one that begins
    inside it if the next start is before its end.
    """
    empty = F.lit("")
    all_ = F.array_sort(F.concat(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(False).alias("token"), s["end"].alias("end"), empty.alias("value"), empty.alias("left"))),
        F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), F.lit(True).alias("token"), t["end"].alias("end"), t["value"].alias("value"), t["left"].alias("left"))),
    ))

    def told(every: Column) -> Column:
        furthest = _running(F.transform(every, lambda x: F.when(x["token"], F.lit(-1)).otherwise(x["end"])), -1, "int", F.greatest)
        next_ = F.reverse(_running(F.transform(F.reverse(every), lambda x: F.when(x["token"], F.lit(2**31 - 1)).otherwise(x["start"])), 2**31 - 1, "int", F.least))
        both = F.zip_with(furthest, next_, lambda end, start: F.struct(end.alias("end"), start.alias("start")))
        return F.zip_with(every, both, lambda x, y: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["left"].alias("left"), ((y["end"] > x["start"]) | (y["start"] < x["end"])).alias("base"), x["token"].alias("token")))

    kept = F.filter(_let(all_, told), lambda x: x["token"])
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["left"].alias("left"), x["base"].alias("base")))


def found(docs: DataFrame) -> DataFrame:
    """docs (row, text) as row, the base spans of each kind, and the instances with their contexts."""
    keep = ["row"]
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # only texts with a digit or an at sign can hold anything
    likely = raw.rlike("[0-9@]")
    clean = F.when(likely, F.regexp_replace(raw, "\u0001", "\u0002"))
    table = docs.select(*keep, clean.alias("_t")).withColumns(
        {
            "_e": F.when(F.contains("_t", F.lit("@")), F.regexp_replace("_t", _EMAIL_DOT, "\u0001")),
            "_c": F.when(F.col("_t").rlike("[0-9][ -]?[0-9]"), F.regexp_replace("_t", _CARD_GAP, "\u0001")),
            "_p": F.when(F.contains("_t", F.lit("+")), F.col("_t")),
            "_i": F.when(F.col("_t").rlike(r"[0-9]\.[0-9]"), F.col("_t")),
        }
    )
    none = F.array().cast(_SPANS)
    cards = F.filter(_places(F.col("_c"), _CARD), lambda x: F.length(F.regexp_replace(x["match"], "\u0001", "")).between(13, 19))
    quads = F.filter(_places(F.col("_i"), _IP), lambda x: F.forall(F.split(x["match"], r"\."), _ip_part))
    table = table.select(
        *keep,
        "_t",
        F.coalesce(_bare(_places(F.col("_e"), _EMAIL)), none).alias("email"),
        F.coalesce(_bare(quads), none).alias("ip"),
        F.coalesce(_bare(F.filter(cards, lambda x: _luhn(F.regexp_replace(x["match"], "\u0001", "")))), none).alias("card"),
        F.coalesce(_bare(F.filter(_places(F.col("_p"), _PHONE), lambda x: F.length(_digits(x["match"])).between(9, 15))), none).alias("phone"),
        F.coalesce(_places(F.col("_t"), _INSTANCE), F.array().cast(_MATCHES)).alias("_tokens"),
    )
    # the value without its lead and the punctuation around it
    lead = lambda x: F.regexp_extract(x["match"], "^(?:[^=:]*[=:])?[^A-Za-z0-9@+]*", 0)
    tail = lambda x: F.regexp_extract(x["match"], "[^A-Za-z0-9]*$", 0)
    # one word, or two if the last has at most three characters
    word = lambda x: F.regexp_extract(F.substring(x["before"], F.greatest(F.char_length(x["before"]) - 60, F.lit(1)), F.lit(61)), r"(\S{0,24})(\s+\S{0,3})?\s+$", 0)
    tokens = F.transform(
        "_tokens",
        lambda x: F.struct(
            (x["start"] + F.char_length(lead(x))).alias("start"),
            (x["end"] - F.char_length(tail(x))).alias("end"),
            F.substring(x["match"], F.char_length(lead(x)) + 1, F.greatest(F.char_length(x["match"]) - F.char_length(lead(x)) - F.char_length(tail(x)), F.lit(0))).alias("value"),
            F.lower(F.when(lead(x).rlike("[A-Za-z]"), lead(x)).otherwise(F.concat(word(x), lead(x)))).alias("left"),
        ),
    )
    table = table.select(*keep, *KINDS, F.filter(tokens, lambda x: x["end"] > x["start"]).alias("_tokens"))
    spans = F.concat(*KINDS)
    apart = F.transform("_tokens", lambda t: F.struct(t["start"], t["end"], t["value"], t["left"], F.lit(False).alias("base")))
    return table.select(*keep, *KINDS, F.when((F.size(spans) > 0) & (F.size("_tokens") > 0), _meets(spans, F.col("_tokens"))).otherwise(apart).alias("instances"))


def _mixed(value: Column) -> Column:
    """A long string of mixed letters and digits, as keys and tokens are."""
    return value.rlike("^[A-Za-z0-9_-]{16,}$") & (F.length(_digits(value)) >= 2) & (F.length(F.regexp_replace(value, "[^A-Za-z]", "")) >= 4)


def _occurrences(table: DataFrame) -> DataFrame:
    """uid, place, instance hash, seed flag and the two patterns of every instance."""
    one = table.where(F.size("instances") > 0).select("uid", F.explode("instances").alias("x")).select("uid", "x.*")
    has = lambda pattern: F.col("value").rlike(pattern).cast("string")
    form = F.concat_ws("|", F.lit("form"), F.regexp_extract("value", "^[A-Za-z]{0,4}", 0), F.least(F.length("value"), F.lit(64)), has("[a-z]"), has("[A-Z]"), has("[^A-Za-z0-9]"))
    left = F.xxhash64(F.lit("left"), "left")
    return one.select(
        "uid", "start", "end", "base", F.xxhash64("value").alias("instance"), (F.col("base") | _mixed(F.col("value"))).alias("seed"), F.length("value").alias("size"),
        F.when(F.col("value").rlike("[A-Za-z]"), F.array(left, F.xxhash64(form))).otherwise(F.array(left)).alias("patterns"),
    )


def confident(occurrences: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, min_seeds: int = MIN_SEEDS, prior: float = PRIOR) -> DataFrame:
    """Patterns (pattern, confidence) that the graph of patterns and instances bears out."""
    edges = written(
        occurrences.select(F.explode("patterns").alias("pattern"), "instance", "seed").groupBy("pattern", "instance").agg(F.max("seed").alias("seed")),
        "pattern-graph",
    )
    # patterns of few instances can never become confident: they leave the graph
    held = edges.groupBy("pattern").agg(F.sum(F.col("seed").cast("long")).alias("seeds")).where(F.col("seeds") >= min_seeds).select("pattern")
    edges = written(edges.join(if_small(held), "pattern"), "pattern-graph")
    instances = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    for _ in range(rounds):
        scored = edges.join(instances, "instance")
        patterns = written(scored.groupBy("pattern").agg((F.sum("score") / (F.count(F.lit(1)) + F.lit(prior))).alias("confidence")), "patterns")
        instances = edges.join(if_small(patterns), "pattern").groupBy("instance").agg(F.greatest(F.max(F.col("seed").cast("double")), F.max("confidence")).alias("score"))
    return patterns.where(F.col("confidence") >= confidence)


def extended(docs: DataFrame) -> DataFrame:
    """docs (row, text) as row, base spans by kind, and ``id``: the spans that confident patterns add."""
    table = written(found(docs).withColumn("uid", F.monotonically_increasing_id()), "instances")
    occurrences = _occurrences(table)
    good = confident(occurrences)
    marked = (
        occurrences.where(~F.col("base") & (F.col("size") >= 6))
        .select("uid", "start", "end", F.explode("patterns").alias("pattern"))
        .join(if_small(good.select("pattern")), "pattern")
        .select("uid", "start", "end").distinct()
        .groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("id"))
    )
    return table.drop("instances").join(marked, "uid", "left").withColumn("id", F.coalesce("id", F.array().cast(_SPANS)))


def _told(kinds: tuple[str, ...]) -> Column:
    def one(kind: str) -> Column:
        return F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))

    return F.array_join(F.concat(*map(one, kinds)), ",")


def spans(docs: DataFrame) -> DataFrame:
    """One row a document: counts of the base kinds, a digest of the base spans, and all spans."""
    read = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("row"), "text")
    return extended(read).select(
        "row.doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(_told(KINDS), 256).alias("base_sha256"), _told((*KINDS, "id")).alias("spans")
    )


def _cut(pieces: Column, low: Column, high: Column) -> Column:
    """The characters from low to high of a text that comes in pieces of PIECE characters."""
    first, last = F.floor(low / PIECE).cast("int"), F.floor(high / PIECE).cast("int")
    piece = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
    inside = F.substring(piece(first), low - first * PIECE + 1, high - low)
    across = F.concat(F.substring(piece(first), low - first * PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, last - first - 1), ""), F.substring(piece(last), F.lit(1), high - last * PIECE))
    return F.when(high <= low, F.lit("")).when(first == last, inside).otherwise(across)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of the text replaced by its kind, such as <EMAIL>, and n_chars to match."""
    columns = docs.columns
    table = extended(docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col("text")))

    def named(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(f"<{kind.upper()}>").alias("kind")))

    text = F.col("row.text")
    table = table.withColumn("_all", F.array_sort(F.concat(*map(named, (*KINDS, "id")))))
    # the furthest end before each span: one that begins before it is inside another
    table = table.withColumn("_ends", F.when(F.size("_all") > 0, _running(F.transform("_all", lambda x: x["end"]), 0, "int", F.greatest)))
    table = table.withColumn("_pieces", F.when(F.size("_all") > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))
    pieces = F.col("_pieces")
    before = F.concat(F.array(F.lit(0)), F.slice("_ends", F.lit(1), F.size("_ends") - 1))
    told = F.transform(F.filter(F.zip_with("_all", before, lambda s, at: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), at.alias("at"))), lambda x: x["start"] >= x["at"]), lambda x: F.concat(_cut(pieces, x["at"], x["start"]), x["kind"]))
    tail = F.element_at("_ends", -1)
    length = (F.size(pieces) - 1) * PIECE + F.char_length(F.element_at(pieces, -1))
    table = table.withColumn("_text", F.when(F.size("_all") > 0, F.concat(F.array_join(told, ""), _cut(pieces, tail, length))))
    cut = F.col("_text")
    row = F.col("row").withField("text", F.when(F.size("_all") > 0, cut).otherwise(text.cast("string")))
    if "n_chars" in columns:
        row = row.withField("n_chars", F.when(F.size("_all") > 0, F.when(F.col("row.n_chars").isNotNull(), F.char_length(cut).cast(docs.schema["n_chars"].dataType))).otherwise(F.col("row.n_chars")))
    return table.select(row.alias("row")).select("row.*")
