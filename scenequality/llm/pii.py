"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Regular kinds (email, ip, card, phone) are the seeds. The words around them are lexical patterns; patterns and the
values they surround form a graph, on which confidence travels to and fro for a few rounds; patterns that end with
high confidence mark identifiers that no regular kind covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenequality.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
LEARNED = "identifier"

# Each finds what the plain pattern finds from left to right: a match can only begin at the start of its run of
# characters or right behind the match before it, and possessive quantifiers keep long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
TOKEN = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"  # a word that holds a digit
CONTEXT = 64  # characters beside a value in which its neighbouring words are looked for
ROUNDS = 3
CONFIDENT = 0.8
SUPPORT = 3  # different believed values that a pattern must surround
DOUBT = 0.5  # added to the values of a pattern, so that a few seeds alone don't make it certain
LEAST_DIGITS = 4  # of a learned identifier
_PART = 256


def _running(sizes: Column) -> Column:
    """Sum of the elements before each element."""
    start = F.struct(F.lit(0).cast("int").alias("total"), F.array().cast("array<int>").alias("out"))
    step = F.aggregate(sizes, start, lambda a, x: F.struct(
        (a["total"] + x).cast("int").alias("total"), F.concat(a["out"], F.array(a["total"])).alias("out")))
    return step["out"]


def _before(sizes: Column) -> Column:
    """_running in parts of fixed size, so that an array of any length takes little more than linear time."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1)), F.lit(_PART))
    totals = F.transform(starts, lambda s: F.aggregate(
        F.slice(sizes, s, F.lit(_PART)), F.lit(0).cast("int"), lambda a, x: (a + x).cast("int")))
    both = F.arrays_zip(starts.alias("s"), _running(totals).alias("before"))
    return F.flatten(F.transform(both, lambda z: F.transform(
        _running(F.slice(sizes, z["s"], F.lit(_PART))), lambda v: (v + z["before"]).cast("int"))))


def _sizes(texts: Column) -> Column:
    return F.transform(texts, lambda t: F.char_length(t).cast("int"))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of struct(start, end, value, left, right); offsets in code points.

    Splitting by the pattern gives the texts between the matches; left and right are the ends of those beside one.
    """
    regex = F.lit(pattern)
    values, between = F.regexp_extract_all(text, regex, F.lit(0)), F.split(text, pattern, -1)
    n = F.size(values)
    gaps = F.slice(between, F.lit(1), n)
    starts = F.zip_with(_before(_sizes(values)), F.zip_with(_before(_sizes(gaps)), _sizes(gaps), lambda a, b: a + b),
                        lambda a, b: a + b)
    zipped = F.arrays_zip(
        starts.alias("start"), values.alias("value"), gaps.alias("left"), F.slice(between, F.lit(2), n).alias("right")
    )
    return F.transform(zipped, lambda z: F.struct(
        z["start"].alias("start"), (z["start"] + F.char_length(z["value"])).cast("int").alias("end"),
        z["value"].alias("value"), F.right(z["left"], F.lit(CONTEXT)).alias("left"),
        F.left(z["right"], F.lit(CONTEXT)).alias("right"),
    ))


_MATCH = "array<struct<start:int,end:int,value:string,left:string,right:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits' checksum, every second one doubled from the right, is a multiple of ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(
        i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return (n >= 16) & (n <= 19) & luhn(_digits(value))
    return (n >= 8) & (n <= 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Matches of one regular kind that pass its check; cheap tests keep the pattern from most texts."""
    hint = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][ -]?[0-9]"),
            "phone": text.contains("+")}[kind]
    found = F.filter(matches(text, PATTERNS[kind]), lambda m: _holds(kind, m["value"]))
    return F.coalesce(F.when(hint, found), F.array().cast(_MATCH))


_KEY = ["doc_id", "text_hash"]


def _word(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(F.lower(text), pattern, 1), F.lit(""))


def _of_kind(kind: str | None, found: Column) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(kind).cast("string").alias("kind"), m.alias("m")))


def occurrences(docs: DataFrame) -> DataFrame:
    """Values that may be identifiers, with their kind (null unless regular) and the words beside them: every base
    span, and every word holding a digit that no base span touches. One row per document, span and kind.

    Overlaps are found along each document by the furthest base end before a word and the nearest base start
    behind it, never by comparing all words with all spans.
    """
    token = F.coalesce(F.when(F.col("text").rlike("[0-9]"), matches(F.col("text"), TOKEN)), F.array().cast(_MATCH))
    every = F.concat(*[_of_kind(k, F.col(k)) for k in KINDS], _of_kind(None, token))
    rows = docs.select(*_KEY, F.explode(every).alias("e")).select(*_KEY, "e.kind", "e.m.*")
    regular = F.col("kind").isNotNull()
    forth = Window.partitionBy(*_KEY).orderBy(F.col("start"), F.col("end"), ~regular)
    back = Window.partitionBy(*_KEY).orderBy(F.desc("start"), F.desc("end"), ~regular)
    up_to = (Window.unboundedPreceding, 0)
    rows = rows.withColumn("reach", F.max(F.when(regular, F.col("end"))).over(forth.rowsBetween(*up_to)))
    rows = rows.withColumn("next", F.min(F.when(regular, F.col("start"))).over(back.rowsBetween(*up_to)))
    touched = (F.coalesce("reach", F.lit(0)) > F.col("start")) | (F.coalesce("next", F.col("end")) < F.col("end"))
    rows = rows.where(regular | ~touched)
    return rows.select(
        *_KEY, "kind", "start", "end", "value",
        _word(F.col("left"), r"(\p{L}+)[^\p{L}]{0,3}$").alias("before"),
        _word(F.col("right"), r"^[^\p{L}]{0,3}(\p{L}+)").alias("after"),
    )


def _patterns(rows: DataFrame) -> DataFrame:
    """Rows once per lexical pattern: the word before, the word after, and both."""
    pattern = F.array_compact(F.array(
        F.concat(F.lit("L:"), "before"), F.concat(F.lit("R:"), "after"), F.concat(F.lit("B:"), "before", F.lit("|"), "after"),
    ))
    return rows.withColumn("pattern", F.explode(pattern))


def bootstrap(rows: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """(pattern, confidence) of the patterns that end with at least ``confident``.

    ``rows`` are occurrences. Values that are regular count 1 throughout; each round a pattern's confidence is
    the mean belief in its different values, and a value's belief is the chance that one of its confident
    patterns is right. Edges are distinct, so copies of a document add nothing.
    """
    edges = cut_lineage(_patterns(rows).groupBy("pattern", "value").agg(
        F.max(F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0)).alias("seed")))
    belief = edges.select("pattern", "value", "seed", F.col("seed").alias("belief"))
    for turn in range(rounds):
        scored = belief.groupBy("pattern").agg(
            (F.sum("belief") / (F.count("*") + DOUBT)).alias("confidence"),
            F.sum((F.col("belief") >= 0.5).cast("int")).alias("believed"),
        )
        good = cut_lineage(scored.where((F.col("confidence") >= confident) & (F.col("believed") >= support)).drop("believed"))
        if turn + 1 < rounds:
            chance = 1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))
            values = edges.join(good, "pattern").groupBy("value").agg(chance.alias("chance"))
            belief = cut_lineage(edges.join(values, "value", "left").select(
                "pattern", "value", "seed",
                F.greatest("seed", F.coalesce("chance", F.lit(0.0))).alias("belief"),
            ))
    return good


SPAN = "array<struct<kind:string,start:int,end:int>>"


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, any more) with base and spans, arrays of struct(kind, start, end).

    ``base`` holds the regular kinds in the order of KINDS, by start; ``spans`` also holds learned identifiers of
    kind ``identifier``, behind them. Null texts count as empty and have none. Offsets are in code points. Columns
    named base, spans or text_hash are replaced; all others pass through. Rows with equal doc_id and text get equal
    spans, null ids included. An empty table gives none.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.drop("base", "spans", "text_hash").withColumn("text_hash", F.xxhash64(text))
    found = docs.select(*_KEY, text.alias("text")).select("*", *[base_spans(F.col("text"), k).alias(k) for k in KINDS])
    rows = cut_lineage(occurrences(found))
    good = bootstrap(rows)
    long_enough = F.length(_digits(F.col("value"))) >= LEAST_DIGITS
    learned = _patterns(rows.where(F.col("kind").isNull() & long_enough)).join(good, "pattern").select(
        *_KEY, "start", "end").distinct()
    regular = rows.where("kind IS NOT NULL").select(*_KEY, "kind", "start", "end")
    every = regular.unionByName(learned.withColumn("kind", F.lit(LEARNED)))
    order = F.array_position(F.lit([*KINDS, LEARNED]), F.col("kind"))
    spans = every.groupBy(*_KEY).agg(F.sort_array(F.collect_set(F.struct(order.alias("o"), "start", "end", "kind"))).alias("_s"))
    spans = spans.select(
        *[F.col(c).alias(f"_{c}") for c in _KEY],
        F.transform("_s", lambda s: F.struct(s["kind"], s["start"], s["end"])).cast(SPAN).alias("spans"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash"))
    joined = docs.join(spans, same, "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))
    return joined.withColumn("base", F.filter("spans", lambda s: s["kind"] != LEARNED)).drop("text_hash", "_doc_id", "_text_hash")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; overlapping spans are replaced together, under the
    kind of the first."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    start = F.struct(F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("out"), F.lit(0).cast("int").alias("reach"))

    def step(a: Column, s: Column) -> Column:
        end = (-s["back"]).cast("int")
        apart = F.concat(a["out"], F.array(F.struct(s["start"].alias("start"), end.alias("end"), s["kind"].alias("kind"))))
        last = F.element_at(a["out"], -1)
        wider = F.concat(
            F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end"), last["kind"].alias("kind"))),
        )
        return F.struct(
            F.when((F.size(a["out"]) == 0) | (s["start"] >= a["reach"]), apart).otherwise(wider).alias("out"),
            F.greatest(a["reach"], end).alias("reach"),
        )

    merged = F.aggregate(ordered, start, step)["out"]
    ends = F.concat(F.array(F.lit(0)), F.transform(merged, lambda m: m["end"]))
    pieces = F.transform(merged, lambda m, i: F.concat(
        F.substr(text, F.get(ends, i) + 1, m["start"] - F.get(ends, i)), F.lit("["), F.upper(m["kind"]), F.lit("]")))
    tail = F.substr(text, F.element_at(ends, -1) + 1)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), tail))
