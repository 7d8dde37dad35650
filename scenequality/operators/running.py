"""Running totals, positions and top-n that survive a group holding most of the rows.

A plain window puts a whole group into one task. A partial count first asks whether any group has
more than ``CROWDED`` rows. If none has, a plain window is planned. Otherwise the rows are dealt out by
ranges of (group, full order), whatever the values look like: one window runs inside (group, range), a
second one over the few range totals, and a left join adds the two. Results equal the plain window. Give
these helpers a materialised input (``cut_lineage``) when it is expensive: they read it more than once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scenequality.session import cut_lineage

CROWDED = 50_000
GROUP_LIMIT = 1000  # ranks up to which Spark limits each group before it shuffles


def _join_keys(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe join on ``keys`` (grouping sets leave null keys); without keys ``other`` is one row."""
    if not keys:
        return df.withColumn("_one", F.lit(1)).join(other.withColumn("_one", F.lit(1)), "_one", how).drop("_one")
    renamed = other.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(c for c in other.columns if c not in keys))
    match = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        match = same if match is None else match & same
    return df.join(renamed, match, how).drop(*(f"_k_{k}" for k in keys))


def _cut(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Add ``_bucket``: the number of the range of (keys, order) that a row falls into.

    Ranges are as even as their sampled bounds, for constant, tied or outlying values too as long as ``order``
    tells rows apart. They are written once, because both readers must see the same numbers.
    """
    ranged = df.repartitionByRange(*keys, *order)
    return cut_lineage(ranged.withColumn("_bucket", F.spark_partition_id()))


def _with_offsets(local: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """Add ``_offset``: the weight in earlier ranges of the same group."""
    totals = local.groupBy(*keys, "_bucket").agg(F.sum(weight).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket", F.sum("_total").over(earlier).alias("_offset"))
    return _join_keys(local, offsets, [*keys, "_bucket"], "left")


def has_crowded(df: DataFrame, keys: list[str], crowded: int = CROWDED) -> bool:
    """Whether some group is larger than one window should hold (one partial count)."""
    return not df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > crowded).isEmpty()


def running_before(df: DataFrame, keys: list[str], value: str, weight: str, out: str,
                   crowded: int | None = CROWDED) -> DataFrame:
    """Add ``out``: the total ``weight`` of the group's rows whose ``value`` is smaller.

    ``value`` must be distinct inside a group (aggregate to cells first). ``crowded=None`` says the
    caller knows that no group can be crowded.
    """
    if crowded is None or not has_crowded(df, keys, crowded):
        plain = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(weight).over(plain), F.lit(0)))
    cut = _cut(df, keys, [value])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("_local", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    joined = _with_offsets(local, keys, F.col(weight))
    return joined.withColumn(out, F.col("_local") + F.coalesce("_offset", F.lit(0))).drop("_bucket", "_local", "_offset")


def positions(df: DataFrame, keys: list[str], order: list, out: str = "position", crowded: int = CROWDED) -> DataFrame:
    """Add ``out``: 0-based position inside the group by ``order``."""
    if not has_crowded(df, keys, crowded):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
        return df.withColumn(out, place.cast("bigint"))
    cut = _cut(df, keys, order)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = cut.withColumn("_local", F.row_number().over(inside) - 1)
    joined = _with_offsets(local, keys, F.lit(1))
    return joined.withColumn(out, (F.col("_local") + F.coalesce("_offset", F.lit(0))).cast("bigint")).drop(
        "_bucket", "_local", "_offset")


def top_n(df: DataFrame, keys: list[str], order: list, n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows of each group. For small ``n`` Spark keeps that many per group and task before it shuffles;
    larger ones are ranked by ranges."""
    if n > GROUP_LIMIT:
        placed = positions(df, keys, order, out)
        return placed.withColumn(out, (F.col(out) + 1).cast("int")).filter(F.col(out) <= n)
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= n)


PRIME = 2147483647  # largest 31-bit prime: products of two states fit a BIGINT


def mix(*parts: Column, seed: int = 0) -> Column:
    """A repeatable pseudo-random BIGINT in [0, PRIME) from non-negative integer columns.

    Squaring steps modulo a prime: plain integer arithmetic inside codegen, so the same draw can
    be repeated in any SQL engine and after any executor loss.
    """
    prime = F.lit(PRIME).cast("bigint")
    state = F.lit(seed % PRIME).cast("bigint")
    for part in parts:
        state = (state * 48271 + part.cast("bigint") % prime + 12345) % prime
        state = (state * state + 104729) % prime
        state = (state * 69621 + 7919) % prime
        state = (state * state + 104729) % prime
    return state


def with_mix(df: DataFrame, seeds: dict[str, int], *parts: str) -> DataFrame:
    """Add one mixed column per entry of ``seeds`` from the numeric columns ``parts``.

    Same numbers as ``mix``. Each squared state gets its own projection, which keeps the generated
    code short where the draw runs per replicate.
    """
    prime = F.lit(PRIME).cast("bigint")
    keep = df.columns
    state = {out: F.lit(seed % PRIME).cast("bigint") for out, seed in seeds.items()}
    for i, part in enumerate(parts):
        piece = F.col(part).cast("bigint") % prime
        df = df.withColumns({f"_{out}_{i}a": (s * 48271 + piece + 12345) % prime for out, s in state.items()})
        square = lambda c: (F.col(c) * F.col(c) + 104729) % prime
        df = df.withColumns({f"_{out}_{i}b": (square(f"_{out}_{i}a") * 69621 + 7919) % prime for out in state})
        state = {out: square(f"_{out}_{i}b") for out in state}
    return df.select(*keep, *(s.alias(out) for out, s in state.items()))
