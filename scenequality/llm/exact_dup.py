"""Exact duplicates by skew-safe combining.

Every task first merges the equal texts of its own rows (the map side of the first aggregate, whose salt is constant in
a task). What is left meets in groups of digest and salt, and the winners of all salts in groups of the digest. The
text itself is a grouping key throughout, so content is compared in full at every stage and a digest only deals rows out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenequality.session import cut_lineage

SALTS = 64
HOT_SHARE = 1 / 4096  # fewer than 4096 classes can hold more than this share of all rows, so these fit a broadcast


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def classes_of(keyed: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) per different text of ``keyed`` (doc_id, digest, text).

    Different texts under one digest are different rows here.
    """
    salted = (
        keyed.withColumn("salt", F.spark_partition_id() % SALTS)
        .groupBy("digest", "salt", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return (
        salted.groupBy("digest", "text")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        .select("digest", "keep_id", "group_size")
    )


def mark_copies(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    normalise: Callable[[Column], Column] = lambda text: text,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs``.

    Texts are equal if they are after ``normalise``; a null text counts as empty. The row of the largest id stays; a
    row without an id stays only where no equal text has one. Of repeated rows (same id, same text) one stays. An
    empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(normalise(F.coalesce(F.col(text_column), F.lit(""))), F.lit(""))
    keyed = docs.select(F.col(id_column).alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", digest(F.col("text")).alias("digest")
    )
    classes = cut_lineage(classes_of(keyed))
    found = _with_class(keyed, classes)
    marked = cut_lineage(
        found.withColumn("top", F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(
            "doc_id", "keep_id", "group_size", "top", "text_sha256"
        )
    )
    return _one_of_repeated(marked).select("doc_id", "keep_id", "group_size", F.col("top").alias("kept"), "text_sha256")


def _with_class(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """``keyed`` with the class of each row and the hexadecimal digest of its text.

    Rows of the few classes above ``HOT_SHARE`` find them in a broadcast; the others meet theirs by digest, where no
    key holds more than that share. Digests of several texts, if there are any, are looked up by their texts.
    """
    twins = cut_lineage(classes.groupBy("digest").count().where("count > 1").select("digest"))
    total = classes.agg(F.sum("group_size")).first()[0] or 0
    hot = classes.where(F.col("group_size") > F.lit(total * HOT_SHARE))
    sha = F.lower(F.hex(sha256(F.col("text")))).alias("text_sha256")
    rows = cut_lineage(keyed.select("doc_id", "digest", sha))
    several = not twins.isEmpty()
    if several:  # the text decides; this path is there for digests weaker than SHA-256
        apart = keyed.join(twins, "digest", "left_semi")
        by_text = apart.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        looked_up = apart.join(by_text, ["digest", "text"]).select("doc_id", "digest", sha, "keep_id", "group_size")
        rows, hot, classes = (t.join(twins, "digest", "left_anti") for t in (rows, hot, classes))
    known = F.broadcast(hot.withColumnsRenamed({"keep_id": "hot_id", "group_size": "hot_size"}))
    rows = rows.join(known, "digest", "left")
    columns = ("doc_id", "digest", "text_sha256", "keep_id", "group_size")
    of_hot = rows.where("hot_size IS NOT NULL").withColumnsRenamed({"hot_id": "keep_id", "hot_size": "group_size"})
    of_rest = rows.where("hot_size IS NULL").drop("hot_id", "hot_size").join(classes, "digest")
    found = of_hot.select(*columns).unionByName(of_rest.select(*columns))
    return found.unionByName(looked_up.select(*columns)) if several else found


def _one_of_repeated(marked: DataFrame) -> DataFrame:
    """``marked`` with ``top`` for one row of those that are repeated in id and text.

    Their rows are numbered inside the partitions of the written table, whose least then decides.
    """
    several = cut_lineage(marked.where("top").groupBy("text_sha256").count().where("count > 1").select("text_sha256"))
    if several.isEmpty():
        return marked
    placed = cut_lineage(marked.withColumn("part", F.spark_partition_id()))
    repeated = placed.where("top").join(several, "text_sha256", "left_semi")
    lowest = repeated.groupBy("text_sha256").agg(F.min("part").alias("part"))
    inside = Window.partitionBy("text_sha256", "part").orderBy("doc_id")
    first = (
        repeated.join(lowest, ["text_sha256", "part"], "left_semi")
        .withColumn("turn", F.row_number().over(inside))
        .withColumn("top", F.col("turn") == 1)
    )
    others = repeated.join(lowest, ["text_sha256", "part"], "left_anti").withColumn("top", F.lit(False))
    single = placed.where("top").join(several, "text_sha256", "left_anti")
    parts = (placed.where("NOT top"), single, first.select(*placed.columns), others.select(*placed.columns))
    kept = parts[0]
    for part in parts[1:]:
        kept = kept.unionByName(part)
    return kept
