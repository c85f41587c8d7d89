"""Exact dedup: rows of one text form a group, one row of each group stays.

Grouping is by a 128-bit content hash and the text itself, so a hash collision only
puts two texts into one bucket of the hash table; bytes decide.  DataFrame functions
only.  Copies collapse before the shuffle (partial aggregation): a text that a third
of all rows hold moves once per map task.  Rows then learn their group over digests,
no second time over texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, id_and_text


def never_null(digest: Column) -> Column:
    """Keeps joins from testing a key for null, which would compute the digest once more."""
    return F.coalesce(digest, F.lit(b""))


def sha256(text: Column) -> Column:
    return never_null(F.unhex(F.sha2(text.cast("binary"), 256)))


def content_hash(text: Column) -> Column:
    return never_null(F.unhex(F.md5(text.cast("binary"))))


def same(text: Column) -> Column:
    return text


def text_groups(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text",
                normalise: Callable[[Column], Column] = same,
                digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    * ``keep``: "min" keeps the smallest id of a group, "max" the largest.
    * A null text counts as empty, so null and empty texts are one group.
    * A null id never wins against another id; a group of null ids only keeps null.
    * A repeated row (same id, same text) is the same document: both get one result.
    * An empty table gives no rows; other columns are not read.
    """
    base = id_and_text(docs, id_col, text_col).withColumn("_t", normalise(F.col("text"))).select(
        "doc_id", "_t", digest(F.col("_t")).alias("_h"))
    best = (F.max if keep == "max" else F.min)("doc_id")
    # Equal bytes meet here: the text is part of the key.
    texts = base.groupBy("_h", "_t").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # From here on a text goes by content hash and SHA-256.  Two texts that share both
    # would be told apart above and be counted here.
    named = texts.select("_h", sha256(F.col("_t")).alias("_s"), "keep_id", "group_size")
    groups = named.groupBy("_h", "_s").agg(
        F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"),
        F.count(F.lit(1)).alias("_texts")).select(
        "_h", "_s", "keep_id",
        F.when(F.col("_texts") == 1, F.col("group_size")).otherwise(
            F.raise_error(F.lit("two texts share both digests"))).alias("group_size"))
    # Written, so that the join below has nothing but two exchanges under it and a hot
    # group can be split.
    groups = Scratch(docs.sparkSession, "exact").store(groups, "groups")
    rows = base.select("doc_id", "_h", sha256(F.col("_t")).alias("_s"))
    return rows.join(groups, ["_h", "_s"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_s")).alias("text_sha256"))


def drop_copies(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they are.

    Rows go by id and text: of several rows of the kept id and text any one stays, and
    another text under a dropped id is not touched.  Rows with a null id stay (they
    cannot be told apart by id).  A text moves once, with the row that holds it, and copies
    collapse before they move."""
    id_, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    rest = F.struct(*[F.col(c) for c in docs.columns if c != text_col], F.col(text_col).isNull().alias("_null"))
    best = F.max_by if keep == "max" else F.min_by
    # equal bytes meet here: the text is part of the key
    first = docs.filter(id_.isNotNull()).select(
        text.alias("_t"), content_hash(text).alias("_h"), id_.alias("_i"), rest.alias("_r")).groupBy("_h", "_t").agg(
        best("_r", "_i").alias("_r"))
    whole = [F.when(~F.col("_r._null"), F.col("_t")).alias(c) if c == text_col else F.col("_r").getField(c).alias(c)
             for c in docs.columns]
    return first.select(*whole).unionByName(docs.filter(id_.isNull()))
