"""Benchmark decontamination: short test items found inside long documents.

Containment of an item in a document is the share of the item's distinct word shingles
that the document has.  The search is size-partitioned: the sketch of an item is its
bottom-k MinHash, and k follows from the item's size n as ``n - ceil(t * n) + 1``.  A
document that misses a whole sketch misses more than ``n - ceil(t * n)`` shingles and
cannot reach the threshold ``t``, whatever its own length; so no window or banding is
needed and no pair is lost.  Pairs are then verified by exact containment of the shingles themselves.

DataFrame functions only.  Sketches are written first, so Spark knows their size and
sends them to the documents while they are small, or joins by hash when they are not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, id_and_text, unused
from .exact_dedup import content_hash

WORD = r"[\p{L}\p{M}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits: case, blanks and punctuation do
    not hide a passage."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def cut(text: Column, into: Callable[[Column], Column]) -> Column:
    """``into`` of the words of a text.  The words are bound to a lambda variable: a column
    in their place would be computed anew for every shingle."""
    return F.transform(F.array(words(text)), into)[0]


def _starts(w: Column, size: int | Column) -> Column:
    """1-based starts of the shingles of a word list; empty where there are too few words."""
    n = F.size(w) - size + 1
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(w: Column, size: int | Column) -> Column:
    """64-bit hashes of the runs of ``size`` words, repeats included."""
    return F.transform(_starts(w, size), lambda i: F.xxhash64(F.slice(w, i, size)))


def shingles(w: Column, size: int | Column) -> Column:
    """Distinct runs of ``size`` words."""
    return F.array_distinct(F.transform(_starts(w, size), lambda i: F.array_join(F.slice(w, i, size), " ")))


def contained_items(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8,
                    id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                    item_text: str = "text") -> DataFrame:
    """Pairs of documents and items they contain: doc_id, item_id, n_shingles (of the
    item), n_shared, containment (at least ``threshold``).

    * An item of fewer than ``size`` words has one shingle, all its words in a row.
    * Null texts and texts without a word match nothing, on either side.
    * Repeated rows of a document or item are one; rows with a null id match nothing.
    * An empty table on either side gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    named = scratch.store(items.select(F.col(item_id).cast("long").alias("item_id"), words(F.col(item_text)).alias("_w")).filter(
        "item_id IS NOT NULL AND size(_w) > 0").withColumn("_k", F.least(F.size("_w"), F.lit(size))), "items")
    known = scratch.store(named.select(
        "item_id", "_k", shingles(F.col("_w"), F.col("_k")).alias("_items"),
        F.array_distinct(shingle_hashes(F.col("_w"), F.col("_k"))).alias("_hashes")), "shingles")
    n = F.size("_hashes")
    # 1e-9 keeps ceil() from rounding up an exact product
    need = F.ceil(n * F.lit(threshold) - 1e-9).cast("int")
    sketch = scratch.store(known.select(
        F.explode(F.slice(F.array_sort("_hashes"), F.lit(1), n - need + 1)).alias("_h"), "item_id").distinct(), "sketch")
    # at most ``size`` different shingle lengths
    lengths = sorted(r[0] for r in known.select("_k").distinct().collect()) or [size]

    texts = id_and_text(docs, id_col, text_col).filter("doc_id IS NOT NULL")
    hashes = cut(F.col("text"), lambda w: F.concat(*[shingle_hashes(w, k) for k in lengths]))
    met = texts.select("doc_id", F.explode(hashes).alias("_h")).join(sketch, "_h")
    pairs = scratch.store(met.select("doc_id", "item_id").distinct(), "candidates")

    # Only documents with a candidate are cut into shingles themselves.
    wanted = texts.join(pairs, "doc_id").join(known.select("item_id", "_k", "_items"), "item_id")
    own = cut(F.col("text"), lambda w: shingles(w, F.col("_k")))
    shared = wanted.select("doc_id", "item_id", F.size("_items").alias("n_shingles"),
                           F.size(F.array_intersect("_items", own)).alias("n_shared"))
    best = shared.groupBy("doc_id", "item_id").agg(
        F.max("n_shingles").cast("long").alias("n_shingles"), F.max("n_shared").cast("long").alias("n_shared"))
    return best.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).filter(
        F.col("n_shared") >= F.ceil(F.col("n_shingles") * F.lit(threshold) - 1e-9))


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that contain an item, all columns as they are.  Rows go by a
    64-bit hash of id and text, so a clean text is not dropped for sharing an id."""
    row = F.when(F.col(id_col).isNotNull(), F.xxhash64(
        F.col(id_col).cast("long"), content_hash(F.coalesce(F.col(text_col), F.lit("")))))
    hits = contained_items(docs.select(row.alias("doc_id"), F.col(text_col).alias("text")), items, size, threshold)
    name = unused(docs, "_gone")
    gone = Scratch(docs.sparkSession, "decontaminate").store(
        hits.select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(gone, row == F.col(name), "left_anti")
