"""Generated script corpora keyed by any table.

Each key picks a category, one of its templates and one value per pool from
slices of md5 digests, so a row depends on its key and the seed only: the job is
one narrow stage, works on a stream, and never depends on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.hashing import digest, hex_number
from . import templates as T

SLOTS = ["category", "template", "pad"] + list(T.POOLS)
SLOTS_PER_DIGEST = 4
SHARE_TOTAL = sum(n for _, n in T.CATEGORY_SHARES)

CORPUS_COLUMNS = ["id", "category", "label", "label_name", "rationale", "template", "path",
                  "provenance", "script", "n_chars", "n_lines"]


def slot_position(slot: str) -> tuple[int, int]:
    """(digest number, first hex character) of a slot's eight digits."""
    i = SLOTS.index(slot)
    return i // SLOTS_PER_DIGEST, (i % SLOTS_PER_DIGEST) * 8 + 1


def template_rows() -> list[tuple]:
    """(category, position inside the category, template, label, rationale, body)."""
    rows, seen = [], {}
    for name, category, label, rationale, body in T.TEMPLATES:
        rows.append((category, seen.setdefault(category, 0), name, label, rationale, body))
        seen[category] += 1
    return rows


def template_counts() -> dict[str, int]:
    counts: dict[str, int] = {}
    for row in template_rows():
        counts[row[0]] = counts.get(row[0], 0) + 1
    return counts


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        template_rows(), "category string, position bigint, template string, label int, "
                         "rationale string, body string")


def manifest_stats(df: DataFrame, text: str = "script") -> DataFrame:
    """Add label_name (null without a label), n_chars and n_lines (number of ``\\n``)."""
    t = F.col(text)
    return df.withColumns({
        "label_name": F.when(F.col("label") == 1, "dangerous").when(F.col("label").isNotNull(), "safe"),
        "n_chars": F.length(t),
        "n_lines": F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))),
    })


def synthesize_corpus(keys: DataFrame, key: str | Column, seed: int = 1337,
                      prefix: str = "") -> DataFrame:
    """One labelled script per key row; columns as in a corpus manifest."""
    spark = keys.sparkSession
    key_col = (F.col(key) if isinstance(key, str) else key).cast("bigint")
    n_digests = max(slot_position(s)[0] for s in SLOTS) + 1
    drawn = keys.select(key_col.alias("key")).select(
        "key", *[digest(seed, F.col("key"), i).alias(f"d{i}") for i in range(n_digests)])

    def draw(slot: str) -> Column:
        d, start = slot_position(slot)
        return hex_number(F.col(f"d{d}"), start)

    point = F.pmod(draw("category"), F.lit(SHARE_TOTAL))
    category = F.lit(T.CATEGORY_SHARES[-1][0])
    upper = SHARE_TOTAL
    for name, share in reversed(T.CATEGORY_SHARES):
        category = F.when(point < upper, name).otherwise(category)
        upper -= share
    drawn = drawn.withColumn("category", category)
    size = F.lit(None).cast("bigint")
    for name, n in template_counts().items():
        size = F.when(F.col("category") == name, F.lit(n).cast("bigint")).otherwise(size)
    drawn = drawn.withColumn("position", F.pmod(draw("template"), size))
    # The template table is a fixed list of this package (under 100 rows).
    picked = drawn.join(F.broadcast(template_table(spark)), ["category", "position"])
    text = F.replace(F.col("body"), F.lit("{pad}"), F.repeat(
        F.lit(T.PAD_LINE), F.pmod(draw("pad"), F.lit(T.PAD_MAX)).cast("int")))
    for pool, values in T.POOLS.items():
        choice = F.element_at(F.array(*[F.lit(v) for v in values]),
                              (F.pmod(draw(pool), F.lit(len(values))) + 1).cast("int"))
        text = F.replace(text, F.lit("{" + pool + "}"), choice)
    text = F.replace(text, F.lit("{n}"), F.col("key").cast("string"))
    made = picked.withColumn("script", text).withColumn(
        "id", F.concat(F.lit(prefix), F.format_string("%s_%010d", F.col("category"), F.col("key"))))
    made = manifest_stats(made).withColumns({
        "path": F.concat(F.lit("scripts/"), F.col("id"), F.lit(".sh")),
        "provenance": F.lit(f"generated/seed={seed}"),
    })
    return made.select(*CORPUS_COLUMNS)
