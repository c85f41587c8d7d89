"""Corpus hygiene: exact copies, overlap, near copies, open annotation work."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.lexical import _all
from ..session import stored
from . import gramtotals as G


def dedup_exact(df: DataFrame, text: str = "script", order: str = "id") -> DataFrame:
    """Keep the first row (by ``order``) of byte-identical texts.

    A grouped minimum instead of a window: copies collapse before the shuffle, so
    a text that makes up a third of the corpus is no hot group.
    """
    rest = [c for c in df.columns if c != order]
    first = df.withColumn("_h", F.sha2(F.col(text), 256)).groupBy("_h").agg(
        F.min_by(F.struct(*rest), F.col(order)).alias("_row"), F.min(order).alias(order))
    return first.select(order, "_row.*").select(*df.columns)


def exact_overlap(a: DataFrame, b: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``a`` whose text also occurs in ``b``.  Only distinct hashes of
    ``b`` travel; adaptive execution splits a hot hash on the ``a`` side."""
    known = b.select(F.sha2(F.col(text), 256).alias("_h")).distinct()
    return a.withColumn("_h", F.sha2(F.col(text), 256)).join(known, "_h", "left_semi").drop("_h")


def pending_annotation(corpus: DataFrame, done: DataFrame, max_chars: int = 4000,
                       text: str = "script") -> DataFrame:
    """Rows not labelled yet: shown text and how many characters it leaves out."""
    body = F.col(text)
    return corpus.join(done.select("id").distinct(), "id", "left_anti").withColumns({
        "shown": F.substring(body, 1, max_chars),
        "remaining_chars": F.greatest(F.length(body) - max_chars, F.lit(0)),
    })


def shingles(words: Column, size: int = 3) -> Column:
    """Distinct runs of ``size`` words (all words together when there are fewer)."""
    n = F.size(words)
    # Shifted copies of the word list, zipped: each is built once per text.
    room = F.greatest(n - size + 1, F.lit(0))
    runs = F.slice(words, F.lit(1), room)
    for i in range(1, size):
        runs = F.zip_with(runs, F.slice(words, F.lit(i + 1), room), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n >= size, runs).otherwise(F.array(F.array_join(words, " ")))


# A shingle of more sets than this is hot: it never forms pairs on its own.
HOT_SETS = 1000
# Shingles that workers hold to put them last: the most frequent, of at least LATE_DF sets.
LATE_ROWS = 1 << 20
LATE_DF = 4


# ``_set_rows`` and ``_ordered_sets`` order whole sets by one table of counts; ``near_duplicates``
# goes by ``_candidate_sets``, which has no such table.
def _set_rows(df: DataFrame, side: str, size: int, id_col: str, text: str) -> DataFrame:
    """(side, id, _set, _s): sorted shingle hashes of every non-empty text."""
    # The filter is on the text: on the shingles it would compute them twice.
    words = df.filter(F.col(text).rlike(r"\S")).select(
        F.col(id_col).alias("id"), _all(F.lower(F.col(text)), r"\S+").alias("_w"))
    hashed = F.transform(shingles(F.col("_w"), size), lambda s: F.xxhash64(s))
    rows = words.select("id", F.array_sort(F.array_distinct(hashed)).alias("_s"))
    return rows.withColumn("_set", F.unhex(F.md5(F.to_json("_s")))).withColumn("side", F.lit(side))


def _ordered_in_place(sets: DataFrame, late: pa.Table, threshold: float, hot_sets: int) -> DataFrame:
    """``_ordered_sets`` without moving a shingle: the frequent ones (``late``: s, df) come
    last by their counts, all others first by their hashes."""
    s, df = late.column("s").to_numpy(), late.column("df").to_numpy()
    order = np.argsort(s)
    shared = sets.sparkSession.sparkContext.broadcast((s[order], df[order]))
    names = ["side", "_set", "n", "_s", "rare", "hot", "reach"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late_s, late_df = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                n, all_, rare, hot, reach = [], [], [], [], []
                for one in part.column("_s"):
                    own = one.values.to_numpy()
                    times = np.zeros(len(own), np.int64)
                    if len(late_s):
                        at = np.minimum(np.searchsorted(late_s, own), len(late_s) - 1)
                        times = np.where(late_s[at] == own, late_df[at], 0)
                    by = np.lexsort((own, times))
                    own, times = own[by], times[by]
                    # 1e-9 keeps ceil() from rounding up an exact product
                    last = len(own) - math.ceil(len(own) * threshold - 1e-9) + 1
                    n.append(len(own))
                    all_.append(own)
                    rare.append(own[:last][times[:last] <= hot_sets])
                    hot.append(own[times > hot_sets])
                    reach.append(last - len(rare[-1]))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("side"), part.column("_set"), pa.array(n, pa.int32()), pa.array(all_, longs),
                     pa.array(rare, longs), pa.array(hot, longs), pa.array(reach, pa.int32())], names=names)

    return sets.select("side", "_set", "_s").mapInArrow(
        run, "side string, _set binary, n int, _s array<long>, rare array<long>, hot array<long>, reach int")


def _ordered_sets(rows: DataFrame, threshold: float, hot_sets: int, late_rows: int = LATE_ROWS) -> DataFrame:
    """One row per distinct set and side: its shingles rare first (those of few sets in any
    one order), split into the prefix that is not hot (``rare``) and all hot ones (``hot``), and how many of
    the hot ones the prefix reaches (``reach``)."""
    sets = rows.groupBy("side", "_set").agg(F.any_value("_s").alias("_s"))
    sets = stored(sets, "distinct")
    posting = sets.select("side", "_set", F.explode("_s").alias("s"))
    freq = posting.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    many = stored(freq.filter(F.col("df") >= min(LATE_DF, hot_sets + 1)), "frequent")
    counts = sorted(((r["df"], r["count"]) for r in many.groupBy("df").count().collect()), reverse=True)
    if sum(n for df, n in counts if df > hot_sets) <= late_rows:
        held, cut = 0, None
        for df, n in counts:
            held += n
            if held > late_rows:
                break
            cut = df
        late = many.filter(F.col("df") >= cut) if cut is not None else many.limit(0)
        return _ordered_in_place(sets, late.toArrow(), threshold, hot_sets)
    # more hot shingles than a worker should hold: their counts are joined to all of them
    # one list per set, as long as its text
    ordered = posting.join(freq, "s").groupBy("side", "_set").agg(
        F.array_sort(F.collect_list(F.struct("df", "s"))).alias("_o")).withColumn("n", F.size("_o"))
    # 1e-9 keeps ceil() from rounding up an exact product
    last = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    prefix = F.slice("_o", F.lit(1), last)

    def hashes(items: Column) -> Column:
        return F.transform(items, lambda e: e["s"])

    rare = F.filter(prefix, lambda e: e["df"] <= hot_sets)
    hot = F.filter(F.col("_o"), lambda e: e["df"] > hot_sets)
    return ordered.select(
        "side", "_set", "n", hashes(F.col("_o")).alias("_s"), hashes(rare).alias("rare"),
        hashes(hot).alias("hot"), (last - F.size(rare)).alias("reach"))


ORDERED_ROWS = 256


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
    """(part, what came back to it, its texts): the rows of a part come together."""
    place, held = None, ([], [])
    for now, turn, rows in G._runs(batches):
        if now != place and place is not None:
            yield place, *held
            held = ([], [])
        place = now
        held[turn].append(rows)
    if place is not None:
        yield place, *held


def _values(rows: list[pa.RecordBatch]) -> np.ndarray:
    found = [r.column("_s").flatten().to_numpy(zero_copy_only=False) for r in rows]
    return np.concatenate(found).view("<u8") if found else np.empty(0, "<u8")


def _side_counts(ranges: int):
    """``G.SENT``: sets of either side of a part that hold a shingle (``g``: a, ``n``: b)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, _, texts in _parts(batches):
            values = _values(texts)
            lengths = [pa.compute.list_value_length(r.column("_s")).to_numpy(zero_copy_only=False) for r in texts]
            of_a = np.concatenate([np.repeat(pa.compute.equal(r.column("side"), "a").to_numpy(zero_copy_only=False), n)
                                   for r, n in zip(texts, lengths)])
            h, at = np.unique(values, return_inverse=True)
            n_a, n_all = np.bincount(at[of_a], minlength=len(h)), np.bincount(at, minlength=len(h))
            home = G.range_of(h, ranges)
            cuts = np.flatnonzero(np.diff(home, prepend=-1))
            for start, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(h)]):
                yield G._sent([(place, int(home[start]), *G._terms_sent(
                    h[start:end], n_a[start:end], n_all[start:end] - n_a[start:end]))], G.SENT)

    return run


COMMON = "part int, range int, k int, df binary"


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``COMMON``: the sets that hold a shingle, zero if all are of one side, to each part
    that sent it, in the order it was sent."""
    for rows in G._by_range(batches):
        h, n_a, n_b = (np.concatenate(c) for c in zip(*(G._terms_of(r["k"], r["h"], r["g"], r["n"]) for r in rows)))
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
        a, b = np.add.reduceat(n_a[order], first), np.add.reduceat(n_b[order], first)
        df = np.empty(len(h), np.uint64)
        df[order] = np.repeat(np.where((a > 0) & (b > 0), a + b, 0), np.diff(first, append=len(h)))
        start = 0
        for r in rows:
            yield G._sent([(r["part"], r["range"], r["k"], G.packed(df[start:start + r["k"]]))], COMMON)
            start += r["k"]


def _pruned(threshold: float, hot_sets: int):
    """The sets that may reach ``threshold``, each with its shingles of both sides.

    The order of all shingles puts those of one side first, then those of few sets.  A set
    with no shingle of both sides among its first ``n - ceil(t * n) + 1`` has no partner."""
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, back, texts in _parts(batches):
            known = [G.unpacked(d, k) for r in back for d, k in zip(r.column("df").to_pylist(), r.column("k").to_pylist())]
            df = np.concatenate([*known, np.empty(0, np.uint64)]).astype(np.int64)
            h, at = np.unique(_values(texts), return_inverse=True)
            if len(h) != len(df):
                raise ValueError("the texts have changed between two readings")
            times, start = df[at], 0
            for rows in texts:
                kept, out = [], []
                for i, own in enumerate(rows.column("_s")):
                    own = own.values.to_numpy()
                    d = times[start:start + len(own)]
                    start += len(own)
                    # 1e-9 keeps ceil() from rounding up an exact product
                    last = len(own) - math.ceil(len(own) * threshold - 1e-9) + 1
                    both = d > 0
                    last -= len(own) - int(both.sum())
                    if last < 1:
                        continue
                    n, own, d = len(own), own[both], d[both]
                    by = np.lexsort((own, d))
                    own, d = own[by], d[by]
                    rare = own[:last][d[:last] <= hot_sets]
                    name = hashlib.md5(n.to_bytes(8, "little") + own.tobytes()).digest()
                    kept.append(i)
                    out.append((name, n, own, rare, own[d > hot_sets], last - len(rare)))
                for cut in range(0, len(kept), ORDERED_ROWS):
                    some = rows.take(pa.array(kept[cut:cut + ORDERED_ROWS], pa.int64()))
                    columns = zip(zip(*out[cut:cut + ORDERED_ROWS]), (pa.binary(), pa.int32(), longs, longs, longs, pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [some.column("side"), some.column("id"), *(pa.array(c, kind) for c, kind in columns)],
                        names=["side", "id", "_set", "n", "_s", "rare", "hot", "reach"])

    return run


def _candidate_sets(texts: DataFrame, threshold: float, size: int, hot_sets: int,
                    part_bytes: int, range_bytes: int) -> DataFrame:
    """(side, id, _set, n, _s, rare, hot, reach) of the texts (side, id, _t) that may have a
    partner on the other side; ``_s`` holds the shingles found on both.

    Texts are dealt to parts twice; what a part knows of its shingles travels packed, so no
    set moves and no shingle is a row."""
    texts = texts.filter(F.col("_t").rlike(r"\S"))
    n_bytes = texts.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    parts = max(4 * texts.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // part_bytes))
    ranges = max(1, -(-n_bytes // range_bytes))
    rows = texts.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("turn"), "side", "id", "_t")
    words = _all(F.lower(F.col("_t")), r"\S+").alias("_w")
    hashed = F.array_sort(F.array_distinct(F.transform(shingles(F.col("_w"), size), lambda s: F.xxhash64(s)))).alias("_s")
    first = rows.repartition(parts, "part").sortWithinPartitions("part").select("part", "turn", "side", words)
    counted = first.select("part", "turn", "side", hashed).mapInArrow(_side_counts(ranges), G.SENT)
    common = counted.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(_common, COMMON)
    none = {c: F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("side", "id", "_t")}
    both = common.select("part", F.lit(0).alias("turn"), *none.values(), "range", "k", "df").unionByName(rows.select(
        "*", F.lit(0).alias("range"), F.lit(0).alias("k"), F.lit(None).cast("binary").alias("df")))
    second = both.repartition(parts, "part").sortWithinPartitions("part", "turn", "range").select(
        "part", "turn", "side", "id", words, "k", "df").select("part", "turn", "side", "id", hashed, "k", "df")
    longs = ArrayType(LongType())
    return second.mapInArrow(_pruned(threshold, hot_sets), StructType([
        StructField("side", StringType()), StructField("id", rows.schema["id"].dataType), StructField("_set", BinaryType()),
        StructField("n", IntegerType()), *(StructField(c, longs) for c in ("_s", "rare", "hot")),
        StructField("reach", IntegerType())]))


def _jaccard(common: Column, n_a: Column, n_b: Column) -> Column:
    return common / (n_a + n_b - common)


def _rare_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(set_a, similarity) of pairs that share a prefix shingle that is not hot."""
    def side(name: str) -> DataFrame:
        return sets.filter(F.col("side") == name)

    def prefix(name: str) -> DataFrame:
        return side(name).select(F.explode("rare").alias("s"), F.col("_set").alias(f"set_{name}"),
                                 F.col("n").alias(f"n_{name}"))

    def whole(name: str) -> DataFrame:
        return side(name).select(F.col("_set").alias(f"set_{name}"), F.col("_s").alias(f"s_{name}"), F.col("n").alias(f"n_{name}"))

    fits = (F.col("n_a") >= F.col("n_b") * threshold) & (F.col("n_b") >= F.col("n_a") * threshold)
    pairs = prefix("a").join(prefix("b"), "s").filter(fits).select("set_a", "set_b").distinct()
    both = pairs.join(whole("a"), "set_a").join(whole("b"), "set_b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    return both.select("set_a", _jaccard(common, F.col("n_a"), F.col("n_b")).alias("similarity"))


def _hot_pairs(sets: DataFrame) -> DataFrame:
    """(set_a, similarity) counting hot shingles alone.

    Sets fold by their hot part: a group of near copies shares one, however large
    the group is.  Without a common rare shingle the overlap is that of the hot
    parts, and the smallest member is the most similar one; with a common rare
    shingle this is a lower bound and the rare pairs hold the exact value.
    """
    per_set = sets.filter(F.col("reach") > 0).select(
        "side", "_set", "n", "hot", "reach", F.unhex(F.md5(F.to_json("hot"))).alias("hot_set"))
    a = per_set.filter("side = 'a'").groupBy("hot_set", "n").agg(
        F.max("reach").alias("reach"), F.any_value("hot").alias("hot"))
    b = per_set.filter("side = 'b'").groupBy("hot_set").agg(
        F.max("reach").alias("reach"), F.any_value("hot").alias("hot"), F.min("n").alias("n"))

    def reached(folded: DataFrame, *keys: Column) -> DataFrame:
        return folded.select(*keys, F.explode(F.slice("hot", F.lit(1), F.col("reach"))).alias("s"))

    left = reached(a, F.col("hot_set").alias("hot_a"), F.col("n").alias("n_a"))
    right = reached(b, F.col("hot_set").alias("hot_b"))
    pairs = left.join(right, "s").select("hot_a", "n_a", "hot_b").distinct()
    both = pairs.join(a.select(F.col("hot_set").alias("hot_a"), F.col("n").alias("n_a"), F.col("hot").alias("s_a")),
                      ["hot_a", "n_a"]).join(
        b.select(F.col("hot_set").alias("hot_b"), F.col("n").alias("n_b"), F.col("hot").alias("s_b")), "hot_b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    best = both.groupBy("hot_a", "n_a").agg(
        F.max(_jaccard(common, F.col("n_a"), F.col("n_b"))).alias("similarity"))
    members = per_set.filter("side = 'a'").select(
        F.col("_set").alias("set_a"), F.col("hot_set").alias("hot_a"), F.col("n").alias("n_a"))
    return members.join(best, ["hot_a", "n_a"]).select("set_a", "similarity")


def near_duplicates(a: DataFrame, b: DataFrame, threshold: float = 0.85, size: int = 3,
                    id_col: str = "id", text: str = "text", hot_sets: int = HOT_SETS,
                    part_bytes: int = G.PART_BYTES, range_bytes: int = G.RANGE_BYTES) -> DataFrame:
    """Rows of ``a`` whose best shingle Jaccard against any row of ``b`` reaches
    ``threshold``: (id, similarity).  Exact; no pair of unrelated rows is formed.

    * Shingles of one side only are counted and left out; sets with too many of them for
      any partner are not written at all.
    * Rows with equal sets fold into one set first, so copies meet once however many there are.
    * Shingles are ordered rare first.  The first shingle two sets share lies among
      the first ``n - ceil(t * n) + 1`` of each when they are as similar as the
      threshold; only such pairs are candidates.
    * A shingle of more than ``hot_sets`` sets forms no pairs of sets: sets fold by
      their hot shingles and meet once per fold.
    """
    texts = [df.select(F.lit(side).alias("side"), F.col(id_col).alias("id"), F.col(text).alias("_t"))
             for side, df in (("a", a), ("b", b))]
    rows = stored(_candidate_sets(texts[0].unionByName(texts[1]), threshold, size, hot_sets, part_bytes, range_bytes), "sets")
    sets = stored(rows.groupBy("side", "_set").agg(*[F.any_value(c).alias(c) for c in (
        "n", "_s", "rare", "hot", "reach")]), "distinct")
    best = _rare_pairs(sets, threshold).unionByName(_hot_pairs(sets)).groupBy("set_a").agg(
        F.max("similarity").alias("similarity")).filter(F.col("similarity") >= threshold)
    members = rows.filter("side = 'a'").select("id", F.col("_set").alias("set_a"))
    return members.join(best, "set_a").select("id", "similarity")
