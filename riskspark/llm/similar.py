"""Near-dedup by exact similarity: SimHash finds most links, a prefix search the rest.

Texts are near copies if the Jaccard index of their sets of five-word runs is 0.8 or
more.  No pair at or above that is left out:

* Equal sets fold into one node first.
* Links of fingerprints within ``radius`` bits (compared bit-sliced, module ``simhash``)
  and of each set to the smallest set of its prefix keys are candidates.  Verified, they
  give first components, so a large group of near copies meets in few pairs.
* Of two sets that reach the threshold, the first ``n - ceil(t * n) + 1`` runs of each,
  in one fixed order of all runs, share one.  Sets of different first components that
  do are candidates too, if their sizes and the number and places of all runs that these
  prefixes share leave room for the threshold.  A key of many sets is dealt to many tasks.
* Of the sets of a key that more than ``pair_rows`` hold, one is the centre, compared with
  the others.  Those of a Jaccard index of ``CORE`` or more with it do not meet by the key.
  A set that reaches the threshold with one of them is at most ``1 - t`` further from the
  centre (1 - Jaccard is a metric), and two sets differ as much as their differences to the
  centre do.  So either both reach the threshold with the centre (and are connected), or
  their differences share a run among the first ``n * (1 - t) / t + 1`` of each.  Runs that
  the centre lacks come first there: what near copies have in common with their centre
  brings no two of them together, and what they change they seldom share.
* Every candidate is verified on the runs of the texts themselves.

The fixed order is that of hashes with runs that are frequent in a sample put last.  The
sample and the centres decide how many candidates there are, never the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, id_and_text, map_arrow, pair_slices, release_memory, slices, unused
from .exact_dedup import content_hash
from .simhash import components, fingerprint_of, links, shingle_hashes

SAMPLE = 16          # one text of so many is read for the order of runs
SAMPLE_COUNT = 4     # a run is frequent from so many sampled texts on
SAMPLE_RUNS = 50_000  # so many frequent runs at most are put last
KEY_ROWS = 512       # sets of one key that one task compares with all others of the key
PAIR_ROWS = 32       # a key of more sets has a centre
CORE = 0.5           # sets of so much similarity to the centre of a key meet by their differences to it


def shingle_set(text: bytes, size: int) -> set[bytes]:
    """Distinct runs of ``size`` words (all words where there are fewer), A-Z lower-cased."""
    words = text.lower().split()
    k = min(size, len(words))
    return {b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)} if words else set()


def _frequent(texts: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of runs that many texts of the sample hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [np.unique(shingle_hashes(t, size)) for t in part.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["key"])

    sampled = texts.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counted = map_arrow(sampled, run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.filter(F.col("n") >= SAMPLE_COUNT).orderBy(F.desc("n"), "key").limit(SAMPLE_RUNS).collect()
    return np.sort(np.array([r.key for r in rows], dtype=np.int64).view(np.uint64))


def _in_order(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sorted hashes with those of ``last`` put last."""
    if not len(last):
        return hashes
    late = last[np.minimum(np.searchsorted(last, hashes), len(last) - 1)] == hashes
    return np.concatenate((hashes[~late], hashes[late]))


def _difference(hashes: np.ndarray, centre: np.ndarray, last: np.ndarray) -> np.ndarray:
    """What one of two sets has alone, in order: runs that ``centre`` lacks, then its own."""
    return np.concatenate((_in_order(np.setdiff1d(hashes, centre, assume_unique=True), last),
                           _in_order(np.setdiff1d(centre, hashes, assume_unique=True), last)))


def _sets(texts: DataFrame, size: int, threshold: float, last: np.ndarray) -> DataFrame:
    """(doc_id, c, digest, fp, n, keys): hash of the text, digest of its set, fingerprint,
    number of runs and the prefix of the runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for part in slices(batches, "text", 1 << 20):
            c, digest, fp, n, keys = [], [], [], [], []
            for text in part.column("text").cast(pa.binary()).to_pylist():
                hashes = shingle_hashes(text, size)
                fp.append(fingerprint_of(hashes))
                hashes = np.unique(hashes)
                c.append(hashlib.md5(text).digest())
                digest.append(hashlib.blake2b(hashes.astype("<u8").tobytes(), digest_size=16).digest())
                n.append(len(hashes))
                need = int(np.ceil(len(hashes) * threshold - 1e-9))
                keys.append(_in_order(hashes, last)[:len(hashes) - need + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(c, pa.binary()), pa.array(digest, pa.binary()),
                 pa.array(np.array(fp, dtype=np.uint64).view(np.int64)), pa.array(n, pa.int32()),
                 pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "c", "digest", "fp", "n", "keys"])
        release_memory()

    return map_arrow(texts, run, "doc_id long, c binary, digest binary, fp long, n int, keys array<long>")


def _fits(threshold: float) -> Column:
    """Whether two sets can reach the threshold, by their sizes and by what follows the
    common run, if that is their first."""
    n, m = F.col("x.n"), F.col("y.n")
    need = F.lit(threshold / (1 + threshold)) * (n + m) - 1e-6
    return (F.least(n, m) >= F.lit(threshold) * F.greatest(n, m) - 1e-6) & (
        F.least(n - F.col("x.pos"), m - F.col("y.pos")) >= need)


def _sizes_fit(threshold: float) -> Column:
    """Whether two sets can reach the threshold, by their sizes alone."""
    n, m = F.col("x.n"), F.col("y.n")
    return F.least(n, m) >= F.lit(threshold) * F.greatest(n, m) - 1e-6


def _opened(placed: DataFrame, keys: list[str], key_rows: int) -> DataFrame:
    """Rows of ``placed`` (keys, x) whose key several components hold, with the number of
    ``parts`` that its sets are dealt to."""
    mixed = placed.groupBy(*keys).agg(
        F.min("x.g").alias("_g"), F.max("x.g").alias("_h"), F.count(F.lit(1)).alias("_n")).filter("_g < _h").select(
        *keys, F.ceil(F.col("_n") / key_rows).cast("int").alias("parts"))
    return placed.join(mixed.hint("merge"), keys)


def _meetings(open_: DataFrame, keys: list[str], fit: Column) -> DataFrame:
    """(keys, x, y): sets of ``open_`` (keys, parts, x) of different components that share
    a key and ``fit``."""
    mine = open_.withColumn("part", F.pmod(F.xxhash64("x.node"), F.col("parts")).cast("int")).select(*keys, "part", "x")
    others = open_.select(*keys, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("x").alias("y"))
    return mine.join(others.hint("merge"), [*keys, "part"]).filter((F.col("x.g") > F.col("y.g")) & fit)


def _candidates(open_: DataFrame, threshold: float) -> DataFrame:
    """(a, b): sets of ``open_`` (key, parts, x) of different components that can reach the
    threshold, by all the runs their prefixes share.

    Up to the last shared run both prefixes are known, so what else the sets share comes
    after it.  The prefix that ends first in the order of runs is known as a whole, so what
    else they share comes after its end.  Sets that share a run by which one of them does
    not meet are found by ``_apart``.
    """
    counted = _meetings(open_, ["key"], _sizes_fit(threshold)).groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(
        F.count(F.lit(1)).alias("common"), F.max("x.n").alias("n"), F.max("y.n").alias("m"),
        F.max("x.pos").alias("i"), F.max("y.pos").alias("j"))
    behind_last = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) - 1
    behind_prefix = F.ceil(F.greatest("n", "m") * F.lit(threshold) - 1e-9) - 1
    need = F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("m")) - 1e-6
    return counted.filter(F.col("common") + F.least(behind_last, behind_prefix) >= need).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _apart(open_: DataFrame, threshold: float) -> DataFrame:
    """(a, b): sets of ``open_`` (centre, key, parts, x) of different components that can
    reach the threshold, one of them in the ``core``, by all the runs that their differences
    to one centre share.

    Sets of n and m runs that reach it differ in (n + m) * (1 - t) / (1 + t) runs at most.
    Their differences, of d and e runs, share half of what d + e is above that.  The first
    run they share leaves so many behind it, and what else they share comes after the last.
    """
    def need(n, m, d, e):
        apart = F.lit((1 - threshold) / (1 + threshold)) * (F.col(n) + F.col(m))
        return F.greatest(F.lit(1), F.ceil((F.col(d) + F.col(e) - apart) / 2 - 1e-6))

    least = need("x.n", "y.n", "x.d", "y.d")
    fit = (F.col("x.core") | F.col("y.core")) & _sizes_fit(threshold) & (F.col("x.pos") + least <= F.col("x.d")) & (F.col("y.pos") + least <= F.col("y.d"))
    counted = _meetings(open_, ["centre", "key"], fit).groupBy(
        "centre", F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(
        F.count(F.lit(1)).alias("common"), *(F.max(f"{s}.{c}").alias(f"{s}{c}") for s in "xy" for c in ("n", "d", "pos")))
    behind = F.least(F.col("xd") - F.col("xpos"), F.col("yd") - F.col("ypos")) - 1
    return counted.filter(F.col("common") + behind >= need("xn", "yn", "xd", "yd")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, threshold: float,
              last: np.ndarray, scratch: Scratch, name: str) -> DataFrame:
    """(a, b, near, core, n, d, keys): the pairs (a, b, apart) of nodes whose texts reach the
    threshold, and of those ``apart``, b a centre, all that one of its core may reach it with:
    the number of runs of a, the size of its difference to b and the first runs of that."""
    pairs = scratch.store(pairs.groupBy("a", "b").agg(F.max("apart").alias("apart")), f"{name}-pairs")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    hashes = scratch.store(nodes.select("node", "c").join(wanted.hint("merge"), "node"), f"{name}-nodes")
    found = texts.select(content_hash(F.col("text")).alias("c"), "text").join(hashes.hint("merge"), "c")
    # a node has one content hash: by both, rows stay where the join has put them
    held = scratch.store(found.groupBy("c", "node").agg(F.first("text").alias("text")).drop("c"), f"{name}-texts")
    both = pairs.join(held.select(F.col("node").alias("a"), F.col("text").alias("text")).hint("merge"), "a").join(
        held.select(F.col("node").alias("b"), F.col("text").alias("other")).hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for part in pair_slices(batches, "text", "other", 1 << 20):
            near, core, n, d, keys = [], [], [], [], []
            for s, t, apart in zip(*(part.column(c).to_pylist() for c in ("text", "other", "apart"))):
                s, t = s.encode(), t.encode()
                x, y = shingle_set(s, size), shingle_set(t, size)
                common = len(x & y)
                either = len(x) + len(y) - common
                near.append(common >= threshold * either - 1e-9)
                core.append(None)
                for column in (n, d, keys):
                    column.append(None)
                if apart and common >= (CORE + threshold - 1) * either - 1e-6:
                    runs = np.unique(shingle_hashes(s, size))
                    found = _difference(runs, np.unique(shingle_hashes(t, size)), last)
                    room = int(len(runs) * (1 - threshold) / threshold + 1e-6)
                    core[-1], n[-1], d[-1], keys[-1] = common >= CORE * either, len(runs), len(found), found[:room + 1].view(np.int64)
            out = pa.RecordBatch.from_arrays(
                [part.column("a"), part.column("b"), pa.array(near, pa.bool_()), pa.array(core, pa.bool_()), pa.array(n, pa.int32()),
                 pa.array(d, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["a", "b", "near", "core", "n", "d", "keys"])
            yield out.filter(pa.compute.or_(out.column("near"), pa.compute.is_valid(out.column("core"))))
        release_memory()

    out = scratch.store(map_arrow(both.select("a", "b", "apart", "text", "other"), run,
                                  "a long, b long, near boolean, core boolean, n int, d int, keys array<long>"), name)
    for done in ("pairs", "nodes", "texts"):
        scratch.drop(f"{name}-{done}")
    return out


def similar_groups(docs: DataFrame, size: int = 5, threshold: float = 0.8, radius: int = 4, blocks: int = 6,
                   bucket_rows: int = 4096, key_rows: int = KEY_ROWS, pair_rows: int = PAIR_ROWS, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, c (MD5 of the text), component_id.

    * Texts are linked if the Jaccard index of their distinct runs of ``size`` words is
      at least ``threshold``; texts without a word are linked to each other.
    * ``component_id`` is a number that the texts of one component share.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    texts = id_and_text(docs, id_col, text_col)
    # a row number, fixed once written, names a set: shorter than its digest
    last = _frequent(texts, size)
    sets = scratch.store(_sets(texts, size, threshold, last).withColumn("row", F.monotonically_increasing_id()), "sets")
    folded = scratch.store(sets.groupBy("digest").agg(
        F.min(F.struct("row", "c", "fp", "n")).alias("x"), F.count(F.lit(1)).alias("_rows")), "folded")
    nodes = scratch.store(folded.select(F.col("x.row").alias("node"), "x.c", "x.fp", "x.n"), "slim")
    # sets of several rows; the keys, by far the widest column, move only if these are many
    several = scratch.store(folded.filter("_rows > 1").select("digest", F.col("x.row").alias("_row")), "several")
    named = sets.join(several, "digest", "left").withColumn("node", F.coalesce("_row", "row"))
    prints = scratch.store(named.select("doc_id", "c", "node"), "rows-of")
    prefixes = named.filter("node = row")
    scratch.drop("folded")

    # prefix keys of more than one set; most have one and go no further
    counted = prefixes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    shared = scratch.store(counted.filter("_n > 1").select("key"), "shared")
    rows = scratch.store(prefixes.select("node", "n", F.posexplode("keys").alias("pos", "key")).join(shared.hint("merge"), "key"), "rows")
    for done in ("sets", "several", "shared"):
        scratch.drop(done)

    # one set stands for each fingerprint, and one for each key
    stands = scratch.store(nodes.groupBy("fp").agg(F.min("node").alias("node")), "stands")
    near = links(stands.select(F.col("fp").alias("id"), "fp"), radius, blocks, bucket_rows)
    by_print = near.join(stands.select(F.col("fp").alias("a"), F.col("node").alias("_a")).hint("merge"), "a").join(
        stands.select(F.col("fp").alias("b"), F.col("node").alias("_b")).hint("merge"), "b").select(
        F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b"))
    equal = nodes.select("fp", F.col("node").alias("a")).join(
        stands.select("fp", F.col("node").alias("b")).hint("merge"), "fp").filter("a <> b").select("a", "b")
    # the centre of a key of many sets is one with few runs ahead of it: most are a copy's own changes
    busy = F.col("_n") > pair_rows
    counts = scratch.store(rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("node", "n", "pos")).alias("_y"), F.min(F.struct("pos", "node", "n")).alias("_z")).select(
        "key", busy.alias("apart"), F.when(busy, F.struct("_z.node", "_z.n", "_z.pos")).otherwise(F.col("_y")).alias("y")), "counts")
    n, m = F.col("x.n"), F.col("y.n")
    by_key = rows.select("key", F.struct("node", "n", "pos").alias("x")).join(counts.hint("merge"), "key").filter(
        F.when(F.col("apart"), (F.col("x.node") != F.col("y.node")) & (
            F.least(n, m) >= F.lit(CORE + threshold - 1) * F.greatest(n, m) - 1e-6)).otherwise(
            (F.col("x.node") > F.col("y.node")) & _fits(threshold))).select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b"), "apart")
    pairs = by_print.unionByName(equal).withColumn("apart", F.lit(False)).unionByName(by_key)
    first = _verified(pairs, nodes, texts, size, threshold, last, scratch, "first")
    linked = first.filter("near").select("a", "b")

    # the rest: sets that share a key, or part of their difference to a centre, and are not yet connected
    known = scratch.store(components(linked, scratch, "first-star").withColumnRenamed("id", "node"), "known")
    core = first.filter("core").select(F.col("a").alias("node"), F.col("b").alias("centre"), "core")
    central = rows.join(counts.filter("apart").select("key", F.col("y.node").alias("centre")).hint("merge"), "key")
    left = central.join(core.hint("merge"), ["node", "centre"], "left").filter("core OR node = centre").groupBy("node").agg(
        F.collect_list("key").alias("left"))
    g = F.coalesce("component_id", "node").alias("g")
    placed = scratch.store(rows.join(known.hint("merge"), "node", "left").join(left.hint("merge"), "node", "left").filter(
        ~F.coalesce(F.array_contains("left", F.col("key")), F.lit(False))).select(
        "key", F.struct(g, "node", "n", "pos").alias("x")), "placed")
    for done in ("rows", "stands", "counts"):
        scratch.drop(done)
    differing = first.filter("keys IS NOT NULL").select(
        F.col("a").alias("node"), F.col("b").alias("centre"), "core", "n", "d", F.posexplode("keys").alias("pos", "key"))
    differing = scratch.store(differing.join(known.hint("merge"), "node", "left").select(
        "centre", "key", F.struct(g, "node", "core", "n", "d", "pos").alias("x")), "differing")
    open_ = scratch.store(_opened(placed, ["key"], key_rows), "open")
    apart = scratch.store(_opened(differing, ["centre", "key"], key_rows), "apart")
    for done in ("placed", "differing", "known"):
        scratch.drop(done)
    rest = _candidates(open_, threshold).unionByName(_apart(apart, threshold)).withColumn("apart", F.lit(False))
    second = _verified(rest, nodes, texts, size, threshold, last, scratch, "second").select("a", "b")

    for done in ("open", "apart", "slim"):
        scratch.drop(done)
    roots = components(linked.unionByName(second), scratch).withColumnRenamed("id", "node")
    return prints.select("doc_id", "c", "node").join(roots.hint("merge"), "node", "left").select(
        "doc_id", "c", F.coalesce("component_id", "node").alias("component_id"))


def drop_similar(docs: DataFrame, size: int = 5, threshold: float = 0.8, radius: int = 4, blocks: int = 6,
                 bucket_rows: int = 4096, key_rows: int = KEY_ROWS, pair_rows: int = PAIR_ROWS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component (the text of the smallest id), all
    columns as they are.  Rows with a null id stay; rows go by id and text."""
    scratch = Scratch(docs.sparkSession, "similar")
    groups = scratch.store(similar_groups(
        docs, size, threshold, radius, blocks, bucket_rows, key_rows, pair_rows, id_col, text_col).filter("doc_id IS NOT NULL"), "groups")
    best = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "c")).alias("_best"))
    gone_id, gone_c = unused(docs, "_gone"), unused(docs, "_c")
    gone = scratch.store(groups.join(best.hint("merge"), "component_id").filter(
        F.struct("doc_id", "c") != F.col("_best")).select(
        F.col("doc_id").alias(gone_id), F.col("c").alias(gone_c)).distinct(), "gone")
    mine = content_hash(F.coalesce(F.col(text_col), F.lit("")))
    # merge joins of texts keep one plan at every size, so a small run shows what a large one moves
    return docs.join(gone.hint("merge"), (F.col(id_col).cast("long") == F.col(gone_id)) & (mine == F.col(gone_c)), "left_anti")
