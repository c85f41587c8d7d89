"""SimHash near-dedup with bit-sliced comparison.

Texts become 64-bit fingerprints; fingerprints that differ in at most ``radius`` bits
are linked; linked rows form components.

* Equal fingerprints fold into one first, so copies meet once.
* The 64 bits are cut into ``blocks`` blocks.  Of two fingerprints within the radius at
  least ``blocks - radius`` blocks agree, so they share the value of one choice of so
  many blocks: rows meet by (choice, value), and no link is lost.
* Rows that met are compared bit-sliced: bit plane p holds bit p of all rows, 64 rows a
  word.  The rows are sorted by bucket, and for each shift d the distances between row
  i and row i + d of one bucket build up in vertical carry-save counters, plane after
  plane; words whose lanes have all passed the radius are abandoned.
* A bucket above ``bucket_rows`` rows is cut into parts by hash, and pairs of parts go
  to tasks of their own, so that no task holds a hot bucket.
* A task returns a spanning forest of the links it found, not all of them, and
  components come from alternating star rounds, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, hash_parts, id_and_text, map_arrow, slices, unused

HASH_SEED = 42


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words (of all words where there are fewer)."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(words))
    digest, seed = xxhash.xxh64_intdigest, HASH_SEED
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())],
                    dtype=np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit p is set if it is set in over half of the hashes; zero without hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    # 65,536 hashes at a time bound the unpacked bits of very long texts
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start:start + (1 << 16)].astype("<u8").view(np.uint8)
        counts += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of whole texts, A-Z lower-cased, over runs of
    ``size`` words, repeats included; null and empty texts have fingerprint zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint_of(shingle_hashes(t, size)) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return map_arrow(id_and_text(docs, id_col, text_col), run, "doc_id long, fp long")


# ---------------------------------------------------------------- comparison

def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words) uint64: plane p holds bit p of every row, row i in lane i of the words."""
    n = len(fps)
    padded = np.zeros(-(-max(n, 1) // 64) * 64, np.uint64)
    padded[:n] = fps
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view("<u8")


def lane_words(flags: np.ndarray) -> np.ndarray:
    """One bit per row, 64 rows a word."""
    padded = np.zeros(-(-max(len(flags), 1) // 64) * 64, np.uint8)
    padded[:len(flags)] = flags
    return np.packbits(padded, bitorder="little").view("<u8")


def shifted(words: np.ndarray, d: int) -> np.ndarray:
    """The lanes of ``words`` moved down by ``d`` rows, along the last axis."""
    whole, rest = divmod(d, 64)
    out = np.zeros_like(words)
    if whole < words.shape[-1]:
        out[..., :words.shape[-1] - whole] = words[..., whole:]
    if rest:
        low = out >> np.uint64(rest)
        high = np.zeros_like(out)
        high[..., :-1] = out[..., 1:] << np.uint64(64 - rest)
        out = low | high
    return out


def within_radius(planes: np.ndarray, d: int, alive: np.ndarray, radius: int) -> np.ndarray:
    """Rows i (of the lanes set in ``alive``) whose distance to row i + d is at most
    ``radius``: carry-save counters per lane, one plane after the other."""
    others = shifted(planes, d)
    block = np.flatnonzero(alive)
    alive = alive[block].copy()
    levels = max(1, (radius + 1).bit_length())
    counters = [np.zeros(len(block), np.uint64) for _ in range(levels)]
    # counters start so that the carry out of the top one means "over the radius"
    start = (1 << levels) - 1 - radius
    for level in range(levels):
        if start >> level & 1:
            counters[level] |= np.uint64(0xFFFFFFFFFFFFFFFF)
    for p in range(64):
        carry = planes[p, block] ^ others[p, block]
        for level in range(levels):
            counters[level], carry = counters[level] ^ carry, counters[level] & carry
        alive &= ~carry
        if p % 8 == 7:
            open_ = alive != 0
            if not open_.any():
                return np.empty(0, np.int64)
            if open_.sum() < 0.7 * len(block):
                block, alive = block[open_], alive[open_]
                counters = [c[open_] for c in counters]
    lanes = np.unpackbits(alive.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, lane = np.nonzero(lanes)
    return block[word] * 64 + lane


def bucket_links(key: np.ndarray, ids: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links inside buckets.  Rows are sorted by ``key``."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    found: list[tuple[int, int]] = []
    planes, d = None, 1
    while d < len(key):
        # rows that have a row of their own bucket d places on
        near = np.zeros(len(key), bool)
        near[:-d] = key[d:] == key[:-d]
        big = near.copy()
        big[d:] |= near[:-d]
        if not near.any():
            break
        if big.sum() < 0.5 * len(key):
            # only buckets of more than d rows go on, all their rows together
            big = np.isin(key, key[near])
            key, ids, fps, near, planes = key[big], ids[big], fps[big], near[big], None
        if planes is None:
            planes = bit_planes(fps)
        for i in within_radius(planes, d, lane_words(near), radius).tolist():
            a, b = root(int(ids[i])), root(int(ids[i + d]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((max(a, b), min(a, b)))
        d += 1
    return found


def _choice_key(fp: Column, picked: tuple[int, ...], edges: list[int], number: int) -> Column:
    """A 64-bit key of the values of the picked blocks of a fingerprint."""
    mask = sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in picked)
    signed = mask - (1 << 64) if mask >> 63 else mask
    return F.xxhash64(F.lit(number), fp.bitwiseAND(F.lit(signed)))


def links(folded: DataFrame, radius: int, blocks: int, bucket_rows: int) -> DataFrame:
    """(a, b), a > b: links between rows of ``folded`` (id, fp), as a forest per task.

    Keys of choices are hashes; two buckets that collide only compare more rows.
    """
    edges = [64 * b // blocks for b in range(blocks + 1)]
    choices = list(combinations(range(blocks), blocks - radius))
    keys = F.array(*[_choice_key(F.col("fp"), c, edges, i) for i, c in enumerate(choices)])
    rows = folded.select("id", "fp", F.explode(keys).alias("key"))
    big = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > bucket_rows)
    split = rows.join(big, "key", "left").withColumn(
        "_parts", F.coalesce(F.ceil(F.col("_n") / bucket_rows).cast("int"), F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("_parts")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda other: F.xxhash64(
        F.col("key"), F.least(mine, other), F.greatest(mine, other)))
    dealt = split.select("id", "fp", F.explode(F.when(F.col("_parts") == 1, F.array("key")).otherwise(pair)).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush(rows_: list[tuple[np.ndarray, ...]], last: bool):
            key, ids, fps = (np.concatenate(c) for c in zip(*rows_))
            # the bucket at the end may go on in the next batch
            cut = len(key) if last else int(np.searchsorted(key, key[-1]))
            rest = [] if cut == len(key) else [(key[cut:], ids[cut:], fps[cut:])]
            pairs = bucket_links(key[:cut], ids[:cut], fps[:cut].view(np.uint64), radius) if cut else []
            a, b = (np.array(c, dtype=np.int64) for c in zip(*pairs)) if pairs else (np.empty(0, np.int64),) * 2
            return rest, pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("key", "id", "fp")))
            if sum(len(h[0]) for h in held) >= 100_000:
                held, out = flush(held, False)
                yield out
        if held:
            yield flush(held, True)[1]

    placed = dealt.repartition(hash_parts(folded.sparkSession), "key").sortWithinPartitions("key")
    return map_arrow(placed.select("key", "id", "fp"), run, "a long, b long")


def components(edges: DataFrame, scratch: Scratch, name: str = "star") -> DataFrame:
    """(id, component_id) of every id in ``edges`` (a, b): the smallest id reachable.

    Large-star and small-star rounds in turn; each round is written to the shared
    folder.  The number of rounds grows with the logarithm of the largest component.  Merge
    joins keep one plan at every size: each broadcast would leave a thread in the driver.
    """
    current = scratch.store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                            .filter("a <> b").distinct(), f"{name}-0")
    state, round_ = None, 0
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        # large star: every larger neighbour of a goes to the smallest of all
        large = both.filter("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        # small star: every smaller neighbour, and a itself, goes to the smallest
        small = large.join(least.hint("merge"), "a").filter("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        following = small.unionByName(least.select("a", F.col("_m").alias("b"))).distinct()
        round_ += 1
        following = scratch.store(following, f"{name}-{round_}")
        now = following.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{round_ - 1}")
        current = following
        if now == state:
            break
        state = now
    roots = current.groupBy("a").agg(F.min("b").alias("component_id")).withColumnRenamed("a", "id")
    return roots.unionByName(current.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())


def near_groups(docs: DataFrame, size: int = 4, radius: int = 4, blocks: int = 6, bucket_rows: int = 4096,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    * ``component_id`` is the smallest id reachable over links, its own included.
    * Null and empty texts have fingerprint zero, which is linked like any other.
    * A row with a null id gets the component of its fingerprint; null if no row with
      an id is linked to it.
    * Repeated rows each get a result; an empty table gives none.
    """
    if not radius < blocks <= 64:
        raise ValueError("blocks must be more than radius")
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.store(fingerprints(docs, size, id_col, text_col), "fingerprints")
    folded = scratch.store(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "folded").filter("id IS NOT NULL")
    roots = components(links(folded, radius, blocks, bucket_rows), scratch)
    named = folded.join(roots, "id", "left").select(
        "fp", F.coalesce("component_id", "id").alias("component_id"))
    return fps.join(named, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, size: int = 4, radius: int = 4, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component (the one of the smallest id), all
    columns as they are.  Rows with a null id stay."""
    groups = near_groups(docs, size, radius, id_col=id_col, text_col=text_col)
    name = unused(docs, "_gone")
    gone = Scratch(docs.sparkSession, "simhash").store(groups.filter("doc_id <> component_id").select(
        F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
