"""Suffix-array dedup: long strings that stand more than once in the corpus.

A string of ``length`` bytes is repeated if it starts at another place too, in the same
document or another.  Repeated strings meet through anchors, and longest-previous-factor
arrays decide where they meet.

* Every window of ``length`` bytes owns one anchor: the gram of ``gram`` bytes in it whose
  hash is smallest.  Equal windows have equal anchors at equal distance.  The windows of
  one anchor are neighbours; the bytes they cover are the anchor's context.
* Anchors whose gram stands once are done.  Contexts that are equal as a whole fold into
  one (by 64 bits of gram hash and 64 of context hash): all their windows are repeated,
  however many copies there are.
* Different contexts of one gram go to one bucket.  Over all windows of the bucket the
  suffix order is built by prefix doubling.  In it the previous and the next smaller
  position give the longest previous factor of each window; one of full length is an
  earlier match.  The same from the other end gives later matches.
* A gram with many different contexts is no single bucket: its contexts are cut into
  ranges of windows, and a range meets those that share the bytes all its windows have in
  common.  Equal ranges fold, ranges without a partner are done, and what is left is
  ordered in its bucket or cut again, down to single windows.  A context of a passage with
  changing surroundings leaves some thirty rows on the way, however common the passage.

Texts are joined with what is known of their anchors once; only documents with contexts
to compare are read a second time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, hash_parts, id_and_text, map_arrow, slices

LENGTH = 400
GRAM = 64
# Different contexts of one gram (or pieces that share a core) that are ordered in one
# bucket; more are cut into smaller pieces, each in a bucket of its own.
BUCKET_ROWS = 32
# Ranges that a piece is cut into.
FANOUT = 7
# Context bytes that a task orders at a time (a bucket more at most).
BUCKET_BYTES = 4 << 20
# Bytes of a document whose anchors are found at a time; 24 bits hold a place in them.
PIECE = 1 << 22

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@cache
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling hash's base and of its inverse, 2**bits of each."""
    up, down = np.full(1 << bits, BASE), np.full(1 << bits, INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit rolling hash of every run of ``gram`` bytes."""
    up, down = powers(max(12, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[:len(data) - gram + 1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from minima of blocks to both sides."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def anchors(data: np.ndarray, length: int, gram: int) -> list[tuple[int, int, int, int]]:
    """(gram hash, context hash, first, last window start) of every anchor, in order."""
    found = []
    width = length - gram + 1
    for start in range(0, max(len(data) - length + 1, 0), PIECE):
        piece = data[start:start + PIECE + length - 1]
        h = gram_hashes(piece, gram)
        # the smallest hash, the leftmost of equal ones: its place is in the low bits
        place = np.arange(len(h), dtype=np.uint64)
        best = sliding_minimum(h >> np.uint64(24) << np.uint64(24) | place, width)
        at = (best & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.append(first[1:], len(at)) - 1
        raw = piece.tobytes()
        for a, lo, hi in zip(at[first].tolist(), first.tolist(), last.tolist()):
            # the place of the anchor in its context belongs to the context
            c = xxhash.xxh3_64_intdigest(raw[lo:hi + length], seed=a - lo)
            found.append((int(h[a]), c, start + lo, start + hi))
    return found


def anchor_place(context: np.ndarray, length: int, gram: int) -> int:
    """Where the anchor of a context is: the leftmost smallest gram of its first window."""
    return int(np.argmin(gram_hashes(context[:length], gram) >> np.uint64(24)))


def signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of sorted or unsorted [start, end) spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def outcome(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans and the digest of what is left."""
    runs, digest, at = merged(spans), hashlib.sha256(), 0
    for a, b in runs:
        digest.update(text[at:a])
        at = b
    digest.update(text[at:])
    return len(text), sum(b - a for a, b in runs), len(runs), digest.hexdigest()


# ------------------------------------------------------------- suffix order

def ranks(keys: np.ndarray) -> np.ndarray:
    """The place of every key among the distinct ones."""
    return np.unique(keys, return_inverse=True)[1].astype(np.uint64)


def suffix_ranks(data: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The first eight bytes of every suffix as a number, and (depth, rank of every suffix
    by its first ``depth`` bytes) by prefix doubling up to ``length``."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    word = np.zeros(n, np.uint64)
    for i in range(8):
        word = word << np.uint64(8) | padded[i:i + n].astype(np.uint64)
    levels = []
    if length >= 8:
        levels.append((8, ranks(word)))
        while levels[-1][0] * 2 <= length:
            depth, rank = levels[-1]
            ahead = np.concatenate((rank[depth:], np.zeros(min(depth, n), np.uint64)))[:n]
            levels.append((depth * 2, ranks(rank << np.uint64(32) | ahead)))
    return word, levels


def window_order(word: np.ndarray, levels: list, starts: np.ndarray, length: int) -> np.ndarray:
    """The suffix order of the windows at ``starts``, equal ones by position: two
    overlapping blocks of the deepest rank make up ``length`` bytes."""
    if levels:
        depth, rank = levels[-1]
        key = rank[starts] << np.uint64(32) | rank[starts + length - depth]
    else:
        key = word[starts] >> np.uint64(8 * (8 - length))
    return np.lexsort((starts, key))


def common_prefix(word: np.ndarray, levels: list, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Bytes that the suffixes at ``a`` and ``b`` have in common, ``length`` at most."""
    a, b, found = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    last = len(word) - 1
    for depth, rank in reversed(levels):
        step = np.where((rank[np.minimum(a, last)] == rank[np.minimum(b, last)]) & (found + depth <= length), depth, 0)
        a, b, found = a + step, b + step, found + step
    differ = word[np.minimum(a, last)] ^ word[np.minimum(b, last)]
    for i in range(1, 8):
        found += (differ >> np.uint64(8 * (8 - i)) == 0) & (a <= last) & (b <= last)
    return np.minimum(found, length)


def smaller_before(places: np.ndarray) -> np.ndarray:
    """For every entry the index of the nearest one before it that is smaller, else -1."""
    best = np.arange(-1, len(places) - 1)
    open_ = np.flatnonzero(best >= 0)
    while True:
        # all entries between an index and its candidate are larger than the one at the index
        open_ = open_[places[best[open_]] > places[open_]]
        if not len(open_):
            return best
        best[open_] = best[best[open_]]
        open_ = open_[best[open_] >= 0]


def factor_lengths(data: np.ndarray, starts: np.ndarray, length: int, backwards: tuple[bool, ...]) -> list[np.ndarray]:
    """For every window the longest prefix of it (``length`` at most) that also starts at
    an earlier window, or, ``backwards``, at a later one; one array a direction.

    In suffix order the suffix with the longest common prefix among the earlier ones is
    the previous or the next smaller position."""
    word, levels = suffix_ranks(data, length)
    order = window_order(word, levels, starts, length)
    places, n, found = starts[order], len(starts), []
    for back in backwards:
        turned = -places if back else places
        before = smaller_before(turned)
        after = n - 1 - smaller_before(turned[::-1])[::-1]
        factor = np.zeros(n, np.int64)
        for other in (before, after):
            has = np.flatnonzero((other >= 0) & (other < n))
            factor[has] = np.maximum(factor[has], common_prefix(word, levels, places[has], places[other[has]], length))
        out = np.zeros(n, np.int64)
        out[order] = factor
        found.append(out)
    return found


def longest_previous_factors(data: np.ndarray, starts: np.ndarray, length: int, backwards: bool = False) -> np.ndarray:
    """``factor_lengths`` of one direction."""
    return factor_lengths(data, starts, length, (backwards,))[0]


def previous_factors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window: whether an earlier and whether a later one equals it."""
    before, after = factor_lengths(data, starts, length, (False, True))
    return before >= length, after >= length


def runs_of(places: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of runs of neighbours in sorted numbers."""
    if not len(places):
        return []
    cut = np.flatnonzero(places[1:] != places[:-1] + 1)
    return list(zip(places[np.append(0, cut + 1)].tolist(), places[np.append(cut, len(places) - 1)].tolist()))


# ------------------------------------------------------------------ the job

def find_anchors(texts: DataFrame, length: int, gram: int, keep_first: bool) -> DataFrame:
    """(d, key, h, c, lo, hi, n): the distinct contexts of every text and how often it has
    them; spans that a text repeats by itself (but for the first, with ``keep_first``)
    come without h."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows: list[tuple] = []
            for d, key, text in zip(*(part.column(c).to_pylist() for c in ("d", "key", "text"))):
                if len(text) < length:
                    continue
                own: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for h, c, lo, hi in anchors(np.frombuffer(text, np.uint8), length, gram):
                    own.setdefault((h, c), []).append((lo, hi))
                for (h, c), places in own.items():
                    rows.append((d, key, h, c, *places[0], len(places), False))
                again = [p for places in own.values() if len(places) > 1 for p in places[keep_first:]]
                for a, b in merged([(lo, hi + length) for lo, hi in again]):
                    rows.append((d, key, 0, 0, a, b - length, 0, True))
            d, key, h, c, lo, hi, n, by_itself = zip(*rows) if rows else ((),) * 8
            none = np.array(by_itself, bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(d, pa.int64()), pa.array(key, pa.int64()), pa.array(signed(h), mask=none), pa.array(signed(c), mask=none),
                 pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(n, pa.int32())],
                names=["d", "key", "h", "c", "lo", "hi", "n"])

    return map_arrow(texts.select("d", "key", "text"), run, "d long, key long, h long, c long, lo int, hi int, n int")


SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
RESOLVED = pa.schema([
    ("kind", pa.int32()), ("d", pa.int64()), ("key", pa.int64()), ("doc_id", pa.int64()), ("text", pa.binary()),
    ("spans", SPANS), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
    ("kept_sha256", pa.string()), ("kept", pa.binary()), ("b", pa.binary()), ("nc", pa.int64()), ("lo", pa.int32()),
    ("hi", pa.int32()), ("m", pa.int64())])
RESOLVED_SQL = ("kind int, d long, key long, doc_id long, text binary, spans array<struct<lo:int,hi:int>>, n_bytes long, "
                "n_removed long, n_spans long, kept_sha256 string, kept binary, b binary, nc long, lo int, hi int, m long")
FINAL, PENDING, CONTEXT = range(3)
DIGESTS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def final_row(doc_id: int | None, text: bytes, spans: list[tuple[int, int]], with_text: bool) -> dict:
    row = dict(zip(DIGESTS, (doc_id, *outcome(text, spans))), kind=FINAL)
    if with_text:
        runs = merged(spans)
        edges = [0, *(x for run in runs for x in run), len(text)]
        row["kept"] = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
        row["spans"] = [{"lo": a, "hi": b} for a, b in runs]
    return row


def resolve(joined: DataFrame, length: int, keep_first: bool, with_text: bool) -> DataFrame:
    """Final results of texts that need no comparison; for the others themselves, with
    their contexts to compare."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows: list[dict] = []
            for row in part.to_pylist():
                text, info = row["text"], row["info"] or []
                spans = [(x["lo"], x["hi"] + length) for x in info if x["m"] is None]
                compare = [x for x in info if x["m"] is not None]
                if not any(keep_first or x["m"] == 1 for x in compare):
                    rows.append(final_row(row["doc_id"], text, spans, with_text))
                else:
                    rows.append({"kind": PENDING, "d": row["d"], "key": row["key"], "doc_id": row["doc_id"], "text": text,
                                 "spans": [{"lo": a, "hi": b - length} for a, b in merged(spans)]})
                for x in compare:
                    rows.append({"kind": CONTEXT, "d": row["d"], "key": row["key"], "lo": x["lo"], "hi": x["hi"], "m": x["m"],
                                 "b": x["h"].to_bytes(8, "big", signed=True), "nc": x["nc"],
                                 "text": text[x["lo"]:x["hi"] + length]})
            yield pa.RecordBatch.from_pylist(rows, schema=RESOLVED)

    return map_arrow(joined, run, RESOLVED_SQL)


def compare_pieces(pieces: DataFrame, length: int, keep_first: bool, parts: int) -> DataFrame:
    """(d, key, lo, hi): runs of windows of pieces (b, d, key, lo, hi, m, text) that stand
    in another piece of the bucket ``b`` too; with ``keep_first`` in an earlier one.  Pieces
    of m > 1 are removed as a whole elsewhere and only bear witness, unless the first stays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            data = np.frombuffer(b"".join(x[6] for x in held), np.uint8)
            widths = np.array([x[4] - x[3] + 1 for x in held])
            first = np.concatenate(([0], np.cumsum(widths)))
            at = np.concatenate(([0], np.cumsum([len(x[6]) for x in held])))
            starts = np.arange(first[-1]) + np.repeat(at[:-1] - first[:-1], widths)
            if keep_first:
                hit = np.flatnonzero(longest_previous_factors(data, starts, length) >= length)
            else:
                earlier, later = previous_factors(data, starts, length)
                hit = np.flatnonzero(earlier | later)
            edges = np.searchsorted(hit, first)
            out = [(x[1], x[2], x[3] + a, x[3] + b) for i, x in enumerate(held) if keep_first or x[5] == 1
                   for a, b in runs_of(hit[edges[i]:edges[i + 1]] - first[i])]
            columns = zip(*out) if out else ((),) * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["d", "key", "lo", "hi"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("b", "d", "key", "lo", "hi", "m", "text"))):
                # pieces of one bucket stay together
                if size > BUCKET_BYTES and row[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield flush()

    placed = pieces.repartition(parts, "b").sortWithinPartitions("b", "d", "key", "lo")
    return map_arrow(placed.select("b", "d", "key", "lo", "hi", "m", "text"), run, "d long, key long, lo int, hi int")


def cut(pieces: DataFrame, length: int, gram: int, step: int) -> DataFrame:
    """Pieces (d, key, at, context, lo, hi, m) cut where the distance from a window's start
    to the anchor passes a multiple of ``step``: (b, c, d, key, at, lo, hi, m).  Equal
    windows have one distance, and all windows of a range cover its core, so those equal to
    one of them are in the ranges of the same core; b names the core, c the whole piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "context"):
            rows: list[tuple] = []
            columns = (part.column(c).to_pylist() for c in ("d", "key", "at", "context", "lo", "hi", "m"))
            for d, key, at, context, lo, hi, m in zip(*columns):
                anchor = at + anchor_place(np.frombuffer(context, np.uint8), length, gram)
                for u in range((anchor - hi) // step * step, anchor - lo + 1, step):
                    v = min(u + step - 1, length - gram)
                    first, last = max(lo, anchor - v), min(hi, anchor - u)
                    core = context[anchor - u - at:anchor - v - at + length]
                    b = xxhash.xxh3_128_digest(core, seed=u)
                    c = xxhash.xxh3_64_intdigest(context[first - at:last - at + length], seed=anchor - first)
                    rows.append((b, int(signed([c])[0]), d, key, at, first, last, m))
            columns = zip(*rows) if rows else ((),) * 8
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["b", "c", "d", "key", "at", "lo", "hi", "m"])

    return map_arrow(pieces.select("d", "key", "at", "context", "lo", "hi", "m"), run,
                     "b binary, c long, d long, key long, at int, lo int, hi int, m long")


def still_open(classes: DataFrame, bucket: str, keep_first: bool) -> DataFrame:
    """(bucket, nc): buckets of several classes, one of which may have windows to mark."""
    return classes.groupBy(bucket).agg(F.count(F.lit(1)).alias("nc"), F.min("m").alias("_m")).filter(
        "nc > 1" if keep_first else "nc > 1 AND _m = 1").select(bucket, "nc")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_rows: int = BUCKET_ROWS,
                   id_col: str = "doc_id", text_col: str = "text", keep_first: bool = False,
                   with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with
    ``with_text`` also spans (the removed runs as lo, hi, end exclusive) and kept (the
    bytes that stay).

    Removed is every byte covered by a string of ``length`` bytes that also starts
    elsewhere in the input; no copy stays.  With ``keep_first`` the first start of a
    string, by id, then place, is no reason to remove it.  Matches never cross texts.

    * Null and empty texts, and those shorter than ``length``, lose nothing.
    * Repeated rows (same id, same text) are copies of each other and lose all their
      windows; with ``keep_first`` they are one document and get one result.
    * A null id counts as zero in the order; texts of one id go by a hash.
    * An empty table gives no rows; other columns are not read.
    """
    if not 0 < gram <= length:
        raise ValueError("a gram must fit into the length")
    spark = docs.sparkSession
    scratch, parts = Scratch(spark, "repeats"), hash_parts(spark)
    row, place = ["d", "key"], ["d", "key", "lo", "hi"]
    # A row goes by its id and a hash of id and text; equal rows share both.
    texts = id_and_text(docs, id_col, text_col).select(
        F.coalesce("doc_id", F.lit(0)).alias("d"), F.xxhash64("doc_id", "text").alias("key"), "doc_id",
        F.col("text").cast("binary").alias("text"))
    found = scratch.store(find_anchors(texts, length, gram, keep_first), "anchors")
    grams = found.filter("h IS NOT NULL")
    repeated = scratch.store(grams.groupBy("h").agg(F.sum("n").alias("_t")).filter("_t > 1").select("h"), "repeated")
    shared = scratch.store(grams.join(repeated, "h"), "shared")
    contexts = scratch.store(shared.groupBy("h", "c").agg(
        F.sum("n").alias("m"), F.min(F.struct(*place)).alias("rep")), "contexts")
    several = scratch.store(still_open(contexts, "h", keep_first), "several")

    def folded(rows: DataFrame, classes: DataFrame, by: list[str]) -> DataFrame:
        """Places of rows whose class has several (but for the first, if it stays)."""
        one = rows.join(classes.filter("m > 1").select(*by, "rep"), by)
        if keep_first:
            one = one.filter(F.struct(*(F.col(c) for c in place)) != F.col("rep"))
        return one.select(*place)

    none = F.lit(None).cast("long")
    spans = folded(shared, contexts, ["h", "c"]).unionByName(found.filter("h IS NULL").select(*place)).select(
        *place, none.alias("h"), none.alias("m"), none.alias("nc"))
    compare = contexts.join(several, "h").select(*(f"rep.{c}" for c in place), "h", "m", "nc")
    # as long as its text at most
    info = spans.unionByName(compare).groupBy(*row).agg(F.collect_list(F.struct("lo", "hi", "h", "m", "nc")).alias("info"))
    resolved = scratch.store(resolve(texts.join(info, row, "left").select(*row, "doc_id", "text", "info"),
                                     length, keep_first, with_text), "resolved")
    for name in ("anchors", "repeated", "shared", "contexts", "several"):
        scratch.drop(name)  # all that is known of them is in the written rows

    pieces = resolved.filter(F.col("kind") == CONTEXT).select("b", "nc", *place, "m", "text")
    few = pieces.filter(F.col("nc") <= bucket_rows)
    # Repeated rows bring each of their contexts once more.
    few = few.filter("m = 1").unionByName(few.filter("m > 1").dropDuplicates(place))
    more = [compare_pieces(few, length, keep_first, parts)]
    contexts = scratch.store(pieces.filter(F.col("nc") > bucket_rows).groupBy("d", "key", F.col("lo").alias("at")).agg(
        F.first("text").alias("context"), F.first("hi").alias("hi"), F.first("m").alias("m")), "hot")
    hot, step = contexts.withColumn("lo", F.col("at")), length - gram + 1
    while step > 1:
        step = -(-step // FANOUT)
        rows = scratch.store(cut(hot, length, gram, step), f"cut{step}")
        classes = scratch.store(rows.groupBy("b", "c").agg(
            F.sum("m").alias("m"), F.min(F.struct(*place)).alias("rep"), F.min_by("at", F.struct(*place)).alias("at")), f"classes{step}")
        mine = rows if keep_first else rows.filter("m = 1")
        more.append(folded(mine.drop("m"), classes, ["b", "c"]))
        left = scratch.store(classes.join(still_open(classes, "b", keep_first), "b").select(
            "b", "nc", "at", "m", *(f"rep.{c}" for c in place)), f"open{step}")
        hot = left.join(contexts.select("d", "key", "at", "context"), ["d", "key", "at"])
        more.append(compare_pieces(hot.filter(F.col("nc") <= bucket_rows).withColumn("text", F.substring(
            "context", F.col("lo") - F.col("at") + 1, F.col("hi") - F.col("lo") + length)), length, keep_first, parts))
        hot = hot.filter(F.col("nc") > bucket_rows)

    spans = scratch.store(reduce(DataFrame.unionByName, more).groupBy(*row).agg(
        F.collect_list(F.struct("lo", "hi")).alias("more")), "spans")
    pending = resolved.filter(F.col("kind") == PENDING).select(*row, "doc_id", "text", "spans")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_pylist([final_row(
                x["doc_id"], x["text"], [(s["lo"], s["hi"] + length) for s in (x["spans"] or []) + (x["more"] or [])],
                with_text) for x in part.to_pylist()], schema=RESOLVED)

    names = DIGESTS + ["spans", "kept"] * with_text
    late = map_arrow(pending.join(spans, row, "left").select("doc_id", "text", "spans", "more"), finish, RESOLVED_SQL)
    return resolved.filter(F.col("kind") == FINAL).select(*names).unionByName(late.select(*names))
