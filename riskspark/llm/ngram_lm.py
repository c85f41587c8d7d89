"""LM scoring: an interpolated modified Kneser-Ney bigram model.

The model is counted in Spark and stored as sorted arrays in the shared folder, which
workers memory-map: no worker and no broadcast holds it.

* Vocabulary: words are counted per task, then per hash; every shard of the hash space
  becomes a sorted array of 64-bit hashes with its counts.  A word's number is its place
  in those arrays.
* Pairs: every task packs its distinct (context, word) numbers with their counts into one
  block per shard; a shard merges its blocks and becomes a sorted array of pair keys with
  counts.  Shards go by context.  A context above a share of all tokens (there are only so
  many) is spread over all shards by pair, so none of them holds a hot one.
* Statistics: shards emit, packed by block of word numbers, the totals and the numbers of
  followers seen once, twice and more per context, and the number of contexts per word.

Scoring reads each text once more and looks its sorted distinct pairs up.  Files are named
by shard and written whole, so a repeated task writes the same file again.
"""

from __future__ import annotations

import os
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, hash_parts, id_and_text, map_arrow, mappable, slices, write_bytes

BLOCK_BITS = 18
BLOCK = 1 << BLOCK_BITS
STATS = np.dtype([("total", "<f8"), ("words", "<u4"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4")])
END_WORD = b""
REMEMBERED_WORDS = 300_000
# Pairs that a counting task holds before it packs them.
HELD_PAIRS = 3_000_000
FULL = 255


def learns(id_col: Column) -> Column:
    """Rows that the model learns from; the others are held out."""
    return F.crc32(id_col.cast("string")) % 7 != 2


def tokens(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased, and the end of the text."""
    return text.lower().split() + [END_WORD]


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def mix(a: np.ndarray) -> np.ndarray:
    """Spread numbers over 64 bits."""
    a = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return a ^ (a >> np.uint64(29))


def pack(*columns: np.ndarray) -> bytes:
    """Unsigned integer columns of one length, the first sorted: differences of the
    first, byte planes of all, compressed."""
    parts = [struct.pack("<II", len(columns), len(columns[0]))]
    for i, column in enumerate(columns):
        column = column.astype("<u8")
        if i == 0 and len(column):
            column = np.concatenate((column[:1], column[1:] - column[:-1]))
        planes = np.ascontiguousarray(column.view(np.uint8).reshape(-1, 8).T).tobytes()
        packed = pa.compress(planes, "zstd", asbytes=True)
        parts += [struct.pack("<I", len(packed)), packed]
    return b"".join(parts)


def unpack(data: bytes) -> list[np.ndarray]:
    n_columns, n = struct.unpack_from("<II", data)
    at, columns = 8, []
    for i in range(n_columns):
        (size,) = struct.unpack_from("<I", data, at)
        planes = pa.decompress(data[at + 4:at + 4 + size], n * 8, "zstd", asbytes=True)
        column = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view("<u8").ravel()
        columns.append(np.cumsum(column, dtype=np.uint64) if i == 0 else column)
        at += 4 + size
    return columns


@cache
def mapped(uri: str, kind: str) -> np.ndarray:
    """A stored array, memory-mapped once per worker."""
    path, copy = mappable(uri)
    found = np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)
    if copy:
        os.unlink(path)
    return found


@dataclass(frozen=True)
class Vocabulary:
    """Where words live: shards of the hash space, and the number before each shard."""

    path: str
    sizes: tuple[int, ...]
    n_tokens: int

    @property
    def size(self) -> int:
        return sum(self.sizes)

    @property
    def begin(self) -> int:
        """The number that stands for the begin of a text, a context only."""
        return self.size

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count) of every hash."""
        order = np.argsort(hashes)
        ranked, offsets = hashes[order], np.cumsum([0, *self.sizes])
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shards = shard_of_hash(ranked, len(self.sizes))
        edges = np.searchsorted(shards, np.arange(len(self.sizes) + 1))
        for s in np.unique(shards).tolist():
            part = slice(edges[s], edges[s + 1])
            known = mapped(f"{self.path}/vocabulary-{s}.hash", "<u8")
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, ranked[part]), len(known) - 1)
            hit = known[at] == ranked[part]
            number[order[part]] = np.where(hit, at + offsets[s], -1)
            count[order[part]] = np.where(hit, mapped(f"{self.path}/vocabulary-{s}.count", "<i8")[at], 0)
        return number, count


def shard_of_hash(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Equal stretches of the hash space, so shards are sorted among themselves."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


class Words:
    """Numbers and counts of words, remembered for a bounded number of them."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[bytes, int] = {}
        self.number, self.count = np.empty(0, np.int64), np.empty(0, np.int64)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count) of every word."""
        if len(self.known) > REMEMBERED_WORDS:
            self.known, self.number, self.count = {}, self.number[:0], self.count[:0]
        new = list(set(words) - self.known.keys())
        if new:
            number, count = self.vocabulary.lookup(np.array(list(map(word_hash, new)), np.uint64))
            self.known.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.number = np.concatenate((self.number, number))
            self.count = np.concatenate((self.count, count))
        place = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return self.number[place], self.count[place]


def pair_shard(keys: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """The shard of pair keys: by context, or by the pair where the context is hot."""
    context = keys >> np.uint64(32)
    spread = np.isin(context, hot)
    return (mix(np.where(spread, keys, context)) % np.uint64(shards)).astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def pair_keys(lists: list[list[bytes]], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens of some texts: context numbers, word numbers, word counts, lengths."""
    flat = [w for one in lists for w in one]
    number, count = words.of(flat)
    lengths = np.array([len(one) for one in lists], np.int64)
    context = np.empty_like(number)
    context[1:] = number[:-1]
    context[np.cumsum(lengths) - lengths] = words.vocabulary.begin
    return context, number, count, lengths


def build_vocabulary(train: DataFrame, scratch: Scratch, shards: int) -> Vocabulary:
    """Count words and write the sorted hash arrays."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            hashes = np.array(list(map(word_hash, held)), np.uint64).view(np.int64)
            out = pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(list(held.values()), pa.int64())], names=["h", "n"])
            held.clear()
            return out

        for part in slices(batches, "text"):
            for text in part.column("text").cast(pa.binary()).to_pylist():
                held.update(tokens(text))
            if len(held) > REMEMBERED_WORDS:
                yield flush()
        yield flush()

    counted = map_arrow(train, count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    # the same stretches as shard_of_hash
    high = F.shiftrightunsigned(F.col("h"), 32)
    placed = counted.withColumn("shard", F.shiftrightunsigned(high * shards, 32).cast("int")).repartition(
        shards, "shard").sortWithinPartitions("shard")
    base = scratch.path

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, table in by_shard(batches, "shard"):
            hashes = table.column("h").to_numpy().view(np.uint64)
            counts = table.column("n").to_numpy()
            order = np.argsort(hashes)
            write_bytes(f"{base}/vocabulary-{shard}.hash", hashes[order].astype("<u8").tobytes())
            write_bytes(f"{base}/vocabulary-{shard}.count", counts[order].astype("<i8").tobytes())
            yield pa.RecordBatch.from_pydict({"shard": [shard], "size": [len(hashes)], "total": [int(counts.sum())]})

    rows = scratch.store(map_arrow(placed.select("shard", "h", "n"), write, "shard long, size long, total long"), "vocabulary")
    found = {r.shard: (r["size"], r.total) for r in rows.collect()}  # one row per shard
    for s in range(shards):
        if s not in found:
            for kind in ("hash", "count"):
                write_bytes(f"{base}/vocabulary-{s}.{kind}", b"")
    sizes = tuple(found.get(s, (0, 0))[0] for s in range(shards))
    if sum(sizes) >= 1 << 32:
        raise ValueError("pair keys hold word numbers below 2**32")
    return Vocabulary(base, sizes, sum(t for _, t in found.values()))


def by_shard(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.Table]]:
    """Rows of a partition sorted by ``column``, one table per value."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        values = batch.column(column).to_numpy()
        edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            if current is not None and int(values[a]) != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = int(values[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held)


def hot_contexts(vocabulary: Vocabulary, scratch: Scratch, spark, shards: int) -> np.ndarray:
    """Numbers of contexts with more than 1 / (4 * shards) of all tokens, at most
    4 * shards, and the begin of a text."""
    base, limit = scratch.path, max(1, vocabulary.n_tokens // (4 * shards))
    offsets = np.cumsum([0, *vocabulary.sizes])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column("id").to_pylist():
                counts = mapped(f"{base}/vocabulary-{s}.count", "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(counts > limit) + offsets[s])], names=["number"])

    rows = map_arrow(spark.range(0, shards, 1, min(shards, 64)), scan, "number long").collect()
    return np.array([r.number for r in rows] + [vocabulary.begin], np.uint64)


def count_pairs(train: DataFrame, vocabulary: Vocabulary, hot: np.ndarray, scratch: Scratch, shards: int) -> DataFrame:
    """Write the pair arrays; return packed statistics by block of word numbers:
    (block, contexts, words, n1, n2, n3, n4)."""
    base = scratch.path

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(vocabulary)
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys = np.concatenate(held) if held else np.empty(0, np.uint64)
            held.clear()
            keys, counts = summed(keys, np.ones(len(keys), np.int64))
            shard = pair_shard(keys, hot, shards)
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            used = [s for s in range(shards) if edges[s] < edges[s + 1]]
            blocks = [pack(keys[order[edges[s]:edges[s + 1]]], counts[order[edges[s]:edges[s + 1]]]) for s in used]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(blocks, pa.binary())], names=["shard", "block"])

        for part in slices(batches, "text"):
            lists = [tokens(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
            context, number, _, _ = pair_keys(lists, words)
            held.append(context.astype(np.uint64) << np.uint64(32) | number.astype(np.uint64))
            if sum(map(len, held)) > HELD_PAIRS:
                yield flush()
        yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, table in by_shard(batches, "shard"):
            keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
            waiting: list[list[np.ndarray]] = []
            blocks = table.column("block").to_pylist()
            for i, block in enumerate(blocks):
                waiting.append(unpack(block))
                # merge as it comes, so that distinct pairs only are held
                if sum(len(w[0]) for w in waiting) > 2_000_000 or i == len(blocks) - 1:
                    keys, counts = summed(np.concatenate([keys, *(w[0] for w in waiting)]),
                                          np.concatenate([counts, *(w[1].astype(np.int64) for w in waiting)]))
                    waiting = []
            write_bytes(f"{base}/pairs-{shard}.key", keys.astype("<u8").tobytes())
            write_bytes(f"{base}/pairs-{shard}.n", np.minimum(counts, FULL).astype("u1").tobytes())
            large = counts >= FULL
            write_bytes(f"{base}/pairs-{shard}.large", np.stack((keys[large], counts[large].astype(np.uint64))).astype("<u8").tobytes())
            context, word = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
            first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
            per_context = [context[first], *(np.add.reduceat(x, first).astype(np.uint64) for x in (
                counts, counts == 1, counts == 2, counts >= 3))]
            per_word = np.unique(word, return_counts=True)
            seen = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
            c_block, w_block = per_context[0] >> np.uint64(BLOCK_BITS), per_word[0] >> np.uint64(BLOCK_BITS)
            for b in np.union1d(c_block, w_block).tolist():
                c, w = slice(*np.searchsorted(c_block, [b, b + 1])), slice(*np.searchsorted(w_block, [b, b + 1]))
                yield pa.RecordBatch.from_pydict({
                    "block": [int(b)], "contexts": [pack(*(x[c] for x in per_context))],
                    "words": [pack(per_word[0][w], per_word[1][w].astype(np.uint64))]} | {
                    f"n{k}": [n] for k, n in enumerate(seen, 1)})
                seen = [0, 0, 0, 0]  # once per shard

    packed = map_arrow(train, count, "shard long, block binary")
    placed = packed.repartition(shards, "shard").sortWithinPartitions("shard")
    return map_arrow(placed, merge, "block long, contexts binary, words binary, n1 long, n2 long, n3 long, n4 long")


def write_statistics(stats: DataFrame, scratch: Scratch, parts: int) -> DataFrame:
    """Write one array of STATS per block; return (block, types, n1 .. n4): how many
    pairs, and how many words follow one, two, three, four contexts."""
    base = scratch.path

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in by_shard(batches, "block"):
            out = np.zeros(BLOCK, STATS)
            first = np.uint64(block << BLOCK_BITS)
            for row in table.select(["contexts", "words"]).to_batches(max_chunksize=64):
                for contexts, words in zip(row.column(0).to_pylist(), row.column(1).to_pylist()):
                    number, *values = unpack(contexts)
                    at = (number - first).astype(np.intp)  # distinct within one row
                    for name, value in zip(("total", "n1", "n2", "n3"), values):
                        out[name][at] += value.astype(out[name].dtype)
                    number, value = unpack(words)
                    out["words"][(number - first).astype(np.intp)] += value.astype("<u4")
            write_bytes(f"{base}/stats-{block}", out.tobytes())
            yield pa.RecordBatch.from_pydict({"block": [block], "types": [int(out["words"].sum(dtype=np.int64))]} | {
                f"n{k}": [int((out["words"] == k).sum())] for k in (1, 2, 3, 4)} | {"more": [int((out["words"] >= 3).sum())]})

    placed = stats.repartition(parts, "block").sortWithinPartitions("block")
    return map_arrow(placed.select("block", "contexts", "words"), write,
                     "block long, types long, n1 long, n2 long, n3 long, n4 long, more long")


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2, 3 and more, from the numbers of
    n-grams counted once to four times.  Where those are missing, one half."""
    n1, n2, n3, n4 = map(float, n)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    d1 = 1 - 2 * y * n2 / n1 if n1 else 0.5
    d2 = 2 - 3 * y * n3 / n2 if n2 else 0.5
    d3 = 3 - 4 * y * n4 / n3 if n3 else 0.5
    return np.array([0.0, np.clip(d1, 0.05, 0.95), np.clip(d2, 0.05, 1.9), np.clip(d3, 0.05, 2.9)])


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    hot: np.ndarray
    shards: int
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    types: int  # distinct pairs
    word_rest: float  # weight of the uniform part of the word level

    def pair_counts(self, context: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Counts of pairs; 0 where the context or the word is unknown."""
        out = np.zeros(len(context), np.int64)
        valid = np.flatnonzero((context >= 0) & (number >= 0))
        keys = context[valid].astype(np.uint64) << np.uint64(32) | number[valid].astype(np.uint64)
        distinct, back = np.unique(keys, return_inverse=True)
        shard = pair_shard(distinct, self.hot, self.shards)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(self.shards + 1))
        counts = np.zeros(len(distinct), np.int64)
        for s in np.unique(shard).tolist():
            place = order[edges[s]:edges[s + 1]]
            known = mapped(f"{self.vocabulary.path}/pairs-{s}.key", "<u8")
            if not len(known):
                continue
            asked = distinct[place]
            at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
            hit = known[at] == asked
            got = np.where(hit, mapped(f"{self.vocabulary.path}/pairs-{s}.n", "u1")[at].astype(np.int64), 0)
            full = np.flatnonzero(got == FULL)
            if len(full):
                large = mapped(f"{self.vocabulary.path}/pairs-{s}.large", "<u8").reshape(2, -1)
                got[full] = large[1][np.searchsorted(large[0], asked[full])]
            counts[place] = got
        out[valid] = counts[back]
        return out

    def statistics(self, numbers: np.ndarray) -> np.ndarray:
        """STATS of word numbers; zeros for unknown ones."""
        distinct, back = np.unique(numbers, return_inverse=True)
        out = np.zeros(len(distinct), STATS)
        block = distinct >> BLOCK_BITS
        for b in np.unique(block[distinct >= 0]).tolist():
            inside = block == b
            out[inside] = mapped(f"{self.vocabulary.path}/stats-{b}", STATS)[distinct[inside] & (BLOCK - 1)]
        return out[back]

    def probabilities(self, context: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Probability of every word after its context; numbers are -1 where unknown."""
        seen = self.statistics(number)["words"].astype(np.int64)
        types = max(self.types, 1)
        word = (seen - self.word_discounts[np.minimum(seen, 3)]) / types + self.word_rest / (self.vocabulary.size + 1)
        stats = self.statistics(context)
        total = stats["total"]
        count = self.pair_counts(context, number)
        d = self.pair_discounts
        rest = d[1] * stats["n1"] + d[2] * stats["n2"] + d[3] * stats["n3"]
        with np.errstate(divide="ignore", invalid="ignore"):
            pair = (count - d[np.minimum(count, 3)] + rest * word) / total
        return np.where(total > 0, pair, word)


def fit(train: DataFrame, scratch: Scratch, shards: int) -> Model:
    """Count a model from (doc_id, text) rows."""
    spark = train.sparkSession
    vocabulary = build_vocabulary(train, scratch, shards)
    hot = hot_contexts(vocabulary, scratch, spark, shards)
    stats = scratch.store(count_pairs(train, vocabulary, hot, scratch, shards), "statistics")
    seen = stats.agg(*(F.sum(f"n{k}") for k in (1, 2, 3, 4))).first()
    pairs = discounts([x or 0 for x in seen])
    blocks = scratch.store(write_statistics(stats, scratch, shards), "blocks")
    total = blocks.agg(*(F.sum(c) for c in ("types", "n1", "n2", "n3", "n4", "more"))).first()
    types, n1, n2, n3, n4, more = [x or 0 for x in total]
    words = discounts([n1, n2, n3, n4])
    rest = (words[1] * n1 + words[2] * n2 + words[3] * more) / types if types else 1.0
    # blocks and shards that hold nothing have empty files
    have = {r.block for r in blocks.select("block").collect()}  # one row per 2**18 words
    for b in range((vocabulary.begin >> BLOCK_BITS) + 1):
        if b not in have:
            write_bytes(f"{scratch.path}/stats-{b}", np.zeros(BLOCK, STATS).tobytes())
    for name in ("vocabulary", "statistics", "blocks"):
        scratch.drop(name)  # the arrays hold it
    return Model(vocabulary, hot, shards, pairs, words, types, rest)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of (doc_id, text)."""
    n, v = model.vocabulary.n_tokens, model.vocabulary.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model.vocabulary)
        for part in slices(batches, "text"):
            lists = [tokens(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
            context, number, count, lengths = pair_keys(lists, words)
            starts = np.cumsum(lengths) - lengths
            base = np.add.reduceat(np.log10((count + 1) / (n + v + 1)), starts)
            own = np.add.reduceat(np.log10(model.probabilities(context, number)), starts)
            known = np.add.reduceat((count > 0).astype(np.int64), starts)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *map(pa.array, (lengths, known, base, own))],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return map_arrow(docs, run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, perplexity.

    * The model learns from rows that are not held out; a row with a null id is not learnt
      from and not held out.
    * A null or empty text has one token, its end.  Repeated rows count as often as they
      stand there.  Without a training row every token is unknown: probability one for
      the only type there is.  An empty table gives no rows.
    """
    rows = id_and_text(docs, id_col, text_col)
    scratch, shards = Scratch(docs.sparkSession, "lm"), hash_parts(docs.sparkSession)
    model = fit(rows.filter(learns(F.col("doc_id"))), scratch, shards)
    return score(rows, model).select(
        "doc_id", F.coalesce(~learns(F.col("doc_id")), F.lit(False)).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.vocabulary.n_tokens).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
