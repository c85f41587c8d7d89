"""Byte-level BPE over overlapping chunks, by a file of ranks.

A long text is cut into chunks that overlap.  Every chunk is pre-tokenised on its own,
from its own start, by whatever task holds it.  Two neighbours resynchronise at the first
position of their overlap where both start a pre-token: the pattern looks ahead only, so
from there on both cut alike.  The pieces between those positions are then encoded
independently.  Where a pre-token spans a whole overlap the neighbours become one larger
chunk, and their borders are looked for again, until every border is found.  Decoding
concatenates the raw bytes of the tokens.

Short texts are one chunk and take one narrow pass.  Long texts are encoded once for each
different text, however many rows repeat it.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import COMMON_PATTERN, WORD_PATTERN, uncommon
from .common import Scratch, id_and_text, map_arrow, slices

NO_RANK = 1 << 40

# Bytes above which merging takes a heap instead of scanning for the minimum: the same
# merges in the same order, without the square of the length.
SCANNED_BYTES = 128

# Words that a worker remembers; beyond them it starts anew.
REMEMBERED_WORDS = 200_000

# Characters of a chunk, and how far it reaches into the next one.
CHUNK, OVERLAP = 1 << 15, 1 << 10

# A match may depend on the character behind it, and on two behind an apostrophe.
LOOKAHEAD = 3


class Ranks:
    """A rank file (one base64 token and its rank a line) and a pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in rows}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, self.ranks), default=0)
        self.wide = regex.compile(pattern)
        self.narrow = COMMON_PATTERN if pattern == WORD_PATTERN else None
        self.odd = uncommon()
        self.words: dict[str, bytes] = {}

    def pattern(self, text: str):
        return self.wide if self.narrow is None or self.odd.search(text) else self.narrow

    def _rank(self, word: bytes, start: int, end: int) -> int:
        return NO_RANK if end - start > self.longest else self.ranks.get(word[start:end], NO_RANK)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the lowest rank goes first, of equal ones the leftmost."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        if len(word) > SCANNED_BYTES:
            return self._merge_long(word)
        cuts = list(range(len(word) + 1))
        scores = [self._rank(word, i, i + 2) for i in range(len(word) - 1)]
        while scores and (low := min(scores)) < NO_RANK:
            i = scores.index(low)
            del cuts[i + 1], scores[i]
            if i:
                scores[i - 1] = self._rank(word, cuts[i - 1], cuts[i + 1])
            if i < len(scores):
                scores[i] = self._rank(word, cuts[i], cuts[i + 2])
        return [self.ranks[word[a:b]] for a, b in zip(cuts, cuts[1:])]

    def _merge_long(self, word: bytes) -> list[int]:
        n = len(word)
        # end[i]: where the part that starts at i ends, 0 where none starts
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self._rank(word, i, i + 2)) < NO_RANK]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := self._rank(word, i, end[stop])) < NO_RANK:
                    heapq.heappush(heap, (r, i, end[stop]))
            k = before[i]
            if k >= 0 and (r := self._rank(word, k, stop)) < NO_RANK:
                heapq.heappush(heap, (r, k, stop))
        return [self.ranks[word[i:e]] for i, e in enumerate(end) if e]

    def packed(self, words: list[str]) -> bytes:
        """The ids of pre-tokens as little-endian unsigned 32-bit integers."""
        out, known = [], self.words
        for word in words:
            ids = known.get(word)
            if ids is None:
                ids = np.array(self.merge(word.encode()), dtype="<u4").tobytes()
                if len(word) <= 64:
                    if len(known) >= REMEMBERED_WORDS:
                        known.clear()
                    known[word] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        return self.packed(self.pattern(text).findall(text))

    def starts(self, text: str) -> tuple[list[int], int]:
        """Where pre-tokens start, and up to where those starts hold whatever follows."""
        ends = [m.end() for m in self.pattern(text).finditer(text)]
        held = max((e for e in ends[-LOOKAHEAD - 1:] if e + LOOKAHEAD <= len(text)), default=0)
        return [0, *ends], held

    def encode_between(self, text: str, start: int, end: int) -> bytes:
        """Ids of the pre-tokens that start in [start, end)."""
        words = []
        for match in self.pattern(text).finditer(text, start):
            if match.start() >= end:
                break
            words.append(match.group())
        return self.packed(words)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


@cache
def ranks_of(path: str, pattern: str) -> Ranks:
    """One vocabulary per worker, whatever the number of tasks it runs."""
    return Ranks(path, pattern)


def cut_texts(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, part, core, text) of (key, text): chunk number ``part`` has ``core``
    characters of its own and reaches up to ``overlap`` into the next one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                starts = range(0, len(text), chunk)
                for first in range(0, len(starts), 64):
                    some = starts[first:first + 64]
                    yield pa.RecordBatch.from_pydict({
                        "key": pa.array([key] * len(some), pa.string()),
                        "part": pa.array(range(first, first + len(some)), pa.int64()),
                        "core": pa.array([min(chunk, len(text) - s) for s in some], pa.int64()),
                        "text": pa.array([text[s:s + chunk + overlap] for s in some], pa.string())})

    return map_arrow(texts, run, "key string, part long, core long, text string")


def borders(chunks: DataFrame, vocabulary: str, pattern: str, overlap: int) -> DataFrame:
    """(key, part, core, start, stop): the piece of each chunk, from its first common
    pre-token start with the chunk before to the next one's; ``start`` is null where the
    overlap has none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ranks_of(vocabulary, pattern)
        for batch in slices(batches, "text"):
            heads, tails = [], []
            for core, text in zip(batch.column("core").to_pylist(), batch.column("text").to_pylist()):
                starts, held = own.starts(text)
                heads.append([s for s in starts if s < overlap])
                tails.append([s - core for s in starts if core <= s <= held])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "part", "core")),
                 *(pa.array(x, pa.list_(pa.int64())) for x in (heads, tails))],
                names=["key", "part", "core", "head", "tail"])

    seen = map_arrow(chunks, run, "key string, part long, core long, head array<long>, tail array<long>")
    order = Window.partitionBy("key").orderBy("part")
    common = F.array_min(F.array_intersect(F.lag("tail").over(order), F.col("head")))
    seen = seen.select("key", "part", "core", F.when(F.row_number().over(order) == 1, 0).otherwise(common).alias("start"),
                       F.lead("part").over(order).isNull().alias("last"))
    stop = F.when(F.col("last"), F.col("core")).otherwise(F.col("core") + F.lead("start").over(order))
    return seen.select("key", "part", "core", "start", stop.alias("stop"))


def joined_chunks(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """Chunks whose border with the one before was not found become one with it."""
    order = Window.partitionBy("key").orderBy("part")
    runs = found.select("key", "part", F.count("start").over(order).alias("run"))
    piece = F.struct("part", "core", "text")
    grouped = (chunks.join(runs, ["key", "part"]).groupBy("key", "run")
               .agg(F.sort_array(F.collect_list(piece)).alias("parts")))
    own = F.transform(F.slice("parts", 1, F.size("parts") - 1), lambda p: p.text.substr(F.lit(1), p.core.cast("int")))
    return grouped.select("key", F.col("parts")[0]["part"].alias("part"),
                          F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p.core).alias("core"),
                          F.array_join(F.concat(own, F.array(F.element_at("parts", -1)["text"])), "").alias("text"))


def encode_long(texts: DataFrame, vocabulary: str, pattern: str, chunk: int, overlap: int,
                scratch: Scratch) -> DataFrame:
    """(key, ids) of (key, text): chunks in parallel, stitched, pieces in parallel."""
    chunks = scratch.store(cut_texts(texts, chunk, overlap).dropDuplicates(["key", "part"]), "chunks-0")
    for round_no in range(1, 1 << 30):
        found = scratch.store(borders(chunks, vocabulary, pattern, overlap), f"borders-{round_no}")
        if found.where("start is null").isEmpty():
            break
        # fewer chunks each time, at the end one for each text
        chunks = scratch.store(joined_chunks(chunks, found), f"chunks-{round_no}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ranks_of(vocabulary, pattern)
        for batch in slices(batches, "text"):
            spans = zip(*(batch.column(c).to_pylist() for c in ("text", "start", "stop")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("part"),
                 pa.array([own.encode_between(*span) for span in spans], pa.binary())], names=["key", "part", "ids"])

    pieces = map_arrow(chunks.join(found.drop("core"), ["key", "part"]), run, "key string, part long, ids binary")
    ordered = F.sort_array(F.collect_list(F.struct("part", "ids")))
    whole = F.unhex(F.array_join(F.transform(ordered, lambda p: F.hex(p.ids)), ""))
    return pieces.groupBy("key").agg(whole.alias("ids"))


def encode(docs: DataFrame, vocabulary: str, pattern: str = WORD_PATTERN, id_col: str = "doc_id",
           text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, decoded: bool = False) -> DataFrame:
    """(doc_id, ids): whole texts as ids, packed as little-endian unsigned 32-bit integers.
    ``decoded`` adds the bytes that the ids decode to, in the step that makes the ids.

    A null or empty text has no ids (an empty binary); a null id stays null; repeated
    rows each get theirs; texts of any length are encoded whole; an empty table gives no
    rows; other columns are not read, so their names cannot clash.
    """
    if not LOOKAHEAD < overlap <= chunk:
        raise ValueError("an overlap is longer than what a match looks ahead, and at most a chunk")
    rows = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ranks_of(vocabulary, pattern)
        for batch in slices(batches, "text"):
            ids = [own.encode(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array([own.decode(i) for i in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][:len(columns)])

    short = map_arrow(rows.where(F.length("text") <= chunk), run,
                      "doc_id long, ids binary" + (", decoded binary" if decoded else ""))
    scratch = Scratch(docs.sparkSession, "chunked-bpe")
    keyed = rows.where(F.length("text") > chunk).select("doc_id", F.sha2("text", 256).alias("key"), "text")
    coded = scratch.store(encode_long(keyed.select("key", "text"), vocabulary, pattern, chunk, overlap, scratch), "coded")
    long = keyed.select("doc_id", "key").join(coded, "key").select("doc_id", "ids")
    return short.unionByName(decode(long, vocabulary, pattern) if decoded else long)


def decode(encoded: DataFrame, vocabulary: str, pattern: str = WORD_PATTERN) -> DataFrame:
    """(doc_id, ids, decoded): the raw bytes of the tokens, concatenated; null ids have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ranks_of(vocabulary, pattern)
        for batch in slices(batches, "ids"):
            texts = [own.decode(ids or b"") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str = WORD_PATTERN, **options) -> DataFrame:
    """(doc_id, ids, decoded): every text encoded, and decoded again from its ids."""
    return encode(docs, vocabulary, pattern, decoded=True, **options)
