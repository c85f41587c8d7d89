"""BPE encoding and decoding with a contiguous rank array per word.

A text is cut into words by the tokenizer's pattern.  A word is a list of part
boundaries with the ids between them, and beside it the contiguous array of ranks of
adjacent parts.  Encoding scans that array for its minimum, deletes the boundary
between the two parts, and refreshes the two ranks next to it, until no pair has a
rank.  Words repeat, so each worker keeps the results of a bounded number of words.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .common import id_and_text, map_arrow, release_memory, slices

NO_RANK = 1 << 62
ID_BITS = 20
ID_MASK = (1 << ID_BITS) - 1

# Parts above which the scan for the minimum gives way to a heap: same merges in the
# same order, without the square of the length.
SHORT_WORD = 128

# Words that a worker remembers: those of the running and of the last generation.
REMEMBERED_WORDS = 150_000

# FIXED VALUES: the pattern of byte-level tokenizers that cuts a text into words.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# The same pattern for the standard library, twice as fast, and the characters whose class
# differs there (other numbers, separators): texts with one of those take the first form.
COMMON_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


@cache
def uncommon() -> re.Pattern:
    """One character that the two patterns put into different classes, or any beyond the
    basic plane."""
    kinds = ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s"))
    every = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    odd: set[str] = set()
    for wide, narrow in kinds:
        odd |= set(regex.findall(wide, every)) ^ set(re.findall(narrow, every))
    return re.compile("[" + "".join(map(re.escape, sorted(odd))) + "\U00010000-\U0010FFFF]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in vocabulary files of byte-level tokenizers:
    printable Latin-1 characters stand for themselves, the rest follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Tokenizer:
    """A byte-level BPE vocabulary file (tokenizers JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.byte_ids = [vocab[s] for s in symbols]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        # (left id, right id) -> rank and merged id in one number, smallest rank first
        self.pairs: dict[int, int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs.setdefault(vocab[a] << ID_BITS | vocab[b], rank << ID_BITS | vocab[a + b])
        value = {s: b for b, s in enumerate(symbols)}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(map(value.__getitem__, token)) if all(c in value for c in token) else token.encode()
        for token, i in self.specials.items():
            self.token_bytes[i] = token.encode()
        self.pattern = regex.compile(WORD_PATTERN)
        by_length = sorted(self.specials, key=len, reverse=True)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if by_length else None
        self.odd = uncommon()
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > SHORT_WORD:
            return self._encode_long(ids)
        get = self.pairs.get
        bounds = list(range(len(ids) + 1))
        ranks = [get(a << ID_BITS | b, NO_RANK) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)
            # the boundary between parts i and i + 1 goes
            del bounds[i + 1], ids[i + 1], ranks[i]
            ids[i] = low & ID_MASK
            if i:
                ranks[i - 1] = get(ids[i - 1] << ID_BITS | ids[i], NO_RANK)
            if i < len(ranks):
                ranks[i] = get(ids[i] << ID_BITS | ids[i + 1], NO_RANK)
        return tuple(ids)

    def _encode_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same merges for a long word: a heap of (rank, place) over linked parts."""
        get, n = self.pairs.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def candidate(i: int):
            j = after[i]
            return (get(ids[i] << ID_BITS | ids[j], NO_RANK), i, ids[i], ids[j]) if j < n else (NO_RANK, i, 0, 0)

        heap = [c for c in map(candidate, range(n)) if c[0] != NO_RANK]
        heapq.heapify(heap)
        while heap:
            low, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = low & ID_MASK, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (c := candidate(k))[0] != NO_RANK:
                    heapq.heappush(heap, c)
        return tuple(i for i in ids if i >= 0)

    def _learn(self, word: str) -> tuple[int, ...]:
        """Ids of a word that the running generation does not know."""
        ids = self.older.get(word) or self.encode_word(word.encode())
        if len(word) <= 64:
            if len(self.words) >= REMEMBERED_WORDS:
                self.older, self.words = self.words, {}
            self.words[word] = ids
        return ids

    def _encode_plain(self, text: str, out: list[int]) -> None:
        extend = out.extend
        pattern = self.pattern if self.odd.search(text) else COMMON_PATTERN
        words = pattern.findall(text)
        known = self.words.get
        for word in words:
            ids = known(word)
            if ids is None:
                ids = self._learn(word)
                known = self.words.get
            extend(ids)

    def encode(self, text: str) -> list[int]:
        """Ids of a text; special tokens written out in it become their ids."""
        out: list[int] = []
        if self.special_pattern is None or not any(s in text for s in self.specials):
            self._encode_plain(text, out)
            return out
        for part in self.special_pattern.split(text):
            if part in self.specials:
                out.append(self.specials[part])
            elif part:
                self._encode_plain(part, out)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids (special tokens kept); bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@cache
def tokenizer(path: str) -> Tokenizer:
    """One vocabulary per worker, whatever the number of tasks it runs."""
    return Tokenizer(path)


def _ragged(lists: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
    flat = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of whole texts, in one stage without a shuffle.

    A null or empty text has no ids; repeated rows each get theirs; an empty table
    gives no rows; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)
        for part in slices(batches, "text"):
            ids = [own.encode(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _ragged(ids)], names=["doc_id", "ids"])

    return map_arrow(id_and_text(docs, id_col, text_col), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, keep_ids: bool = True) -> DataFrame:
    """(doc_id, [ids,] decoded) from (doc_id, ids).  Null ids decode to an empty text."""
    names = ["doc_id", "ids", "decoded"] if keep_ids else ["doc_id", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)
        for batch in batches:
            # 1,000 rows at a time keep the ids and texts at hand few
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                ids = part.column("ids")
                ends = np.cumsum([0, *pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_pylist()])
                flat = ids.flatten().to_numpy()
                texts = [own.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])]
                columns = [part.column("doc_id"), ids, pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns if keep_ids else [columns[0], columns[2]], names=names)

    schema = "doc_id long, ids array<int>, decoded string" if keep_ids else "doc_id long, decoded string"
    return map_arrow(encoded.select("doc_id", "ids"), run, schema)


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): every text encoded, and decoded again from its ids.

    One worker a core does both: two steps would be two workers at a time, each with
    the tables of the tokenizer, and the ids would travel between them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)
        for part in slices(batches, "text", 1 << 20):
            ids = [own.encode(t) for t in part.column("text").to_pylist()]
            decoded = pa.array([own.decode(i) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _ragged(ids), decoded],
                                             names=["doc_id", "ids", "decoded"])
        release_memory()

    return map_arrow(id_and_text(docs, id_col, text_col), run, "doc_id long, ids array<int>, decoded string")


def digest_columns() -> list[Column]:
    """n_tokens, ids_sha256 and decoded_sha256 of the columns ids and decoded."""
    return [F.size("ids").cast("long").alias("n_tokens"),
            F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
            F.sha2(F.col("decoded"), 256).alias("decoded_sha256")]


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, ids, decoded)."""
    return encoded.select("doc_id", *digest_columns())
