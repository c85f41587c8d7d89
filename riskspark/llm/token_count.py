"""Token counts with compiled finite-state transducers; no token is ever written out.

Two deterministic machines are composed.

* The word machine reads characters by class and marks where words start.  It has ten
  states, so a chunk of text is a map from the state before it to the state after it.
  All chunks of a batch are read in lockstep from all states at once, the maps compose
  in a parallel prefix scan, and a second reading from the now known states marks the
  starts.  Long texts take no longer than short ones of the same total length.
* The merge machine reads the bytes of a word.  The last token of the encoding of every
  prefix is determined by the prefix: it is the one token that ends there and is
  compatible with the last token of what stands before it.  So a state is the longest
  suffix that starts some token, with the last token and the count at each place in it;
  a transition is annotated with the change of the token count.  Its states number
  many, most are never met: transitions are compiled when first met, and words run in
  lockstep, one table lookup per byte.

Adding up the annotations of a text gives its token count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .bpe import Tokenizer, tokenizer
from .common import id_and_text, map_arrow, slices

# Character classes of the word machine.
LETTER, NUMBER, SPACE, BLANK, SYMBOL, QUOTE, SHORT, R, V, L, E, END, PAD = range(13)
# Its states.
START, WORD, DIGITS, SIGNS, AFTER_SPACE, AFTER_BLANK, QUOTED, QUOTE_R, QUOTE_V, QUOTE_L = range(10)
N_STATES, N_CLASSES = 10, 13
# Outputs of a transition: a word starts at this character, at the one before it.
HERE, BEFORE = 1, 2

CHUNK = 256
MAX_STATES = 1 << 17


@cache
def character_classes() -> np.ndarray:
    """The class of every code point."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    table = np.full(0x110000, SYMBOL, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        table[[ord(c) for c in regex.findall(pattern, every)]] = kind
    for text, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", SHORT), ("r", R), ("v", V), ("l", L), ("e", E)):
        table[[ord(c) for c in text]] = kind
    return table


def word_machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output) of every state and class."""
    following = np.zeros((N_STATES, N_CLASSES), np.uint8)
    output = np.zeros((N_STATES, N_CLASSES), np.uint8)
    letters = (LETTER, SHORT, R, V, L, E)
    # what a character starts when it starts a word
    begins = {c: WORD for c in letters} | {NUMBER: DIGITS, SPACE: AFTER_SPACE, BLANK: AFTER_BLANK, SYMBOL: SIGNS,
                                           QUOTE: QUOTED, END: START}
    goes_on = {WORD: letters, DIGITS: (NUMBER,), SIGNS: (SYMBOL, QUOTE), AFTER_SPACE: (), AFTER_BLANK: (), QUOTED: (),
               START: ()}
    for state, same in goes_on.items():
        for c, begun in begins.items():
            following[state, c], output[state, c] = (state, 0) if c in same else (begun, HERE)
    for state in (AFTER_SPACE, AFTER_BLANK):
        for c in begins:
            if c in (SPACE, BLANK):
                output[state, c] = 0  # the run of blanks goes on
            elif c != END:
                # the last blank of a run leaves it; a space joins what follows
                joined = state == AFTER_SPACE
                output[state, c] = BEFORE if joined else BEFORE | HERE
                if joined and c == QUOTE:
                    following[state, c] = SIGNS
    # a quote that starts a word: a contraction, or a sign
    for c in (SYMBOL, QUOTE):
        following[QUOTED, c], output[QUOTED, c] = SIGNS, 0
    following[QUOTED, SHORT], output[QUOTED, SHORT] = START, 0
    for c, state, last in ((R, QUOTE_R, E), (V, QUOTE_V, E), (L, QUOTE_L, L)):
        following[QUOTED, c], output[QUOTED, c] = state, 0
        # no contraction after all: the letter has started a word
        following[state], output[state] = following[WORD], output[WORD] | BEFORE
        following[state, last], output[state, last] = START, 0
    following[:, PAD], output[:, PAD] = np.arange(N_STATES), 0
    return following, output


def word_starts(classes: np.ndarray) -> np.ndarray:
    """Where words start in a stream of classes, in which END closes every text."""
    n = len(classes)
    chunks = -(-n // CHUNK)
    padded = np.full(chunks * CHUNK, PAD, np.uint8)
    padded[:n] = classes
    steps = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T).astype(np.intp)
    following, output = word_machine()
    flat_next, flat_out = following.ravel(), output.ravel()
    # the map of every chunk: from each state to the state after it
    maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (chunks, 1))
    for step in steps:
        maps = flat_next[maps.astype(np.intp) * N_CLASSES + step[:, None]]
    # inclusive prefix scan of the maps
    reach = 1
    while reach < chunks:
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), axis=1)
        reach *= 2
    state = np.concatenate(([START], maps[:-1, START])).astype(np.intp)
    marks = np.empty((CHUNK, chunks), np.uint8)
    for i, step in enumerate(steps):
        at = state * N_CLASSES + step
        marks[i] = flat_out[at]
        state = flat_next[at].astype(np.intp)
    marks = marks.T.ravel()[:n]
    starts = (marks & HERE).astype(bool)
    starts[:-1] |= (marks[1:] & BEFORE).astype(bool)
    return np.flatnonzero(starts)


class MergeMachine:
    """The byte transducer of a vocabulary, compiled as it is met."""

    def __init__(self, own: Tokenizer):
        self.own = own
        # tokens that merging can build, by their bytes, and every prefix of one
        self.ids = {own.token_bytes[i]: i for i in own.byte_ids}
        for packed in own.pairs.values():
            i = packed & ((1 << 20) - 1)
            self.ids[own.token_bytes[i]] = i
        self.prefixes = {t[:k] for t in self.ids for k in range(len(t) + 1)}
        self.fits: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.table = np.full(1024 * 256, -1, np.int32)
        # the empty prefix: no suffix, no token before it
        self._number((b"", (-1,), (0,)))

    def _number(self, state: tuple) -> int:
        found = self.numbers.get(state)
        if found is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
            if len(self.states) * 256 > len(self.table):
                self.table = np.concatenate((self.table, np.full(len(self.table), -1, np.int32)))
        return found

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when they stand side by side."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            text = self.own.token_bytes[right]
            if left < 0:
                known = self.own.encode_word(text) == (right,)
            else:
                known = self.own.encode_word(self.own.token_bytes[left] + text) == key
            self.fits[key] = known
        return known

    def compile(self, number: int, byte: int) -> int:
        """The packed transition of a state: next state and change of the count."""
        suffix, lasts, counts = self.states[number]
        grown = suffix + bytes((byte,))
        for start in range(len(grown)):
            token = self.ids.get(grown[start:])
            if token is not None and self._compatible(lasts[start], token):
                break
        else:
            raise ValueError("the vocabulary lacks a single byte")
        count = counts[start] + 1  # relative to the count before this byte
        cut = next(k for k in range(len(grown) + 1) if grown[k:] in self.prefixes)
        following = self._number((grown[cut:], (lasts + (token,))[cut:],
                                  tuple(c - count for c in counts[cut:]) + (0,)))
        packed = following << 8 | (count + 128)
        self.table[number << 8 | byte] = packed
        return packed

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of every word; the words run in lockstep, the longest first."""
        if len(self.states) > MAX_STATES:
            self.clear()
        order = np.argsort(-lengths, kind="stable")
        at, left = starts[order], lengths[order]
        state = np.zeros(len(order), np.int64)
        total = np.zeros(len(order), np.int64)
        # words with more than j bytes, for every j
        running = len(order) - np.searchsorted(left[::-1], np.arange(left[0] if len(left) else 0), side="right")
        for j, n in enumerate(running.tolist()):
            key = state[:n] << 8 | data[at[:n] + j]
            packed = self.table[key]
            missing = np.flatnonzero(packed < 0)
            if len(missing):
                for k in np.unique(key[missing]).tolist():
                    self.compile(k >> 8, k & 255)
                packed[missing] = self.table[key[missing]]
            state[:n] = packed >> 8
            total[:n] += (packed & 255) - 128
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out


@cache
def machine(vocabulary: str) -> MergeMachine:
    """One machine per worker; what it has compiled serves later tasks."""
    return MergeMachine(tokenizer(vocabulary))


def count_tokens(texts: list[str], compiled: MergeMachine) -> np.ndarray:
    """Token counts of whole texts.  A special token written out in a text counts as one
    and cuts the text in two."""
    own, extra = compiled.own, np.zeros(len(texts), np.int64)
    parts, owner = [], []
    for i, text in enumerate(texts):
        if own.special_pattern is not None and any(s in text for s in own.specials):
            pieces = own.special_pattern.split(text)
            extra[i] = sum(p in own.specials for p in pieces)
            pieces = [p for p in pieces if p not in own.specials]
        else:
            pieces = [text]
        parts += pieces
        owner += [i] * len(pieces)
    stream = "\0".join(parts) + "\0"
    points = np.frombuffer(stream.encode("utf-32-le"), np.uint32)
    classes = character_classes()[points]
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    classes[ends] = END
    starts = word_starts(classes)
    data = np.frombuffer(stream.encode(), np.uint8)
    width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    offset = np.concatenate(([0], np.cumsum(width)))
    # every END starts a word of its own, which is no word
    real = classes[starts] != END
    stops = np.append(starts[1:], len(points))
    first, last = offset[starts[real]], offset[stops[real]]
    tokens = compiled.counts(data, first, last - first)
    part = np.searchsorted(ends, starts[real])
    return extra + np.bincount(np.array(owner, np.intp)[part], weights=tokens, minlength=len(texts)).astype(np.int64)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    A null or empty text has no bytes and no tokens; repeated rows each get a result; an
    empty table gives none; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = machine(vocabulary)
        for part in slices(batches, "text", 2 << 20):
            counts = count_tokens(part.column("text").to_pylist(), compiled)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.compute.binary_length(part.column("text")).cast(pa.int64()), pa.array(counts)],
                names=["doc_id", "n_bytes", "n_tokens"])

    counted = map_arrow(id_and_text(docs, id_col, text_col), run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
