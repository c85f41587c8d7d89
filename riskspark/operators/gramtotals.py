"""TF-IDF totals per term without a row per gram.

Texts are dealt to parts of bounded size.  A worker numbers the terms of its part, so the
grams of a slice of texts are numbers that one sort turns into term counts.  A part sends
88 bits of each term and how many of its texts hold it.  What all parts hold comes back to
each for its own terms, ahead of its texts, and the part sends the sum and the largest
weight of each term.  Terms travel packed, one row per part and range of hashes: hashes as
differences in order, names in order and compressed.  No vocabulary stands in one place.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from . import textml

# Terms and cached grams that a worker numbers before it sends them and starts anew.
HELD_TERMS = 1 << 21
HELD_GRAMS = 1 << 23
SENT_TERMS = 1 << 19  # terms that a task counts at a time, where texts are rows
SLICE_ROWS = 250
SLICE_TOKENS = 1 << 18
PART_BYTES = 8 << 20  # of text in a part
RANGE_BYTES = 4 << 20  # of text for each range of hashes
MERGED_ROWS = 1 << 20
OUT_ROWS = 1 << 16
COUNT_BITS = 28
KINDS = ("word", "char")


class Terms:
    """Numbers of the terms that a worker has met."""

    def __init__(self):
        self.names: list[str] = []
        self.kinds = bytearray()
        self.words: dict[str, int] = {}
        self.pairs: dict[int, int] = {}
        self.chars: dict[str, int] = {}
        self.tokens: dict[str, int] = {}
        self.grams: list[np.ndarray] = []  # of each token, repeats included
        self.n_grams = 0

    def new(self, name: str, kind: int) -> int:
        self.names.append(name)
        self.kinds.append(kind)
        return len(self.names) - 1

    def word(self, word: str) -> int:
        found = self.words.get(word)
        if found is None:
            found = self.words[word] = self.new(word, 0)
        return found

    def pair(self, key: int) -> int:
        found = self.pairs.get(key)
        if found is None:
            found = self.pairs[key] = self.new(f"{self.names[key >> 32]} {self.names[key & 0xFFFFFFFF]}", 0)
        return found

    def char(self, gram: str) -> int:
        found = self.chars.get(gram)
        if found is None:
            found = self.chars[gram] = self.new(gram, 1)
        return found

    def token(self, token: str) -> int:
        found = self.tokens.get(token)
        if found is None:
            w = f" {token} "
            grams = np.array([self.char(w[i:i + n]) for n in range(3, min(5, len(w)) + 1)
                              for i in range(len(w) + 1 - n)], np.int64)
            found = self.tokens[token] = len(self.grams)
            self.grams.append(grams)
            self.n_grams += len(grams)
        return found

    def again(self, name: str, kind: int) -> int:
        """The number of a term of an earlier ``Terms``."""
        if kind:
            return self.char(name)
        first, _, second = name.partition(" ")
        return self.pair(self.word(first) << 32 | self.word(second)) if second else self.word(first)

    def digests(self, start: int) -> tuple[np.ndarray, np.ndarray]:
        """88 bits of each term from ``start``: 64, and 24 more."""
        data = b"".join(hashlib.blake2b(bytes([k]) + t.encode(), digest_size=12).digest()
                        for t, k in zip(self.names[start:], self.kinds[start:]))
        held = np.frombuffer(data, np.dtype([("h", "<u8"), ("g", "<u4")]))
        return held["h"].copy(), held["g"] >> np.uint32(8)


def _numbers(column: pa.ListArray, number) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of every string in a column of lists."""
    lengths = pa.compute.list_value_length(column).to_numpy()
    coded = column.flatten().dictionary_encode()
    table = np.array([number(s) for s in coded.dictionary.to_pylist()], np.int64)
    return np.repeat(np.arange(len(column)), lengths), table[coded.indices.to_numpy()] if len(table) else table


def _occurrences(part: pa.RecordBatch, doc_of: np.ndarray, terms: Terms) -> list[tuple]:
    """(texts, terms, times) of the words, the pairs and the grams of a slice."""
    row, word = _numbers(part.column("_words"), terms.word)
    beside = row[1:] == row[:-1]
    keys, at = np.unique(word[:-1][beside] << 32 | word[1:][beside], return_inverse=True)
    pair = np.array([terms.pair(k) for k in keys.tolist()], np.int64)[at]
    token_row, token = _numbers(part.column("_tokens"), terms.token)
    held, times = np.unique(doc_of[token_row] << 32 | token, return_counts=True)
    grams = [terms.grams[t] for t in (held & 0xFFFFFFFF).tolist()]
    sizes = [len(g) for g in grams]
    return [(doc_of[row], word, np.ones(len(row), np.int64)),
            (doc_of[row[1:][beside]], pair, np.ones(len(pair), np.int64)),
            (np.repeat(held >> 32, sizes), np.concatenate(grams or [np.empty(0, np.int64)]), np.repeat(times, sizes))]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pa.compute.list_value_length(batch.column("_tokens")).to_numpy()
        start = held = 0
        for row, size in enumerate(sizes.tolist()):
            if row > start and (row - start >= SLICE_ROWS or held + size > SLICE_TOKENS):
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


class Counts:
    """Term counts of the texts of a part, slice by slice.  Rows come sorted by id: rows of
    one id are one text, however many slices it takes."""

    def __init__(self):
        self.terms = Terms()
        self.last = self.open = None  # the id, and the terms and counts, of the text that may go on

    def folded(self, parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, tf) of occurrences, in order."""
        doc, term, times = (np.concatenate(c).astype(np.uint64) for c in zip(*parts))
        bits, mask = np.uint64(COUNT_BITS), np.uint64((1 << COUNT_BITS) - 1)
        if max(len(self.terms.names), int(times.max(initial=0))) >= 1 << COUNT_BITS:
            raise OverflowError("a text holds a term too often, or too many terms")
        key = doc << bits + bits | term << bits | times
        key.sort()
        group = key >> bits
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1])[:len(group)])
        tf = np.add.reduceat(key & mask, first) if len(first) else key
        group = group[first]
        return (group >> bits).astype(np.int64), (group & mask).astype(np.int64), tf.astype(np.int64)

    def of(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, tf) of the texts that are over with this slice."""
        ids = part.column("id").to_pylist()
        if self.open is None:
            self.last, self.open = ids[0], (np.empty(0, np.int64), np.empty(0, np.int64))
        doc_of = np.cumsum([a != b for a, b in zip([self.last, *ids[:-1]], ids)], dtype=np.int64)
        self.last = ids[-1]
        doc, term, tf = self.folded([(np.zeros(len(self.open[0]), np.int64), *self.open),
                                     *_occurrences(part, doc_of, self.terms)])
        end = int(np.searchsorted(doc, doc_of[-1]))
        self.open = term[end:], tf[end:]
        return doc[:end], term[:end], tf[:end]

    def rest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, tf) of the last text."""
        term, tf = self.open or (np.empty(0, np.int64), np.empty(0, np.int64))
        self.last = self.open = None
        return np.zeros(len(term), np.int64), term, tf

    def full(self) -> bool:
        return len(self.terms.names) > HELD_TERMS or self.terms.n_grams > HELD_GRAMS

    def anew(self) -> None:
        """Forget all terms but those of the text that may go on."""
        old, self.terms = self.terms, Terms()
        if self.open is not None:
            self.open = np.array([self.terms.again(old.names[t], old.kinds[t]) for t in self.open[0].tolist()],
                                 np.int64), self.open[1]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(part, turn, rows): batches cut where the part or the turn changes."""
    for batch in batches:
        place, turn = (batch.column(c).to_numpy() for c in ("part", "turn"))
        cuts = np.flatnonzero((place[1:] != place[:-1]) | (turn[1:] != turn[:-1])) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if end > start:
                yield int(place[start]), int(turn[start]), batch.slice(start, end - start)


def grown(held: np.ndarray, size: int) -> np.ndarray:
    """``held`` with zeros behind it up to ``size``, and room for more."""
    return held if len(held) >= size else np.concatenate((held, np.zeros(2 * size - len(held))))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in as many bytes as the largest needs, the low bytes of all first."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(data, np.uint8).reshape(-1, n)
        out[:, :len(planes)] = planes.T
    return out.view("<u8").ravel()


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """The range of a hash: in order, and of equal size."""
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)


SENT = "part int, range int, k int, h binary, g binary, n binary"
REPLIED = "part int, k int, h binary, g binary, n binary"


def _terms_sent(h: np.ndarray, g: np.ndarray, n: np.ndarray) -> tuple:
    """Terms in order of their hashes: (k, h, g, n), packed."""
    steps = np.diff(h, prepend=np.uint64(0))
    return len(h), int(steps[0]).to_bytes(8, "little") + packed(steps[1:]), packed(g), packed(n)


def _terms_of(k: int, h: bytes, g: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = np.concatenate((np.frombuffer(h[:8], "<u8"), unpacked(h[8:], k - 1)))
    return np.cumsum(steps, dtype=np.uint64), unpacked(g, k), unpacked(n, k)


def _sent(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows), fields)],
                                      names=[name for name, _ in fields])


def _frequencies(ranges: int):
    """``SENT``: texts of a part that hold a term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, counts, n = None, Counts(), np.empty(0)

        def add(term: np.ndarray) -> None:
            nonlocal n
            n = grown(n, len(counts.terms.names))
            n += np.bincount(term, minlength=len(n))

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal n
            h, g = counts.terms.digests(0)
            found = np.flatnonzero(n)
            found = found[np.lexsort((g[found], h[found]))]
            at = range_of(h[found], ranges)
            cuts = np.flatnonzero(np.diff(at, prepend=-1))
            for start, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(found)]):
                some = found[start:end]
                yield _sent([(place, at[start], *_terms_sent(h[some], g[some], n[some].astype(np.uint64)))], SENT)
            n = np.empty(0)
            counts.anew()

        for now, _, rows in _runs(batches):
            if now != place and place is not None:
                add(counts.rest()[1])
                yield from send()
            place = now
            for some in slices(iter([rows])):
                add(counts.of(some)[1])
                if counts.full():
                    yield from send()
        if place is not None:
            add(counts.rest()[1])
            yield from send()

    return run


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each range, which come together."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["range"] != held[0]["range"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _replies(min_df: int):
    """``REPLIED``: how many texts of all parts hold a term, to each part that sent it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_range(batches):
            h, g, n = (np.concatenate(c) for c in zip(*(_terms_of(r["k"], r["h"], r["g"], r["n"]) for r in rows)))
            order = np.lexsort((g, h))
            first = np.flatnonzero(np.append(True, (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])))
            df = np.empty(len(h), np.uint64)
            df[order] = np.repeat(np.add.reduceat(n[order], first), np.diff(first, append=len(h)))
            start = 0
            for r in rows:
                own = start + np.flatnonzero(df[start:start + r["k"]] >= min_df)
                start += r["k"]
                if len(own):
                    yield _sent([(r["part"], *_terms_sent(h[own], g[own], df[own]))], REPLIED)

    return run


def _row_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(analyzer, term, n): texts of a task, one a row, that hold a term."""
    counts, n = Counts(), np.empty(0)

    def send() -> Iterator[pa.RecordBatch]:
        names, kinds = counts.terms.names, counts.terms.kinds
        for at in range(0, len(names), OUT_ROWS):
            end = min(at + OUT_ROWS, len(names))
            yield pa.RecordBatch.from_arrays(
                [pa.array([KINDS[k] for k in kinds[at:end]], pa.string()), pa.array(names[at:end], pa.string()),
                 pa.array(n[at:end].astype(np.int64))], names=["analyzer", "term", "n"])

    for part in slices(batches):
        term = counts.folded(_occurrences(part, np.arange(part.num_rows), counts.terms))[1]
        n = grown(n, len(counts.terms.names))
        n += np.bincount(term, minlength=len(n))
        if len(counts.terms.names) > SENT_TERMS or counts.full():
            yield from send()
            n = np.empty(0)
            counts.anew()
    yield from send()


def frequencies(df: DataFrame, text: str = "script") -> DataFrame:
    """(analyzer, term, df): rows whose text holds a term.  Texts stay where they are; a task
    sends a row for each of its terms."""
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = df.select(textml.words_of(lower).alias("_words"), textml._all(lower, r"\S+").alias("_tokens"))
    sent = rows.mapInArrow(_row_frequencies, "analyzer string, term string, n long")
    return sent.groupBy("analyzer", "term").agg(F.sum("n").alias("df"))


TOTALS = "range int, k int, words int, names binary, df binary, m binary, many binary, t binary"


def _totals_sent(at: int, words: list[tuple], chars: list[tuple], df: np.ndarray, t: np.ndarray, m: np.ndarray) -> tuple:
    """Sum and largest of the weights of some terms.  A term in one text of a part has one weight."""
    names = sorted(words) + sorted(chars)
    order = np.array([i for _, i in names], np.int64)
    t, m = t[order], m[order]
    return (at, len(names), len(words), zlib.compress("\n".join(name for name, _ in names).encode(), 1),
            packed(df[order]), m.tobytes(), np.packbits(t != m).tobytes(), t[t != m].tobytes())


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(analyzer, term, df, t, m) of the totals of all parts."""
    names = ["analyzer", "term", "df", "t", "m"]

    def merge(tables: list[pa.Table]) -> pa.Table:
        out = pa.concat_tables(tables).group_by(names[:3], use_threads=False).aggregate([("t", "sum"), ("m", "max")])
        return out.select([*names[:3], "t_sum", "m_max"]).rename_columns(names)

    for rows in _by_range(batches):
        held, waiting = [], 0
        for r in rows:
            k, m = r["k"], np.frombuffer(r["m"])
            t = m.copy()
            t[np.unpackbits(np.frombuffer(r["many"], np.uint8), count=k).astype(bool)] = np.frombuffer(r["t"])
            held.append(pa.table([
                pa.array([KINDS[0]] * r["words"] + [KINDS[1]] * (k - r["words"]), pa.string()),
                pa.array(zlib.decompress(r["names"]).decode().split("\n"), pa.string()),
                pa.array(unpacked(r["df"], k).astype(np.int64)), pa.array(t), pa.array(m)], names=names))
            waiting += k
            if waiting > MERGED_ROWS:
                held, waiting = [merge(held)], 0
        yield from merge(held).combine_chunks().to_batches(max_chunksize=OUT_ROWS)


def _weights(n_docs: int, ranges: int):
    """``TOTALS``: sum and largest of the weights of a term in a part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, counts, known = None, Counts(), 0
        parts: list[tuple] = []  # rows of the vocabulary as they come
        h = g = df = np.empty(0, np.uint64)
        idf, total, top, at_of, home = (np.empty(0) for _ in range(5))
        kind = np.empty(0, np.uint8)

        def add(doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
            nonlocal idf, total, top, at_of, home, kind, known
            size = len(counts.terms.names)
            if known < size and len(h):
                idf, total, top, at_of, home = (grown(a, size) for a in (idf, total, top, at_of, home))
                own, more = counts.terms.digests(known)
                at = np.minimum(np.searchsorted(h, own), len(h) - 1)
                for _ in range(8):  # the first of equal ``h`` may be another term
                    wrong = (h[at] == own) & (g[at] != more) & (at + 1 < len(h))
                    at = at + wrong
                same = (h[at] == own) & (g[at] == more)
                home[known:size] = range_of(own, ranges)
                idf[known:size] = np.where(same, np.log((1.0 + n_docs) / (1.0 + df[at])) + 1.0, 0)
                at_of[known:size] = at
                kind, known = np.frombuffer(bytes(counts.terms.kinds), np.uint8), size
            if not known:
                return
            held = idf[term] > 0
            term, w = term[held], (1.0 + np.log(tf[held])) * idf[term[held]]
            row = doc[held] * 2 + kind[term]
            x = w / np.sqrt(np.bincount(row, w * w))[row]
            total += np.bincount(term, x, minlength=len(total))
            np.maximum.at(top, term, x)

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal idf, total, top, at_of, home, known
            found = np.flatnonzero(total)
            found = found[np.argsort(home[found], kind="stable")]
            cuts = np.flatnonzero(np.diff(home[found], prepend=-1))
            names, kinds = counts.terms.names, counts.terms.kinds
            for start, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(found)]):
                some = found[start:end]
                own = [[(names[t], i) for i, t in enumerate(some.tolist()) if kinds[t] == kind] for kind in (0, 1)]
                yield _sent([_totals_sent(int(home[some[0]]), *own, df[at_of[some].astype(np.int64)], total[some], top[some])], TOTALS)
            idf, total, top, at_of, home = (np.empty(0) for _ in range(5))
            known = 0
            counts.anew()

        for now, turn, rows in _runs(batches):
            if now != place and place is not None:
                add(*counts.rest())
                yield from send()
                h = g = df = np.empty(0, np.uint64)
            place = now
            if not turn:
                parts += [_terms_of(r["k"], r["h"], r["g"], r["n"]) for r in rows.select(["k", "h", "g", "n"]).to_pylist()]
                continue
            if parts:
                h, g, df = (np.concatenate(c) for c in zip(*parts))
                order = np.lexsort((g, h))
                h, g, df = h[order], g[order], df[order]
                parts.clear()
            for some in slices(iter([rows])):
                add(*counts.of(some))
                if counts.full():
                    yield from send()
        if place is not None:
            add(*counts.rest())
            yield from send()

    return run


def tfidf_totals(df: DataFrame, min_df: int = 2, id_col: str = "id", text: str = "script",
                 part_bytes: int = PART_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(analyzer, term, df, idf, total_weight, max_weight): the weights of ``textml.tfidf``,
    summed per term.  Rows without an id count for the vocabulary only."""
    n_docs, n_bytes = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    parts = max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-(n_bytes or 0) // part_bytes))
    lower = F.lower(F.coalesce(F.col("_t"), F.lit("")))
    # texts travel as they are and are cut into words where they arrive
    rows = df.select(F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int").alias("part"),
                     F.col(id_col).alias("id"), F.col(text).alias("_t"))
    words = [textml.words_of(lower).alias("_words"), textml._all(lower, r"\S+").alias("_tokens")]
    first = rows.repartition(parts, "part").sortWithinPartitions("part", "id").select(
        "part", F.lit(1).alias("turn"), "id", *words)
    # a range of hashes holds the terms of so much text; equal terms meet in one range
    ranges = max(1, -(-(n_bytes or 0) // range_bytes))
    counted = first.mapInArrow(_frequencies(ranges), SENT)
    vocabulary = counted.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(_replies(min_df), REPLIED)
    blobs = [f.split() for f in REPLIED.split(", ")[1:]]
    both = vocabulary.select(
        "part", F.lit(0).alias("turn"), F.lit(None).cast(rows.schema["id"].dataType).alias("id"),
        F.lit(None).cast(rows.schema["_t"].dataType).alias("_t"), *(c for c, _ in blobs)).unionByName(
        rows.filter("id IS NOT NULL").select("part", F.lit(1).alias("turn"), "id", "_t", *(F.lit(None).cast(t).alias(c) for c, t in blobs)))
    second = both.repartition(parts, "part").sortWithinPartitions("part", "turn", "id").select(
        "part", "turn", "id", *words, *(c for c, _ in blobs))
    sent = second.mapInArrow(_weights(n_docs, ranges), TOTALS)
    totals = sent.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(
        _merged, "analyzer string, term string, df long, t double, m double")
    idf = F.ln(F.lit(float(1 + n_docs)) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return totals.select("analyzer", "term", "df", idf.alias("idf"), F.col("t").alias("total_weight"), F.col("m").alias("max_weight"))
