"""Toxicity: a convolutional text classifier over hashed word embeddings.

Words are hashed into buckets; a bucket has an embedding.  Filters of several widths
slide over the embeddings of a whole text, each keeps its largest response (max
pooling), and a linear layer turns those into a logit.  A first network is trained in numpy
on a bounded sample of labelled rows.  Where there is more to learn from, all labelled rows
train it on: a task goes through its shards of rows in small steps, and the networks of all
shards are averaged.  The logit is calibrated to a probability on a fifth of all labelled
rows that training did not see, and so is the threshold of rejection of each language.
Scoring runs on Arrow batches of whole texts, in one stage.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, id_and_text, map_arrow, release_memory, slices, unused

WIDTHS = (1, 2, 3)
FILTERS = 8
DIM = 8
BUCKETS = 1 << 22
# Labelled rows that the first network reads at most: a third for label 1, the rest for
# label 0, in each the smallest hashes of the ids.
FIT_ROWS = 6000
FIT_CHARS = 1 << 16  # characters of a text that the first network reads
SHARD_ROWS = 6000  # rows one copy of the network learns from before copies are averaged
CHUNK_WORDS = 1 << 21  # words of a shard in memory at a time
PASSES = 2  # of a shard over each of its rows, at least
STEP_ROWS = 32
RATE = 0.1
LOGIT_BINS = 256  # logits are counted in bins of one part in so many to calibrate
EPOCHS = 8
# Steps that small samples are trained for at least.
LEAST_STEPS = 1500
REMEMBERED_WORDS = 200_000
WORD = re.compile(r"\w+")


def bucket(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode()) % BUCKETS


@dataclass
class Network:
    """``rows`` are the sorted buckets of ``table``, from row 1 on; row 0 is zero and stands
    for every bucket that training has not seen in two texts, and for the end of a text."""

    rows: np.ndarray
    table: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    shift: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    default_threshold: float = 0.5

    def __post_init__(self):
        self.known: dict[str, int] = {}
        self.square: dict | None = None  # squared gradients of a network that has learnt

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def rows_of(self, buckets: np.ndarray) -> np.ndarray:
        """Table rows of buckets."""
        if not len(self.rows):
            return np.zeros(len(buckets), np.int64)
        at = np.minimum(np.searchsorted(self.rows, buckets), len(self.rows) - 1)
        return np.where(self.rows[at] == buckets, at + 1, 0)

    def numbers(self, text: str) -> list[int]:
        """Table rows of the words of a text, and the padding that ends it."""
        known, found = self.known, WORD.findall(text.lower())
        new = list({word for word in found if word not in known})
        if new:
            if len(known) + len(new) > REMEMBERED_WORDS:
                known.clear()
                new = list(set(found))
            known.update(zip(new, self.rows_of(np.array([bucket(w) for w in new])).tolist()))
        return [known[word] for word in found] + [0] * max(WIDTHS)

    def pooled(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(texts, filters of all widths): largest response of every filter.  A window
        may start at any word and run into the padding; never into the next text."""
        parts, ends = [], np.append(starts[1:], len(flat))
        for width in WIDTHS:
            kernel = self.filters[width]
            response = self.responses(kernel[0], flat)
            for j in range(1, width):
                response[:-j] += self.responses(kernel[j], flat[j:])
            response[(ends[:, None] - np.arange(1, width)).ravel()] = -np.inf
            parts.append(np.maximum.reduceat(response, starts, axis=0))
        return np.concatenate(parts, axis=1)

    def responses(self, kernel: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Table rows ``flat`` times a kernel, over the shorter of the two first."""
        return (self.table @ kernel)[flat] if len(self.table) < len(flat) else self.table[flat] @ kernel

    def logits(self, texts: list[str]) -> np.ndarray:
        return self.logits_of([self.numbers(t) for t in texts])

    def logits_of(self, lists: list) -> np.ndarray:
        """Logits of texts given as table rows with their padding."""
        starts = np.cumsum([0, *map(len, lists)])[:-1]
        flat = np.fromiter((i for one in lists for i in one), np.int64)
        return np.maximum(self.pooled(flat, starts) + self.bias, 0) @ self.out + self.shift

    def scores(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.slope * self.logits(texts).astype(np.float64) + self.offset) if texts else np.empty(0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def untrained(buckets: np.ndarray, rng: np.random.Generator) -> Network:
    """A network of random weights for sorted buckets."""
    table = rng.normal(0, 0.05, (len(buckets) + 1, DIM)).astype(np.float32)
    table[0] = 0
    filters = {w: rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    n_units = FILTERS * len(WIDTHS)
    return Network(buckets, table, filters, np.full(n_units, 0.1, np.float32), rng.normal(0, 0.3, n_units).astype(np.float32))


def no_square(net: Network) -> dict:
    """Squared gradients before the first step."""
    units = len(net.bias)
    return {"table": np.full(net.table.shape, 1e-4, np.float32), "bias": np.full(units, 1e-4), "out": np.full(units, 1e-4),
            "shift": 1e-4} | {w: np.full(f.shape, 1e-4, np.float32) for w, f in net.filters.items()}


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, batch: int = STEP_ROWS, seed: int = 5) -> Network:
    """Fit a network; labels are 0 or 1.  Without both classes it stays at the prior."""
    rng = np.random.default_rng(seed)
    found = [np.array([bucket(w) for w in WORD.findall(t.lower())], np.int32) for t in texts]
    seen, n = np.unique(np.concatenate([np.unique(one) for one in found] or [np.empty(0, np.int32)]), return_counts=True)
    kept = seen[n > 1].astype(np.int64)
    net = untrained(kept, rng)
    positives = float(labels.sum())
    if not 0 < positives < len(labels):
        net.shift = 0.0 if not len(labels) else (4.0 if positives else -4.0)
        net.out[:] = 0
        return net
    lists = [padded(net, one) for one in found]
    weight = np.where(labels == 1, min(5.0, (len(labels) - positives) / positives), 1.0)
    net.square = no_square(net)
    for _ in range(max(epochs, -(-LEAST_STEPS * batch // len(lists)))):
        order = rng.permutation(len(lists))
        for at in range(0, len(order), batch):
            picked = order[at:at + batch]
            step(net, [lists[i] for i in picked], labels[picked], weight[picked])
    net.bias, net.out, net.shift = net.bias.astype(np.float32), net.out.astype(np.float32), float(net.shift)
    return net


def padded(net: Network, buckets: np.ndarray) -> np.ndarray:
    """Table rows of the words of a text, given by bucket, and the padding that ends it."""
    return np.concatenate((net.rows_of(buckets), np.zeros(max(WIDTHS), np.int64)))


def step(net: Network, lists: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One step of adaptive gradient descent on a few texts; returns the table rows moved."""
    square = net.square
    flat = np.concatenate(lists)
    lengths = np.array([len(one) for one in lists])
    starts = np.cumsum(lengths) - lengths
    best, places = [], []
    for w in WIDTHS:
        response = net.table[flat] @ net.filters[w][0]
        for j in range(1, w):
            response[:-j] += net.table[flat[j:]] @ net.filters[w][j]
        # windows that would run into the next text are left out
        place = np.array([s + response[s:s + n - w + 1].argmax(axis=0) for s, n in zip(starts, lengths)])
        places.append(place)
        best.append(np.take_along_axis(response, place, axis=0))
    act = np.concatenate(best, axis=1) + net.bias
    hidden = np.maximum(act, 0)
    error = (sigmoid(hidden @ net.out + net.shift) - labels) * weight / len(lists)
    back = (error[:, None] * net.out * (act > 0)).astype(np.float32)
    change_of = {"out": hidden.T @ error, "bias": back.sum(axis=0), "shift": error.sum()}
    touched, moved = [], []
    for k, w in enumerate(WIDTHS):
        g = back[:, k * FILTERS:(k + 1) * FILTERS]
        change_of[w] = np.empty_like(net.filters[w])
        for j in range(w):
            tokens = flat[places[k] + j]
            change_of[w][j] = np.einsum("nf,nfd->df", g, net.table[tokens])
            touched.append(tokens.ravel())
            moved.append((g[:, :, None] * net.filters[w][j].T[None]).reshape(-1, DIM))
    tokens, which = np.unique(np.concatenate(touched), return_inverse=True)
    change = np.zeros((len(tokens), DIM), np.float32)
    np.add.at(change, which, np.concatenate(moved))
    change[tokens == 0] = 0
    square["table"][tokens] += change ** 2
    net.table[tokens] -= RATE * change / np.sqrt(square["table"][tokens])
    for w in WIDTHS:
        square[w] += change_of[w] ** 2
        net.filters[w] -= RATE * 0.2 * change_of[w] / np.sqrt(square[w])
    for name in ("out", "bias", "shift"):
        square[name] = square[name] + change_of[name] ** 2
        setattr(net, name, getattr(net, name) - RATE * 0.5 * change_of[name] / np.sqrt(square[name]))
    return tokens


def calibrate(net: Network, texts: list[str], labels: np.ndarray, langs: list[str | None],
              log_odds: float | None = None) -> None:
    """Slope and offset of the logit by a few Newton steps on smoothed targets, then per
    language the threshold of the best F1 (the common one where a language has fewer
    than five labelled rows of either class).  ``log_odds`` are those of label 1 among
    all labelled rows; they replace those of the sample."""
    if len(texts):
        calibrate_on(net, net.logits(texts).astype(np.float64), labels, np.ones(len(labels)), langs, log_odds)


def calibrate_on(net: Network, x: np.ndarray, labels: np.ndarray, n: np.ndarray, langs: list[str | None],
                 log_odds: float | None = None) -> None:
    """``calibrate`` by logits ``x``, each of ``n`` rows."""
    total, pos = n.sum(), n[labels == 1].sum()
    if not 0 < pos < total:
        return
    goal = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (total - pos + 2))
    design, beta = np.stack([x, np.ones_like(x)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(design @ beta)
        hessian = design.T @ (design * (n * p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(hessian, design.T @ (n * (p - goal)) + 1e-3 * (beta - [1, 0])), -1, 1)
    net.slope, net.offset = (float(beta[0]), float(beta[1])) if beta[0] > 0 else (1.0, 0.0)
    if log_odds is not None:
        net.offset += log_odds - float(np.log(pos / (total - pos)))
    scores = sigmoid(net.slope * x + net.offset)

    def best_threshold(mask: np.ndarray) -> float:
        s, y, k = scores[mask], labels[mask], n[mask]
        cuts = np.linspace(0.05, 0.95, 91)
        hit = np.array([k[(s >= c) & (y == 1)].sum() for c in cuts])
        f1 = 2 * hit / np.maximum(np.array([k[s >= c].sum() for c in cuts]) + k[y == 1].sum(), 1)
        top = cuts[f1 >= f1.max() - 1e-12]
        return float(top[np.abs(top - np.median(top)).argmin()])

    names = np.array([lang or "" for lang in langs])
    net.thresholds, net.default_threshold = {}, best_threshold(np.ones(len(labels), bool))
    for lang in sorted(set(names.tolist())):
        mask = names == lang
        if min(n[mask & (labels == 1)].sum(), n[mask & (labels == 0)].sum()) >= 5:
            net.thresholds[lang] = best_threshold(mask)


def learns(id_col: Column) -> Column:
    """Rows that labels may be learnt from; the others are held out."""
    return F.crc32(id_col.cast("string")) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, epochs: int = EPOCHS,
        label_col: str = "toxic", lang_col: str = "lang") -> Network:
    """Train on all labelled rows that are not held out; a fifth of them calibrates.

    The first network comes from at most ``fit_rows`` rows: those whose hashed id is
    smallest, so the choice depends on the ids only.  One row of each id and its first
    FIT_CHARS characters reach the driver: at most fit_rows * FIT_CHARS characters (393 MB
    of ASCII, four times that in the worst encoding).  If there are more rows, or longer
    texts, whole texts of all rows train it on (``train_on``).  Rows without a label or id
    teach nothing."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = scratch.store(labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col(label_col) > 0).cast("int").alias("label")).filter(
        "doc_id IS NOT NULL AND label IS NOT NULL").filter(learns(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("label").alias("label")), "labels")
    total = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    odds = float(np.log(total[1] / total[0])) if len(total) == 2 else None
    most = {1: fit_rows // 3, 0: fit_rows - fit_rows // 3}

    def first(label: int) -> DataFrame:
        return known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[label])

    chosen = scratch.store(first(1).unionByName(first(0)), "chosen")
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                        lang.cast("string").alias("lang"))
    # at most fit_rows rows of FIT_CHARS characters, however often an id is repeated
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(
        F.min(F.struct(F.substring("text", 1, FIT_CHARS).alias("text"), "lang")).alias("_row"),
        F.max(F.length("text") > FIT_CHARS).alias("cut"))
    # as columns, and given back to the system once read: the driver lives on
    rows = one.select("doc_id", "_row.text", "_row.lang", F.col("label").cast("double"), "cut").toArrow().sort_by("doc_id")
    held = pa.array([calibrates(i) for i in rows.column("doc_id").to_pylist()], pa.bool_())
    train_part, held_part = rows.filter(pa.compute.invert(held)), rows.filter(held)
    any_cut = any(rows.column("cut").to_pylist())
    del rows
    net = train(train_part.column("text").to_pylist(), train_part.column("label").to_numpy(), epochs)
    calibrate(net, held_part.column("text").to_pylist(), held_part.column("label").to_numpy(),
              held_part.column("lang").to_pylist(), odds)
    del train_part, held_part
    release_memory()
    more = any(total.get(label, 0) > most[label] for label in most) or any_cut
    # a network that has met one class only stays at the prior
    if more and getattr(net, "square", None):
        net = train_on(net, texts, known, scratch)
        release_memory()
    return net


def calibrates(doc_id: int) -> bool:
    """The fifth of the labelled rows that training does not see."""
    return not xxhash.xxh64_intdigest(str(doc_id)) % 5


def _word_rows(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, label, lang, held, words): buckets of the words of each labelled whole text.

    The merge hint keeps one plan at every size: texts move once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: dict[str, int] = {}
        for part in slices(batches, "text", 1 << 20):
            lists = []
            for text in part.column("text").to_pylist():
                if len(buckets) >= REMEMBERED_WORDS:
                    buckets.clear()
                one = []
                for word in WORD.findall(text.lower()):
                    b = buckets.get(word)
                    if b is None:
                        b = buckets[word] = bucket(word)
                    one.append(b)
                lists.append(one)
            held = [calibrates(i) for i in part.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("label"), part.column("lang"), pa.array(held, pa.bool_()),
                 pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "label", "lang", "held", "words"])

    one = texts.filter(learns(F.col("doc_id"))).join(known.hint("merge"), "doc_id").groupBy("doc_id", "label").agg(
        F.min(F.struct("text", "lang")).alias("_row")).select("doc_id", "label", "_row.text", "_row.lang")
    return map_arrow(one, run, "doc_id long, label int, lang string, held boolean, words array<int>")


def _frequent_buckets(rows: DataFrame) -> np.ndarray:
    """Sorted buckets that at least two texts hold: at most BUCKETS numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int32)
        for batch in batches:
            for one in batch.column("words"):
                n[np.unique(one.values.to_numpy())] += 1
        found = np.flatnonzero(n)
        for at in range(0, len(found), 1 << 16):
            part = found[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(n[part].astype(np.int64))], names=["bucket", "n"])

    counted = map_arrow(rows.select("words"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = counted.filter("n > 1").select("bucket").toArrow().column("bucket").to_numpy()
    return np.sort(found.astype(np.int64))


def _dense(net: Network) -> np.ndarray:
    """All weights but the table, as rows of DIM."""
    flat = np.concatenate([net.filters[w].ravel() for w in WIDTHS] + [net.bias, net.out, [net.shift]])
    return np.append(flat, np.zeros(-len(flat) % DIM)).reshape(-1, DIM)


def _set_dense(net: Network, rows: np.ndarray) -> None:
    flat, at = rows.ravel(), 0
    for w in WIDTHS:
        size = net.filters[w].size
        net.filters[w] = flat[at:at + size].reshape(net.filters[w].shape).astype(np.float32)
        at += size
    units = len(net.bias)
    net.bias, net.out = (flat[i:i + units].astype(np.float32) for i in (at, at + units))
    net.shift = float(flat[at + 2 * units])


def train_on(net: Network, texts: DataFrame, known: DataFrame, scratch: Scratch, seed: int = 6) -> Network:
    """``net`` after it has learnt from all rows of ``known`` (doc_id, label), whole texts.

    Rows are dealt to shards by hashed id.  Every shard goes on from ``net`` (a single one
    from a new network), CHUNK_WORDS
    words after the other; a weight becomes the mean over the shards that moved it.  What a
    worker holds is a network (its table has at most BUCKETS rows) and one chunk."""
    rows = scratch.store(_word_rows(texts, known), "words")
    fit_on = rows.filter("NOT held")
    n = {r["label"]: r["count"] for r in fit_on.groupBy("label").count().collect()}
    weight_1 = min(5.0, n.get(0, 0) / n[1]) if n.get(1) else 1.0
    shards = max(1, -(-sum(n.values()) // SHARD_ROWS))
    passes = max(PASSES, -(-LEAST_STEPS * STEP_ROWS // max(1, sum(n.values()))))
    kept = _frequent_buckets(fit_on)
    start, net = net, untrained(kept, np.random.default_rng(seed))
    net.square = no_square(net)
    if shards == 1:
        passes = max(passes, EPOCHS)  # one shard is all there is: it needs no common start
    else:
        old = net.rows_of(start.rows)
        has = old > 0
        net.table[old[has]], net.square["table"][old[has]] = start.table[1:][has], start.square["table"][1:][has]
        net.filters, net.bias, net.out, net.shift = start.filters, start.bias, start.out, start.shift
        net.square = start.square | {"table": net.square["table"]}
    shared = texts.sparkSession.sparkContext.broadcast(net)
    names = ["slot", *(f"v{i}" for i in range(DIM))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, moved, held, n_words = None, None, None, [], 0

        def take() -> None:
            rng = np.random.default_rng((seed, shard))
            labels = np.array([y for y, _ in held], dtype=np.float64)
            weight = np.where(labels == 1, weight_1, 1.0)
            for _ in range(passes):
                order = rng.permutation(len(held))
                for at in range(0, len(order), STEP_ROWS):
                    picked = order[at:at + STEP_ROWS]
                    moved[step(own, [held[i][1] for i in picked], labels[picked], weight[picked])] = True
            held.clear()

        def weights() -> Iterator[pa.RecordBatch]:
            take()
            slots = np.flatnonzero(moved)
            slots = slots[slots > 0]
            dense = _dense(own)
            values = np.concatenate((own.table[slots], dense.astype(np.float32)))
            slots = np.append(slots, -1 - np.arange(len(dense)))
            for at in range(0, len(slots), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slots[part].astype(np.int32)), *(pa.array(np.ascontiguousarray(v)) for v in values[part].T)], names=names)

        for batch in batches:
            for number, label, words in zip(batch.column("shard").to_pylist(), batch.column("label").to_pylist(), batch.column("words")):
                if number != shard:
                    if own is not None:
                        yield from weights()
                    own, shard, n_words = copy.deepcopy(shared.value), number, 0
                    moved = np.zeros(len(own.table), bool)
                held.append((label, padded(own, words.values.to_numpy().astype(np.int64))))
                n_words += len(held[-1][1])
                if n_words >= CHUNK_WORDS:
                    take()
                    n_words = 0
        if own is not None:
            yield from weights()

    dealt = fit_on.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"),
                          F.xxhash64("doc_id", F.lit(seed)).alias("place"), "doc_id", "label", "words")
    # so many partitions that a task has about one shard, on small data no more than there are
    placed = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "place", "doc_id")
    trained = map_arrow(placed.select("shard", "label", "words"), run, ", ".join(["slot int", *(f"v{i} float" for i in range(DIM))]))
    mean = trained.groupBy("slot").agg(*[F.avg(c).cast("float").alias(c) for c in names[1:]]).toArrow()
    slots = mean.column("slot").to_numpy()
    values = np.stack([mean.column(c).to_numpy() for c in names[1:]], axis=1)
    net.filters = dict(net.filters)
    net.table[slots[slots > 0]] = values[slots > 0]
    if len(slots):
        _set_dense(net, values[slots < 0][np.argsort(-slots[slots < 0])])
    _calibrate_all(net, rows.filter("held"))
    shared.unpersist()
    scratch.drop("words")
    return net


def _calibrate_all(net: Network, rows: DataFrame) -> None:
    """Calibrate by all held rows: their logits are counted in bins by label and language."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = own.logits_of([padded(own, w.values.to_numpy().astype(np.int64)) for w in part.column("words")])
                bins = np.rint(np.clip(x, -40, 40) * LOGIT_BINS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("label"), part.column("lang"), pa.array(bins)], names=["label", "lang", "bin"])

    counted = map_arrow(rows.select("label", "lang", "words"), run, "label int, lang string, bin int").groupBy(
        "label", "lang", "bin").agg(F.count(F.lit(1)).alias("n")).orderBy("label", "lang", "bin").collect()
    calibrate_on(net, np.array([r.bin / LOGIT_BINS for r in counted]), np.array([float(r.label) for r in counted]),
                 np.array([float(r.n) for r in counted]), [r.lang for r in counted])


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): probability of the label for every whole text.  Null texts count
    as empty and get the score of a text without words; repeated rows each get one."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in slices(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(own.scores(part.column("text").to_pylist()))], names=["doc_id", "score"])

    return map_arrow(id_and_text(docs, id_col, text_col), run, "doc_id long, score double")


def toxic_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    rows = score(docs, fit(docs, labels, fit_rows))
    return rows.select("doc_id", F.coalesce(~learns(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                       (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, lang_col: str = "lang") -> DataFrame:
    """``docs`` without those whose score reaches the threshold of their language, all
    columns as they are.  Rows go by id and text; those with a null id stay."""
    net = fit(docs, labels, fit_rows, lang_col=lang_col)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col in docs.columns else F.lit("")
    cut = F.lit(net.default_threshold)
    for name, value in net.thresholds.items():
        cut = F.when(lang == name, value).otherwise(cut)
    # a row is judged where it is: neither it nor its score moves
    cut_c = unused(docs, "_cut")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in slices(batches, "text", 1 << 20):
            found = own.scores([t or "" for t in part.column("text").to_pylist()])
            stays = found < part.column(cut_c).to_numpy()
            yield part.drop_columns([cut_c]).filter(pa.array(stays, pa.bool_()))

    judged = docs.withColumn(cut_c, F.when(F.col("doc_id").cast("long").isNull(), float("inf")).otherwise(cut).cast("double"))
    return map_arrow(judged, run, docs.schema)
