"""Spelling variants: words one edit apart, found by walking a trie level by level.

The trie is a distributed edge table (node, first code point, label, child), path
compressed: a label is what all words below it share.  Level k of it is grouped from the
words that still share their prefix with others, and states (word, position, node, edits)
meet it by a join, all words at once:

* a state without an edit follows the word's own edge;
* it also takes every other edge of its node, at the cost of its one edit: the label's
  first code point replaces one of the word, is inserted, or one of the word is deleted.
  Other edges leave a word where the neighbour does, so each neighbour is met once;
* a state with one edit follows the only edge that spells on in the word.

States that use up the word at a node where a word ends are neighbours.  Words walk
forwards and backwards, each time with edits in the second half only, where a node has
few edges: one of two words one edit apart shares half of itself with the other at one of
its ends.  No node has more edges than the alphabet, so no group is compared with itself.
"""

from __future__ import annotations

import os.path
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, id_and_text, map_arrow, slices

# FIXED VALUES: what a word is made of, and which occurrences lose a code point.
RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
MISSPELT = 97

MIN_LENGTH, MIN_COUNT, DOMINANCE = 5, 3, 2

# Different words that a task counts before it passes the counts on.
COUNTED_WORDS = 200_000

EDGES = "side int, node string, first string, label string, child string, depth int, ends boolean, n long, leaf boolean"


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", misspelt: int | None = MISSPELT) -> DataFrame:
    """(word, n), n partly summed: the runs of whole texts, A-Z lower-cased, without the
    code point that a checksum of document and run picks in one of ``misspelt`` cases.
    A null id counts as an empty one, a null text has no words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in slices(batches, "text", 1 << 20):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                found: Counter[bytes] = Counter()
                for word, n in Counter(RUN.findall(text)).items():
                    # in Latin-1 lower() knows A-Z only
                    found[word.encode("latin-1").lower()] += n
                for coded, n in found.items():
                    word = coded.decode("latin-1")
                    if misspelt:
                        check = zlib.crc32(coded if coded.isascii() else word.encode(), prefix)
                        if check % misspelt == 0:
                            at = check % len(word)
                            word = word[:at] + word[at + 1:]
                    held[word] += n
                if len(held) >= COUNTED_WORDS:
                    yield passed_on()
        yield passed_on()

    return map_arrow(id_and_text(docs, id_col, text_col), run, "word string, n long")


def level_edges(states: DataFrame) -> DataFrame:
    """The edges below the nodes of one level, from the words that go on there."""
    start = F.struct("word", "n")
    heads = (states.where("edits = 0 and pos < length(word)")
             .groupBy("side", "node", F.col("pos").alias("depth"), F.substring("word", F.col("pos") + 1, F.lit(1)).alias("first"))
             .agg(F.min(start).alias("low"), F.max("word").alias("high")))
    heads = heads.select("side", "node", "depth", "first", "low.word", "low.n", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {c: batch.column(c).to_pylist() for c in ("depth", "word", "high", "n")}
            shared = [os.path.commonprefix(pair) for pair in zip(rows["word"], rows["high"])]
            ends = [p == w for p, w in zip(shared, rows["word"])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("side"), batch.column("node"), batch.column("first"),
                 pa.array([p[d:] for p, d in zip(shared, rows["depth"])], pa.string()), pa.array(shared, pa.string()),
                 pa.array(map(len, shared), pa.int32()), pa.array(ends, pa.bool_()),
                 pa.array([n if e else None for n, e in zip(rows["n"], ends)], pa.int64()),
                 pa.array([w == h for w, h in zip(rows["word"], rows["high"])], pa.bool_())],
                names=["side", "node", "first", "label", "child", "depth", "ends", "n", "leaf"])

    return map_arrow(heads, run, EDGES)


def next_states(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states one level down.  ``pos`` counts code points of the word used so far."""
    size, label = F.length("word"), F.length("label")
    edges = edges.withColumnsRenamed({"node": "parent", "n": "near_n", "side": "way"})
    own = F.substring("word", F.col("pos") + 1, F.lit(1))
    here = (F.col("side") == F.col("way")) & (F.col("node") == F.col("parent"))

    def at(start: Column | int, length: Column) -> Column:
        return F.substring("word", F.col("pos") + 1 + start, length)

    states = states.select("side", "word", "n", "pos", "node", "edits")
    followed = (states.where(F.col("pos") < size).join(edges, here & (own == F.col("first")))
                .where((F.col("edits") == 0) | (at(0, label) == F.col("label")))
                .withColumn("pos", F.col("pos") + label))
    rest = F.expr("substring(label, 2)")
    moves = F.array(
        F.when(at(1, label - 1) == rest, label),                                # replaced
        F.when(at(0, label - 1) == rest, label - 1),                            # inserted
        F.when(at(1, label) == F.col("label"), label + 1))                      # deleted
    edited = (states.where((F.col("edits") == 0) & (F.col("pos") >= F.floor(size / 2)))
              .join(edges, here & (own != F.col("first")))
              .withColumn("move", F.explode(F.array_compact(moves)))
              .withColumn("pos", F.col("pos") + F.col("move")).drop("move")
              .where(F.col("pos") <= size).withColumn("edits", F.lit(1)))
    both = followed.unionByName(edited).select(
        "side", "word", "n", "pos", F.col("child").alias("node"), "edits", "ends", "near_n", "leaf")
    # an edited word that is used up has to end where a word does; below a leaf is nothing
    used_up = F.col("pos") == size
    return both.where(F.when(F.col("edits") == 0, ~F.col("leaf")).otherwise(F.when(used_up, F.col("ends")).otherwise(~F.col("leaf"))))


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, near, near_n) of (word, n): all pairs of words one edit apart, both ways."""
    states = scratch.store(words.select(
        F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), "word", "n").select(
        "side", F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word")).alias("word"), "n",
        F.lit(0).alias("pos"), F.lit("").alias("node"), F.lit(0).alias("edits"), F.lit(False).alias("ends"),
        F.lit(None).cast("long").alias("near_n"), F.lit(False).alias("leaf")), "states-0")
    found = states.where("false")
    level = 0
    while not states.where("pos < length(word)").isEmpty():
        edges = scratch.store(level_edges(states), f"edges-{level}")
        level += 1
        states = scratch.store(next_states(states, edges), f"states-{level}")
        found = found.unionByName(states.where("ends and length(word) - pos = 1 - edits"))
    half = F.floor(F.length("word") / 2).cast("int")
    facing = [F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(c)).alias(c) for c in ("word", "node")]
    # backwards only what the forward walk cannot meet
    return (found.select("side", *facing, "near_n")
            .where((F.col("side") == 0) | (F.substring("word", F.lit(1), half) != F.substring("node", F.lit(1), half)))
            .select("word", F.col("node").alias("near"), "near_n"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last.  Counts at least double
    from a word to its form, so a few rounds of doubled steps reach every root."""
    links = scratch.store(forms.select("word", F.col("form").alias("root")), "links-0")
    for step in range(1, 1 << 30):
        beyond = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        links = scratch.store(links.join(beyond, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), f"links-{step}")
        if links.where("moved").isEmpty():
            return links.drop("moved")
        links = links.drop("moved")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                    min_count: int = MIN_COUNT, misspelt: int | None = MISSPELT) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of at least ``min_length`` code
    points and ``min_count`` occurrences with its most frequent near word (ties: the
    smallest in code-point order) where that is at least twice as frequent.

    Null and empty texts have no words; repeated rows count each; an empty table gives no
    rows; other columns are not read, so their names cannot clash.  Words may be of any
    length; levels grow with what different words share, not with their length.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    counted = occurrences(docs, id_col, text_col, misspelt).groupBy("word").agg(F.sum("n").alias("n"))
    words = scratch.store(counted.where((F.length("word") >= min_length) & (F.col("n") >= min_count)), "words")
    near = (near_words(words, scratch).groupBy("word")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best")))
    strong = -F.col("best.minus") >= DOMINANCE * F.col("n")
    judged = scratch.store(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.minus")).alias("form_n")), "judged")
    found = roots(judged.where("form is not null").select("word", "form"), scratch)
    return judged.join(found, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
