"""Learned text baselines: TF-IDF over word 1-2 grams and character 3-5 grams.

``tfidf`` is a long table (id, analyzer, term, weight).  The estimators read the
same weights as sparse vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import fixed as K, ranking
from ..functions.lexical import _all
from ..session import checkpointed, stored
from . import metrics as M, scoring

# The weights of a linear model live on the driver: a larger vocabulary is an error, to be
# answered with a higher ``min_df`` or more memory, never with shared columns.
MAX_COLUMNS = 1 << 24
FOREST_COLUMNS = 1 << 10


def words_of(text: Column) -> Column:
    """Lower-case words of two or more word characters."""
    return _all(F.lower(text), K.WORD_TOKEN_PATTERN)


def with_pairs(words: Column) -> Column:
    """Words and pairs of neighbours; pass a column, it is read several times."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.concat(words, F.zip_with(
        F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))


def word_ngrams(text: Column) -> Column:
    return with_pairs(words_of(text))


def _padded_grams(word: Column, low: int, high: int) -> Column:
    w = F.concat(F.lit(" "), word, F.lit(" "))
    lengths = F.sequence(F.lit(low), F.least(F.lit(high), F.length(word) + 2))
    return F.flatten(F.transform(lengths, lambda n: F.transform(
        F.sequence(F.lit(1), F.length(word) + 3 - n), lambda i: F.substring(w, i, n))))


def char_wb_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character runs of 3 to 5 inside each word padded with one blank per side."""
    return F.flatten(F.transform(_all(F.lower(text), r"\S+"), lambda w: _padded_grams(w, low, high)))


PIECE_GRAMS = 1 << 16  # grams of a text that are written out at a time


def gram_digest(text: str) -> tuple[int, int, str]:
    """Number of character grams of a lower-case text, number of different ones, and the
    MD5 of all in order, joined by ``|``.

    A gram is a window of 3 to 5 code points without a blank inside, blanks around every
    word standing for its padding.  Windows are sorted as numbers, a gram that ends early
    first, which is the order of code points and of UTF-8 bytes."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    held = np.full(len(points) + 2, 33, np.uint64)  # code points plus one: zero is no point
    held[1:-1] = np.where((points >= 9) & (points <= 13), 33, points + 1)
    word = held != 33
    width = 12 if held.max() < 1 << 12 else 21
    firsts, lasts, inside = [], [], np.ones(len(held), bool)
    for n in (3, 4, 5):
        inside = inside[:len(held) - n + 1] & word[n - 2:len(held) - 1]
        at = np.flatnonzero(inside)
        parts = [held[at + i] if i < n else np.uint64(0) for i in range(5)]
        firsts.append(parts[0] << np.uint64(2 * width) | parts[1] << np.uint64(width) | parts[2])
        lasts.append(np.broadcast_to(parts[3] << np.uint64(width) | parts[4], at.shape))
    first, last = np.concatenate(firsts), np.concatenate(lasts)
    if width == 12:
        both = np.sort(first << np.uint64(24) | last)
        first, last = both >> np.uint64(24), both & np.uint64((1 << 24) - 1)
    else:
        order = np.lexsort((last, first))
        first, last = first[order], last[order]
    distinct = int(((first[1:] != first[:-1]) | (last[1:] != last[:-1])).sum()) + (len(first) > 0)
    body, mask = hashlib.md5(), np.uint64((1 << width) - 1)
    for start in range(0, len(first), PIECE_GRAMS):
        f, l = first[start:start + PIECE_GRAMS], last[start:start + PIECE_GRAMS]
        table = np.empty((len(f), 6), "<u4")
        for column, value, place in ((1, f, 2), (2, f, 1), (3, f, 0), (4, l, 1), (5, l, 0)):
            table[:, column] = value >> np.uint64(place * width) & mask
        table[:, 0] = ord("|") + 1
        flat = table.ravel()
        flat = flat[flat != 0] - 1
        body.update(flat[start == 0:].astype("<u4").tobytes().decode("utf-32-le").encode())
    return len(first), distinct, body.hexdigest()


def char_wb_digests(df: DataFrame, id_col: str = "id", text: str = "script") -> DataFrame:
    """(id, n, n_distinct, digest): ``gram_digest`` of the grams that ``char_wb_ngrams``
    gives.  No list of grams stands in a row.  A null text has no digest and the sizes that
    Spark gives for null."""
    lower = df.select(F.col(id_col).alias("id"), F.lower(F.col(text)).alias("_t"))
    none = lower.sparkSession.range(1).select(F.size(F.lit(None).cast("array<string>"))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [gram_digest(t.as_py()) if t.is_valid else (none, none, None) for t in batch.column("_t")]
            n, distinct, digest = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int32()), pa.array(distinct, pa.int32()), pa.array(digest, pa.string())],
                names=["id", "n", "n_distinct", "digest"])

    return lower.mapInArrow(run, StructType([lower.schema["id"], *(
        StructField(c, t) for c, t in (("n", IntegerType()), ("n_distinct", IntegerType()), ("digest", StringType())))]))


def by_id(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows placed by id once: every later grouping by (id, ...) stays where it is,
    so texts travel but their many grams never do."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, id_col)


def terms(df: DataFrame, id_col: str = "id", text: str = "script") -> DataFrame:
    """(id, analyzer, term, tf): occurrences per row.

    Character grams come from the distinct words of a row, weighted by their count.
    """
    rows = by_id(df.select(F.col(id_col).alias("id"), F.lower(F.col(text)).alias("_t")))
    words = rows.select("id", words_of(F.col("_t")).alias("_w")).select(
        "id", F.explode(with_pairs(F.col("_w"))).alias("term")).groupBy("id", "term").agg(
        F.count(F.lit(1)).alias("tf")).select("id", F.lit("word").alias("analyzer"), "term", "tf")
    distinct = rows.select("id", F.explode(_all(F.col("_t"), r"\S+")).alias("w")).groupBy("id", "w").agg(
        F.count(F.lit(1)).alias("k"))
    chars = distinct.select("id", "k", F.explode(_padded_grams(F.col("w"), 3, 5)).alias("term")).groupBy(
        "id", "term").agg(F.sum("k").alias("tf")).select("id", F.lit("char").alias("analyzer"), "term", "tf")
    return words.unionByName(chars)


def vocabulary(term_counts: DataFrame, n_docs: int, min_df: int = 2) -> DataFrame:
    """(analyzer, term, df, idf) of the terms in at least ``min_df`` rows."""
    return with_idf(term_counts.groupBy("analyzer", "term").agg(F.count(F.lit(1)).alias("df")), n_docs, min_df)


def with_idf(df: DataFrame, n_docs: int, min_df: int) -> DataFrame:
    idf = F.ln(F.lit(float(1 + n_docs)) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return df.filter(F.col("df") >= min_df).withColumn("idf", idf)


# Bytes of a vocabulary that is sent to every task; a row costs its term and some 64 more.
BROADCAST_BYTES = 128 << 20


def vocabulary_bytes(vocab: DataFrame) -> int:
    return vocab.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0


def weigh(term_counts: DataFrame, vocab: DataFrame, n_bytes: int) -> DataFrame:
    """(id, analyzer, term, weight) + vocabulary columns: sublinear tf times idf,
    scaled to length 1 per row and analyzer.

    A vocabulary of checked size is broadcast and rows stay in place.  A larger one
    is joined on the term; a term found in most rows is then a hot key, which skew
    joins split, as its vocabulary side is a single row.
    """
    table = F.broadcast(vocab) if n_bytes <= BROADCAST_BYTES else vocab
    raw = term_counts.join(table, ["analyzer", "term"]).withColumn(
        "_w", (F.lit(1.0) + F.ln(F.col("tf").cast("double"))) * F.col("idf"))
    # as long as one document has terms
    per_row = Window.partitionBy("id", "analyzer")
    return raw.withColumn("_norm", F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(per_row))).withColumn(
        "weight", F.col("_w") / F.col("_norm")).drop("_w", "_norm")


def stored_vocabulary(counts: DataFrame, n_docs: int, min_df: int) -> tuple[DataFrame, int]:
    """The vocabulary written to the shared folder, and its bytes."""
    vocab = stored(vocabulary(counts, n_docs, min_df), "vocabulary")
    return vocab, vocabulary_bytes(vocab)


def tfidf(df: DataFrame, min_df: int = 2, id_col: str = "id", text: str = "script") -> DataFrame:
    counts = terms(df, id_col, text)
    vocab, n_bytes = stored_vocabulary(counts, df.count(), min_df)
    return weigh(counts, vocab, n_bytes).select("id", "analyzer", "term", "df", "idf", "tf", "weight")


# Bytes, counted as above, of a vocabulary that every worker holds as dictionaries.
WORKER_BYTES = 32 << 20
REMEMBERED_WORDS = 50_000


class Weigher:
    """TF-IDF weights of some texts at a time, for a vocabulary a worker can hold."""

    def __init__(self, vocab: pa.Table, sizes: list[int]):
        analyzer, term, slot, idf = (vocab.column(c).to_pylist() for c in ("analyzer", "term", "slot", "idf"))
        self.idf, self.char = np.zeros(len(slot)), np.zeros(len(slot), np.int64)
        self.idf[slot] = idf
        self.char[slot] = [a == "char" for a in analyzer]
        self.words = {t: s for a, t, s in zip(analyzer, term, slot) if a == "word"}
        self.chars = {t: s for a, t, s in zip(analyzer, term, slot) if a == "char"}
        self.sizes = sizes
        self.known: dict[str, np.ndarray] = {}

    def grams(self, word: str) -> np.ndarray:
        """Slots of the character grams of a word, repeats included."""
        found = self.known.get(word)
        if found is None:
            w = f" {word} "
            runs = (w[i:i + n] for n in range(3, min(5, len(w)) + 1) for i in range(len(w) + 1 - n))
            found = np.array([self.chars[g] for g in runs if g in self.chars], np.int64)
            if len(self.known) >= REMEMBERED_WORDS:
                self.known.clear()
            self.known[word] = found
        return found

    def vectors(self, words: pa.ListArray, tokens: pa.ListArray) -> list[pa.StructArray]:
        """The stored form of the sparse vector of every text, folded to each of the sizes: one
        sort of all occurrences gives the counts, one pass over them the weights and the norms."""
        row, code, names = _coded(words)
        own = np.array([self.words.get(s, -1) for s in names], np.int64)
        beside = row[1:] == row[:-1]
        pairs, at = np.unique(code[:-1][beside] << 32 | code[1:][beside], return_inverse=True)
        pair = np.array([self.words.get(f"{names[k >> 32]} {names[k & 0xFFFFFFFF]}", -1) for k in pairs.tolist()], np.int64)
        token_row, token, names = _coded(tokens)
        held, times = np.unique(token_row << 32 | token, return_counts=True)
        grams = [self.grams(s) for s in names]
        grams = [grams[k] for k in (held & 0xFFFFFFFF).tolist()]
        lengths = [len(g) for g in grams]
        rows = np.concatenate((row, row[1:][beside], np.repeat(held >> 32, lengths)))
        slots = np.concatenate((own[code], pair[at], *grams))
        times = np.concatenate((np.ones(len(row) + len(at), np.int64), np.repeat(times, lengths)))
        known = slots >= 0
        rows, slots, tf = _summed(rows[known], slots[known], times[known], len(self.idf))
        raw = (1.0 + np.log(tf)) * self.idf[slots]
        part = rows * 2 + self.char[slots]
        weights = raw / np.sqrt(np.bincount(part, raw * raw))[part]
        return [_sparse(len(words), size, *(
            _summed(rows, slots % size, weights, size) if size < len(self.idf) else (rows, slots, weights)))
            for size in self.sizes]


def _sparse(n: int, size: int, rows: np.ndarray, slots: np.ndarray, weights: np.ndarray) -> pa.StructArray:
    """``n`` sparse vectors as they are stored, from their entries in order."""
    ends = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.StructArray.from_arrays(
        [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)),
         pa.ListArray.from_arrays(ends, pa.array(slots.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(weights))],
        names=["type", "size", "indices", "values"])


def _coded(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Row and number of every string in a column of lists, and the numbered strings."""
    coded = column.flatten().dictionary_encode()
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), lengths), coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def _summed(rows: np.ndarray, slots: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, sum of the values), in order."""
    key = rows * max(1, size) + slots
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    sums = np.add.reduceat(values[order], first) if len(first) else values
    return rows[order][first], slots[order][first], sums


class TextSpace:
    """Vocabulary and weights of a training corpus, applied to any corpus."""

    def __init__(self, train: DataFrame, min_df: int = 2, max_columns: int = MAX_COLUMNS):
        from . import gramtotals

        vocab = with_idf(gramtotals.frequencies(train), train.count(), min_df).withColumn(
            "_md5", F.md5(F.concat_ws("|", "analyzer", "term")))
        numbered = checkpointed(ranking.ranked(
            vocab, [], ranking.hash_bucket(F.col("_md5")), [F.col("_md5"), F.col("term")], "_rank"))
        self.size, self.n_bytes = numbered.count(), vocabulary_bytes(numbered)
        if self.size > max_columns:
            raise ValueError(f"{self.size} terms need more than {max_columns} columns")
        self.vocab = numbered.withColumn("slot", (F.col("_rank") - 1).cast("int")).select("analyzer", "term", "df", "idf", "slot")

    def vectors(self, rows: DataFrame, keep: list[str], name: str = "features",
                columns: int | None = None) -> DataFrame:
        """``rows`` with a sparse TF-IDF vector; ``columns`` folds it to fewer."""
        return self.folded(rows, keep, {name: columns})

    def folded(self, rows: DataFrame, keep: list[str], widths: dict[str, int | None]) -> DataFrame:
        """``rows`` with a sparse TF-IDF vector for each name of ``widths``, folded to so many
        columns (None: all).

        A vocabulary that workers can hold turns every text into its vectors in place: no gram
        is ever a row.  A larger one is joined to the grams."""
        sizes = {name: max(1, self.size if w is None else min(w, self.size)) for name, w in widths.items()}
        if self.n_bytes <= WORKER_BYTES:
            return self._vectors_in_place(rows, ["id", *keep], sizes)
        weights = weigh(terms(rows), self.vocab, self.n_bytes)
        joined = rows.select("id", *keep)
        for name, size in sizes.items():
            own = weights.groupBy("id", F.pmod(F.col("slot"), F.lit(size)).alias("slot")).agg(F.sum("weight").alias("weight"))
            # one list per script: as long as the script has terms
            packed = own.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("slot", "weight"))).alias("_e"))
            joined = joined.join(packed, "id", "left").withColumn(
                name, sparse_vector(size, F.col("_e.slot"), F.col("_e.weight"))).drop("_e")
        return joined

    def _vectors_in_place(self, rows: DataFrame, keep: list[str], sizes: dict[str, int]) -> DataFrame:
        from pyspark.ml.linalg import VectorUDT

        text = F.lower(F.coalesce(F.col("script"), F.lit("")))
        split = rows.select(*keep, words_of(text).alias("_words"), _all(text, r"\S+").alias("_tokens"))
        schema = StructType([*split.select(*keep).schema, *(StructField(name, VectorUDT()) for name in sizes)])
        shared = rows.sparkSession.sparkContext.broadcast(self.vocab.select("analyzer", "term", "slot", "idf").toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from .gramtotals import slices

            weigher = Weigher(shared.value, list(sizes.values()))
            for part in slices(batches):
                found = weigher.vectors(part.column("_words"), part.column("_tokens"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *found], names=[*keep, *sizes])

        return split.mapInArrow(run, schema)


def sparse_vector(size: int, indices: Column, values: Column) -> Column:
    """A sparse ML vector from index and value arrays (null: no entries).

    The vector type has no SQL constructor for sparse data, but its stored form is
    a plain struct, which a JSON round trip turns into the type on the JVM.
    """
    from pyspark.ml.linalg import VectorUDT

    stored = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
        F.coalesce(indices, F.array().cast("array<int>")).alias("indices"),
        F.coalesce(values, F.array().cast("array<double>")).alias("values"))
    text = F.to_json(F.struct(stored.alias("v")))
    return F.from_json(text, StructType([StructField("v", VectorUDT())]))["v"]


def with_class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``y`` and ``class_weight`` = n / (2 * n of the row's class)."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts and set(counts) != {0, 1}:
        raise ValueError(f"rows of both classes and no other label are needed, found {sorted(map(str, counts))}")
    total = sum(counts.values())
    weight = F.lit(1.0)
    for y, n in counts.items():
        weight = F.when(F.col(label) == y, F.lit(total / (2.0 * n))).otherwise(weight)
    return df.withColumn("class_weight", weight).withColumn("y", F.col(label).cast("double"))


def logreg(n_rows: int, c: float = 4.0, features: str = "features"):
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(featuresCol=features, labelCol="y", weightCol="class_weight",
                              regParam=1.0 / (c * n_rows), standardization=False, maxIter=50)


def svm(n_rows: int, c: float = 1.0, features: str = "features"):
    from pyspark.ml.classification import LinearSVC

    return LinearSVC(featuresCol=features, labelCol="y", weightCol="class_weight",
                     regParam=1.0 / (c * n_rows), standardization=False, maxIter=50)


def forest(n_trees: int = 300, seed: int = K.SPLIT_SEED, features: str = "features"):
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(featuresCol=features, labelCol="y", weightCol="class_weight",
                                  numTrees=n_trees, maxDepth=10, seed=seed)


def squash_margin(margin: Column) -> Column:
    return scoring.sigmoid(margin)


def scored_by(model, rows: DataFrame, keep: list[str], name: str) -> DataFrame:
    """(keep, detector, risk, predicted) of a fitted classifier."""
    return scored_by_all({name: model}, rows, keep)


def scored_by_all(models: dict, rows: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, detector, risk, predicted) of fitted classifiers that read the same vectors,
    written once: who reads them several times does not score again."""
    from pyspark.ml.functions import vector_to_array

    entries = []
    for i, (name, model) in enumerate(models.items()):
        names = {"rawPrediction": f"_raw{i}", "prediction": f"_hit{i}"}
        if model.hasParam("probabilityCol"):
            names["probability"] = f"_p{i}"
        rows = model.copy({model.getParam(f"{c}Col"): to for c, to in names.items()}).transform(rows)
        risk = (vector_to_array(names["probability"])[1] if "probability" in names
                else squash_margin(vector_to_array(names["rawPrediction"])[1]))
        entries.append(F.struct(F.lit(name).alias("detector"), risk.alias("risk"),
                                (F.col(names["prediction"]) == 1.0).alias("predicted")))
    return stored(rows.select(*keep, F.explode(F.array(*entries)).alias("_e")).select(*keep, "_e.*"), "predictions")


def metric_table(pred: DataFrame, keys: tuple = ("detector",)) -> DataFrame:
    return M.full_metrics(pred, list(keys))


KEEP = ["id", "label"]


def _width(name: str) -> int | None:
    return FOREST_COLUMNS if name == "text_rf" else None


def _features(name: str) -> str:
    return "features" if _width(name) is None else "folded"


def training_vectors(space: TextSpace, train: DataFrame, widths: dict[str, int | None] = {"features": None}) -> DataFrame:
    """Vectors of ``train`` with class weights, written once: classes are counted before texts
    turn into vectors."""
    return stored(space.folded(with_class_weights(train), ["label", "class_weight", "y"], widths), "vectors")


def fit_baseline(name: str, rows: DataFrame, n_trees: int = 300):
    """Fit one text baseline on weighted training vectors."""
    if name == "text_rf":
        return forest(n_trees, features=_features(name)).fit(rows)
    return {"text_logreg": logreg, "text_svm": svm}[name](rows.count(), features=_features(name)).fit(rows)


def baseline_predictions(names: tuple, train: DataFrame, test: DataFrame, n_trees: int = 300) -> DataFrame:
    """(id, label, detector, risk, predicted) of each baseline fitted on all of ``train``.

    Estimators share the vectors they read: a text turns into them in one pass and leaves one
    small row per estimator; vectors of ``test`` are never written, ``test`` is read once.
    """
    train = checkpointed(train)
    space = TextSpace(train)
    widths = {_features(n): _width(n) for n in names}
    fit_on = training_vectors(space, train, widths)
    models = {n: fit_baseline(n, fit_on, n_trees) for n in names}
    return scored_by_all(models, space.folded(test, ["label"], widths), KEEP)


def variant_recall(train: DataFrame, test: DataFrame, rewrites: dict, names: tuple) -> DataFrame:
    """Recall of text detectors fitted on ``train``, per rewrite of the dangerous rows of
    ``test``, and its drop from the original text."""
    from . import mutate

    # texts are dealt before they multiply
    rows = mutate.variants(by_id(test.filter("label = 1").select("id", "label", "script")), rewrites)
    rows = rows.withColumn("id", F.concat_ws("|", "id", "variant"))
    pred = baseline_predictions(names, train, rows.drop("variant"))
    return M.recall_by_variant(pred.withColumn("variant", F.substring_index("id", "|", -1)), ["detector"])


def evaluate_baselines(train: DataFrame, test: DataFrame, real: DataFrame | None = None,
                       names: tuple = ("text_logreg", "text_svm", "text_rf"), n_trees: int = 300) -> DataFrame:
    """Metrics of every baseline on ``test``, and on ``real`` after a refit on all rows."""
    pred = baseline_predictions(names, train, test, n_trees).withColumn("target", F.lit("test"))
    if real is not None:
        refit = baseline_predictions(names, train.unionByName(test), real, n_trees)
        pred = pred.unionByName(refit.withColumn("target", F.lit("holdout")))
    return metric_table(pred, ("target", "detector"))


def _assembled(rows: DataFrame, inputs: list[str], name: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=inputs, outputCol=name).transform(rows)


def gbt_on_features(train: DataFrame, test: DataFrame, rounds: int = 300) -> DataFrame:
    """Boosted trees on the 13 features (depth 4, rate 0.1)."""
    from pyspark.ml.classification import GBTClassifier

    keep = KEEP + K.FEATURES
    fit = checkpointed(_assembled(scoring.features_for(train).select(*keep), K.FEATURES)
                       .withColumn("y", F.col("label").cast("double")))
    model = GBTClassifier(featuresCol="features", labelCol="y", maxDepth=4, stepSize=0.1,
                          maxIter=rounds, seed=K.SPLIT_SEED).fit(fit)
    rows = _assembled(scoring.features_for(test).select(*keep), K.FEATURES)
    return metric_table(scored_by(model, rows, KEEP, "gbt_on_features"))


def union_features_tfidf(train: DataFrame, test: DataFrame) -> DataFrame:
    """The 13 features next to the TF-IDF vector, logistic."""
    train = checkpointed(train)
    space = TextSpace(train)

    def both(rows: DataFrame, keep: list[str]) -> DataFrame:
        own = scoring.features_for(by_id(rows.select("id", *keep, "script")))
        return _assembled(space.vectors(own, [*keep, *K.FEATURES], "tfidf"), K.FEATURES + ["tfidf"])

    fit = checkpointed(both(with_class_weights(train), ["label", "class_weight", "y"]))
    model = logreg(fit.count()).fit(fit)
    return metric_table(scored_by(model, both(test, ["label"]), KEEP, "union_features_tfidf"))


def tuned_text_logreg(train: DataFrame, test: DataFrame, grid: list[float] = K.REGULARISATION_GRID,
                      folds: int = 5) -> DataFrame:
    """Logistic baseline with C chosen on the training rows by cross-validated F1."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    train = checkpointed(train)
    space = TextSpace(train)
    fit = training_vectors(space, train)
    n = fit.count()
    estimator = logreg(n)
    params = ParamGridBuilder().addGrid(estimator.regParam, [1.0 / (c * n) for c in grid]).build()
    f1 = MulticlassClassificationEvaluator(labelCol="y", metricName="fMeasureByLabel", metricLabel=1.0)
    model = CrossValidator(estimator=estimator, estimatorParamMaps=params, evaluator=f1, numFolds=folds,
                           seed=K.SPLIT_SEED).fit(fit).bestModel
    best_c = 1.0 / (model.getRegParam() * n)
    out = metric_table(scored_by(model, space.vectors(test, ["label"]), KEEP, "tuned_text_logreg"))
    return out.withColumn("best_c", F.lit(best_c))
