"""Readers and writers: manifests with script files, labels, signatures, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import fixed as K
from ..functions.lexical import strip

MANIFEST_SCHEMA = ("id string, category string, label int, label_name string, rationale string, "
                   "template string, path string, provenance string, source string, source_url string, "
                   "n_chars int, n_lines int")
SIGNATURE_SCHEMA = ("version string, description string, categories map<string,string>, "
                    "signatures array<struct<id:string,category:string,weight:double,regex:string,rationale:string>>")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped."""
    return spark.read.schema(MANIFEST_SCHEMA).json(path).filter("id is not null")


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder as it stands in ``_metadata.file_path``, with a slash behind it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = fs.makeQualified(path).toUri()
    text = uri.toString().rstrip("/") + "/"
    # local paths are written with one slash or three: one here and below
    return "file:/" + text.removeprefix("file:").lstrip("/") if text.startswith("file:") else text


def read_corpus(spark: SparkSession, manifest: str, base_dir: str, strict: bool = True) -> DataFrame:
    """Manifest rows with their script bodies, joined on the relative path.

    Strict: a missing body fails the job, the template defaults to ``unknown``.
    Otherwise such rows are dropped and the template defaults to ``external``.
    """
    rows = read_manifest(spark, manifest)
    bodies = (
        spark.read.option("recursiveFileLookup", "true").text(base_dir, wholetext=True)
        .select(F.col("value").alias("script"), F.col("_metadata.file_path").alias("_file"))
    )
    # Paths in the manifest are relative to the base folder: its qualified form is cut off
    # by length.  Both sides are percent-encoded the same way.
    base = _qualified(spark, base_dir)
    bodies = bodies.withColumn("_file", F.regexp_replace("_file", "^file:/+", "file:/"))
    rest = F.substr(F.col("_file"), F.lit(len(base) + 1))
    inside = F.when(F.col("_file").startswith(base), rest).otherwise(
        F.raise_error(F.concat(F.lit(f"not below {base}: "), F.col("_file"))).cast("string"))
    # a plus sign is no blank in a file URI
    bodies = bodies.withColumn("path", F.url_decode(F.replace(inside, F.lit("+"), F.lit("%2B")))).drop("_file")
    joined = rows.join(bodies, "path", "left" if strict else "inner")
    body = F.col("script")
    if strict:
        body = F.when(body.isNull(), F.raise_error(F.concat(F.lit("no script at "), F.col("path"))).cast("string")
                      ).otherwise(body)
    return joined.select(
        "id", "category", "label", F.coalesce("rationale", F.lit("")).alias("rationale"), "path",
        body.alias("script"),
        F.coalesce("template", F.lit("unknown" if strict else "external")).alias("template"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, label) of an annotator's JSON lines; the last line of an id wins.

    Lines are ordered by file and by their running number inside it.
    """
    raw = spark.read.text(path).select(
        F.from_json("value", "id string, label int, annotator string").alias("r"),
        F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_no"))
    rows = raw.select("r.*", "_file", "_no").filter("id is not null")
    return rows.groupBy("id").agg(F.max_by("label", F.struct("_file", "_no")).alias("label"))


def load_signatures(spark: SparkSession, path: str) -> DataFrame:
    """Knowledge-base rows of a signature JSON document."""
    doc = spark.read.schema(SIGNATURE_SCHEMA).json(path, multiLine=True)
    return doc.select(F.explode("signatures").alias("s")).select("s.*")


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines that are not comments, trimmed."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("prompt"))
    return lines.filter((F.col("prompt") != "") & ~F.col("prompt").startswith("#"))


def write_manifest(df: DataFrame, path: str) -> None:
    """The manifest as JSON lines and as CSV with a header."""
    rows = df.drop("script")
    rows.write.mode("overwrite").json(f"{path}/manifest.jsonl")
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/manifest.csv")


def write_bodies(df: DataFrame, base_dir: str) -> None:
    """One file per script at its manifest path below ``base_dir``.

    Tasks write the files of their own rows; a retried task writes the same files
    again.  ``base_dir`` is a shared path or a URI pyarrow knows.
    """
    uri = base_dir if "://" in base_dir else "file://" + base_dir.removeprefix("file:")

    def write(rows) -> None:
        from pyarrow import fs

        target, root = fs.FileSystem.from_uri(uri)
        for row in rows:
            path = f"{root}/{row['path']}"
            target.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with target.open_output_stream(path) as out:
                out.write(row["script"].encode("utf-8"))

    df.select("path", "script").foreachPartition(write)


def result_document(analyzed: DataFrame) -> DataFrame:
    """(id, result): the nested result of a script as one JSON text."""
    from ..functions.lexical import PARSED_COLUMNS

    parsed = F.struct(*[c for c in PARSED_COLUMNS if c != "words"])
    doc = F.struct(
        parsed.alias("parsed"),
        F.struct(*[F.col(c).alias(c.removeprefix("context_")) for c in K.FEATURE_GROUPS["context"]]).alias("context"),
        F.transform("hits", lambda h: h["id"]).alias("signature_hits"),
        F.struct(*K.FEATURES).alias("features"),
        F.struct("risk", "trust", "level", "logit", "dangerous").alias("assessment"),
        F.struct("decision", F.col("seccomp"), F.col("namespace")).alias("policy"))
    return analyzed.select("id", F.to_json(doc).alias("result"))


def write_results(analyzed: DataFrame, path: str) -> None:
    """One JSON text per script, below ``path``, compressed (any reader of text unpacks it)."""
    result_document(analyzed).select("result").write.mode("overwrite").option("compression", "gzip").text(path)


def extract_script(reply: Column) -> Column:
    """The first fenced block of a reply (trimmed, null when empty), else the whole
    reply when it starts with ``#!``, else null."""
    fenced = F.regexp_extract_all(reply, F.lit("(?s)" + K.FENCE_PATTERN), F.lit(1))
    block = strip(F.get(fenced, F.lit(0)))
    plain = F.when(strip(reply).startswith("#!"), strip(reply))
    return F.when(F.size(fenced) > 0, F.nullif(block, F.lit(""))).otherwise(plain)


def conversations_to_corpus(conv: DataFrame, provider: str = "local", model: str = "assistant") -> DataFrame:
    """Manifest rows of the assistant replies that hold a script, with their prompt.

    The conversation numbers the prompt; replies of one conversation count up.  The
    prompt is the last user turn before the reply, null if there is none.
    """
    turns = Window.partitionBy("conv_id").orderBy("turn")
    asked = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(
        turns.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    replies = conv.withColumn("prompt", asked).filter("role = 'assistant'")
    k = F.row_number().over(turns) - 1
    rows = replies.withColumns({"k": k, "script": extract_script(F.col("text"))}).filter("script is not null")
    sid = F.format_string(f"llm_{provider}_%03d_%d", F.col("conv_id"), F.col("k"))
    return rows.select(
        sid.alias("id"), F.concat(F.lit("scripts/"), sid, F.lit(".sh")).alias("path"),
        F.lit(f"{provider}:{model}").alias("provenance"), F.length("script").alias("n_chars"), "prompt", "script")
