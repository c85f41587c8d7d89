"""Structured Streaming jobs: the scoring gate, event decisions, feedback steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed as K
from ..operators import learning, monitor, policy, scoring
from ..operators.scoring import RiskModel
from ..session import checkpointed, shared_path


def stream_table(spark: SparkSession, folder: str, name: str, max_files: int | None = None) -> DataFrame:
    """The parquet table ``name`` of ``folder`` as a stream, with the schema it has.

    The path is a glob, so the table may be one file or a folder of files.
    """
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{folder}/{name}.parque[t]")


def stream_analyze(scripts: DataFrame, model: RiskModel = RiskModel()) -> DataFrame:
    """Gate each arriving script; stateless, so the plan is the batch plan."""
    return scoring.analyze(scripts, model)


def stream_decide(events: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Decide each observed syscall against the static policy table."""
    table = policy.policy_table(events.sparkSession) if rules is None else rules
    return monitor.decide_events(events, table)


def decision_windows(decided: DataFrame, delay: str = "10 minutes", length: str = "1 hour",
                     ts: str = "ts") -> DataFrame:
    """Counts by window, level and action; rows later than ``delay`` are left out."""
    timed = decided.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    return timed.groupBy(F.window("_ts", length), "level", "action").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "level", "action", "n")


def write_model(spark: SparkSession, model: RiskModel, path: str, version: int) -> None:
    """One model version; writing the same version again replaces it."""
    scoring.model_table(spark, model, str(version)).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/version={version}")


def model_versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).schema(
        "model_id string, feature string, weight double, version long").parquet(path)


def model_before(spark: SparkSession, path: str, version: int) -> RiskModel:
    """The newest model older than ``version``."""
    rows = model_versions(spark, path).filter(F.col("version") < version)
    newest = rows.agg(F.max("version")).first()[0]
    return scoring.read_model(rows.filter(F.col("version") == newest))


def stream_feedback(labelled: DataFrame, path: str, start: RiskModel = RiskModel(),
                    lr: float = learning.STEP_RATE, l2: float = learning.L2):
    """A stream writer that moves the model one gradient step per micro-batch.

    ``labelled`` carries features and a label.  Batch i reads the newest version
    before i + 1 and writes version i + 1, so a replayed batch redoes the same
    step from the same model instead of applying it twice.
    """
    spark = labelled.sparkSession
    write_model(spark, start, path, 0)

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        version = batch_id + 1
        model = model_before(session, path, version)
        # analysed once: the test below and the step read the written rows
        folded = checkpointed(learning.fold_rows(batch))
        if folded.isEmpty():
            write_model(session, model, path, version)
            return
        write_model(session, learning.online_step(folded, model, lr, l2), path, version)

    return labelled.writeStream.foreachBatch(step)


def stream_monitor(decided: DataFrame, path: str, keys: list[str] = ["level", "decision"]):
    """A stream writer that keeps the running counts of every monitored level.

    The counts are the state of a streaming aggregation: a batch sends one partial row per
    key and task, however many events a level has, and state holds one row per key.  In
    update mode a batch brings the changed keys only; batch i merges them into the newest
    snapshot before i + 1 and writes snapshot i + 1, so a replayed batch writes the same
    one again and a restart goes on from the counts so far.
    """
    counts = monitor.monitor_report(decided, keys)

    def step(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        fresh = checkpointed(batch)
        before = monitor_snapshot(batch.sparkSession, path, counts.schema, version)
        kept = fresh if before is None else fresh.unionByName(before.join(fresh, keys, "left_anti"))
        kept.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")

    return counts.writeStream.outputMode("update").foreachBatch(step)


def monitor_snapshot(spark: SparkSession, path: str, schema, before: int | None = None) -> DataFrame | None:
    """The counts of the newest snapshot (older than ``before``), None where there is none.
    Keys of a snapshot are levels, so it stays a few rows."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    versions = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
    newest = max((v for v in versions if before is None or v < before), default=None)
    return None if newest is None else spark.read.schema(schema).parquet(f"{path}/version={newest}")


def run_available(writer, checkpoint: str) -> None:
    """Process all input that is there, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def collect_stream(stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream over the available input into parquet and read it back."""
    spark = stream.sparkSession
    out = shared_path(spark, name)
    writer = stream.writeStream.format("parquet").option("path", out).outputMode("append")
    run_available(writer, shared_path(spark, f"{name}-progress"))
    return spark.read.schema(stream.schema).parquet(out)
