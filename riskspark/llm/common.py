"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import urllib.parse
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.fs  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import shared_dir


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; all other columns stay behind, so
    their names cannot clash with those an operator adds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that ``column`` holds at most ``max_bytes`` each (or one
    row): what a task holds at a time does not depend on the length of the texts."""
    for batch in batches:
        start, held = 0, 0
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        for row, size in enumerate(sizes):
            size = size or 0
            if row > start and held + size > max_bytes:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def pair_slices(batches: Iterator[pa.RecordBatch], left: str, right: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``slices`` by the bytes of two columns together."""
    for batch in batches:
        for part in slices(iter([batch]), left, max_bytes):
            yield from slices(iter([part]), right, max_bytes)


def release_memory() -> None:
    """Give what this worker no longer uses back to the system: workers live on between
    stages, beside the next ones of their executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def unused(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: their Python workers
    need not have it on their path."""
    context = spark.sparkContext
    if getattr(context, "_riskspark_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._riskspark_shipped = True


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with the package at hand on the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def hash_parts(spark: SparkSession) -> int:
    """Partitions of an explicit shuffle: the session's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """A fresh folder below ``spark.checkpoint.dir`` for written intermediate tables."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and go on from the written rows: no lineage behind
        them, and a lost executor costs a re-read only."""
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete one stored table (or all); only for tables that no result reads."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def local_path(uri: str) -> str | None:
    """The path behind a ``file:`` URI or a plain path; None for other stores."""
    parsed = urllib.parse.urlparse(uri)
    if parsed.scheme in ("", "file"):
        return urllib.parse.unquote(parsed.path)
    return None


def write_bytes(uri: str, data: bytes) -> None:
    """Write a file of the shared folder from a task.  The name is final only when the
    bytes are complete, and a repeated task writes the same bytes again."""
    path = local_path(uri)
    if path is not None:
        temp = f"{path}.{uuid.uuid4().hex}.part"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(temp, "wb") as out:
            out.write(data)
        os.replace(temp, path)
        return
    fs, target = pa.fs.FileSystem.from_uri(uri)
    temp = f"{target}.{uuid.uuid4().hex}.part"
    fs.create_dir(os.path.dirname(target), recursive=True)
    with fs.open_output_stream(temp) as out:
        out.write(data)
    fs.move(temp, target)


def mappable(uri: str) -> tuple[str, bool]:
    """A path that this worker can memory-map: the file itself where the shared folder
    is mounted, else a copy (second value True: unlink it once mapped)."""
    path = local_path(uri)
    if path is not None:
        return path, False
    fs, target = pa.fs.FileSystem.from_uri(uri)
    handle, copy = tempfile.mkstemp(prefix="model-")
    with os.fdopen(handle, "wb") as out, fs.open_input_stream(target) as data:
        shutil.copyfileobj(data, out, 1 << 20)
    return copy, True
