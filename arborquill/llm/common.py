"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import re
import tempfile
import threading
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every operator: ASCII space, tab, newline, vertical tab, form feed, return.
SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keyed(df: DataFrame, id_col: str, text_col: str, binary: bool = False) -> DataFrame:
    """Columns ``id`` and ``text`` (null: empty), the latter as UTF-8 bytes if asked."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("id"), (text.cast("binary") if binary else text).alias("text"))


#: Spark's setting by which an execution's shuffle files go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
#: Of each session's setting: how many checkpoints are being written, and the value before.
_HELD: dict[int, tuple[int, str]] = {}


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the session names, else, within one machine only, a temporary one."""
    if (at := spark.conf.get("spark.checkpoint.dir", None)) is not None:
        return at
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="checkpoint-")


@contextlib.contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Within, executions drop their shuffle files; several threads may be within at once."""
    key = id(spark._jsparkSession)
    with _LOCK:
        n, before = _HELD.get(key, (0, None))
        if not n:
            before = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _HELD[key] = (n + 1, before)
    try:
        yield
    finally:
        with _LOCK:
            n, before = _HELD.pop(key)
            if n > 1:
                _HELD[key] = (n - 1, before)
            else:
                spark.conf.set(CLEANUP, before)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the folder that the cluster names.

    The shuffle files behind it are then of no use and go at once. Checkpoints themselves go with the
    DataFrame if the cluster sets spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    spark = df.sparkSession
    with _LOCK:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))
    with cleaned_up(spark):
        return df.select("*").checkpoint(eager=True)  # the setting counts where a DataFrame is made


def pieces(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose second column holds about ``most`` bytes each, one row at least."""
    column = batch.column(1)
    sizes = pc.binary_length(column).to_pylist()
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + (n or 0) > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n or 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def sliced(batches: Iterable[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from pieces(batch, most)


def hex_sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)
