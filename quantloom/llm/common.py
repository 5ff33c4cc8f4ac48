"""What the text operators share: batches, shared storage, sizes and RNG streams."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.session import shipped

#: Rows, and bytes of text, that a Python worker holds as objects at a time.  One row may exceed it.
SLICE_ROWS, SLICE_BYTES = 2048, 2 << 20
#: Largest data (bytes, as counted before sending) that an operator sends to all executors.
BROADCAST_BYTES = 32 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow, with this package at hand wherever the tasks run."""
    shipped(df.sparkSession)
    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (tests), a temporary folder becomes it."""
    sc = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir"):
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(found)
        return found
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quantloom-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of what settled() returned, once nothing reads them any more."""
    for df in tables:
        plan = df._jdf.queryExecution().analyzed()
        if plan.getClass().getSimpleName() == "LogicalRDD" and (path := plan.rdd().getCheckpointFile()).isDefined():
            delete(df.sparkSession, path.get())


def delete(spark: SparkSession, path: str) -> None:
    """A folder of any file system, with all that is in it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that does not clash with those taken, whatever their case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"{name}_{uuid.uuid4().hex[:6]}"
    return name


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each has few rows and, unless one row is longer, few bytes of the column text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            end = min(max(end, at + 1), at + SLICE_ROWS)
            yield batch.slice(at, end - at)
            at = end


def texts(batch: pa.RecordBatch, column: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def utf8(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column as one array, and row i's bounds at [i] and [i + 1]; nulls are empty."""
    col = pc.cast(pc.fill_null(batch.column(batch.schema.get_field_index(column)), ""), pa.large_string())
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    ends = np.frombuffer(offsets, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser on uint64, wrapping."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def crc_of_id(column: str = "doc_id") -> "F.Column":
    """crc32 of the id's decimal text, as the folds define it; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def bounded_sample(df: DataFrame, key: str, rows: int, total: int, seed: int = 7) -> DataFrame:
    """About `rows` of the `total` rows, chosen by a hash of key: the documented bound for fitting classifiers."""
    share = min(1.0, 1.15 * rows / max(total, 1))
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) < int(share * (1 << 30)))
