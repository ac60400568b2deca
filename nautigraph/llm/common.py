"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cut import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, under a local master only, one of our own."""
    where = checkpoint_dir(spark)
    return where if "://" in where else f"file://{where.removeprefix('file:')}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/nautigraph-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def filesystem(path: str):
    """(pyarrow file system, path on it) of a URI, for files that tasks read and write themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path; at exit the JVM may already be gone, and then there is nothing left to do."""
    try:
        if spark.sparkContext._jsc is None:
            return
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception as e:  # noqa: BLE001  py4j raises plain Exceptions of many kinds at shutdown
        if "py4j" not in type(e).__module__ and not isinstance(e, (ConnectionError, OSError, AttributeError)):
            raise


def modest_batches(spark: SparkSession) -> None:
    """Send documents to Python a thousand at a time, unless the session asks for a number of its own.

    Spark's default of 10,000 rows is meant for narrow rows; of whole documents that many fill the memory of
    executors and their Python workers with copies.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "1000")


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives the loss of executors."""
    modest_batches(df.sparkSession)
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows whose crc32(doc_id as text) mod 3 is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def map_rows(df: DataFrame, schema: str, fn: Callable[[Iterator[tuple]], Iterable[tuple]]) -> DataFrame:
    """mapInArrow with fn on an iterator of row tuples, yielding tuples; a few hundred rows are held at a time."""
    modest_batches(df.sparkSession)
    target = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for part in slices(b):
                    yield from zip(*(c.to_pylist() for c in part.columns))

        buffer: list[tuple] = []
        for row in fn(rows()):
            buffer.append(row)
            if len(buffer) >= 1024:
                yield _batch(buffer, target)
                buffer = []
        if buffer:
            yield _batch(buffer, target)
        pa.default_memory_pool().release_unused()  # workers live on; the next task may be of another kind

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in small pieces, so that only a few rows at a time become Python objects."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64 arrays: a bijection whose bits pass as independent."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """uint64 hashes as doubles in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


#: Rows of a side that is broadcast at most; such sides hold a few narrow columns, some tens of bytes a row.
BROADCAST_ROWS = 1_000_000


def join_counted(left: DataFrame, right: DataFrame, on, how: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """left join right, right being a written table of narrow rows: broadcast if it's counted to be small, else shuffled."""
    return left.join(F.broadcast(right) if right.count() <= most else right.hint("merge"), on, how)
