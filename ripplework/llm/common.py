"""What the operators of this subpackage share: input shaping, the shared folder, batched Python stages."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python stage works on at once, whatever the size of Arrow's batches.
CHUNK_BYTES = 2 << 20

_OWN: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package even where the driver got it from its own path."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, local mode gets a temporary folder, as its executors are on this machine; a cluster is refused.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="ripplework-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return "file://" + _OWN["dir"]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and lost executors cost nothing.

    The files are removed when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ripplework-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


def rows_of(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone; extra columns, whatever they are called, go no further."""
    ship(df.sparkSession)
    return df.select(*(F.col(f"`{c}`") for c in columns))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def split_batches(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose text column holds about limit bytes; a longer single text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)


def fields_of(df: DataFrame, columns: Iterable[str]) -> str:
    """Schema text of some columns of df, each with a comma before it; for operators that carry columns along."""
    kinds = dict(df.dtypes)
    return "".join(f", `{c}` {kinds[c]}" for c in columns)


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, and would hold their peaks beside the JVM's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_chunks(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]]], text: str = "text", limit: int = CHUNK_BYTES) -> DataFrame:
    """Run make()'s function over byte-bounded slices of df. make runs once in each task, so it can hold caches."""
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for piece in split_batches(batches, text, limit):
            out = work(piece)
            for one in [out] if isinstance(out, (pa.RecordBatch, dict)) else out:
                yield pa.RecordBatch.from_pydict(one, schema=arrow) if isinstance(one, dict) else one
        del work
        give_back()

    return df.mapInArrow(run, schema)


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def input_tasks(df: DataFrame) -> int:
    """How many partitions the plan of df starts with; used to size buckets by the input."""
    return max(1, df.rdd.getNumPartitions())
