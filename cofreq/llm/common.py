"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cofreq.session import ensure_checkpoint_dir, own_path, ship_package

# rows and bytes of an Arrow batch: they bound the Python workers' memory
ARROW_ROWS = 512
ARROW_BYTES = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: the plan
    runs once, later uses scan the files, and the lineage is cut in a way that
    survives lost executors.  The files belong to the innermost open
    ``cofreq.session.Run``, which frees them; outside any run, to the retention
    of that folder, like checkpoints."""
    spark = df.sparkSession
    ship_package(spark)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage-{label}-{uuid.uuid4().hex[:12]}"
    own_path(spark, path)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._cofreq_stage = path
    return written


def free(*staged: DataFrame | None) -> None:
    """Delete the files of tables that ``stage`` returned, once everything made
    from them is written itself."""
    for df in staged:
        path = getattr(df, "_cofreq_stage", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def give_back() -> None:
    """Return memory that a worker's batches no longer need to the system;
    workers live on and serve later stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def batch_sizes(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the Arrow batches that Python workers get, in rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType,
              rows: int = ARROW_ROWS, made_by_task: bool = False) -> DataFrame:
    """One output batch for each input batch of at most ``rows`` rows.  With
    ``made_by_task``, ``fn()`` makes the function for the batches of one task, so
    that what it holds (a vocabulary, a cache) goes with the task."""
    ship_package(df.sparkSession)
    batch_sizes(df.sparkSession, rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = fn() if made_by_task else fn
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = step(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out
        del step
        give_back()

    return df.mapInArrow(run, schema)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """The UTF-8 bytes of a string column; None for null."""
    return pc.cast(batch.column(name), pa.binary()).to_pylist()


def bytes_len(col: str) -> Column:
    """UTF-8 bytes of a string column, 0 for null."""
    return F.coalesce(F.octet_length(col), F.lit(0)).cast("bigint")


def text_window(text: Column, key: Column, n_chars: int) -> Column:
    """``text``, or a run of ``n_chars`` characters of a longer one from a place
    chosen by a hash of ``key``.  For the same samples as ``row_sample``."""
    place = F.pmod(F.xxhash64(key, F.length(text)), (F.length(text) - n_chars + 1).cast("bigint")).cast("int")
    return F.when(F.length(text) <= n_chars, text).otherwise(F.substring(text, place + 1, F.lit(n_chars)))


def row_sample(df: DataFrame, key: str, n_rows: int, target: int) -> DataFrame:
    """About ``target`` of ``n_rows`` rows, chosen by a hash of ``key``
    (deterministic).  Only for the bounded samples that classifiers are fitted
    on."""
    if n_rows <= target:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000)) < F.lit(max(1, target * 1_000_000 // n_rows)))
