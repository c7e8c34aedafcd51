"""Session helpers: a local session for tests and the bench, reliable
checkpointing, and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows above which a side input is joined by shuffle instead of broadcast.
BROADCAST_MAX_ROWS = 2_000_000


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session configured the way the library expects a cluster
    session to be configured (AQE on, UI off)."""
    builder = SparkSession.builder
    event_dir = os.environ.get("COFREQ_EVENT_LOG_DIR")
    if event_dir:  # stage/task timings for profiling, written to a scratch folder
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_dir)
    spark = (
        builder.master(f"local[{cores}]")
        .appName("cofreq")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.optimizer.canChangeCachedPlanOutputPartitioning", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        # keep the driver's status store small in long sessions
        .config("spark.ui.retainedJobs", "200")
        .config("spark.ui.retainedStages", "200")
        .config("spark.sql.ui.retainedExecutions", "50")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever they run (once
    per Spark context): executors fetch it from the driver like any file given
    with ``--py-files``."""
    sc = spark.sparkContext
    if getattr(sc, "_cofreq_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="cofreq-code-"), "cofreq_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._cofreq_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory.  On a cluster this is the
    shared folder named by ``spark.checkpoint.dir``; a private scratch folder
    is created only for a local master when nothing is configured (tests)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="cofreq-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


class Run:
    """The intermediates of one run: the files and tables that ``materialize``
    and ``bucketed_table`` wrote while it was the innermost open run.  Other
    runs of the session keep theirs.

        with Run(spark) as run:
            result = hybrid_mine(tx, 100)
            write_itemsets_text(result, path)
        # everything the miner wrote is gone, the result is whole

    Used without ``with``, ``open()`` and ``close()`` mark what belongs to it
    and ``release()`` frees it (a lazy result of the run cannot be read after
    that)."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, [], []

    def open(self) -> Run:
        _runs(self.spark).append(self)
        return self

    def close(self) -> None:
        open_runs = _runs(self.spark)
        if self in open_runs:
            open_runs.remove(self)

    def release(self) -> int:
        """Drop the tables and delete the files; returns how many there were."""
        n = len(self.tables) + len(self.paths)
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in self.paths:
            _delete(self.spark, path)
        self.paths, self.tables = [], []
        return n

    __enter__ = open

    def __exit__(self, *_) -> None:
        self.close()
        self.release()


def _runs(spark: SparkSession) -> list[Run]:
    """The open runs of a session, the innermost last; below them one that owns
    what is written outside any run."""
    sc = spark.sparkContext
    if not hasattr(sc, "_cofreq_runs"):
        sc._cofreq_runs = [Run(spark)]
    return sc._cofreq_runs


def own_path(spark: SparkSession, path: str) -> None:
    """Let the innermost open ``Run`` own the files at ``path``."""
    _runs(spark)[-1].paths.append(path)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: the plan
    runs once, and the lineage is cut in a way that survives executor loss.
    The files belong to the innermost open ``Run``."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{FILES}/{uuid.uuid4().hex[:16]}"
    own_path(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    """Size check for a broadcast side (a plain count: parallel, one number a task)."""
    return df.count() <= max_rows


def maybe_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint only when the side is proven small; otherwise the join
    stays a shuffle join (and AQE may still pick broadcast at run time)."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def bucketed_table(df: DataFrame, key: str, buckets: int, sort: bool = True) -> DataFrame:
    """Write ``df`` as a table bucketed (and sorted) by ``key`` under the
    shared checkpoint folder and read it back.

    Joins between two such tables on ``key`` with the same bucket count need
    no exchange, and the written table cuts the lineage (it survives executor
    loss).  ``df`` should already be hash-partitioned on ``key`` into
    ``buckets`` partitions, so each task writes one file per bucket."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    name = f"{INTERMEDIATE_PREFIX}{uuid.uuid4().hex[:16]}"
    _runs(spark)[-1].tables.append(name)
    _runs(spark)[-1].paths.append(f"{base}/tables/{name}")
    writer = df.write.bucketBy(buckets, key)
    if sort:
        writer = writer.sortBy(key)
    writer.option("path", f"{base}/tables/{name}").mode("overwrite").format("parquet").saveAsTable(name)
    return spark.table(name)


INTERMEDIATE_PREFIX = "cofreq_"
FILES = "cofreq-files"


def drop_intermediate_tables(spark: SparkSession, names: list[str] | None = None) -> int:
    """K7 (keep_intermediate=False): drop the named intermediate tables with
    their files; without ``names``, everything that was written outside any
    ``Run`` (what open or finished runs own is theirs to release).  Call it once
    the results built from them are written.  Returns the number of tables
    dropped."""
    rest = _runs(spark)[0]
    if names is None:
        n = len(rest.tables)
        rest.release()
        return n
    base = ensure_checkpoint_dir(spark).rstrip("/")
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        _delete(spark, f"{base}/tables/{name}")
    return len(names)


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own in the checkpoint folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
