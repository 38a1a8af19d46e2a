"""Session settings the library relies on, and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

_freeing: dict[str, tuple[int, str]] = {}  # blocks open in a session, and its setting before the first
_freeing_lock = Lock()
_stages: ContextVar[tuple[list[str], ...]] = ContextVar("gaugebook_stages", default=())  # a list per open block

# Runtime settings only: cluster sizing (executors, memory, shuffle partitions)
# stays with whoever submits the job.
RUNTIME_CONF = {
    # Instants are compared and bucketed by month in UTC.
    "spark.sql.session.timeZone": "UTC",
    # Overflow must fail loudly, never wrap or turn into NULL.
    "spark.sql.ansi.enabled": "true",
    # INT96, the default, carries no statistics: time filters could not skip row groups.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # One hot site, key or reading may hold a third of all rows: the joins below
    # aggregate first, and AQE splits the oversized partitions of the other side.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "gaugebook", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints. Only a local session may go without one: its
    executor is the driver, so that a temporary folder is seen by both."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="gaugebook-checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the checkpoint root."""
    app = spark.sparkContext.applicationId
    return f"{checkpoint_root(spark)}/gaugebook/{app}/{label}-{uuid.uuid4().hex[:12]}"


#: Spark removes the shuffle files of a query when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside the block, each query's shuffle files go when it ends. Otherwise they stay on the
    executors' disks until the driver collects garbage, which may never happen: an epoch
    would hold the shuffles of all its stages at once. Each query is to run once only.
    Blocks of several threads may overlap: the last to end restores the setting."""
    session = spark._jsparkSession.sessionUUID()
    with _freeing_lock:
        inside, before = _freeing.get(session) or (0, spark.conf.get(FREE_SHUFFLES, "false"))
        _freeing[session] = inside + 1, before
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        with _freeing_lock:
            inside, before = _freeing.pop(session)
            if inside > 1:
                _freeing[session] = inside - 1, before
            else:
                spark.conf.set(FREE_SHUFFLES, before)


def stage(df: DataFrame, label: str, compression: str | None = None, outlives: bool = False) -> DataFrame:
    """Cut lineage by writing `df` to the checkpoint folder as Parquet.

    Unlike a row checkpoint the result is columnar, so each later reader scans
    only the columns it uses and the planner knows the real size. The files
    survive lost executors. `compression` is Parquet's, by default the session's.
    With `outlives` they stay after the innermost `dropping_stages` and go with the
    one around it, if any.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    blocks = _stages.get()
    if outlives:
        blocks = blocks[:-1]
    if blocks:
        blocks[-1].append(path)
    with freeing_shuffles(spark):
        df.write.mode("errorifexists").parquet(path, compression=compression)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._stage_path = path
    return staged


def release(*staged: DataFrame) -> None:
    """Remove the files of stages that nothing reads any more, ahead of the end of their block."""
    for df in staged:
        _remove(df.sparkSession, df._stage_path)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def dropping_stages(spark: SparkSession) -> Iterator[None]:
    """Remove what `stage` writes inside the block once the block is done, and the shuffle
    files of each of its queries when that ends. Blocks may lie in each other."""
    inner: list[str] = []
    token = _stages.set((*_stages.get(), inner))
    try:
        with freeing_shuffles(spark):
            yield
    finally:
        _stages.reset(token)
        for path in inner:
            _remove(spark, path)
