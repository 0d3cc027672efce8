"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import functools
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts of these operators spell it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader (any file system that Spark knows)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows in an Arrow batch. Documents are long, and a batch is held by the JVM and by the Python worker.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def ship(spark: SparkSession) -> None:
    """Send this package's source to the Python workers, once per application; they may run where it isn't installed.

    A session that doesn't set the size of Arrow batches gets one that suits long texts."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    context, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(context, "_windrow_shipped", False) or not package.is_dir():
        return
    folder = Path(tempfile.mkdtemp(prefix="windrow-"))  # Spark serves the file from here as long as the driver runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(folder / "windrow_source.zip", "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(folder / "windrow_source.zip"))
    context._windrow_shipped = True


def lean(part):
    """A function over batches that gives freed memory back to the system when it ends; workers live on for other tasks."""

    @functools.wraps(part)
    def run(batches):
        try:
            yield from part(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The session's ``spark.checkpoint.dir`` (or the checkpoint directory already set). Only a local session,
    where driver and executors are one process, gets a temporary folder if there is none.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="windrow-")
    context.setCheckpointDir(made)
    return made


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/windrow/{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at.getParent())
    return path


class Temporary:
    """The tables written within a ``temporary`` block."""

    def __init__(self):
        self.paths: dict[str, SparkSession] = {}

    def keep(self, *tables: DataFrame) -> None:
        """These tables (as ``materialise`` gave them) outlive the block."""
        for table in tables:
            session = self.paths.pop(table._windrow_path, None)
            if session is not None and len(held := _open.get()) > 1:
                held[-2].paths[table._windrow_path] = session

    def discard(self, table: DataFrame) -> None:
        """Delete a table that is no longer needed, if it was written within the block."""
        if session := self.paths.pop(table._windrow_path, None):
            _delete(session, table._windrow_path)


_open: contextvars.ContextVar[tuple[Temporary, ...]] = contextvars.ContextVar("windrow_temporary", default=())


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def temporary():
    """Tables that ``materialise`` writes within the block are deleted at its end, but for those that are kept."""
    held = Temporary()
    token = _open.set((*_open.get(), held))
    try:
        yield held
        for path, session in held.paths.items():
            _delete(session, path)
    finally:
        _open.reset(token)  # what a failed block has written goes with the session


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: its lineage ends there, and lost executors
    cost no more than the tasks that they ran. The commit protocol of Spark's writers covers retried tasks."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._windrow_path = path
    if held := _open.get():
        held[-1].paths[path] = df.sparkSession
    return out


#: Rows that a task writes at least, where a bound on a table's rows is known.
TASK_ROWS = 20_000


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """df, which has at most so many rows, in no more tasks than they need, for writing.

    For every file that it makes in a folder of the ``file`` scheme Hadoop starts three processes, which the executor's
    JVM gives birth to; hundreds of tables of a few rows in hundreds of files each are a load of their own. No task gets
    more work than TASK_ROWS rows on average, and all cores stay in use.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def normal_text(col: str = "text"):
    """The text with every run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(col), F.lit("")), SPACE, " ")


def bounded_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are at most ``most``; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= most else df
