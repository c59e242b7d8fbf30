"""Cutting lineage and running driver-side fixpoint loops.

A loop over DataFrames doubles its plan with every turn, so each turn is written as a
Parquet table in the shared folder that the cluster names in ``spark.checkpoint.dir``
and read again.  Such a table survives the loss of executors, carries sizes that the
planner uses for the next joins, and is pruned by column like any other source.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    Where the session names none, a temporary one is set if driver and executors are one
    process (tests); on a cluster that is an error, as executors do not share local disks.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="coppice-"))
        named = sc.getCheckpointDir()
    return named


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone: the cluster cleans its own folder
        pass


_OPEN = threading.local()


def _scopes() -> list[list[tuple[SparkSession, str]]]:
    """What was written inside each open ``scope`` of this thread."""
    if not hasattr(_OPEN, "scopes"):
        _OPEN.scopes = []
    return _OPEN.scopes


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: same rows, no lineage.

    The files go when the innermost open ``scope`` ends, or with the process.
    """
    path = temporary_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def temporary_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted as tables of ``cut`` are."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes():
        _scopes()[-1].append((spark, path))
    else:
        atexit.register(_remove, spark, path)
    return path


@contextmanager
def scope() -> Iterator[None]:
    """Tables cut inside are deleted at the end: nothing lazy that reads them may leave."""
    _scopes().append([])
    try:
        yield
    finally:
        for spark, path in _scopes().pop():
            _remove(spark, path)


def cut_of(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``cut(make(), name)``, after which the tables that making it cut are deleted."""
    open_ = _scopes()
    open_.append([])
    try:
        df = make()
        inner = open_.pop()
        try:
            return cut(df, name)
        finally:
            open_.append(inner)
    finally:
        for spark, path in open_.pop():
            _remove(spark, path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table made by ``cut`` that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if file.startswith(("file:", "/", "hdfs:", "s3", "viewfs:", "abfs", "gs:")):
            _remove(spark, file)


def planned_bytes(df: DataFrame) -> int:
    """Size of ``df`` as the optimizer estimates it from file sizes; runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def signature(df: DataFrame) -> tuple:
    """Row count and an order-free checksum; equal signatures end a loop."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("x"),
        F.coalesce(F.sum(F.xxhash64(*df.columns).bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(0)).alias("s"),
    ).first()
    return tuple(row)


def fixpoint(
    state: DataFrame,
    step: Callable[[DataFrame], DataFrame],
    *,
    max_iter: int = 200,
    name: str = "loop",
) -> DataFrame:
    """Apply ``step`` until the rows no longer change; each turn is cut."""
    state = cut(state, name)
    before = signature(state)
    for _ in range(max_iter):
        new = cut(step(state), name)
        after = signature(new)
        drop_cut(state)
        state = new
        if after == before:
            return state
        before = after
    raise RuntimeError(f"{name}: no fixpoint after {max_iter} turns")


@contextmanager
def time_limit(spark: SparkSession, seconds: float) -> Iterator[None]:
    """Spark jobs that this thread starts inside are cancelled when the time is up, which raises ``TimeoutError``.

    Tasks are interrupted too, so that a job that hangs in one lets go of its cores.
    """
    sc, group, late, done = spark.sparkContext, f"limit-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def stop() -> None:
        if not done.wait(seconds):
            late.set()
            # a job may be on its way, or the next one follow: those are cancelled as they come
            while not done.is_set():
                sc.cancelJobGroup(group)
                done.wait(0.5)

    keys = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")
    before = {key: sc.getLocalProperty(key) for key in keys}
    sc.setJobGroup(group, f"at most {seconds} s", interruptOnCancel=True)
    watch = threading.Thread(target=stop, daemon=True)
    watch.start()
    try:
        yield
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"not done after {seconds} s") from e
        raise
    finally:
        done.set()
        watch.join()
        for key, value in before.items():
            sc.setLocalProperty(key, value)
