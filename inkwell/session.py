"""Where intermediate tables live, and how the Arrow kernels reach executors."""

from __future__ import annotations

import sys
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster such
    a folder would be private to one machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if "folder" not in _LOCAL:  # the setting itself cannot be changed in a running session
        _LOCAL["folder"] = tempfile.mkdtemp(prefix="inkwell-")
    return _LOCAL["folder"]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def enable_checkpoints(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies; one that is gone already is no error."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def checkpoint_path(df: DataFrame) -> str | None:
    """Where the files of a frame returned by ``checkpoint()`` lie."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    return file.get() if file.isDefined() else None


class WorkingTables:
    """The tables written inside one ``working_tables`` block."""

    def __init__(self, spark: SparkSession, outer: WorkingTables | None):
        self.spark, self.outer, self.paths = spark, outer, []

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this block that nothing will read again, before the block ends."""
        for path in {getattr(t, "_written_at", None) for t in tables} & set(self.paths):
            self.paths.remove(path)
            delete_path(self.spark, path)

    def keep(self, df: DataFrame, label: str = "result") -> DataFrame:
        """``df`` as a table that outlives the block; what is no table of it yet is written down first."""
        if getattr(df, "_written_at", None) not in self.paths:
            df = materialize(df, label)
        self.paths.remove(df._written_at)
        if self.outer is not None:
            self.outer.paths.append(df._written_at)
        return df

    def close(self) -> None:
        while self.paths:
            delete_path(self.spark, self.paths.pop())


_BLOCK: ContextVar[WorkingTables | None] = ContextVar("inkwell_working_tables", default=None)


@contextmanager
def working_tables(spark: SparkSession):
    """Tables materialised inside the block are deleted on leaving it, but those given to ``keep``.

    What is kept belongs to the enclosing block, so that a job inside ``working_tables`` leaves
    nothing behind. Without an enclosing block a kept table stays until its folder is deleted: only the caller
    knows when the last reader of a result is done.
    """
    block = WorkingTables(spark, _BLOCK.get())
    token = _BLOCK.set(block)
    try:
        yield block
    finally:
        _BLOCK.reset(token)
        block.close()


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables of the enclosing block, if there is one, that nothing will read again."""
    block = _BLOCK.get()
    if block is not None:
        block.drop(*tables)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession):
    """Writes inside the block delete the files of their shuffles as they end, and do not leave them to the driver's next collection."""
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader over it.

    Used where one result feeds several jobs: it is computed once, its lineage
    ends at the files, and a lost executor costs a re-read instead of a re-run.
    What was shuffled for it is deleted when it is written. With ``by`` the files are parted by that column.
    The table belongs to the enclosing ``working_tables`` block, if there is one.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    block = _BLOCK.get()
    if block is not None:
        block.paths.append(path)
    with shuffles_deleted(spark):
        df.write.parquet(path, partitionBy=by)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def ship_kernels() -> None:
    """Send kernel functions inside the task closure, so executors need no install."""
    for name in ("inkwell.functions.kernels", "inkwell.functions.balls", "inkwell.functions.variational", "inkwell.functions.skipgram", "inkwell.functions.term_blocks", "inkwell.functions.han", "inkwell.functions.lattice"):
        __import__(name)
        cloudpickle.register_pickle_by_value(sys.modules[name])


@contextmanager
def planned_layout(spark: SparkSession):
    """Plan joins as laid out, without runtime re-planning, inside the block.

    For loops over tables already partitioned and sharded by key: re-planning would
    forget their partitioning at every checkpoint and shuffle them again each round.
    """
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
