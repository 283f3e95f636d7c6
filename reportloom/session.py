"""Session helpers: shared folders, lineage cuts and a local test session."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used, but only for a local
    master: on a cluster a machine-local folder would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    made = tempfile.mkdtemp(prefix="reportloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/reportloom/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage and drop its lineage."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def local_session(app: str = "reportloom", cores: str | int = "*", **conf: str) -> SparkSession:
    """Session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("REPORTLOOM_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def keep_freed() -> None:
    """From now on this process uses up to 256 MB of freed arrays again before it returns them.

    Else every large array is got from the system and cleared page by page, which costs
    as much as filling it.  ``give_back`` returns them all the same.
    """
    tune = getattr(ctypes.CDLL(None), "mallopt", None)  # where the C library has it
    if tune is not None:
        tune(-3, 32 << 20)  # M_MMAP_THRESHOLD: larger arrays go back at once
        tune(-1, 256 << 20)  # M_TRIM_THRESHOLD


def give_back() -> None:
    """Return to the system what freed arrays held.

    A Python worker lives on after its task, and its allocators keep what they once got,
    which would count against the executor while other stages run.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def giving_back(fn: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function over the batches of a task that gives memory back at its end."""

    @functools.wraps(fn)
    def run(*args):
        try:
            yield from fn(*args)
        finally:
            give_back()

    return run
