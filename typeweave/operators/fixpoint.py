"""Iteration to a fixpoint with reliable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task sorts or gathers at once where their number is known, about.
ROWS = 250_000

_OWN: dict[str, str] = {}
_SCRATCH: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = os.path.join(tempfile.gettempdir(), "typeweave-shared", key)
        spark.sparkContext.setCheckpointDir(_OWN[key])
    return _OWN[key]


def scratch_dir(spark: SparkSession) -> str:
    """A folder for this application's tables in the shared folder; it goes when the driver's JVM ends."""
    context = spark.sparkContext
    path = f"{shared_dir(spark)}/typeweave-{context.applicationId}"
    if path not in _SCRATCH:
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _SCRATCH.add(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so that a lost executor costs no earlier round."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """As `checkpointed`, but columnar and compressed: for tables that later steps read in part."""
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` returned and that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "written_to", None):
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame, number: int, *keys: str) -> DataFrame:
    """df dealt out by keys to as many tasks as `number` rows need, so that a task's memory doesn't grow with the table.

    Steps by these keys that follow need no other exchange; where Spark deals out itself, a task may
    get all that fits its advisory size, compressed, and each sort of the stage holds that.
    """
    return df.repartition(-(-max(number, 1) // ROWS), *keys)


def iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], measure: Callable[[DataFrame], object], *, max_rounds: int, what: str) -> DataFrame:
    """Apply `step` until `measure` (a few scalars, computed by Spark) repeats; more than `max_rounds` is an error.

    Of the rounds' tables only the last stays.
    """
    state = written(state, "round")
    before = measure(state)
    for _ in range(max_rounds):
        last, state = state, written(step(state), "round")
        discard(last)
        after = measure(state)
        if after == before:
            return state
        before = after
    raise RuntimeError(f"{what} did not settle in {max_rounds} rounds")
