"""Session helpers: table loading and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only where the session names none and is local (tests, single machines) a temporary folder is set, which
    is removed at exit. A cluster without that setting is refused: its executors share no temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        made = tempfile.mkdtemp(prefix="logloom-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        named = "file://" + made
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_STAGED: dict[str, list[str]] = {}


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder as a Parquet table and read it back.

    The plan above it then no longer depends on the plan below it: a lost executor costs a
    re-read, and several consumers share one computation. The table is columnar and compressed,
    so it is smaller than a checkpoint of rows. ``clear_staged`` removes it once results are written.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"logloom-{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> int:
    """Remove the tables this session has staged; frames that read them can't be used any more. Their number."""
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


#: Bytes above which a table is never broadcast by hand.
BROADCAST_BYTES = 8 << 20


@contextmanager
def timed(label: str, report=print) -> Iterator[None]:
    """Report the seconds that a block took."""
    began = time.perf_counter()
    try:
        yield
    finally:
        report(f"{label}: {time.perf_counter() - began:.3f} s")
