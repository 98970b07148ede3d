"""Helpers shared by the operators: shared storage, table access, regions of text."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, a fresh local one for a local master (tests), an error on a cluster."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="twinarm-")
        spark.conf.set("spark.checkpoint.dir", configured)
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that a lost executor costs no recomputation from the start."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    temporary(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def temporary(spark: SparkSession, path: str) -> None:
    """Have a written scratch table deleted when the driver's JVM ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


#: Rows of whole texts that a Python worker gets at once.
BATCH_ROWS = 2000
#: The C allocator keeps few pools and gives large blocks back at once, and Arrow uses it too, so that workers don't hold the peaks of earlier stages.
RETURN_MEMORY = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "16777216", "ARROW_DEFAULT_MEMORY_POOL": "system"}


#: What tasks leave in their worker for later ones of their kind, by kind.
resident: dict[str, dict] = {}


def give_back(kind: str = "") -> None:
    """Let go of what tasks of other kinds have left in this worker, and return freed memory to the system, also that between blocks in use."""
    for other in resident.keys() - {kind}:
        del resident[other]
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def frugal(task: Callable[[Iterator], Iterator], kind: str = "") -> Callable[[Iterator], Iterator]:
    """A task for mapInArrow that gives memory back before it, after each batch and in the end, since workers live on with the peaks of all they have run."""

    def each(batches):
        for batch in batches:
            yield batch
            del batch
            give_back(kind)

    def run(batches):
        give_back(kind)
        yield from task(each(batches))
        give_back(kind)

    return run


def importable(spark: SparkSession) -> None:
    """Let Python workers started from here find this package (on a cluster it is installed or shipped with the job), hand them whole texts in
    small batches and keep their allocator from spreading."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    for name, value in RETURN_MEMORY.items():
        env.setdefault(name, value)
    if top not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [top, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at_most_about(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Rows of df that differ in key, a hash of theirs, one each; where they are more than rows, about as many, by that hash."""
    n = df.select(key).distinct().count()
    kept = df if n <= rows else df.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    return kept.dropDuplicates([key])
