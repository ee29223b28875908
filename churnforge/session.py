"""Session construction and shared-storage helpers."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import io
import os
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Local default used only when the session names no checkpoint folder
# (tests, laptops). On a cluster spark.checkpoint.dir points at shared
# storage and is always read from the session.
_LOCAL_CHECKPOINT_ROOT = "/tmp/churnforge-checkpoints"


def get_session(master: str | None = None, app: str = "churnforge",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # delete checkpoint files once no live DataFrame references them
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    Only a local session may fall back to a machine-local folder; on a
    cluster a missing spark.checkpoint.dir is an error, because executors
    could not read each other's files.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        os.makedirs(_LOCAL_CHECKPOINT_ROOT, exist_ok=True)
        current = _LOCAL_CHECKPOINT_ROOT
        spark.conf.set("spark.checkpoint.dir", current)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables,
    deleted when the driver ends."""
    root = ensure_checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def write_shared(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one file through Spark's file system layer (any shared storage)."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hpath.getFileSystem(spark._jsc.hadoopConfiguration()).create(hpath)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once a context: however
    the driver found it, executors get it as a py-file. A package that itself
    came as a py-file is with them already."""
    sc, here = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(sc, "_churnforge_shipped", False) or not here.is_dir():
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted([*here.rglob("*.py"), *here.rglob("*.txt")]):
            z.write(f, f.relative_to(here.parent))
    path = f"{scratch_path(spark, 'package')}/churnforge.zip"
    write_shared(spark, path, data.getvalue())
    sc.addPyFile(path)
    sc._churnforge_shipped = True


#: Bytes of an Arrow batch on its way to Python, unless the session says otherwise:
#: a worker holds a batch or two at a time, and so does the JVM beside its heap.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def release_memory() -> None:
    """Give freed memory back to the system: workers are used again by later
    stages, whose own peaks would otherwise come on top of this one's."""
    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):       # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def _lean(fn):
    def run(batches):
        try:
            yield from fn(batches)
        finally:
            release_memory()

    return run


def map_in_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` of a function of this package, in small batches; the
    worker's freed memory goes back when the task ends."""
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)
    return df.mapInArrow(_lean(fn), schema)


def cut_lineage(df):
    """Reliable checkpoint into the shared folder (never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def training_partitions(df, id_col: str, small: int = 10_000, most_small: int = 16, large: int = 1_000_000):
    """Deal a training table by its id into a number of partitions that follows
    from its row count alone: one for every ``small`` rows up to ``most_small``,
    then as many as keep ``large`` rows each. Tree learners sample per partition,
    so a fit must not depend on how the input happened to be split or on the
    cluster's size; and they run hundreds of short jobs, whose time on a small
    table is that of starting tasks."""
    n = df.count()
    parts = max(min(most_small, -(-n // small)), -(-n // large), 1)
    return df.repartition(parts, id_col).sortWithinPartitions(id_col)


def boosting_partitions(df, id_col: str, rows: int = 75_000, most: int = 12):
    """A training table for boosted trees, dealt like :func:`training_partitions`
    into fewer parts: a round is some ten stages, so that on tables of a million
    rows and less starting their tasks takes longer than their rows do. Tables
    of up to 20,000 rows keep their parts."""
    n = df.count()
    parts = max(min(2, -(-n // 10_000)), min(most, -(-n // rows)), -(-n // 1_000_000), 1)
    return df.repartition(parts, id_col).sortWithinPartitions(id_col)


def table_version(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the files behind the given tables: names, sizes, times."""
    seen = []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
        seen += [f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files]
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:16]
