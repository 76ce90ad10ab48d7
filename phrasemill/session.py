"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
_stored: list[str] = []
PARTITION_ROWS = 1 << 16  # short rows that fill a partition
#: For tables in a local folder: no checksum file beside each file. Without Hadoop's native library a process (chmod) is
#: started for every file that is made, and while it starts, its memory is the executor's. Other stores do not read these.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions))
    builder = builder.config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application (a few hundred KB of source)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    handle, path = tempfile.mkstemp(suffix=".zip", prefix="phrasemill-")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(_PACKAGE.rglob("*.py")):
            archive.write(source, source.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use the shared folder in ``spark.checkpoint.dir``; only a local session (tests) may do without one, and
    gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="phrasemill-checkpoints-"))


def saved(frame: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder, so that a lost executor costs no earlier stage."""
    ensure_checkpoints(frame.sparkSession)
    return frame.checkpoint(eager=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(frame: DataFrame) -> DataFrame:
    """Write frame as Parquet to the shared checkpoint folder and read it back: cuts the lineage, and
    takes less room than checkpoint(). ``clear`` deletes what was stored."""
    ensure_checkpoints(frame.sparkSession)
    path = f"{frame.sparkSession.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    frame.write.options(**_PLAIN_FILES).parquet(path)
    _stored.append(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete the tables that ``stored`` wrote, once nothing reads them any more; how many there were.
    (Checkpoints go with spark.cleaner.referenceTracking.cleanCheckpoints.)"""
    paths, _stored[:] = list(_stored), []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def few(frame: DataFrame, rows: int) -> DataFrame:
    """frame, which has at most so many short rows, in no more partitions than these fill, or one for each core:
    every partition that is written is a file or more, and a task wherever it is read."""
    return frame.coalesce(max(frame.sparkSession.sparkContext.defaultParallelism, -(-rows // PARTITION_ROWS)))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a small input over all cores. A small file is one task however many cores there are; input
    that already gives every core a full task is left as it is, so nothing large is shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(2 * cores, key) if (1 << 20) < size < cores * (64 << 20) else rows
