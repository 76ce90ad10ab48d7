"""What scratch tables and checkpoints cost beside their rows: files, and processes that an executor starts for them."""

import os
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from phrasemill.llm.components import connected
from phrasemill.session import few, saved, stored

COUNT = """
from phrasemill.session import local_session, stored
spark = local_session(2)
spark.sparkContext.setCheckpointDir({folder!r})
print(stored(spark.range(100).repartition(8)).count())
"""


def test_a_stored_partition_starts_two_processes_at_most(tmp_path):
    log, tool = tmp_path / "log", tmp_path / "bin" / "chmod"
    tool.parent.mkdir()
    tool.write_text(f'#!/bin/sh\necho "$@" >> {log}\nexec /bin/chmod "$@"\n')
    tool.chmod(0o755)
    env = os.environ | {"PATH": f"{tool.parent}:{os.environ['PATH']}", "PYTHONPATH": str(Path(__file__).resolve().parents[2])}
    run = subprocess.run([sys.executable, "-c", COUNT.format(folder=str(tmp_path / "shared"))], env=env, capture_output=True, text=True, timeout=120)
    assert run.stdout.split() == ["100"], run.stderr[-2000:]
    started = [x for x in log.read_text().splitlines() if "attempt_" in x] if log.exists() else []
    assert len(started) <= 2 * 8  # a folder and a file for each task: no checksum file


def test_stored_tables_have_no_checksum_files(spark):
    frame = stored(spark.range(100).repartition(3))
    folder = Path(frame.inputFiles()[0].removeprefix("file://")).parent
    assert frame.count() == 100 and len(frame.inputFiles()) == 3
    assert not list(folder.glob(".part-*.crc"))


def test_partitions_follow_the_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    assert few(spark.range(0, 1000, 1, 50), 1000).rdd.getNumPartitions() == cores
    assert few(spark.range(0, 1000, 1, 50), 10 << 16).rdd.getNumPartitions() == max(10, cores)
    assert few(spark.range(0, 1000, 1, 2), 10 << 20).rdd.getNumPartitions() == 2


def test_rounds_of_components_are_written_in_few_partitions(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = saved(spark.range(1, 60).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v")))
        roots = connected(links)
        assert {r.root for r in roots.collect()} == {0} and roots.count() == 60
        assert roots.select("node").filter("node > 0").rdd.getNumPartitions() < 40 + 2 * spark.sparkContext.defaultParallelism
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
