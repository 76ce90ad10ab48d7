"""Sources and sinks: raw byte files, tables, blocks, payload files and metrics."""

from __future__ import annotations

import resource
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.functions.bytes import as_bytes, blocks

# File name endings of the stored formats.
EXTENSIONS = {
    "lz78": ".lz78", "topk_lz78": ".topklz78", "lz77": ".lpf", "lpfs": ".lpfs", "gzip9": ".gzip", "topk_weiner": ".weiner", "topk_weiner_fast": ".weinerf",
    "blockwise_lz77": ".lz77block", "topk_lz77": ".topklz77", "twopass": ".topk2pass", "psample": ".topkpsample", "sample": ".topksample", "topk_sel": ".topk",
    "lzend": ".lzend", "lzend_kk": ".lzendkk", "lzend_kkl": ".lzendkkl", "topk_lzend": ".lzendtopk", "lzend_blockwise": ".lzendblock", "attract": ".topkattract",
}


def byte_files(spark: SparkSession, path: str, prefix: int | None = None) -> DataFrame:
    """path, b: whole files as bytes; prefix: their first bytes only. A file is one row, so files beyond
    the size of a binary value (2 GB) must be cut before."""
    files = spark.read.format("binaryFile").load(path)
    data = F.col("content") if prefix is None else F.substr("content", F.lit(1), F.lit(prefix))
    return files.select("path", data.alias("b"))


def byte_table(spark: SparkSession, folder: str, name: str, key: str, column: str, prefix: int | None = None) -> DataFrame:
    """key, b: a text column of a Parquet table as UTF-8 bytes."""
    data = as_bytes(column)
    cut = data if prefix is None else F.substr(data, F.lit(1), F.lit(prefix))
    return spark.read.parquet(f"{folder}/{name}.parquet").select(key, cut.alias("b"))


def block_table(spark: SparkSession, folder: str, name: str, key: str, column: str, window: int) -> DataFrame:
    return blocks(byte_table(spark, folder, name, key, column), "b", window, key)


def write_parsed(parsed: DataFrame, path: str, algo: str) -> None:
    """Phrases with the algorithm's name and file ending as columns."""
    parsed.select("*", F.lit(algo).alias("algo"), F.lit(EXTENSIONS[algo]).alias("ext")).write.mode("overwrite").parquet(path)


def read_parsed(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """The phrases and the algorithm that they are to be decoded with."""
    rows = spark.read.parquet(path)
    names = [r.algo for r in rows.select("algo").distinct().limit(2).collect()]
    if len(names) != 1:
        raise ValueError("one parsing was expected")
    return rows.drop("algo", "ext"), names[0]


def measured(run: Callable[[], DataFrame], **facts: object) -> DataFrame:
    """One row of sorted metrics of a run: the facts, rows, milliseconds, the driver's peak memory in bytes
    (its JVM's pools and its Python), and of containers (a column payload) the bytes out, with the ratio to the
    bytes in if a column n tells them."""
    pools = [p for p in _pools() if p.isValid()]
    for pool in pools:
        pool.resetPeakUsage()
    start = time.time()
    frame = run()
    wanted = {"rows": F.count("*")}
    if "payload" in frame.columns:
        wanted["nout"] = F.sum(F.octet_length("payload"))
        if "n" in frame.columns:
            wanted["n"] = F.sum("n")
    found = frame.agg(*(c.alias(k) for k, c in wanted.items())).first().asDict()
    values = {**facts, **found, "time": int((time.time() - start) * 1000)}
    values["memory"] = sum(p.getPeakUsage().getUsed() for p in pools) + resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024
    if found.get("n"):
        values["ratio"] = round(found["nout"] / found["n"], 4)
    return frame.sparkSession.createDataFrame([tuple(str(values[k]) for k in sorted(values))], ", ".join(f"`{k}` string" for k in sorted(values)))


def _pools() -> list:
    """The memory pools of the driver's JVM."""
    jvm = SparkSession.getActiveSession()._jvm
    return list(jvm.java.lang.management.ManagementFactory.getMemoryPoolMXBeans())
