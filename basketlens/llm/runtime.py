"""What every operator needs from the session: code on the workers, checkpoints, Arrow maps."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.session import checkpoint_dir

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per application.

    The workers then import it whatever folder they were started in.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="basketlens-code-"), "basketlens.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("basketlens", os.path.relpath(path, package)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder of ``spark.checkpoint.dir``.

    Rows survive the loss of any executor; the files go when the frame is
    collected as garbage (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, under these names (extra and clashing columns go)."""
    positions = []
    for name in names:
        exact = [i for i, c in enumerate(df.columns) if c == name]
        if not exact:
            raise ValueError(f"column {name!r} is missing; there are {df.columns}")
        positions.append(exact[0])
    if len({c.lower() for c in df.columns}) == len(df.columns):
        return df.select(*names)
    renamed = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return renamed.select(*(renamed[f"c{i}"].alias(n) for i, n in zip(positions, names, strict=True)))


def give_back() -> None:
    """Give memory that a worker no longer uses back to the system.

    Workers are used again for later stages; Arrow's pool and the allocator
    would keep the largest arrays of each.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another allocator than glibc's
        pass


def lean_map(run: Callable) -> Callable:
    """A function for mapInArrow that gives memory back when its task ends."""

    def mapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return mapped


def lean_group(run: Callable) -> Callable:
    """A function of one table for applyInArrow that gives memory back after each call."""

    def one(table: pa.Table) -> pa.Table:
        out = run(table)
        give_back()
        return out

    return one


def lean_cogroup(run: Callable) -> Callable:
    """The same for two tables."""

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        give_back()
        return out

    return two


FAN = 32


def combined(parts: DataFrame, partitions: int, join: Callable[[list[bytes]], bytes]) -> bytes | None:
    """All rows of a frame (part binary) joined, ``FAN`` parts at a time; None without a row.

    ``partitions``: of the frame, each with one row at most.  No task and not
    the driver ever holds more than ``FAN`` parts, however many there are.
    """

    def level(table: pa.Table) -> pa.Table:
        return pa.table({"key": table["key"].slice(0, 1), "part": pa.array([join(table["part"].to_pylist())], pa.binary())})

    rows = parts.select(F.spark_partition_id().cast("long").alias("key"), "part")
    while partitions > FAN:
        partitions = -(-partitions // FAN)
        rows = rows.withColumn("key", F.col("key") % partitions).groupBy("key").applyInArrow(lean_group(level), "key long, part binary")
    found = [bytes(r.part) for r in rows.select("part").collect()]
    return join(found) if found else None
