"""Session helpers: a local session for tests and the shared folder for cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "terraloom") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers, once per application, so that functions
    find them wherever the driver was started (what ``--py-files`` does)."""
    sc = spark.sparkContext
    if getattr(sc, "_terraloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), "terraloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._terraloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (local tests) a fresh folder is
    made, and it is remembered in the session so that later calls agree. On a cluster there is
    no folder that could be guessed: it has to be named.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
        path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: it survives the loss of executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder for a written table or a stream's state."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def shared(df: DataFrame) -> DataFrame:
    """Keep a pre-aggregated input that is read more than once.

    Only daily records, fields and other reductions of the raw tables are kept, never the
    raw tables; lost blocks are recomputed and what does not fit spills to disk.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)
