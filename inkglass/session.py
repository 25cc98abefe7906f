"""Session helpers: configuration, shared scratch storage and code shipping."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: dict[str, str] = {}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("inkglass")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Functions that run in Python workers are pickled by module reference, so
    every executor must be able to import the package wherever it was started.
    """
    sc = spark.sparkContext
    if _SHIPPED.get(sc.applicationId):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="inkglass-"), "inkglass_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    _SHIPPED[sc.applicationId] = target


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under the folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    and the master is local (tests, a laptop) a temporary folder stands in.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="inkglass-scratch-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/inkglass/{uuid.uuid4().hex}"


def stored(df: DataFrame, where: str, name: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back: lineage ends there, so
    a lost executor costs only the tasks that were running on it."""
    path = f"{where}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
