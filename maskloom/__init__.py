"""Finding, masking and auditably restoring personal data and secrets in text, on Spark."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

_ROOT = Path(__file__).resolve().parent.parent


def ship(spark) -> None:
    """Have the executors' Python import this package: once a session, and only
    where their search path does not hold it already."""
    sc = spark.sparkContext
    given = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT in given or getattr(sc, "_maskloom", False):
        return
    to = Path(tempfile.mkdtemp(prefix="maskloom-")) / "maskloom.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(Path(__file__).resolve().parent.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(str(to))
    sc._maskloom = True


def shared_dir(spark) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). A temporary
    one is set only where the session names none and runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="maskloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def own_dir(spark) -> str:
    """This application's part of the shared folder; see ``clear``."""
    return f"{shared_dir(spark)}/maskloom/{spark.sparkContext.applicationId}"


def new_path(spark, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df, name: str):
    """``df``, written to the shared folder and read back: cuts lineage so that a
    lost executor repeats one step at most, and no step runs twice. It holds what
    ``df`` holds, so the folder is to be as private as the tables are."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A table of less for each core is small.
SMALL = 64 << 20


def spread(df):
    """``df``, dealt out over the cores where it is a small table in fewer files than
    there are cores: a file may be a single row group, which one task reads. Other
    tables are as their scans deal them out, without a shuffle."""
    if df.isStreaming:
        return df
    cores, files = df.sparkSession.sparkContext.defaultParallelism, df.inputFiles()
    if not files or len(files) >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL * cores else df


def clear(spark) -> None:
    """Remove all that this application has written to the shared folder. Tables
    that were read from there cannot be read any more."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
