"""Shared plumbing of the training-data operators: session settings, tables in
the shared folder, and names that cannot clash with a caller's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom import new_path, ship, spread, written

#: Narrow rows of a known number in a task.
ROWS = 1 << 15
#: Upper bounds of these settings for tables of whole documents. A column of 4096
#: texts at once is tens of MB, an Arrow batch may be 64 MB: in every task.
BOUNDS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20,
    "spark.sql.execution.arrow.maxRecordsPerBatch": 1000,
    "spark.sql.parquet.columnarReaderBatchSize": 256,
}


def session(df: DataFrame) -> SparkSession:
    """The session of ``df``, with batches bounded for whole documents and this
    package on the executors. Plans run after they are made, so the bounds stay set;
    lower ones of the caller's are left."""
    spark = df.sparkSession
    ship(spark)
    for name, most in BOUNDS.items():
        now = spark.conf.get(name, str(most)).removesuffix("b")
        if not now.isdigit() or int(now) > most or int(now) <= 0:
            spark.conf.set(name, str(most))
    return spark


def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``maskloom.written``, in fewer files where ``df`` is known to hold at most
    ``rows`` rows, and these are narrow: a small table does not take a task, and a
    file, for each of the shuffle's partitions."""
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS)))
    return written(df, name)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hash(df: DataFrame):
    """A 64-bit hash of all of a row's hashable columns."""
    cols = [df[c] for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return F.xxhash64(*cols)


def held_out():
    """True where crc32 of doc_id as text leaves remainder 0 by 5; a null id is
    never held out (and never labelled either)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["session", "materialise", "new_path", "spread", "fresh", "row_hash", "held_out", "table"]
