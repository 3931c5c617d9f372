"""Artefacts from files, and the labelled corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions.bytesview import bind, running_sum, view

MANIFEST = (
    "version int, samples array<struct<name:string,description:string,artefact:struct<path:string,language_id:string,mime_type:string>,content:string,"
    "expected:array<struct<type:string,value:string>>,slices:array<string>,decoys:array<string>,residual_secrets:array<string>>>"
)
#: Types a corpus may label.
LABELLED = ("Email", "Phone", "InternalIp", "Iban", "SortCode", "Secret")


def read_files(spark: SparkSession, path: str, extensions=(), skip=()) -> DataFrame:
    """artefact_id, content (binary), path of the files under ``path``, at any
    depth. Filters are on the path, before contents are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if extensions:
        rows = rows.where(F.rlike("path", F.lit(r"\.(?:" + "|".join(extensions) + ")$")))
    for folder in skip:
        rows = rows.where(~F.contains("path", F.lit(f"/{folder}/")))
    return rows.select(F.xxhash64("path").alias("artefact_id"), "content", "path")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("path"))
    return rows.select(F.xxhash64("path").alias("artefact_id"), "content", "path")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A row a sample of the manifest; missing lists are empty."""
    rows = spark.read.schema(MANIFEST).json(path, multiLine=True, mode="FAILFAST").select(F.explode("samples").alias("s")).select("s.*")
    empty = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("slices", "decoys", "residual_secrets")}
    rows = rows.withColumns(empty).withColumn("expected", F.coalesce("expected", F.array().cast("array<struct<type:string,value:string>>")))
    hints = {h: F.col(f"artefact.{h}") for h in ("path", "language_id", "mime_type")}
    return rows.withColumns(hints).drop("artefact")


def occurrences(text: Column, value: Column) -> Column:
    """Byte spans (start, end) of every place of ``value`` in ``text``, none overlapping."""
    b, v = view(text), view(value)
    both = F.struct(b.alias("b"), v.alias("v"))

    def spans(x: Column) -> Column:
        parts = F.split(x["b"], F.concat(F.lit("\\Q"), x["v"], F.lit("\\E")), -1)
        sizes = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.length(p) + F.length(x["v"]))
        return F.transform(running_sum(sizes), lambda e: F.struct((e - F.length(x["v"])).alias("start"), e.alias("end")))

    return bind(both, spans)


def labels(corpus: DataFrame) -> DataFrame:
    """sample, entity_type, value, start, end: each label at each of its places. An
    unknown type, or a value that is not there, is refused."""
    rows = corpus.select(F.col("name").alias("sample"), "content", F.explode("expected").alias("e"))
    rows = rows.select("sample", F.col("e.type").alias("entity_type"), F.col("e.value").alias("value"), occurrences(F.col("content"), F.col("e.value")).alias("at"))
    bad = ~F.col("entity_type").isin(*LABELLED) | (F.size("at") == 0)
    none = F.raise_error(F.lit("a label is of an unknown type or not in its sample")).cast("array<struct<start:int,end:int>>")
    rows = rows.withColumn("at", F.when(bad, none).otherwise(F.col("at")))
    return rows.select("sample", "entity_type", "value", F.explode("at").alias("at")).select("sample", "entity_type", "value", "at.start", "at.end").distinct()


def in_slice(corpus: DataFrame, tag: str) -> DataFrame:
    return corpus.where(F.array_contains("slices", tag))
