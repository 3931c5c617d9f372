"""Masked packs as JSON lines, and the checks on reading them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
BINDINGS = "array<struct<display:string,mapping_ref:string>>"
PACK = (
    f"schema_version int, artefact_id long, text string, bindings {BINDINGS}, namespace struct<kind:string,id:string>, policy_version string, "
    "stats struct<counts:map<string,bigint>,blocked_artefacts:int>, created_at long, glued array<struct<word:string,parts:array<string>>>"
)


def save(packs: DataFrame, path: str) -> None:
    packs.select(
        F.lit(VERSION).alias("schema_version"),
        F.col("artefact_id").cast("long").alias("artefact_id"),
        "text",
        "bindings",
        F.struct(F.col("ns_kind").alias("kind"), F.col("ns_id").alias("id")).alias("namespace"),
        "policy_version",
        F.struct("counts", "blocked_artefacts").alias("stats"),
        "created_at",
        *[c for c in ("glued",) if c in packs.columns],
    ).write.mode("append").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Packs as ``mask`` gives them. Another version, an empty display, a ref that
    is no UUID, an unknown kind of namespace or a glued word that is not its parts
    is refused."""
    rows = spark.read.schema(PACK).json(path, mode="FAILFAST")
    uuid = "^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
    bad_ref = F.exists("bindings", lambda b: F.coalesce((b["display"] == "") | ~F.rlike(b["mapping_ref"], F.lit(uuid)), F.lit(True)))
    glued = F.coalesce("glued", F.array().cast(dict(rows.dtypes)["glued"]))
    bad_word = F.exists(glued, lambda g: F.coalesce(F.array_join(g["parts"], "") != g["word"], F.lit(True)))
    bad = (F.col("schema_version") != VERSION) | ~F.lower("namespace.kind").isin("session", "repo", "org") | bad_ref | bad_word
    checked = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("a pack cannot be trusted")).cast("string")).otherwise(F.col("text"))
    return rows.select(
        "artefact_id",
        checked.alias("text"),
        "bindings",
        F.col("stats.counts").alias("counts"),
        F.col("stats.blocked_artefacts").alias("blocked_artefacts"),
        F.col("namespace.kind").alias("ns_kind"),
        F.col("namespace.id").alias("ns_id"),
        "policy_version",
        "created_at",
        glued.alias("glued"),
    )
