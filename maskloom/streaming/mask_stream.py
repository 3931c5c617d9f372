"""Masking of streams: detection is stateless; each micro-batch interns in one
commit, then writes its packs, then its audit events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from maskloom.operators.mask import mask, redact
from maskloom.operators.vault import Vault
from maskloom.plans.policy import Policy
from maskloom.sources import audit


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Hook events as they are added to a folder, one JSON object a line."""
    return spark.readStream.schema("event_id long, event string, payload string").json(path)


def redact_stream(artefacts: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Of a streaming table: no state, so any output mode and sink."""
    return redact(artefacts, policy)


def mask_stream(artefacts: DataFrame, vault: Vault, ns_kind: str, ns_id: str, out: str, checkpoint: str, policy: Policy | None = None, now: int | None = None) -> DataStreamWriter:
    """A writer to start. Packs go to ``out``/packs, events to ``out``/audit. A
    batch that runs again finds its keys in the vault, so its placeholders are
    the same; its packs lie in a folder of its own, written over."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            made = mask(rows, vault, ns_kind, ns_id, policy, now).persist()
            made.write.mode("overwrite").parquet(f"{out}/packs/batch={number}")
            audit.events_of(made, f"batch-{number}").select(F.to_json(F.struct("schema_version", "id", "event")).alias("value")).write.mode("overwrite").text(f"{out}/audit/batch={number}")
            made.unpersist()
        finally:
            rows.unpersist()

    return artefacts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


__all__ = ["read_events", "redact_stream", "mask_stream"]
