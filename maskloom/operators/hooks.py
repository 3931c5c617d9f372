"""Events of an agent's hooks: what in them is to be masked, and the answer.

``events``: event_id, event (a name in any case, with or without ``-`` and ``_``)
and payload (JSON). A payload that is not understood is blocked.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Events, and the field of each that is guarded.
EVENTS = {"userpromptsubmit": "UserPromptSubmit", "pretooluse": "PreToolUse", "posttooluse": "PostToolUse"}
FIELDS = {"UserPromptSubmit": "prompt", "PreToolUse": "tool_input", "PostToolUse": "tool_response"}
RESUBMIT = "This prompt holds sensitive values and was not sent. Resubmit the masked version if intended:\n\n"


def event_name(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in EVENTS.items() for x in kv])
    return F.try_element_at(known, F.lower(F.translate(name, "_-", "")))


def destination_name(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit("_"), F.lit("-")))


def subjects(events: DataFrame) -> DataFrame:
    """event_id, event, payload, subject (null if there is nothing to guard),
    path, kind (of the guarded field), drift (why the payload is not understood)."""
    rows = events.withColumn("event", event_name(F.col("event"))).withColumn("v", F.try_parse_json("payload"))
    get = lambda of: F.try_variant_get("v", f"$.{of}", "variant")
    field, guarded = F.lit(None).cast("string"), F.lit(None).cast("variant")
    raw = F.lit(None).cast("string")
    for event, name in FIELDS.items():
        here = F.col("event") == event
        field = F.when(here, name).otherwise(field)
        guarded = F.when(here, get(name)).otherwise(guarded)
        raw = F.when(here, F.get_json_object("payload", f"$.{name}")).otherwise(raw)
    rows = rows.withColumns({"field": field, "kind": F.schema_of_variant(guarded), "raw": raw})
    drift = (
        F.when(F.col("event").isNull(), "unknown event")
        .when(F.col("v").isNull(), "not JSON")
        .when(F.col("kind").isNull(), F.concat(F.lit("no field "), F.col("field")))
        .when((F.col("field") == "prompt") & (F.col("kind") != "STRING"), "prompt is not a string")
    )
    # null stands for itself once it is written out
    text = F.when(F.col("kind") == "VOID", "null").otherwise(F.col("raw"))
    path = F.when(F.col("event") != "UserPromptSubmit", F.try_variant_get("v", "$.tool_input.file_path", "string"))
    return rows.withColumn("drift", drift).select(
        "event_id", "event", "payload", F.when(F.col("drift").isNull() & (text != ""), text).alias("subject"), path.alias("path"), "kind", "drift"
    )


def _same(a, b) -> bool:
    if isinstance(a, dict):
        return isinstance(b, dict) and a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return isinstance(b, list) and len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, str):
        return isinstance(b, str)
    return type(a) is type(b) and a == b


@F.pandas_udf(T.BooleanType())
def same_shape(original, masked):
    """Whether two JSON texts differ in the contents of strings only."""
    import pandas as pd

    def one(a, b):
        try:
            return _same(json.loads(a), json.loads(b))
        except (TypeError, ValueError):
            return False

    return pd.Series([one(a, b) for a, b in zip(original, masked)])


def answers(subjects_: DataFrame, masked: DataFrame) -> DataFrame:
    """``masked``: artefact_id (the event's), text. Per event decision (pass,
    transform, block), exit_code, output (JSON, or null)."""
    rows = subjects_.join(masked.select(F.col("artefact_id").alias("event_id"), F.col("text").alias("masked")), "event_id", "left")
    is_text = F.col("kind") == "STRING"
    kept = F.col("drift").isNull() & (F.col("subject").isNull() | (F.col("masked") == F.col("subject")))
    sound = F.when(is_text, True).otherwise(same_shape(F.col("subject"), F.col("masked")))
    quoted = F.to_json(F.struct(F.col("masked").alias("x")))  # {"x":...}
    value = F.when(is_text, F.substr(quoted, F.lit(6), F.length(quoted) - 6)).otherwise(F.col("masked"))
    wrap = lambda start: F.concat(F.lit(start), value, F.lit("}}"))
    output = (
        F.when(F.col("event") == "UserPromptSubmit", F.to_json(F.struct(F.lit("block").alias("decision"), F.concat(F.lit(RESUBMIT), "masked").alias("reason"))))
        .when(F.col("event") == "PreToolUse", wrap('{"hookSpecificOutput":{"hookEventName":"PreToolUse","permissionDecision":"allow","updatedInput":'))
        .otherwise(wrap('{"hookSpecificOutput":{"hookEventName":"PostToolUse","updatedToolOutput":'))
    )
    decision = F.when(kept, "pass").when(F.col("drift").isNotNull() | F.col("masked").isNull(), "block").when(sound, "transform").otherwise("block")
    rows = rows.withColumn("decision", decision)
    return rows.select(
        "event_id", "event", "decision", F.when(F.col("decision") == "block", 2).otherwise(0).alias("exit_code"), F.when(F.col("decision") == "transform", output).alias("output")
    )
