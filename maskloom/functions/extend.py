"""Detectors of a user's own, and whether a detector keeps to what others rely on.

Any function of a viewed text (see ``bytesview.view``) to an array of findings is a
detector; give ``detect.scan`` a dict of them. ``of_pattern`` makes one of a pattern,
without Python on the executors; ``of_python`` of a Python function, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskloom.functions.bytesview import ascii_boundaries, cut, find_spans, view
from maskloom.schema import CUSTOM, FINDING, ORDER

SPANS = "array<struct<entity_type:string,start:int,end:int,confidence:float>>"


def type_order(entity_type: Column) -> Column:
    """A type's place among all; custom ones come after the fixed ones."""
    known = F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv])
    return F.coalesce(F.try_element_at(known, entity_type), F.lit(len(ORDER)))


def _findings(spans: Column, detector: str, b: Column) -> Column:
    one = lambda s: F.struct(
        s["entity_type"].alias("entity_type"), type_order(s["entity_type"]).alias("type_ord"), s["start"].alias("start"), s["end"].alias("end"),
        s["confidence"].cast("float").alias("confidence"), F.lit(detector).alias("detector"), cut(b, s["start"], s["end"]).alias("value"),
    )
    return F.transform(spans, one).cast(f"array<{FINDING}>")


def of_pattern(entity_type: str, detector: str, pattern: str, confidence: float) -> Callable[[Column], Column]:
    """A detector of all matches of a Java pattern over bytes; ``\\b`` is ASCII."""

    def find(b: Column) -> Column:
        spans = find_spans(b, ascii_boundaries(pattern))
        return _findings(F.transform(spans, lambda s: F.struct(F.lit(entity_type).alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), F.lit(confidence).alias("confidence"))), detector, b)

    return find


def of_python(detector: str, find: Callable[[bytes], Iterable[tuple[str, int, int, float]]]) -> Callable[[Column], Column]:
    """A detector of what ``find`` gives for a text's bytes: (type, start, end,
    confidence), positions in bytes. A null text has none."""

    def run(texts):
        import pandas as pd

        return pd.Series([[tuple(x) for x in find(t.encode("latin-1"))] if t is not None else [] for t in texts])

    spans = F.pandas_udf(run, T._parse_datatype_string(SPANS))

    def detect(b: Column) -> Column:
        return _findings(spans(b), detector, b)

    detect.python = True
    return detect


def violations(spark: SparkSession, detector: Callable[[Column], Column], texts: Iterable[str | bytes | None], declared: Iterable[str]) -> DataFrame:
    """What a detector does, on sample ``texts``, that no detector may: rows of text
    (its number) and what. Twice the same text has the same findings; types are among
    those ``declared`` (a custom one as ``Custom:<name>``); confidence is from 0 to 1;
    a span lies in the text and its value is what stands there."""
    for name in declared:
        if name not in ORDER and not name.startswith(CUSTOM):
            raise ValueError(f"no type is called {name}")
    rows = spark.createDataFrame([(i, None if t is None else t.encode() if isinstance(t, str) else bytes(t)) for i, t in enumerate(texts)], "text int, content binary")
    viewed = rows.select("text", view(F.col("content"), True).alias("b"))
    found = viewed.select("text", "b", detector(F.col("b")).alias("first")).withColumn("second", detector(F.concat("b", F.lit(""))))
    bad = lambda name, test: F.when(F.exists("first", test), name)
    what = F.array_compact(
        F.array(
            F.when(~F.col("first").eqNullSafe(F.col("second")), "other findings the second time"),
            bad("an undeclared type", lambda f: ~F.coalesce(f["entity_type"].isin(*declared), F.lit(False))),
            bad("a confidence outside 0 to 1", lambda f: ~F.coalesce(f["confidence"].between(0, 1), F.lit(False))),
            bad("a span outside the text", lambda f: ~F.coalesce((f["start"] >= 0) & (f["start"] <= f["end"]) & (f["end"] <= F.length("b")), F.lit(False))),
            bad("a value that is not at its span", lambda f: f["value"] != cut(F.col("b"), f["start"], f["end"])),
        )
    )
    return found.select("text", F.explode(what).alias("what"))


def conforms(spark: SparkSession, detector: Callable[[Column], Column], texts: Iterable[str | bytes | None], declared: Iterable[str]) -> None:
    """Raise AssertionError with the first violation, if there is one."""
    first = violations(spark, detector, list(texts), list(declared)).orderBy("text", "what").first()
    if first:
        raise AssertionError(f"on text {first['text']}: {first['what']}")
