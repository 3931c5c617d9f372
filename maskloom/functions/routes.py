"""Verdicts on requests: only listed routes are masked or passed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The routes known.
MASKED = (("POST", "/v1/messages"), ("POST", "/v1/messages/count_tokens"))
PASSED = (("HEAD", "/"), ("HEAD", "/api/hello"), ("GET", "/inference-profiles"), ("GET", "/v1/models"))
MODEL = r"^/model/[^/]+/(?:invoke|invoke-with-response-stream)$"


def route_verdict(method: Column, target: Column) -> Column:
    """Mask, Pass or Block of a method and request target, its query aside."""
    path = F.substring_index(target, "?", 1)
    any_of = lambda routes: F.concat(method, F.lit(" "), path).isin([f"{m} {p}" for m, p in routes])
    masked = any_of(MASKED) | ((method == "POST") & F.rlike(path, F.lit(MODEL)))
    return F.when(masked, "Mask").when(any_of(PASSED), "Pass").otherwise("Block")
