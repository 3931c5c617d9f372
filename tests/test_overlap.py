import random

import pytest
from pyspark.sql import functions as F

from maskloom.operators import overlap
from maskloom.operators.overlap import resolve, resolve_rows
from maskloom.schema import FINDING, ORDER


def owners(findings):
    """Byte by byte: who ranks highest there."""
    ranked = sorted(findings, key=lambda f: (f[0] == "Secret", f[2] - f[3], f[2], f[1], f[5]))
    own = {}
    for k, f in enumerate(ranked):
        for at in range(f[2], f[3]):
            own.setdefault(at, k)
    out = []
    for at in sorted(own):
        if out and out[-1][0] == own[at] and out[-1][2] == at:
            out[-1][2] = at + 1
        else:
            out.append([own[at], at, at + 1])
    return sorted((ranked[k][0], a, b) for k, a, b in out)


def make(kind, start, end, detector="d"):
    return (kind, ORDER[kind], start, end, 0.5, detector, "".join(chr(97 + i % 26) for i in range(start, end)))


@pytest.mark.parametrize("block", [4, 1024])
def test_random_cases(spark, monkeypatch, block):
    rng = random.Random(3)
    cases = [(0, []), (1, [make("Secret", 0, 30), make("Email", 5, 10), make("Email", 20, 25)])]
    for i in range(2, 400):
        fs = [make(rng.choice(["Secret", "Email", "Phone", "Iban"]), a, a + rng.randint(1, 12), f"d{rng.randint(0, 2)}") for a in (rng.randint(0, 25) for _ in range(rng.randint(0, 6)))]
        cases.append((i, fs))
    df = spark.createDataFrame(cases, f"artefact_id int, f array<{FINDING}>")
    arrays = {r["artefact_id"]: r["f"] for r in df.select("artefact_id", resolve(F.col("f")).alias("f")).collect()}
    table: dict = {}
    monkeypatch.setattr(overlap, "BLOCK", block)
    for r in resolve_rows(df.select("artefact_id", F.explode("f").alias("x")).select("artefact_id", "x.*")).collect():
        table.setdefault(r["artefact_id"], []).append((r["entity_type"], r["start"], r["end"]))
    for i, fs in cases:
        want = owners(fs)
        assert sorted((f["entity_type"], f["start"], f["end"]) for f in arrays[i]) == want
        assert sorted(table.get(i, [])) == want
        assert all(len(f["value"]) == f["end"] - f["start"] for f in arrays[i])
    assert [(f["entity_type"], f["start"], f["end"]) for f in arrays[1]] == [("Secret", 0, 5), ("Email", 5, 10), ("Secret", 10, 20), ("Email", 20, 25), ("Secret", 25, 30)]
