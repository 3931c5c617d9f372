"""How well findings match labels: joins and aggregates.

``findings``: sample, entity_type, start, end, detector, class; ``labels``:
sample, entity_type, start, end. Joins are on the sample, so ranges are compared
within one only.
"""

from __future__ import annotations

import os
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom import new_path, written
from maskloom.schema import MASK, REDACT

# The gates.
GATES = {"secret_recall": 0.99, "pii_recall": 0.95, "false_positive_rate": 0.03, "consistency": 0.99, "p95_us": 25_000, "hot_p95_us": 50_000}
#: Checks that a corpus must have samples for.
STRUCTURAL = {"artefact-block-fires", "masked-json-still-parses"}


def overlap(a: str, b: str) -> Column:
    return (F.col(f"{a}.start") < F.col(f"{b}.end")) & (F.col(f"{b}.start") < F.col(f"{a}.end"))


def protected(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("class").isin(MASK, REDACT))


def matched(left: DataFrame, right: DataFrame, how: str = "left_semi", same_type: bool = True) -> DataFrame:
    """Rows of ``left`` with (left_semi) or without (left_anti) one of ``right`` in
    the sample that overlaps, of the same type."""
    on = (F.col("a.sample") == F.col("b.sample")) & overlap("a", "b")
    if same_type:
        on = on & (F.col("a.entity_type") == F.col("b.entity_type"))
    return left.alias("a").join(right.alias("b"), on, how)


def ratio(n: Column, of: Column) -> Column:
    return F.when(of == 0, 1.0).otherwise(n / of)


def metrics(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: recall, precision, false_positive_rate; 1, 1 and 0 of nothing."""
    acted = protected(findings)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    rows = one(labels, "labels").crossJoin(one(matched(labels, acted), "recalled"))
    rows = rows.crossJoin(one(acted, "acted")).crossJoin(one(matched(acted, labels), "right"))  # of one row each
    wrong = F.when(F.col("acted") == 0, 0.0).otherwise((F.col("acted") - F.col("right")) / F.col("acted"))
    return rows.select(
        ratio(F.col("recalled"), F.col("labels")).alias("recall"), ratio(F.col("right"), F.col("acted")).alias("precision"), wrong.alias("false_positive_rate")
    )


def recall_split(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels caught, of secrets and of the rest: kind, matched, total."""
    kind = F.when(F.col("entity_type") == "Secret", "secret").otherwise("pii").alias("kind")
    total = labels.groupBy(kind).agg(F.count(F.lit(1)).alias("total"))
    caught = matched(labels, protected(findings)).groupBy(kind).agg(F.count(F.lit(1)).alias("matched"))
    return total.join(caught, "kind", "left").select("kind", F.coalesce("matched", F.lit(0)).cast("long").alias("matched"), "total")


def detector_false_positives(findings: DataFrame, labels: DataFrame, benign: DataFrame) -> DataFrame:
    """Per detector total, false_positives (findings over no label of any type)
    and those of them in ``benign`` samples (sample)."""
    total = findings.groupBy("detector").agg(F.count(F.lit(1)).alias("total"))
    wrong = matched(findings, labels, "left_anti", same_type=False)
    wrong = wrong.join(benign.select("sample").distinct().withColumn("benign", F.lit(1)), "sample", "left")
    wrong = wrong.groupBy("detector").agg(F.count(F.lit(1)).alias("false_positives"), F.count("benign").alias("benign_false_positives"))
    return total.join(wrong, "detector", "left").fillna(0, ["false_positives", "benign_false_positives"])


def nearest_rank(values: DataFrame, column: str, share: float = 0.95) -> DataFrame:
    """The ceil(share * n)-th smallest, not interpolated."""
    return values.agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {column})").alias("p"))


def raw_left(packs: DataFrame, labels: DataFrame) -> DataFrame:
    """sample and entity_type of labelled values that a masked text still holds.
    ``packs``: sample, text; ``labels`` with value, of types that are protected."""
    both = packs.join(labels.select("sample", "entity_type", "value").distinct(), "sample")
    return both.where(F.contains("text", F.col("value"))).select("sample", "entity_type")


def consistency(probes: DataFrame) -> DataFrame:
    """``probes``: first, second - what a value became at its two places in one
    text. Stable and total over those that became something."""
    return probes.agg(F.count(F.when(F.col("first") == F.col("second"), 1)).alias("stable"), F.count(F.lit(1)).alias("total"))


def placeholder_consistency(labels: DataFrame, vault, policy=None, now: int = 1) -> DataFrame:
    """Each labelled value that is to be masked, twice in one text: do both become
    the same display? Values that no detector takes do not count. ``labels``:
    entity_type, value."""
    from maskloom.operators.mask import mask
    from maskloom.plans.policy import Policy

    policy = policy or Policy.default()
    values = labels.where(policy.entity_class(F.col("entity_type")).isin(MASK, REDACT)).select("value").distinct()
    probes = values.select(F.xxhash64("value").alias("artefact_id"), F.concat("value", F.lit("\n"), "value").alias("content"))
    packs = mask(probes, vault, "repo", "probes", policy, now).where(F.size("bindings") > 0)
    parts = F.split("text", "\n", 2)
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    shown = F.array_contains("bindings.display", first)
    return consistency(packs.select(first.alias("first"), F.when(shown, second).alias("second")))


def display_collisions(corpus: DataFrame, vault, now: int = 1) -> DataFrame:
    """Samples that hold a look-alike of a placeholder, each masked in a namespace
    of its own and restored: sample, decoy_minted, corrupted."""
    from maskloom.operators.mask import mask, rehydrate

    rows = corpus.select(F.col("name").alias("artefact_id"), "content", "decoys")
    packs = written(mask(rows, vault, "session", F.col("artefact_id"), now=now), "packs")
    back = rehydrate(packs, vault, "local-patch", now=now).select("artefact_id", F.col("text").alias("restored"))
    out = rows.join(packs.select("artefact_id", "bindings"), "artefact_id").join(back, "artefact_id")
    minted = F.arrays_overlap("decoys", "bindings.display")
    return out.select(F.col("artefact_id").alias("sample"), F.coalesce(minted, F.lit(False)).alias("decoy_minted"), (F.col("restored") != F.col("content")).alias("corrupted"))


def residuals(corpus: DataFrame, findings: DataFrame) -> DataFrame:
    """Per sample, how many of its residual secrets no finding touches, at the
    first place of each; one that is not in the text counts."""
    from maskloom.sources.artefacts import occurrences

    rows = corpus.select(F.col("name").alias("sample"), "content", F.explode("residual_secrets").alias("value"))
    at = F.try_element_at(occurrences(F.col("content"), F.col("value")), F.lit(1))
    rows = rows.select("sample", "value", at["start"].alias("start"), at["end"].alias("end"))
    return matched(rows, findings, "left_anti", same_type=False).groupBy("sample").agg(F.count(F.lit(1)).alias("residual"))


def structural_checks(corpus: DataFrame, packs: DataFrame) -> DataFrame:
    """Of tagged samples: name, sample, passed. ``packs``: sample, text, blocked."""
    rows = corpus.select(F.col("name").alias("sample"), "slices").join(packs, "sample")
    blocks = rows.where(F.array_contains("slices", "artefact-block")).select(F.lit("artefact-block-fires").alias("name"), "sample", F.col("blocked").alias("passed"))
    parses = rows.where(F.array_contains("slices", "json-payload"))
    return blocks.unionByName(parses.select(F.lit("masked-json-still-parses").alias("name"), "sample", F.try_parse_json("text").isNotNull().alias("passed")))


def dead_branches(policy: dict) -> list[str]:
    """Rules of a policy that nothing can reach: no reader of artefacts here fills
    in a language, so a default policy should not go by one."""
    return sorted((policy.get("artefacts") or {}).get("by_language") or {})


def verdict(gates: list[bool | None]) -> str:
    """NoGo if a gate fails, else Incomplete if one was not measured, else Go."""
    return "NoGo" if False in gates else "Incomplete" if None in gates else "Go"


def times(run, n: int = 30) -> dict:
    """``run()`` once to warm up and ``n`` times measured: p50, p95 (nearest rank)
    and max in microseconds."""
    run()
    took = []
    for _ in range(n):
        began = time.perf_counter_ns()
        run()
        took.append((time.perf_counter_ns() - began) // 1000)
    took.sort()
    return {"p50_us": took[-(-n // 2) - 1], "p95_us": took[-(-n * 95 // 100) - 1], "max_us": took[-1]}


def report(corpus: DataFrame, hot: dict | None = None, p95_us: int | None = None, policy: dict | None = None, vault=None) -> dict:
    """All measures of a labelled corpus, as a driver-side summary of small results.

    ``hot``: what ``times`` gives for a hook's answer; ``p95_us``: of detection in one
    process; what is None was not measured. ``policy``: layers merged, else the
    default. ``vault``: for the values that are masked to see what becomes of them;
    else one of its own, under a key of its own."""
    from maskloom.operators.mask import analyse, redact
    from maskloom.operators.vault import Vault
    from maskloom.plans.policy import DEFAULT, Policy
    from maskloom.sources.artefacts import in_slice, labels

    rules = policy or DEFAULT
    policy = Policy.of(rules)
    spark = corpus.sparkSession
    vault = vault or Vault(spark, new_path(spark, "benchmark-vault"), os.urandom(16))
    artefacts = corpus.withColumn("artefact_id", F.col("name"))
    # a benchmark looks into blocked artefacts too: detection is what it measures
    rows = written(analyse(artefacts.drop("path"), policy), "analysed")
    classed = lambda column: rows.select(F.col("artefact_id").alias("sample"), F.explode(column).alias("f")).select("sample", "f.entity_type", "f.start", "f.end", "f.detector", policy.entity_class(F.col("f.entity_type")).alias("class"))
    found, raw, known = classed("findings"), classed("raw"), written(labels(corpus), "labels")
    m = metrics(found, known).first()
    split = {r["kind"]: (r["matched"], r["total"]) for r in recall_split(raw, known).collect()}
    rate = lambda k: split[k][0] / split[k][1] if split.get(k, (0, 0))[1] else 1.0
    packs = redact(artefacts, policy).select(F.col("artefact_id").alias("sample"), "text", "blocked")
    left = raw_left(packs.drop("blocked"), known.where(policy.entity_class(F.col("entity_type")).isin(MASK, REDACT))).count()
    benign = in_slice(corpus, "benign-lookalike").select(F.col("name").alias("sample"))
    detectors = [r.asDict() for r in detector_false_positives(raw, known, benign).orderBy("detector").collect()]
    stable, total = placeholder_consistency(known, vault, policy).first()
    structure = [tuple(r) for r in structural_checks(corpus, packs).groupBy("name").agg(F.count(F.when(F.col("passed"), 1)).alias("passed"), F.count(F.lit(1)).alias("n")).orderBy("name").collect()]
    alike = display_collisions(corpus.where(F.size("decoys") > 0), vault).agg(F.count(F.lit(1)).alias("samples"), F.count(F.when(F.col("decoy_minted"), 1)).alias("minted"), F.count(F.when(F.col("corrupted"), 1)).alias("corrupted")).first()
    secret = corpus.where(F.size("residual_secrets") > 0)
    residual = secret.agg(F.sum(F.size("residual_secrets")).alias("n")).first()["n"] or 0
    unseen = residuals(secret, found).agg(F.sum("residual").alias("n")).first()["n"] or 0
    gates = {
        "zero-raw-PII": left == 0,
        "secret-recall": rate("secret") >= GATES["secret_recall"],
        "pii-recall": rate("pii") >= GATES["pii_recall"],
        "false-positive-rate": m["false_positive_rate"] < GATES["false_positive_rate"],
        "placeholder-consistency": (stable / total if total else 1.0) >= GATES["consistency"],
        "in-process-detect-p95": None if p95_us is None else p95_us < GATES["p95_us"],
        "structural-checks": {name for name, *_ in structure} == STRUCTURAL and all(passed == n for _, passed, n in structure),
        "hot-path-p95": None if hot is None else hot["p95_us"] < GATES["hot_p95_us"],
    }
    return {
        "metrics": m.asDict(),
        "recall": split,
        "raw_left": left,
        "detectors": detectors,
        "consistency": (stable, total),
        "structure": structure,
        "collisions": alike.asDict(),
        "residuals": (unseen, residual),
        "dead": dead_branches(rules),
        "hot": hot,
        "p95_us": p95_us,
        "gates": gates,
        "verdict": verdict(list(gates.values())),
    }


def render(report: dict) -> str:
    """As text, a line a measure. It holds counts and names, never a value."""
    lines = [f"{k}: {v:.3f}" for k, v in report["metrics"].items()]
    lines += [f"{k} recall: {a}/{b}" for k, (a, b) in sorted(report["recall"].items())]
    lines += ["{detector}: {total} found, {false_positives} wrong, {benign_false_positives} of them benign".format(**d) for d in report["detectors"]]
    lines += [f"raw values left: {report['raw_left']}", "placeholders stable: {}/{}".format(*report["consistency"])]
    lines += [f"{name}: {passed}/{n} pass" for name, passed, n in report["structure"]]
    lines += ["look-alikes: {samples} samples, {minted} of them minted, {corrupted} corrupted".format(**report["collisions"])]
    lines += ["residual secrets: {}/{} not found".format(*report["residuals"])]
    lines += [f"policy branch by language never reached: {name}" for name in report["dead"]]
    lines += ["detection in process: " + ("not measured" if report["p95_us"] is None else f"p95 {report['p95_us'] / 1000:.1f} ms")]
    lines += ["hook: " + ("not measured" if report["hot"] is None else "p50 {p50_us}, p95 {p95_us}, max {max_us} us".format(**report["hot"]))]
    says = {True: "pass", False: "FAIL", None: "not measured"}
    return "\n".join([*lines, *(f"{k}: {says[v]}" for k, v in report["gates"].items()), f"verdict: {report['verdict']}"])
