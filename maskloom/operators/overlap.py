"""Overlap resolution: every byte goes to the finding that ranks highest there.

Secrets, found by entropy alone, rank under all else; then longer findings rank
higher, then earlier ones, then the order of types. What higher ranks leave of a
finding stays, as fragments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions.bytesview import bind
from maskloom.schema import FINDING

RANK = ("entity_type = 'Secret'", "start - end", "start", "type_ord", "detector")


def resolve(findings: Column) -> Column:
    """Of an array of findings the disjoint fragments, by position. ``value`` is
    cut to the fragment. Without overlaps this is a sort and one look."""
    by_place = F.array_sort(F.transform(findings, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), f.alias("f"))))
    overlaps = lambda fs: F.exists(
        F.zip_with(F.slice(fs, 1, F.greatest(F.size(fs) - 1, F.lit(0))), F.slice(fs, 2, F.size(fs)), lambda a, b: b["start"] < a["end"]), lambda x: x
    )
    plain = lambda fs: F.transform(fs, lambda x: x["f"])
    return bind(by_place, lambda fs: F.when(F.size(fs) < 2, plain(fs)).when(overlaps(fs), _fragments(findings)).otherwise(plain(fs)))


def _fragments(findings: Column) -> Column:
    ranked = F.array_sort(
        F.transform(
            findings,
            lambda f: F.struct(
                (f["entity_type"] == "Secret").cast("int").alias("a"),
                (f["start"] - f["end"]).alias("b"),
                f["start"].alias("c"),
                f["type_ord"].alias("d"),
                f["detector"].alias("e"),
                f.alias("f"),
            ),
        )
    )
    edges = F.array_sort(F.array_distinct(F.flatten(F.transform(findings, lambda f: F.array(f["start"], f["end"])))))
    both = F.struct(ranked.alias("ranked"), edges.alias("edges"))

    def owned(x: Column) -> Column:
        cells = F.zip_with(
            F.slice(x["edges"], 1, F.size(x["edges"]) - 1), F.slice(x["edges"], 2, F.size(x["edges"])), lambda a, b: F.struct(a.alias("start"), b.alias("end"))
        )
        covers = lambda c: F.filter(x["ranked"], lambda r: (r["f"]["start"] <= c["start"]) & (c["end"] <= r["f"]["end"]))
        owner = F.transform(cells, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.try_element_at(covers(c), F.lit(1))["f"].alias("f")))
        return F.filter(owner, lambda o: o["f"].isNotNull())

    def joined(done: Column, o: Column) -> Column:
        """A cell of the finding that owns the cell before it continues it."""
        last = F.try_element_at(done, F.lit(-1))
        goes_on = (last["end"] == o["start"]) & (last["f"] == o["f"])
        longer = F.struct(last["start"].alias("start"), o["end"].alias("end"), o["f"].alias("f"))
        return F.when(F.coalesce(goes_on, F.lit(False)), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(o)))

    none = F.array().cast(f"array<struct<start:int,end:int,f:{FINDING}>>")
    merged = F.aggregate(bind(both, owned), none, joined)

    def fragment(m: Column) -> Column:
        value = F.substr(m["f"]["value"], m["start"] - m["f"]["start"] + 1, m["end"] - m["start"])
        return m["f"].withField("start", m["start"]).withField("end", m["end"]).withField("value", value)

    return F.transform(merged, fragment)


#: Bytes of a text that are looked at together where findings are rows.
BLOCK = 1024


def resolve_rows(findings: DataFrame, by: str = "artefact_id") -> DataFrame:
    """The same for exploded findings, one row each: as a table, for texts with
    very many. A text is cut into blocks, so no step holds all findings of one:
    edges make cells within a block, each cell goes to the least rank over it, and
    neighbouring cells of one finding, over blocks too, become a fragment."""
    rank = F.struct(*[F.expr(x).alias(f"r{i}") for i, x in enumerate(RANK)], "end").alias("rank")
    ranked = findings.select(by, rank).distinct()
    first, last = F.floor(F.col("rank.r2") / BLOCK), F.floor((F.col("rank.end") - 1) / BLOCK)
    parts = ranked.where("rank.r2 < rank.end").withColumn("block", F.explode(F.sequence(first, last)))
    parts = parts.withColumns({"s": F.greatest(F.col("rank.r2"), F.col("block") * BLOCK).cast("int"), "e": F.least(F.col("rank.end"), (F.col("block") + 1) * BLOCK).cast("int")})
    edges = parts.select(by, "block", F.explode(F.array("s", "e")).alias("cell")).distinct()
    nexts = F.lead("cell").over(Window.partitionBy(by, "block").orderBy("cell"))  # BLOCK + 1 rows at most
    cells = edges.withColumn("cell_end", nexts).where("cell_end is not null")
    over = cells.join(parts, [by, "block"]).where("s <= cell and cell_end <= e")
    owner = over.groupBy(by, "block", "cell", "cell_end").agg(F.min("rank").alias("rank"))
    place = Window.partitionBy(by, "rank").orderBy("cell")  # of one finding
    new = F.coalesce((F.lag("cell_end").over(place) != F.col("cell")).cast("int"), F.lit(1))
    runs = owner.withColumn("new", new).withColumn("run", F.sum("new").over(place))
    spans = runs.groupBy(by, "rank", "run").agg(F.min("cell").alias("s"), F.max("cell_end").alias("e")).drop("run")
    # findings of one rank are one finding; the first of those that differ in what is not ranked
    one = findings.groupBy(by, rank).agg(F.min(F.struct(*[c for c in findings.columns if c != by])).alias("f"))
    out = spans.join(one, [by, "rank"])
    keep = [F.col(by) if c == by else F.col("s").alias(c) if c == "start" else F.col("e").alias(c) if c == "end" else F.col(f"f.{c}").alias(c) for c in findings.columns]
    return out.select(*keep)
