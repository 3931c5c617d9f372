"""The audit log: JSON lines, appended to, one event a line, never a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskloom.functions.detect import PROVENANCE
from maskloom.schema import CUSTOM

VERSION = 1
EVENT = (
    "struct<kind:string,counts:array<struct<entity_type:string,count:bigint>>,detector_version:string,latency_us:bigint,artefact:string,reason:string,"
    "dest:string,actor:string,allowed:boolean,policy_version:string,mapping_ref:string>"
)
RECORD = f"schema_version int, id string, event {EVENT}"
KINDS = ("scan", "block", "demask_decision", "policy_decision", "mapping_created", "demask_request")


def _event(**fields: Column) -> Column:
    names = [f.split(":")[0] for f in EVENT.removeprefix("struct<").removesuffix(">").replace("array<struct<entity_type:string,count:bigint>>", "array").split(",")]
    return F.struct(*[fields.get(n, F.lit(None)).alias(n) for n in names]).cast(EVENT)


def _id(*parts: Column) -> Column:
    h = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    cut = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("4"), cut(14, 3)), F.concat(F.lit("8"), cut(18, 3)), cut(21, 12))


def events_of(packs: DataFrame, run: str) -> DataFrame:
    """A scan event a pack (raw counts, before overlaps are resolved), or a block
    event. ``run`` names the batch: a batch that is written again has the same ids."""
    counts = F.transform(F.map_entries("raw_counts"), lambda e: F.struct(entity_name(e["key"]).alias("entity_type"), e["value"].alias("count")))
    scan = _event(kind=F.lit("scan"), counts=counts, detector_version=F.lit(PROVENANCE))
    block = _event(kind=F.lit("block"), artefact=F.col("artefact_id").cast("string"), reason=F.lit("policy"))
    event = F.when(F.col("blocked_artefacts") > 0, block).otherwise(scan)
    return packs.select(F.lit(VERSION).alias("schema_version"), _id(F.lit(run), F.col("artefact_id")).alias("id"), event.alias("event"))


def decision_of(restored: DataFrame, destination: str, actor: str, policy_version: str, run: str) -> DataFrame:
    event = _event(kind=F.lit("demask_decision"), dest=F.lit(destination), actor=F.lit(actor), allowed=F.col("allowed"), policy_version=F.lit(policy_version))
    return restored.select(F.lit(VERSION).alias("schema_version"), _id(F.lit(run), F.lit("demask"), F.col("artefact_id")).alias("id"), event.alias("event"))


def write(events: DataFrame, path: str) -> None:
    events.select(F.to_json(F.struct("schema_version", "id", "event")).alias("value")).write.mode("append").text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value, place (of lines that are not blank): of all files under ``path``, a
    file's last line only where it was ended. One that was not is a write broken
    off, whatever it holds: it was never part of the log."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, lineSep="\n")
    place = F.struct(F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth"))
    rows = rows.select("value", place.alias("place"), F.col("_metadata.file_size").alias("size"))
    # one row a file: what its lines take with an end each is a byte more than it has
    files = rows.groupBy(F.col("place.file").alias("file"), F.col("size").alias("of")).agg(F.sum(F.octet_length("value") + 1).alias("taken"), F.max("place").alias("torn"))
    torn = files.where("taken = of + 1").select("torn")
    return rows.join(torn, rows["place"] == torn["torn"], "left_anti").where(F.trim("value") != "").select("value", "place")


def _checked(lines: DataFrame) -> DataFrame:
    rows = lines.select(F.from_json("value", RECORD).alias("r"))
    bad = F.coalesce(~(F.col("r.schema_version") == VERSION) | F.col("r.id").isNull() | ~F.col("r.event.kind").isin(*KINDS), F.lit(True))
    return rows.select(F.when(bad, F.raise_error(F.lit("the audit log holds a line that is no event")).cast(f"struct<schema_version:int,id:string,event:{EVENT}>")).otherwise(F.col("r")).alias("r"))


def _once(rows: DataFrame) -> DataFrame:
    times = rows.groupBy("r.id").agg(F.count(F.lit(1)).alias("n"), F.first("r").alias("r"))
    once = F.when(F.col("n") > 1, F.raise_error(F.lit("the audit log holds an id twice")).cast(f"struct<schema_version:int,id:string,event:{EVENT}>")).otherwise(F.col("r"))
    return times.select(once.alias("r")).select("r.*")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All events, checked: a whole line that is no event, of another version or
    kind, or an id that comes twice is refused when the rows are read. A last line
    without its end is left out. ``path``: a file, or a folder at any depth."""
    return _once(_checked(_lines(spark, path)))


def torn(spark: SparkSession, path: str) -> int:
    """How many files end in a line that was broken off."""
    every = spark.read.option("recursiveFileLookup", "true").text(path, lineSep="\n")
    return every.where(F.trim("value") != "").count() - _lines(spark, path).count()


def get(spark: SparkSession, path: str, id_: str) -> DataFrame:
    """The event of an id: only lines that name it are read for events."""
    rows = _checked(_lines(spark, path).where(F.contains("value", F.lit(id_))))
    return _once(rows.where(F.col("r.id") == id_))


def tail(events: DataFrame, n: int, order: str) -> DataFrame:
    """The last ``n`` along ``order``, in order."""
    return events.orderBy(F.desc(order)).limit(n).orderBy(order)


WITHHELD = "[unparseable audit line withheld]"


def last(spark: SparkSession, path: str, n: int = 1) -> DataFrame:
    """The log's last ``n`` lines, nth from 1 on, in the order they were written: a
    column line. One that is not JSON is not shown, as it may hold anything."""
    rows = tail(_lines(spark, path), n, "place").select(F.row_number().over(Window.orderBy("place")).alias("nth"), "value")  # n rows
    return rows.select("nth", F.when(F.try_parse_json("value").isNotNull(), F.col("value")).otherwise(WITHHELD).alias("line"))


def entity_name(name: Column) -> Column:
    """A type as the log names it, in snake case; a custom one by its own name."""
    snake = F.lower(F.regexp_replace(name, "(?<=[a-z])(?=[A-Z])", "_"))
    return F.when(F.startswith(name, F.lit(CUSTOM)), F.substr(name, F.lit(len(CUSTOM) + 1))).otherwise(snake)
