"""The mapping of values to placeholders, as tables.

A vault is a folder: ``mapping`` holds Parquet folders, ``versions`` a file for
each commit that names the folders in force, and ``demask_event`` is appended to.
A commit adds a folder of new rows; only renewals, purges and every COMPACT-th
commit write the mapping anew. The file of a version is written aside and renamed,
which can be done once: whoever comes second starts again, and no reader meets half
a file. Values are encrypted with AES-GCM under a key the caller holds; so is the
salt, which the vault makes and keeps: a key that does not open it is refused.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskloom import written
from maskloom.functions.keying import display, display_tag, placeholder_key
from maskloom.schema import CUSTOM

MAPPING = (
    "key_hex string, mapping_ref string, display string, ordinal long, ns_kind string, ns_id string, entity_kind string, entity_custom string, "
    "value binary, created_at long, expires_at long"
)
EVENT = "mapping_ref string, ns_kind string, ns_id string, requested_at long, success int"


#: Folders a version names, at most.
COMPACT = 64


class VaultError(RuntimeError):
    """Another writer committed first, or the key is not this vault's."""


def numbered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with the column number: 1, 2, .. within ``by`` along ``order``.

    A sort over all of ``order`` deals rows out by ranges of about one size, however
    many of them a group or a first column's value has; these are counted, and
    numbered from where the ranges before end: no group meets in one task."""
    placed = written(df.orderBy(*order).withColumn("range", F.spark_partition_id()), "numbered")
    counts = placed.groupBy(*by, "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy(*by, "range").orderBy(*order)
    out = placed.withColumn("number", F.row_number().over(within)).join(counts, [*by, "range"])
    return out.withColumn("number", F.col("number") + F.col("before")).drop("range", "before")


def encrypt(value: Column, key: bytes) -> Column:
    return F.aes_encrypt(F.encode(value, "UTF-8"), F.lit(key), F.lit("GCM"))


def decrypt(value: Column, key: bytes) -> Column:
    return F.decode(F.aes_decrypt(value, F.lit(key), F.lit("GCM")), "UTF-8")


def entity_kind(entity_type: Column) -> tuple[Column, Column]:
    custom = F.startswith(entity_type, F.lit(CUSTOM))
    return F.when(custom, F.lit("Custom")).otherwise(entity_type), F.when(custom, F.substr(entity_type, F.lit(len(CUSTOM) + 1)))


def with_keys(values: DataFrame, salt: bytes) -> DataFrame:
    """``values``: ns_kind, ns_id, entity_type, value, seen (order of artefacts),
    start. Adds key_hex."""
    return values.withColumn("key_hex", placeholder_key(salt, F.col("value"), F.col("entity_type"), F.col("ns_kind"), F.col("ns_id")))


def mint(mapping: DataFrame, values: DataFrame, key: bytes, now: int, ttl: int | None = None) -> DataFrame:
    """Mapping rows for keys of ``values`` (see ``with_keys``) that ``mapping``
    lacks. A key keeps its first spelling, by artefact order, then position.
    Ordinals go on from the namespace's and tag's highest."""
    place = F.struct("seen", "start")
    first = values.groupBy("key_hex", "ns_kind", "ns_id", "entity_type").agg(F.min(F.struct(place.alias("place"), "value")).alias("x"))
    new = first.join(mapping.select("key_hex"), "key_hex", "left_anti")
    new = new.select("key_hex", "ns_kind", "ns_id", "entity_type", F.col("x.value").alias("value"), F.col("x.place.seen").alias("seen"), F.col("x.place.start").alias("start"))
    new = new.withColumn("tag", display_tag(F.col("entity_type")))
    tag_of = F.regexp_replace("display", "_[0-9]+$", "")
    high = mapping.groupBy("ns_kind", "ns_id", tag_of.alias("tag")).agg(F.max("ordinal").alias("high"))
    by = ["ns_kind", "ns_id", "tag"]
    new = numbered(new, by, ["seen", "start", "key_hex"]).join(high, by, "left")
    ordinal = (F.col("number") + F.coalesce("high", F.lit(0))).cast("long")
    kind, custom = entity_kind(F.col("entity_type"))
    # an id made from the key and the time: the same if a task runs again
    raw = F.sha2(F.concat_ws("|", "key_hex", F.lit(str(now)), F.lit(uuid.uuid4().hex)), 256)
    ref = F.concat_ws("-", F.substr(raw, F.lit(1), F.lit(8)), F.substr(raw, F.lit(9), F.lit(4)), F.concat(F.lit("4"), F.substr(raw, F.lit(14), F.lit(3))), F.concat(F.lit("8"), F.substr(raw, F.lit(18), F.lit(3))), F.substr(raw, F.lit(21), F.lit(12)))
    return new.select(
        "key_hex",
        ref.alias("mapping_ref"),
        display(F.col("tag"), ordinal).alias("display"),
        ordinal.alias("ordinal"),
        "ns_kind",
        "ns_id",
        kind.alias("entity_kind"),
        custom.alias("entity_custom"),
        encrypt(F.col("value"), key).alias("value"),
        F.lit(now).cast("long").alias("created_at"),
        F.lit(None if ttl is None else now + ttl).cast("long").alias("expires_at"),
    )


def renewed(mapping: DataFrame, keys: DataFrame, now: int, ttl: int | None) -> DataFrame:
    """``mapping`` with expired rows of ``keys`` (key_hex) alive again, as they were."""
    seen = keys.select("key_hex").distinct().withColumn("again", F.lit(True))
    out = mapping.join(seen, "key_hex", "left")
    expired = F.col("expires_at").isNotNull() & (F.col("expires_at") <= now) & F.col("again").isNotNull()
    return out.withColumn("expires_at", F.when(expired, F.lit(None if ttl is None else now + ttl).cast("long")).otherwise(F.col("expires_at"))).drop("again").select(*mapping.columns)


def purged(mapping: DataFrame, now: int) -> DataFrame:
    return mapping.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def high_water(mapping: DataFrame) -> DataFrame:
    tag = F.regexp_replace("display", "_[0-9]+$", "")
    return mapping.groupBy("ns_kind", "ns_id", tag.alias("tag")).agg(F.max("ordinal").alias("ordinal"))


def repeated(mapping: DataFrame) -> DataFrame:
    """what (key, ref or ordinal) and value of those that more than one row of
    ``mapping`` has; each may be had once: keys and refs in a vault, ordinals in a
    namespace's tag."""
    tag = F.regexp_replace("display", "_[0-9]+$", "")
    each = lambda what, *of: F.struct(F.lit(what).alias("what"), F.to_json(F.array(*of)).alias("value"))
    rows = mapping.select(F.explode(F.array(each("key", F.col("key_hex")), each("ref", F.col("mapping_ref")), each("ordinal", F.col("ns_kind"), F.col("ns_id"), tag, F.col("ordinal").cast("string")))).alias("x"))
    return rows.groupBy("x.what", "x.value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@dataclass
class Vault:
    """A vault in a folder that Spark and the driver can reach. It is made when it
    is first opened; ``salt``: for a new one (else 32 random bytes); an old one's
    must be the same where it is given."""

    spark: SparkSession
    path: str
    key: bytes
    salt: bytes | None = None

    def __post_init__(self):
        kept = self._read("meta/salt")
        if kept is None:
            made = self.salt or os.urandom(32)
            if not self._put("meta/salt", self._crypt(made, None)):  # another was first
                kept = self._read("meta/salt")
        if kept is not None:
            try:
                made = self._crypt(kept[12:], kept[:12])
            except Exception as why:
                raise VaultError("the key is not this vault's") from why
        if self.salt is not None and self.salt != made:
            raise VaultError("the salt is not this vault's")
        self.salt = made

    def _crypt(self, data: bytes, iv: bytes | None) -> bytes:
        """AES-GCM on the driver: ``data`` under a new iv, which comes first, or what
        it stands for under ``iv``."""
        crypto = self.spark._jvm.javax.crypto
        mode, iv, head = (1, os.urandom(12), True) if iv is None else (2, iv, False)
        cipher = crypto.Cipher.getInstance("AES/GCM/NoPadding")
        cipher.init(mode, crypto.spec.SecretKeySpec(bytearray(self.key), "AES"), crypto.spec.GCMParameterSpec(128, bytearray(iv)))
        out = bytes(cipher.doFinal(bytearray(data)))
        return iv + out if head else out

    def _fs(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> bytes | None:
        jvm, fs = self._fs()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def _put(self, name: str, data: bytes) -> bool:
        """Write a small file that is there whole or not at all; False if another is."""
        jvm, fs = self._fs()
        hadoop = jvm.org.apache.hadoop.fs
        aside, at = hadoop.Path(f"{self.path}/aside/{uuid.uuid4().hex}"), hadoop.Path(f"{self.path}/{name}")
        fs.mkdirs(at.getParent())
        stream = fs.create(aside, False)
        stream.write(bytearray(data))
        stream.close()
        try:
            never = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
            hadoop.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, at, never)
            return True
        except Exception:
            if not fs.exists(at):
                raise
            return False
        finally:
            fs.delete(aside, False)

    def version(self) -> int:
        """The highest committed version; 0 before the first."""
        jvm, fs = self._fs()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        if not fs.exists(at):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()), default=0)

    def mapping(self) -> DataFrame:
        folders = self._folders(self.version())
        if not folders:
            return self.spark.createDataFrame([], MAPPING)
        return self.spark.read.schema(MAPPING).parquet(*(f"{self.path}/mapping/{f}" for f in folders))

    def _folders(self, version: int) -> list[str]:
        if not version:
            return []
        return self._read(f"versions/{version}").decode().split(",")

    def commit(self, rows: DataFrame, base: int, beside: list[str] | None = None) -> None:
        """Make ``rows``, with the folders ``beside``, the mapping, if ``base`` is
        still the last version."""
        folder = uuid.uuid4().hex
        at = f"{self.path}/mapping/{folder}"
        rows.select(*[f.split()[0] for f in MAPPING.split(", ")]).write.parquet(at)
        if not repeated(self.spark.read.schema(MAPPING).parquet(at)).isEmpty():
            raise ValueError("a key, reference or ordinal would be in the vault twice")
        if self.version() != base or not self._put(f"versions/{base + 1}", ",".join([*(beside or []), folder]).encode()):
            raise VaultError("another writer committed first")

    def check(self) -> None:
        """Refuse a mapping that holds a key, a reference or an ordinal twice."""
        found = repeated(self.mapping()).first()
        if found:
            raise VaultError(f"the vault holds a {found['what']} twice")

    def intern(self, values: DataFrame, now: int, ttl: int | None = None, tries: int = 3) -> DataFrame:
        """Every key of ``values`` gets, keeps or renews its row; the mapping after."""
        keyed = with_keys(values, self.salt)
        for left in reversed(range(tries)):
            base = self.version()
            have, folders = self.mapping(), self._folders(base)
            new = mint(have, keyed, self.key, now, ttl)
            expired = have.where(F.col("expires_at") <= now).join(keyed, "key_hex", "left_semi")
            try:
                if len(folders) >= COMPACT or not expired.isEmpty():
                    self.commit(renewed(have, keyed, now, ttl).unionByName(new), base)
                else:
                    self.commit(new, base, folders)
                return self.mapping()
            except VaultError:
                if not left:
                    raise
        raise VaultError("no try was allowed")

    def resolve(self, bindings: DataFrame, now: int) -> DataFrame:
        """``bindings``: display, mapping_ref, ns_kind, ns_id and others. Adds
        value, null where the namespace has no live row; each attempt is logged."""
        live = purged(self.mapping(), now).select("mapping_ref", "ns_kind", "ns_id", decrypt(F.col("value"), self.key).alias("value"))
        out = bindings.join(live, ["mapping_ref", "ns_kind", "ns_id"], "left")
        log = out.select("mapping_ref", "ns_kind", "ns_id", F.lit(now).cast("long").alias("requested_at"), F.col("value").isNotNull().cast("int").alias("success"))
        log.write.mode("append").parquet(f"{self.path}/demask_event")
        return out

    def events(self) -> DataFrame:
        jvm, fs = self._fs()
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/demask_event")):
            return self.spark.createDataFrame([], EVENT)
        return self.spark.read.schema(EVENT).parquet(f"{self.path}/demask_event")

    def purge(self, now: int) -> int:
        """Drop expired rows; how many there were."""
        base, have = self.version(), self.mapping()
        gone = have.where(F.col("expires_at") <= now).count()
        if gone:
            self.commit(purged(have, now), base)
        return gone

    def stats(self) -> dict[str, int]:
        return {"mappings": self.mapping().count(), "demask_events": self.events().count()}
