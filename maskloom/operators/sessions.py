"""Which namespace a request belongs to, and the placeholders of each.

``registry``: address, ns_kind, ns_id. A request's own header wins over its
address; a header that is no UUID, or the nil one, is refused, as is an address
that nobody registered. Nothing falls back to a shared namespace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UUID = r"^(?:urn:uuid:)?(?:\{?[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\}?|[0-9a-f]{32})$"
LOOPBACK = r"^(?:127(?:\.[0-9]{1,3}){3}|\[::1\]):[0-9]{1,5}$"
#: Characters of a bad header that an error repeats, at most.
ECHO = 64


def header_session(header: Column) -> Column:
    """The session id of a namespace header, in plain form; null if refused."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(header), "^urn:uuid:", ""), r"[{}-]", "")
    cut = lambda a, n: F.substr(plain, F.lit(a), F.lit(n))
    dashed = F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))
    return F.when(F.rlike(F.lower(header), F.lit(UUID)) & F.rlike(plain, F.lit("[1-9a-f]")), dashed)


def register(registry: DataFrame, new: DataFrame) -> DataFrame:
    """``registry`` with ``new`` rows over its own; addresses that are not of this
    host are refused."""
    rows = new.withColumn("address", F.when(F.rlike("address", F.lit(LOOPBACK)), F.col("address")).otherwise(F.raise_error(F.lit("not a loopback address"))))
    return registry.join(rows.select("address"), "address", "left_anti").unionByName(rows)


def conflicts(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` whose address another namespace holds."""
    a, b = new.alias("a"), registry.alias("b")
    other = (F.col("a.ns_kind") != F.col("b.ns_kind")) | (F.col("a.ns_id") != F.col("b.ns_id"))
    return a.join(b, (F.col("a.address") == F.col("b.address")) & other, "left_semi")


def unregister(registry: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the rows of ``gone``: the address goes only for the namespace named."""
    return registry.join(gone, ["address", "ns_kind", "ns_id"], "left_anti")


def resolve(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """``requests``: request_id, header (or null), address. Gives request_id,
    ns_kind, ns_id and error (null if resolved)."""
    rows = requests.join(registry, "address", "left")
    session, asked = header_session(F.col("header")), F.col("header").isNotNull()
    bad = F.when(asked & session.isNull(), F.concat(F.lit("invalid namespace header "), F.substr("header", F.lit(1), F.lit(ECHO))))
    bad = bad.when(~asked & F.col("ns_id").isNull(), F.concat(F.lit("unregistered address "), F.col("address")))
    return rows.select(
        "request_id",
        F.when(asked, F.when(session.isNotNull(), "session")).otherwise(F.col("ns_kind")).alias("ns_kind"),
        F.when(asked, session).otherwise(F.col("ns_id")).alias("ns_id"),
        bad.alias("error"),
    )


def bindings_of(packs: DataFrame) -> DataFrame:
    """All placeholders of each namespace: ns_kind, ns_id, display, mapping_ref."""
    return packs.select("ns_kind", "ns_id", F.explode("bindings").alias("b")).select("ns_kind", "ns_id", "b.*").distinct()
