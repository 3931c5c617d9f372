"""Masking and its reverse, over tables of artefacts.

``artefacts``: artefact_id, content, and optionally path, language_id, mime_type.
Detection to classification is one lazy projection; interning is the one step
that commits; the masked text is a projection of its result.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom import spread, written
from maskloom.functions import detect
from maskloom.functions.bytesview import bind, unview, view
from maskloom.functions.keying import display, redaction_marker
from maskloom.operators.overlap import resolve
from maskloom.operators.vault import Vault, numbered, with_keys
from maskloom.plans.policy import Policy
from maskloom.schema import BLOCK, HARD_DENY, MASK, PASS

HINTS = ("path", "language_id", "mime_type")
WORDS = "[0-9A-Za-z_]+|[^0-9A-Za-z_]+"
#: Stand in no view: put around displays to see which of them stand beside a word.
OPEN, CLOSE = "\u0100", "\u0101"
GLUED = "array<struct<word:string,parts:array<string>>>"


def _hint(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def analyse(artefacts: DataFrame, policy: Policy | None = None, detectors=None) -> DataFrame:
    """Per artefact: artefact_id, blocked, bytes (the viewed content), raw (all
    findings), findings (disjoint, by position, with their class). A blocked
    artefact is not looked into. Null content is empty."""
    policy = policy or Policy.default()
    binary = dict(artefacts.dtypes)["content"] == "binary"
    content = F.coalesce(F.col("content"), F.lit(b"" if binary else ""))
    blocked = policy.artefact_class(*[_hint(artefacts, h) for h in HINTS]) == BLOCK
    rows = spread(artefacts.select("artefact_id", blocked.alias("blocked"), content.alias("content")))
    rows = rows.select("artefact_id", "blocked", view(F.col("content"), binary).alias("bytes"))
    none = F.array().cast(f"array<{detect.FINDING}>")
    rows = rows.withColumn("raw", F.when(F.col("blocked"), none).otherwise(detect.scan(F.col("bytes"), detectors)))
    classed = lambda f: f.withField("class", policy.entity_class(f["entity_type"]))
    return rows.withColumn("findings", F.transform(resolve(F.col("raw")), classed))


def count_by_type(findings: Column) -> Column:
    """map of type -> number, types in order of their names."""
    types = F.transform(findings, lambda f: f["entity_type"])
    pairs = F.transform(F.array_sort(F.array_distinct(types)), lambda t: F.struct(t, F.size(F.filter(types, lambda x: x == t)).cast("long")))
    return F.map_from_entries(pairs)


def splice(text: Column, findings: Column, replacement) -> Column:
    """The viewed ``text`` with each finding put as ``replacement(finding)``."""
    def put(fs: Column) -> Column:
        def piece(f: Column, i: Column) -> Column:
            at = F.when(i == 0, 0).otherwise(F.get(fs, i - 1)["end"])
            return F.concat(F.substr(text, at + 1, f["start"] - at), replacement(f))

        return F.concat(F.array_join(F.transform(fs, piece), ""), F.substr(text, F.element_at(fs, -1)["end"] + 1))

    return F.when(F.size(findings) == 0, text).otherwise(bind(findings, put))


def glued_words(marked: Column) -> Column:
    """Of a text with its displays between OPEN and CLOSE the different words in
    which a display has other characters beside it, and their parts: every second
    part is a display. Of a word that came to be in two ways, the first."""
    any_ = f"[0-9A-Za-z_{OPEN}{CLOSE}]"
    found = F.regexp_extract_all(marked, F.lit(f"(?<!{any_}){any_}*{OPEN}{any_}*"), F.lit(0))
    more = F.filter(found, lambda w: ~F.rlike(w, F.lit(f"^{OPEN}[^{OPEN}{CLOSE}]*{CLOSE}$")))
    plain = lambda w: F.translate(w, OPEN + CLOSE, "")

    def named(ws: Column) -> Column:
        first = lambda x: F.filter(ws, lambda w: plain(w) == x)[0]
        return F.transform(F.array_distinct(F.transform(ws, plain)), lambda x: F.struct(x.alias("word"), F.split(first(x), f"[{OPEN}{CLOSE}]", -1).alias("parts")))

    beside = F.rlike(marked, F.lit(f"[0-9A-Za-z_{CLOSE}]{OPEN}|{CLOSE}[0-9A-Za-z_]"))
    return F.when(beside, bind(more, named)).otherwise(F.array().cast(GLUED))


def inspect(artefacts: DataFrame, policy: Policy | None = None) -> DataFrame:
    """What was found and how it would be handled; never the values. A row a
    disjoint finding: artefact_id, entity_type, start, end, confidence, detector, class."""
    found = analyse(artefacts, policy).select("artefact_id", F.explode("findings").alias("f"))
    return found.select("artefact_id", *[F.col(f"f.{c}").alias(c) for c in ("entity_type", "start", "end", "confidence", "detector", "class")])


def redact(artefacts: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Masking without a vault: every finding but those passed becomes a marker.
    artefact_id, text, blocked, counts (handled fragments by type)."""
    rows = analyse(artefacts, policy)
    handled = F.filter("findings", lambda f: f["class"] != PASS)
    text = splice(F.col("bytes"), handled, lambda f: redaction_marker(f["entity_type"]))
    return rows.select(
        "artefact_id", unview(F.when(F.col("blocked"), "").otherwise(text)).alias("text"), "blocked", count_by_type(handled).alias("counts")
    )


def values_of(analysed: DataFrame, ns_kind: str, ns_id: str, order: str = "artefact_id") -> DataFrame:
    """The values to intern: of findings to be masked, with their place."""
    # an order that is no number goes by its hash
    seen = F.col(order) if dict(analysed.dtypes)[order] in ("int", "bigint") else F.xxhash64(order)
    masked = analysed.select("artefact_id", seen.cast("long").alias("seen"), F.posexplode(F.filter("findings", lambda f: f["class"] == MASK)).alias("nth", "f"))
    return masked.select(
        F.lit(ns_kind).alias("ns_kind"),
        F.lit(ns_id).alias("ns_id"),
        F.col("f.entity_type").alias("entity_type"),
        unview(F.col("f.value")).alias("value"),
        "seen",
        F.col("f.start").alias("start"),
        "artefact_id",
    )


def ordinals(artefacts: DataFrame, ns_kind: str, ns_id: str, salt: bytes = b"", policy: Policy | None = None) -> DataFrame:
    """Placeholders of a fresh namespace, without a vault: key_hex, entity_type,
    value (first spelling), display."""
    from maskloom.functions.keying import display_tag

    keyed = with_keys(values_of(analyse(artefacts, policy), ns_kind, ns_id), salt)
    first = keyed.groupBy("key_hex", "entity_type").agg(F.min(F.struct("seen", "start", "value")).alias("x"))
    first = first.select("key_hex", "entity_type", F.col("x.value").alias("value"), F.col("x.seen").alias("seen"), F.col("x.start").alias("start"))
    first = numbered(first.withColumn("tag", display_tag(F.col("entity_type"))), ["tag"], ["seen", "start", "key_hex"])
    return first.select("key_hex", "entity_type", "value", display(F.col("tag"), F.col("number")).alias("display"))


def mask(
    artefacts: DataFrame, vault: Vault, ns_kind: str, ns_id: str, policy: Policy | None = None, now: int | None = None, ttl: int | None = None, order: str = "artefact_id"
) -> DataFrame:
    """``ns_id``: a string, or a Column of artefact_id.

    Masked packs: artefact_id, text, bindings (display, mapping_ref; first use
    first), counts, raw_counts, blocked_artefacts, ns_kind, ns_id,
    policy_version, created_at, glued (see ``glued_words``). Ordinals follow ``order`` (an integer column),
    then position. The vault commits before any pack is to be had."""
    policy = policy or Policy.default()
    now = int(time.time()) if now is None else now
    # read by the commit and by the packs: without it texts would be searched each time
    rows = written(analyse(artefacts, policy), "analysed")
    values = values_of(rows, ns_kind, ns_id, order)
    mapping = vault.intern(values, now, ttl)
    keyed = with_keys(values, vault.salt).join(mapping.select("key_hex", "mapping_ref", "display"), "key_hex")
    used = keyed.groupBy("artefact_id").agg(F.array_sort(F.collect_list(F.struct("start", "display", "mapping_ref"))).alias("used"))
    rows = rows.join(used, "artefact_id", "left")
    shown = F.coalesce(F.map_from_entries(F.transform("used", lambda u: F.struct(u["start"], u["display"]))), F.create_map().cast("map<int,string>"))
    rows = rows.withColumn("shown", shown)
    handled = F.filter("findings", lambda f: f["class"] != PASS)
    display_of = lambda f: F.concat(F.lit(OPEN), F.try_element_at(F.col("shown"), f["start"]), F.lit(CLOSE))
    put = lambda f: F.when(f["class"] == MASK, display_of(f)).otherwise(redaction_marker(f["entity_type"]))
    read = lambda m: F.struct(F.translate(m, OPEN + CLOSE, "").alias("text"), glued_words(m).alias("glued"))
    plain = F.struct(F.col("bytes").alias("text"), F.array().cast(GLUED).alias("glued"))
    rows = rows.withColumn("put", F.when(F.size(handled) == 0, plain).otherwise(bind(splice(F.col("bytes"), handled, put), read)))
    bindings = F.array_distinct(F.transform("used", lambda u: F.struct(u["display"].alias("display"), u["mapping_ref"].alias("mapping_ref"))))
    return rows.select(
        "artefact_id",
        unview(F.when(F.col("blocked"), "").otherwise(F.col("put.text"))).alias("text"),
        F.coalesce(bindings, F.array().cast("array<struct<display:string,mapping_ref:string>>")).alias("bindings"),
        count_by_type(handled).alias("counts"),
        count_by_type(F.col("raw")).alias("raw_counts"),
        F.col("blocked").cast("int").alias("blocked_artefacts"),
        F.lit(ns_kind).alias("ns_kind"),
        F.lit(ns_id).alias("ns_id"),
        F.lit(policy.version).alias("policy_version"),
        F.lit(now).cast("long").alias("created_at"),
        F.col("put.glued").alias("glued"),
    )


def glued_of(packs: DataFrame) -> Column:
    """The words of ``packs`` that hold displays, or none where packs name none."""
    none = F.array().cast(GLUED)
    return F.coalesce(F.col("glued"), none) if "glued" in packs.columns else none


def substitute(text: Column, values: Column, glued: Column | None = None) -> Column:
    """``text`` with each whole word that is a key of the map put as its value,
    in one pass: what is put in is not looked at again. So are the displays within
    the words ``glued``; any other word that holds a display stays."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    of = lambda w: F.try_element_at(values, w)
    if glued is None:
        return F.array_join(F.transform(words, lambda w: F.coalesce(of(w), w)), "")
    part = lambda x, i: F.when(i % 2 == 1, F.coalesce(of(x), x)).otherwise(x)
    whole = F.map_from_entries(F.transform(glued, lambda g: F.struct(g["word"], F.array_join(F.transform(g["parts"], part), ""))))
    return bind(whole, lambda m: F.array_join(F.transform(words, lambda w: F.coalesce(of(w), F.try_element_at(m, w), w)), ""))


def rehydrate(packs: DataFrame, vault: Vault, destination: str, roles=(), policy: Policy | None = None, now: int | None = None) -> DataFrame:
    """Per pack artefact_id, allowed, text (null if denied), unresolved (displays
    left in place). A denial does not touch the vault. Displays that are not one
    word are refused, as no mask makes them. A display within a longer word is
    restored where the pack names that word (column glued)."""
    policy = policy or Policy.default()
    now = int(time.time()) if now is None else now
    if destination in HARD_DENY or not policy.demask_allowed(destination, roles):
        none = F.lit(None).cast("string")
        return packs.select("artefact_id", F.lit(False).alias("allowed"), none.alias("text"), F.array().cast("array<string>").alias("unresolved"))
    bad = F.exists("bindings", lambda b: ~F.rlike(b["display"], F.lit("^[0-9A-Za-z_]+$")))
    packs = packs.withColumn("bindings", F.when(bad, F.raise_error(F.lit("a display is not one word")).cast("array<struct<display:string,mapping_ref:string>>")).otherwise(F.col("bindings")))
    bound = packs.select("artefact_id", "ns_kind", "ns_id", F.explode("bindings").alias("b")).select("artefact_id", "ns_kind", "ns_id", "b.display", "b.mapping_ref")
    found = vault.resolve(bound, now).groupBy("artefact_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("display", "value")))).alias("values"),
        F.array_sort(F.collect_list(F.when(F.col("value").isNull(), F.col("display")))).alias("unresolved"),
    )
    out = packs.select("artefact_id", "text", glued_of(packs).alias("glued")).join(found, "artefact_id", "left")
    values = F.coalesce("values", F.create_map().cast("map<string,string>"))
    return out.select(
        "artefact_id", F.lit(True).alias("allowed"), substitute(F.col("text"), values, F.col("glued")).alias("text"), F.coalesce("unresolved", F.array().cast("array<string>")).alias("unresolved")
    )


def restorations(packs: DataFrame, restored: DataFrame) -> DataFrame:
    """Per pack and display how often it stood before and stands after: a display
    that did not become rarer was not restored."""
    displays = lambda g: F.filter(g["parts"], lambda x, i: i % 2 == 1)
    holds = lambda w, d: F.exists("glued", lambda g: (g["word"] == w) & F.array_contains(displays(g), d))
    times = lambda text, d: F.size(F.filter(F.regexp_extract_all(text, F.lit("[0-9A-Za-z_]+"), F.lit(0)), lambda w: (w == d) | holds(w, d)))
    both = packs.select("artefact_id", F.col("text").alias("masked"), glued_of(packs).alias("glued"), F.explode("bindings.display").alias("display"))
    both = both.join(restored.select("artefact_id", "text"), "artefact_id")
    out = both.select("artefact_id", "display", times(F.col("masked"), F.col("display")).alias("before"), times(F.col("text"), F.col("display")).alias("after"))
    return out.withColumn("restored", F.col("after") < F.col("before"))
