"""One query an operator, over whole tables, and the same as SQL where SQL can.

Each query takes (spark, sf_dir). Patterns of kinds that the tables do not hold
(IBAN, sort codes, IPv6) are looked for in texts made from customers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom import shared_dir, ship, spread
from maskloom.functions import detect, keying, parse, routes
from maskloom.functions.bytesview import find_spans, unview, view
from maskloom.operators import benchmark, hooks, mask, overlap, vault
from maskloom.plans.policy import Policy
from maskloom.schema import ENTITY_TYPES, FINDING, ORDER, TAGS
from maskloom.sources import artefacts, audit

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return register


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(df: DataFrame, id_: str, text, found) -> DataFrame:
    """A row a finding of ``found(view(text))``: id and the value."""
    return spread(df.select(id_, text.alias("t"))).select(id_, F.explode(found(view(F.col("t")))).alias("f")).select(id_, unview(F.col("f.value")).alias("value"))


def docs(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select(F.col("doc_id").alias("artefact_id"), F.col("text").alias("content"), "lang", "source")


# --- detectors ---------------------------------------------------------------

_EMAIL = detect.EMAIL.replace("++", "+").replace("'", "''")
_VALUES = "SELECT {id}, unnest(regexp_extract_all({text}, '{re}')) AS value FROM {of}"


@query(_VALUES.format(id="doc_id", text="text", re=_EMAIL, of="documents"))
def detect_email(spark, sf_dir):
    return _values(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), detect.email)


@query(_VALUES.format(id="doc_id", text="text", re=detect.IPV4, of="documents"))
def detect_ipv4(spark, sf_dir):
    found = lambda b: F.filter(detect.ip(b), lambda f: ~F.contains(f["value"], F.lit(":")))
    return _values(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), found)


@query(
    "SELECT c_custkey, unnest(regexp_extract_all('host fe80::' || hex(c_custkey) || ' via 2001:db8:0:0:0:0:0:' || c_custkey % 97, '"
    + detect.IPV6
    + "')) AS value FROM customer"
)
def detect_ipv6(spark, sf_dir):
    text = F.concat(F.lit("host fe80::"), F.hex("c_custkey"), F.lit(" via 2001:db8:0:0:0:0:0:"), (F.col("c_custkey") % 97).cast("string"))
    return _values(table(spark, sf_dir, "customer"), "c_custkey", text, detect.ip)


@query("SELECT c_custkey, '::ffff:10.0.0.' || (c_custkey % 250) AS value FROM customer UNION ALL SELECT c_custkey, '10.1.2.' || (c_custkey % 250) FROM customer")
def ip_containment(spark, sf_dir):
    """An IPv4 within an IPv6 finding is not found again."""
    n = (F.col("c_custkey") % 250).cast("string")
    text = F.concat(F.lit("a ::ffff:10.0.0."), n, F.lit(" and 10.1.2."), n, F.lit(" b"))
    return _values(table(spark, sf_dir, "customer"), "c_custkey", text, detect.ip)


@query(
    "SELECT c_custkey, unnest(regexp_extract_all('pay GB29 NWBK 6016 1331 ' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || ' 19 or gb29nwbk' || "
    f"lpad(CAST(c_custkey AS VARCHAR), 14, '0') || ' now', '{detect.IBAN}')) AS value FROM customer"
)
def detect_iban(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    four = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    text = F.concat(F.lit("pay GB29 NWBK 6016 1331 "), four, F.lit(" 19 or gb29nwbk"), F.lpad(key, 14, "0"), F.lit(" now"))
    only = lambda b: F.filter(detect.iban_sortcode(b), lambda f: f["entity_type"] == "Iban")
    return _values(table(spark, sf_dir, "customer"), "c_custkey", text, only)


@query(
    "SELECT c_custkey, unnest(regexp_extract_all('sort code 12-' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '-56 not 12-34-567', "
    f"'{detect.SORT_CODE}')) AS value FROM customer"
)
def detect_sort_code(spark, sf_dir):
    text = F.concat(F.lit("sort code 12-"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit("-56 not 12-34-567"))
    return _values(table(spark, sf_dir, "customer"), "c_custkey", text, detect.iban_sortcode)


@query(
    f"""
SELECT doc_id, value FROM ({_VALUES.format(id="doc_id", text="text", re=detect.PHONE, of="documents")})
WHERE length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 7 AND 15 AND regexp_matches(value, '[-+(). ]') AND NOT regexp_matches(value, '{detect.ISO_DATE}')"""
)
def phone_shapes(spark, sf_dir):
    """Candidates with a phone's digits and marks that are no date."""

    def found(b):
        n = lambda s: F.length(F.regexp_replace(s["text"], "[^0-9]", ""))
        spans = F.filter(
            find_spans(b, detect.PHONE), lambda s: n(s).between(7, 15) & F.rlike(s["text"], F.lit("[-+(). ]")) & ~F.rlike(s["text"], F.lit(detect.ISO_DATE))
        )
        return F.transform(spans, lambda s: F.struct(s["text"].alias("value")))

    return _values(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), found)


@query(
    """
WITH t AS (SELECT p_partkey, '9780' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS d FROM part),
c AS (SELECT p_partkey, d, list_sum([CAST(d[i] AS BIGINT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END FOR i IN range(1, 13)]) AS s FROM t),
v AS (SELECT p_partkey, d || CAST((10 - s % 10 + p_partkey % 3) % 10 AS VARCHAR) AS code, p_partkey % 3 = 0 AS isbn FROM c)
SELECT p_partkey, 'call +' || substr(code, 1, 3) || '-' || substr(code, 4, 4) || '-' || substr(code, 8, 4) || '-' || substr(code, 12, 2) AS text FROM v WHERE NOT isbn"""
)
def detect_phone(spark, sf_dir):
    """Book numbers with a right check digit are no phones, others are."""
    digits = F.concat(F.lit("9780"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"))
    rows = table(spark, sf_dir, "part").select("p_partkey", digits.alias("d"))
    weight = lambda i: F.substr("d", F.lit(i), F.lit(1)).cast("long") * (1 if i % 2 else 3)
    total = sum((weight(i) for i in range(2, 13)), weight(1))
    rows = rows.select("p_partkey", F.concat("d", ((10 - total % 10 + F.col("p_partkey") % 3) % 10).cast("string")).alias("c"))
    cut = lambda a, n: F.substr("c", F.lit(a), F.lit(n))
    text = F.concat(F.lit("call +"), F.concat_ws("-", cut(1, 3), cut(4, 4), cut(8, 4), cut(12, 2)))
    return rows.select("p_partkey", text.alias("text")).where(F.size(detect.phone(view(F.col("text")))) > 0)


_TOKEN = f"{detect.TOKEN_CHARACTERS}{{20,}}"
_BITS = (
    "round(list_sum(list_transform(list_distinct(string_split({t}, '')), lambda c: -((length({t}) - length(replace({t}, c, ''))) / length({t})) * "
    "log2((length({t}) - length(replace({t}, c, ''))) / length({t})))), 6)"
)
_SEGMENTS = (
    "(len(list_filter(string_split_regex({t}, '[/._-]'), lambda x: x <> '')) >= 2 AND len(list_filter(string_split_regex({t}, '[/._-]'), "
    "lambda x: x <> '' AND NOT regexp_matches(x, '^([A-Za-z]+|[0-9]{{1,8}})$'))) = 0)"
)


def _structured(t: str) -> str:
    value = f"substr({t}, instr({t}, '=') + 1)"
    key = f"split_part({t}, '=', 1)"
    both = f"{_SEGMENTS.format(t=key)} AND {_SEGMENTS.format(t=value)}"
    return f"({_SEGMENTS.format(t=t)} OR (instr({t}, '=') > 1 AND instr({t}, '=') < length({t}) AND {both}))"


@query(f"SELECT doc_id, value, {_BITS.format(t='value')} AS bits FROM ({_VALUES.format(id='doc_id', text='text', re=_TOKEN, of='documents')})")
def entropy_tokens(spark, sf_dir):
    found = lambda b: F.transform(find_spans(b, _TOKEN), lambda s: F.struct(s["text"].alias("value")))
    rows = _values(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), found)
    return rows.withColumn("bits", F.round(detect.entropy_bits(F.col("value")), 6))


@query(
    f"""
SELECT doc_id, value FROM (SELECT doc_id, text, unnest(regexp_extract_all(text, '{_TOKEN}')) AS value FROM documents)
WHERE {_BITS.format(t='value')} >= 3.5 AND NOT {_structured('value')}
AND NOT (regexp_matches(value, '^[0-9a-f]{{7,64}}$') AND regexp_matches(text, '(^|[^0-9A-Za-z])(?i:commit|sha1|sha256|sha|rev)[ \\t:]*' || value))"""
)
def detect_secret(spark, sf_dir):
    return _values(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), detect.entropy)


@query(f"SELECT page_id, token, {_structured('token')} AS structured FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS token FROM pages)")
def structured_identifier(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("token"))
    return rows.withColumn("structured", detect.structured_identifier(F.col("token")))


# --- spans, counts, overlaps -------------------------------------------------


@query(
    f"""
WITH m AS (SELECT doc_id, regexp_extract_all(text, '{_EMAIL}') AS found, string_split_regex(text, '{_EMAIL}') AS gaps FROM documents),
i AS (SELECT doc_id, found, gaps, unnest(range(1, len(found) + 1)) AS n FROM m WHERE len(found) > 0)
SELECT doc_id, found[n] AS value,
  CAST(list_sum(list_transform(gaps[1:n], lambda x: strlen(x))) + coalesce(list_sum(list_transform(found[1:n - 1], lambda x: strlen(x))), 0) AS INTEGER) AS start,
  CAST(list_sum(list_transform(gaps[1:n], lambda x: strlen(x))) + list_sum(list_transform(found[1:n], lambda x: strlen(x))) AS INTEGER) AS "end"
FROM i"""
)
def findings_spans(spark, sf_dir):
    """Byte offsets, texts beyond ASCII included."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(detect.email(view(F.col("text")))).alias("f"))
    return rows.select("doc_id", unview(F.col("f.value")).alias("value"), "f.start", "f.end")


def _two_detectors(b):
    return F.concat(detect.email(b), F.filter(detect.ip(b), lambda f: ~F.contains(f["value"], F.lit(":"))))


def _counts(by: str) -> str:
    found = " UNION ALL ".join(
        f"SELECT {by} AS k, '{t}' AS entity_type, unnest(regexp_extract_all(text, '{p}')) AS value FROM documents" for t, p in (("Email", _EMAIL), ("InternalIp", detect.IPV4))
    )
    return f"SELECT k AS {by}, entity_type, count(*) AS n, max(strlen(value)) AS longest FROM ({found}) GROUP BY 1, 2"


def _counted(spark, sf_dir, by: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(by, F.explode(_two_detectors(view(F.col("text")))).alias("f"))
    return rows.groupBy(by, F.col("f.entity_type").alias("entity_type")).agg(F.count(F.lit(1)).alias("n"), F.max(F.length("f.value")).cast("long").alias("longest"))


@query(_counts("lang"))
def finding_counts_by_lang(spark, sf_dir):
    return _counted(spark, sf_dir, "lang")


@query(_counts("source"))
def finding_counts_by_source(spark, sf_dir):
    return _counted(spark, sf_dir, "source")


# --- all detectors as SQL --------------------------------------------------------


def _found(entity: str, order: int, detector: str, pattern: str, sure: str) -> str:
    """Spans in characters, s from 0. All patterns match ASCII only, so a span is as
    long in bytes; a place in bytes is the size of what lies before it."""
    return f"""
SELECT id, text, '{entity}' AS entity_type, {order} AS type_ord, '{detector}' AS detector, {sure} AS sure, found[n] AS value,
       CAST(list_sum(list_transform(gaps[1:n], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:n - 1], lambda x: length(x))), 0) AS BIGINT) AS s
FROM (SELECT id, text, found, gaps, unnest(range(1, len(found) + 1)) AS n
      FROM (SELECT id, text, regexp_extract_all(text, '{pattern}') AS found, string_split_regex(text, '{pattern}') AS gaps FROM src))"""


_WEIGHED = "list_sum(list_transform(range(1, {n} + 1), lambda i: CAST(d[i] AS BIGINT) * {w}))"


def _analysed(source: str) -> str:
    """CTEs over ``source`` (id, text): f, all findings; r, by rank; m, what is left
    of each where they overlap; as ``mask.analyse`` has them."""
    near = "substr(text, greatest(1, s - 15), least(s, 16))"
    marker = lambda words: f"(regexp_matches({near}, '(?i)(^|[^0-9A-Za-z_])({words})([^0-9A-Za-z_]|$)'))"
    bits = _BITS.format(t="value")
    return f"""src AS ({source}),
e AS ({_found("Email", ORDER["Email"], "email", _EMAIL, "0.9")}),
p0 AS ({_found("Phone", ORDER["Phone"], "phone", detect.PHONE, "0.7")}),
p1 AS (SELECT *, regexp_replace(regexp_extract(substr(text, greatest(1, s - 23), least(s, 24)), '[0-9-]*$') || value || regexp_extract(substr(text, s + length(value) + 1, 24), '^[0-9-]*'), '[^0-9]', '', 'g') AS d
       FROM p0 WHERE length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 7 AND 15 AND regexp_matches(value, '[-+(). ]') AND NOT regexp_matches(value, '{detect.ISO_DATE}')),
p AS (SELECT * EXCLUDE d FROM p1 WHERE NOT (regexp_matches(value, '^[0-9]{{5}}-[0-9]{{4}}$') AND {marker("zip|postal")})
      AND NOT CASE WHEN regexp_matches(d, '^97[89][0-9]{{10}}$') THEN {_WEIGHED.format(n=13, w="CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END")} % 10 = 0 ELSE false END
      AND NOT CASE WHEN regexp_matches(d, '^[0-9]{{10}}$') THEN {_WEIGHED.format(n=10, w="(11 - i)")} % 11 = 0 AND {marker("isbn")} ELSE false END),
v4 AS ({_found("InternalIp", ORDER["InternalIp"], "ip", detect.IPV4, "0.85")}),
v6 AS ({_found("InternalIp", ORDER["InternalIp"], "ip", detect.IPV6, "0.85")}),
ib AS ({_found("Iban", ORDER["Iban"], "iban-sortcode", detect.IBAN, "0.75")}),
sc AS ({_found("SortCode", ORDER["SortCode"], "iban-sortcode", detect.SORT_CODE, "0.75")}),
t AS ({_found("Secret", ORDER["Secret"], "entropy", _TOKEN, "0.0")}),
h AS (SELECT * EXCLUDE bits REPLACE (least(0.95, greatest(0.5, 0.5 + (bits - 3.5) / 2.0 * 0.45)) AS sure) FROM (SELECT *, {bits} AS bits FROM t) WHERE bits >= 3.5 AND NOT {_structured("value")}
      AND NOT (regexp_matches(value, '^[0-9a-f]{{7,64}}$') AND lower(regexp_extract(substr(text, greatest(1, s - 255), least(s, 256)), '([0-9A-Za-z]*)[ \\t:]*$', 1)) IN ('commit', 'sha1', 'sha256', 'sha', 'rev'))),
f AS (SELECT *, s + length(value) AS e, strlen(substr(text, 1, s)) - s AS extra FROM (
      SELECT * FROM e UNION ALL SELECT * FROM p UNION ALL SELECT * FROM v6 UNION ALL SELECT * FROM ib UNION ALL SELECT * FROM sc UNION ALL SELECT * FROM h
      UNION ALL SELECT * FROM v4 WHERE NOT EXISTS (SELECT 1 FROM v6 WHERE v6.id = v4.id AND v6.s <= v4.s AND v4.s + length(v4.value) <= v6.s + length(v6.value)))),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY entity_type = 'Secret', s - e, s, type_ord, detector) AS rank FROM f),
pt AS (SELECT DISTINCT id, unnest([s, e]) AS edge FROM r),
c AS (SELECT id, edge AS a, lead(edge) OVER (PARTITION BY id ORDER BY edge) AS b FROM pt),
o AS (SELECT c.id, a, b, min(rank) AS rank FROM c JOIN r ON c.id = r.id AND s <= a AND b <= e GROUP BY 1, 2, 3),
g AS (SELECT *, a - sum(b - a) OVER (PARTITION BY id, rank ORDER BY a) + (b - a) AS run FROM o),
k AS (SELECT id, rank, run, min(a) AS st, max(b) AS en FROM g GROUP BY 1, 2, 3),
m AS (SELECT k.id, r.entity_type, r.detector, r.sure, k.st, k.en, r.extra, substr(r.value, k.st - r.s + 1, k.en - k.st) AS value,
             CASE WHEN r.entity_type = 'Secret' THEN 'irreversible-redact' ELSE 'mask' END AS class FROM k JOIN r ON k.id = r.id AND k.rank = r.rank)"""


_DOCS = "SELECT doc_id AS id, coalesce(text, '') AS text FROM documents"
_TAG = "CASE entity_type " + " ".join(f"WHEN '{n}' THEN '{t}'" for n, t in TAGS.items()) + " END"
_TYPES = """coalesce((SELECT '{{' || string_agg('"' || entity_type || '":' || n, ',' ORDER BY entity_type) || '}}' FROM (SELECT entity_type, count(*) AS n FROM {of} x WHERE x.id = src.id GROUP BY 1)), '{{}}')"""


def _spliced(put: str) -> str:
    """Each text of src with the fragments of m put as the SQL ``put``."""
    gap = "substr(src.text, coalesce(lag(en) OVER (PARTITION BY m.id ORDER BY st), 0) + 1, st - coalesce(lag(en) OVER (PARTITION BY m.id ORDER BY st), 0))"
    return f"""(SELECT src.id, CASE WHEN count(q.st) = 0 THEN any_value(src.text) ELSE string_agg(q.piece, '' ORDER BY q.st) || substr(any_value(src.text), CAST(max(q.en) AS BIGINT) + 1) END AS text
  FROM src LEFT JOIN (SELECT m.id, st, en, {gap} || {put} AS piece FROM m JOIN src ON m.id = src.id) q ON q.id = src.id GROUP BY src.id)"""


#: Displays of values by canonical key, numbered within a tag by first place.
_SHOWN = f"""keyed AS (SELECT *, CASE WHEN entity_type IN ('Iban', 'SortCode') THEN lower(regexp_replace(value, '[ -]', '', 'g')) WHEN entity_type = 'Phone' THEN regexp_replace(value, '[ .()-]', '', 'g')
  ELSE lower(value) END AS key, {_TAG} AS tag FROM m WHERE class = 'mask'),
firsts AS (SELECT tag, key, min(struct_pack(id := id, st := st)) AS place FROM keyed GROUP BY 1, 2),
shown AS (SELECT tag, key, tag || '_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS display FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY place) AS n FROM firsts))"""


@query(
    f"""WITH {_analysed(_DOCS)} SELECT detector, entity_type, count(*) AS n, round(avg(e - s), 3) AS mean, CAST(max(e - s) AS INTEGER) AS longest FROM f GROUP BY 1, 2"""
)
def census(spark, sf_dir):
    """All detectors: findings, mean and longest span, by detector and type."""
    rows = spread(docs(spark, sf_dir)).select(F.explode(detect.scan(view(F.col("content")))).alias("f")).select("f.*")
    size = F.col("end") - F.col("start")
    return rows.groupBy("detector", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(size), 3).alias("mean"), F.max(size).alias("longest"))


@query(f"WITH {_analysed(_DOCS)} SELECT src.id AS artefact_id, CAST(count(f.id) AS INTEGER) AS n FROM src LEFT JOIN f ON f.id = src.id GROUP BY 1 ORDER BY n DESC, artefact_id LIMIT 15")
def census_top(spark, sf_dir):
    """The 15 documents with most findings."""
    rows = spread(docs(spark, sf_dir)).select("artefact_id", F.size(detect.scan(view(F.col("content")))).alias("n"))
    return rows.orderBy(F.desc("n"), "artefact_id").limit(15)


_SPANS = """
SELECT CAST(event_id // 25 AS BIGINT) AS artefact_id, CAST(event_id % 97 AS INTEGER) AS s, CAST(event_id % 97 + 3 + (event_id * 7) % 13 AS INTEGER) AS e,
       CASE CAST(event_id % 4 AS INTEGER) WHEN 0 THEN 'Secret' WHEN 1 THEN 'Email' WHEN 2 THEN 'Phone' ELSE 'Iban' END AS entity_type,
       CASE CAST(event_id % 4 AS INTEGER) WHEN 0 THEN 16 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 8 END AS type_ord
FROM events"""
_RESOLVED = f"""
WITH f AS (SELECT DISTINCT * FROM ({_SPANS})),
r AS (SELECT *, row_number() OVER (PARTITION BY artefact_id ORDER BY entity_type = 'Secret', s - e, s, type_ord) AS rank FROM f),
p AS (SELECT DISTINCT artefact_id, unnest([s, e]) AS pt FROM r),
c AS (SELECT artefact_id, pt AS a, lead(pt) OVER (PARTITION BY artefact_id ORDER BY pt) AS b FROM p),
o AS (SELECT c.artefact_id, a, b, min(rank) AS rank FROM c JOIN r ON c.artefact_id = r.artefact_id AND s <= a AND b <= e GROUP BY 1, 2, 3),
g AS (SELECT *, a - sum(b - a) OVER (PARTITION BY artefact_id, rank ORDER BY a) + (b - a) AS run FROM o),
m AS (SELECT artefact_id, rank, run, min(a) AS st, max(b) AS en FROM g GROUP BY 1, 2, 3)
SELECT m.artefact_id, r.entity_type, m.st AS start, m.en AS "end" FROM m JOIN r USING (artefact_id, rank)"""


def _span_rows(spark, sf_dir) -> DataFrame:
    """A span an event, 25 events an artefact: both grow with the table."""
    e = F.col("event_id")
    kind = e % 4
    pick = lambda *xs: F.when(kind == 0, xs[0]).when(kind == 1, xs[1]).when(kind == 2, xs[2]).otherwise(xs[3])
    start = (e % 97).cast("int")
    rows = table(spark, sf_dir, "events").select(
        F.floor(e / 25).cast("long").alias("artefact_id"),
        pick("Secret", "Email", "Phone", "Iban").alias("entity_type"),
        pick(16, 1, 2, 8).alias("type_ord"),
        start.alias("start"),
        (e % 97 + 3 + (e * 7) % 13).cast("int").alias("end"),
    )
    return rows.distinct().select("*", F.lit(1.0).cast("float").alias("confidence"), F.lit("x").alias("detector"), F.lit("").alias("value"))


@query(_RESOLVED)
def resolve_overlaps(spark, sf_dir):
    """Within arrays, a row an artefact."""
    rows = _span_rows(spark, sf_dir)
    names = [f.split(":")[0] for f in FINDING.removeprefix("struct<").removesuffix(">").split(",")]
    grouped = rows.groupBy("artefact_id").agg(F.collect_list(F.struct(*names).cast(FINDING)).alias("fs"))
    return grouped.select("artefact_id", F.explode(overlap.resolve(F.col("fs"))).alias("f")).select("artefact_id", "f.entity_type", "f.start", "f.end")


@query(_RESOLVED)
def resolve_overlaps_table(spark, sf_dir):
    """As joins and windows, a row a finding."""
    return overlap.resolve_rows(_span_rows(spark, sf_dir)).select("artefact_id", "entity_type", "start", "end")


# --- keys and checksums --------------------------------------------------------

_MESSY = "'  ' || c_name || '   ' || c_mktsegment || ' '"


@query(
    f"""
SELECT c_custkey, trim(regexp_replace({_MESSY}, '\\s+', ' ', 'g')) AS person, lower(trim(regexp_replace({_MESSY}, '\\s+', ' ', 'g'))) AS email,
       lower(regexp_replace('12-' || c_custkey || ' 5', '[ -]', '', 'g')) AS sort_code, regexp_replace('(0) 20.' || c_custkey || '-1', '[ .()-]', '', 'g') AS phone FROM customer"""
)
def canonicalize(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    messy = F.concat(F.lit("  "), F.col("c_name"), F.lit("   "), F.col("c_mktsegment"), F.lit(" "))
    canon = lambda text, kind: keying.canonicalize(text, F.lit(kind))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        canon(messy, "Person").alias("person"),
        canon(messy, "Email").alias("email"),
        canon(F.concat(F.lit("12-"), key, F.lit(" 5")), "SortCode").alias("sort_code"),
        canon(F.concat(F.lit("(0) 20."), key, F.lit("-1")), "Phone").alias("phone"),
    )


_PADS = {k: "".join(f"\\x{b ^ p:02X}" for b in b"salt".ljust(64, b"\0")) for k, p in (("i", 0x36), ("o", 0x5C))}


@query(
    f"""
SELECT c_custkey, sha256('{_PADS["o"]}'::BLOB || unhex(sha256('{_PADS["i"]}'::BLOB || encode(lower(c_name || '@example.org')) || '\\x1F'::BLOB || encode('EMAIL') ||
       '\\x1F'::BLOB || encode('REPO:acme')))) AS key_hex FROM customer"""
)
def hmac_key(spark, sf_dir):
    name = F.concat("c_name", F.lit("@example.org"))
    key = keying.placeholder_key(b"salt", name, F.lit("Email"), F.lit("repo"), F.lit("acme"))
    return table(spark, sf_dir, "customer").select("c_custkey", key.alias("key_hex"))


@query(
    """
SELECT o_orderkey, (list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(d[i] AS BIGINT)
  ELSE CAST(d[i] AS BIGINT) * 2 - CASE WHEN CAST(d[i] AS BIGINT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0) AND length(d) >= 2 AS valid
FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS d FROM orders)"""
)
def luhn(spark, sf_dir):
    spaced = F.regexp_replace(F.col("o_orderkey").cast("string"), "^(..)", "$1 -")
    return table(spark, sf_dir, "orders").select("o_orderkey", keying.luhn_valid(spaced).alias("valid"))


@query(
    """
SELECT c_custkey, CAST('32142829123456987654321611' || lpad(CAST(c_custkey % 97 AS VARCHAR), 2, '0') AS HUGEINT) % 97 = 1 AS valid FROM customer"""
)
def iban_mod97(spark, sf_dir):
    """GB.. WEST 1234 5698 7654 32 with every check number."""
    iban = F.concat(F.lit("GB"), F.lpad((F.col("c_custkey") % 97).cast("string"), 2, "0"), F.lit(" WEST 1234 5698 7654 32"))
    return table(spark, sf_dir, "customer").select("c_custkey", keying.iban_valid(iban).alias("valid"))


@query(
    """
WITH t AS (SELECT p_partkey, '978' || lpad(CAST(p_partkey * 7919 % 10000000000 AS VARCHAR), 10, '0') AS a, lpad(CAST(p_partkey * 104729 % 10000000000 AS VARCHAR), 10, '0') AS b FROM part)
SELECT p_partkey, list_sum([CAST(a[i] AS BIGINT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END FOR i IN range(1, 14)]) % 10 = 0 AS isbn13,
       list_sum([CAST(b[i] AS BIGINT) * (11 - i) FOR i IN range(1, 11)]) % 11 = 0 AS isbn10 FROM t"""
)
def isbn(spark, sf_dir):
    k, ten = F.col("p_partkey"), 10_000_000_000
    a = F.concat(F.lit("978"), F.lpad((k * 7919 % ten).cast("string"), 10, "0"))
    b = F.lpad((k * 104729 % ten).cast("string"), 10, "0")
    return table(spark, sf_dir, "part").select("p_partkey", detect.isbn13_valid(a).alias("isbn13"), detect.isbn10_valid(b).alias("isbn10"))


# --- policy ------------------------------------------------------------------


@query(
    """
SELECT page_id, CASE WHEN lower(regexp_extract(p, '^.+\\.([^.]*)$', 1)) IN ('env', 'pem') OR p LIKE '.env%' THEN 'block' ELSE 'pass' END AS handling
FROM (SELECT page_id, CASE CAST(page_id % 5 AS INTEGER) WHEN 0 THEN '.env' WHEN 1 THEN '.env.' || page_id WHEN 2 THEN 'Key' || page_id || '.PEM' WHEN 3 THEN 'notes.md'
      ELSE 'environment' END AS p FROM pages)"""
)
def classify_artefact(spark, sf_dir):
    n = F.col("page_id")
    name = F.when(n % 5 == 0, ".env").when(n % 5 == 1, F.concat(F.lit(".env."), n)).when(n % 5 == 2, F.concat(F.lit("Key"), n, F.lit(".PEM"))).when(n % 5 == 3, "notes.md").otherwise("environment")
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "pages").select("page_id", Policy.default().artefact_class(F.concat(F.lit("some.dir/"), name), none, none).alias("handling"))


@query(
    "SELECT t.name AS entity_type, CASE WHEN t.name = 'Hostname' THEN 'pass' WHEN t.name IN ('Password', 'Secret', 'PrivateKey', 'ApiKey', 'AccessToken') THEN "
    "'irreversible-redact' ELSE 'mask' END AS handling FROM (VALUES " + ", ".join(f"('{n}')" for n, _, _ in ENTITY_TYPES) + ", ('Custom:codename')) AS t(name)"
)
def classify_entity(spark, sf_dir):
    names = spark.createDataFrame([(n,) for n, _, _ in ENTITY_TYPES] + [("Custom:codename",)], "entity_type string")
    return names.select("entity_type", Policy.default().entity_class(F.col("entity_type")).alias("handling"))


@query(
    """
SELECT d AS destination, r AS role, d = 'local-patch' OR (d = 'local-explanation-buffer' AND r = 'reviewer') AS allowed,
       d NOT IN ('local-patch', 'local-test-fixture', 'local-explanation-buffer') AS masked_only
FROM (VALUES ('remote-model-prompt'), ('observability-sink'), ('local-patch'), ('local-explanation-buffer'), ('elsewhere')) AS t(d), (VALUES ('reviewer'), ('guest')) AS u(r)"""
)
def demask_gate(spark, sf_dir):
    """Under a policy that tries to open a destination denied in code."""
    over = {
        "destinations": {
            "remote-model-prompt": {"masked_only": False, "demask_allowed": True},
            "local-explanation-buffer": {"demask_allowed": True, "demask_roles": ["reviewer"]},
            "local-test-fixture": {"demask_allowed": False},
        }
    }
    from maskloom.plans.policy import DEFAULT

    policy = Policy.of(DEFAULT, over)
    names = ["remote-model-prompt", "observability-sink", "local-patch", "local-explanation-buffer", "elsewhere"]
    rows = spark.createDataFrame([(d, r) for d in names for r in ("reviewer", "guest")], "destination string, role string")
    return rows.select("destination", "role", policy.demask_gate(F.col("destination"), F.array("role")).alias("allowed"), policy.masked_only_gate(F.col("destination")).alias("masked_only"))


@query(
    """
SELECT page_id, CASE WHEN m = 'POST' AND (split_part(t, '?', 1) IN ('/v1/messages', '/v1/messages/count_tokens') OR regexp_matches(split_part(t, '?', 1),
  '^/model/[^/]+/(invoke|invoke-with-response-stream)$')) THEN 'Mask' WHEN m || ' ' || split_part(t, '?', 1) IN ('HEAD /', 'HEAD /api/hello', 'GET /inference-profiles',
  'GET /v1/models') THEN 'Pass' ELSE 'Block' END AS verdict
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'POST' ELSE 'GET' END AS m, CASE CAST(page_id % 7 AS INTEGER) WHEN 0 THEN '/v1/messages?beta=true' WHEN 1 THEN '/v1/models'
  WHEN 2 THEN '/model/a.b/invoke' WHEN 3 THEN '/model//invoke' WHEN 4 THEN '/v1/messages/batches' WHEN 5 THEN '/model/x/converse'
  ELSE '/' || regexp_replace(url, '^[a-z]+://[^/]*/?', '') END AS t FROM pages)"""
)
def route_verdict(spark, sf_dir):
    n = F.col("page_id")
    target = F.lit(None).cast("string")
    for i, t in enumerate(["/v1/messages?beta=true", "/v1/models", "/model/a.b/invoke", "/model//invoke", "/v1/messages/batches", "/model/x/converse"]):
        target = F.when(n % 7 == i, t).otherwise(target)
    target = F.coalesce(target, F.concat(F.lit("/"), F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")))
    return table(spark, sf_dir, "pages").select("page_id", routes.route_verdict(F.when(n % 2 == 0, "POST").otherwise("GET"), target).alias("verdict"))


# --- masking -----------------------------------------------------------------


@query(f"SELECT doc_id AS artefact_id, regexp_replace(text, '{_EMAIL}', '[REDACTED:EMAIL]', 'g') AS text FROM documents")
def redact_emails(spark, sf_dir):
    """One detector, no vault."""
    policy = Policy.of({"entities": {"default": "irreversible-redact"}})
    rows = mask.analyse(docs(spark, sf_dir), policy, {"email": detect.email})
    put = mask.splice(F.col("bytes"), F.col("findings"), lambda f: keying.redaction_marker(f["entity_type"]))
    return rows.select("artefact_id", unview(put).alias("text"))


@query(
    f"""WITH {_analysed(_DOCS)}
SELECT src.id AS artefact_id, z.text, false AS blocked, {_TYPES.format(of="m")} AS counts FROM src JOIN {_spliced(f"'[REDACTED:' || {_TAG} || ']'")} z ON z.id = src.id"""
)
def redact_only(spark, sf_dir):
    """All detectors under the default policy, no vault."""
    rows = mask.redact(docs(spark, sf_dir))
    return rows.select("artefact_id", "text", "blocked", F.to_json("counts").alias("counts"))


@query(
    f"""WITH {_analysed(_DOCS)}
SELECT id AS artefact_id, entity_type, CAST(st + extra AS INTEGER) AS start, CAST(en + extra AS INTEGER) AS "end", round(CAST(sure AS DOUBLE), 3) AS confidence, detector, class FROM m"""
)
def inspect(spark, sf_dir):
    return mask.inspect(docs(spark, sf_dir)).withColumn("confidence", F.round(F.col("confidence").cast("double"), 3))


def _vault(spark) -> vault.Vault:
    return vault.Vault(spark, f"{shared_dir(spark)}/maskloom/vault-{uuid.uuid4().hex}", b"a key of 16 byte", b"salt")


#: Secrets stay: a fragment of one beside an address would make one word of two displays.
_ALL = {"entities": {"default": "mask", "overrides": {"secret": "pass"}}, "destinations": {"local-patch": {"demask_allowed": True}}}


@query(
    f"""WITH {_analysed(_DOCS)}, {_SHOWN},
put AS (SELECT m.*, CASE WHEN m.class = 'mask' THEN display ELSE '[REDACTED:' || {_TAG.replace("entity_type", "m.entity_type")} || ']' END AS display
  FROM m LEFT JOIN (SELECT keyed.id, keyed.st, display FROM keyed JOIN shown USING (tag, key)) d ON d.id = m.id AND d.st = m.st),
spliced AS (SELECT * FROM {_spliced("display").replace("FROM m JOIN", "FROM put m JOIN")})
SELECT src.id AS artefact_id, z.text, {_TYPES.format(of="m")} AS counts, {_TYPES.format(of="f")} AS raw_counts,
       CAST((SELECT count(DISTINCT display) FROM put x WHERE x.id = src.id AND x.class = 'mask') AS INTEGER) AS bindings FROM src JOIN spliced z ON z.id = src.id"""
)
def mask_documents(spark, sf_dir):
    packs = mask.mask(docs(spark, sf_dir), _vault(spark), "repo", "documents", now=1)
    return packs.select("artefact_id", "text", F.to_json("counts").alias("counts"), F.to_json("raw_counts").alias("raw_counts"), F.size("bindings").alias("bindings"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(f"SELECT doc_id AS artefact_id, md5(translate(regexp_replace(text, '[ .()-]', '', 'g'), '{_UPPER}', '{_LOWER}')) AS digest FROM documents")
def rehydrate_roundtrip(spark, sf_dir):
    """All but secrets masked, then restored: the texts as they were, but for the
    separators and case of values first seen in another spelling."""
    policy, held = Policy.of(_ALL), _vault(spark)
    packs = mask.mask(docs(spark, sf_dir), held, "repo", "documents", policy, now=1)
    restored = mask.rehydrate(packs, held, "local-patch", policy=policy, now=2)
    plain = F.translate(F.regexp_replace("text", "[ .()-]", ""), _UPPER, _LOWER)
    return restored.select("artefact_id", F.md5(plain.cast("binary")).alias("digest"))


@query("SELECT doc_id AS artefact_id, false AS allowed FROM documents")
def rehydrate_denied(spark, sf_dir):
    rows = docs(spark, sf_dir).select("artefact_id", F.col("content").alias("text"))
    return mask.rehydrate(rows, _vault(spark), "observability-sink", now=1).select("artefact_id", "allowed")


@query(
    """
WITH v AS (SELECT c_custkey, 'user' || (c_custkey * 31 % 53) || '@example.org' AS a, 'USER' || (c_custkey * 17 % 53) || '@Example.org' AS b FROM customer),
s AS (SELECT c_custkey, 1 AS p, a AS value FROM v UNION ALL SELECT c_custkey, 2, b FROM v),
f AS (SELECT *, row_number() OVER (PARTITION BY lower(value) ORDER BY c_custkey, p) AS nth FROM s)
SELECT value, 'EMAIL_' || lpad(CAST(row_number() OVER (ORDER BY c_custkey, p) AS VARCHAR), 3, '0') AS display FROM f WHERE nth = 1"""
)
def ordinals(spark, sf_dir):
    """Placeholders in document order; a value keeps its first spelling."""
    k = F.col("c_custkey")
    a = F.concat(F.lit("user"), k * 31 % 53, F.lit("@example.org"))
    b = F.concat(F.lit("USER"), k * 17 % 53, F.lit("@Example.org"))
    rows = table(spark, sf_dir, "customer").select(k.alias("artefact_id"), F.concat(a, F.lit(" and "), b).alias("content"))
    return mask.ordinals(rows, "repo", "acme", b"salt").select("value", "display")


@query(
    """
SELECT user_id % 3 = 0 AS renewed, count(*) AS n, max(event_id) AS last FROM events
WHERE event_id % 1000 > 500 OR user_id % 3 = 0 GROUP BY 1"""
)
def vault_ttl_purge(spark, sf_dir):
    """Rows that expired by 500 go, but for keys seen again, which are renewed."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("key_hex"), (F.col("event_id") % 1000).cast("long").alias("expires_at"), "user_id", "event_id"
    )
    again = rows.where("user_id % 3 = 0").select("key_hex")
    left = vault.purged(vault.renewed(rows, again, 500, 100), 500)
    return left.groupBy((F.col("user_id") % 3 == 0).alias("renewed")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))


@query("SELECT 'repo' AS ns_kind, CAST(user_id % 5 AS VARCHAR) AS ns_id, 'T' || (user_id % 3) AS tag, max(event_id) AS ordinal FROM events GROUP BY 2, 3")
def vault_high_water(spark, sf_dir):
    tag = F.concat(F.lit("T"), F.col("user_id") % 3)
    rows = table(spark, sf_dir, "events").select(
        F.lit("repo").alias("ns_kind"), (F.col("user_id") % 5).cast("string").alias("ns_id"), keying.display(tag, F.col("event_id")).alias("display"), F.col("event_id").alias("ordinal")
    )
    return vault.high_water(rows)


@query(f"WITH {_analysed(_DOCS)}, {_SHOWN} SELECT (SELECT count(*) FROM shown) AS mappings, (SELECT count(*) FROM (SELECT DISTINCT id, tag, key FROM keyed)) AS attempts")
def vault_stats(spark, sf_dir):
    """Mappings and logged attempts after a mask and a restore."""
    policy, held = Policy.of(_ALL), _vault(spark)
    packs = mask.mask(docs(spark, sf_dir), held, "repo", "documents", policy, now=1)
    mask.rehydrate(packs, held, "local-patch", policy=policy, now=2).write.format("noop").mode("overwrite").save()
    return held.mapping().agg(F.count(F.lit(1)).alias("mappings")).crossJoin(held.events().agg(F.count(F.lit(1)).alias("attempts")))  # of one row each


# --- audit, benchmark ----------------------------------------------------------


def _packs(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    counts = F.create_map(F.lit("InternalIp"), e % 3, F.lit("Email"), e % 5)
    return table(spark, sf_dir, "events").select(e.alias("artefact_id"), counts.alias("raw_counts"), (e % 10 == 0).cast("int").alias("blocked_artefacts"))


@query(
    """
SELECT 'scan' AS kind, 'email' AS entity_type, sum(event_id % 5)::BIGINT AS n FROM events WHERE event_id % 10 <> 0
UNION ALL SELECT 'scan', 'internal_ip', sum(event_id % 3)::BIGINT FROM events WHERE event_id % 10 <> 0
UNION ALL SELECT 'block', NULL, count(*) FROM events WHERE event_id % 10 = 0"""
)
def audit_counts(spark, sf_dir):
    """Written as JSON lines, read back and checked, added up."""
    path = f"{shared_dir(spark)}/maskloom/audit-{uuid.uuid4().hex}"
    audit.write(audit.events_of(_packs(spark, sf_dir), "run"), path)
    rows = audit.read(spark, path).select("event.kind", F.explode_outer("event.counts").alias("c"))
    n = F.when(F.col("kind") == "scan", F.col("c.count")).otherwise(1)
    return rows.groupBy("kind", F.col("c.entity_type").alias("entity_type")).agg(F.sum(n).alias("n"))


@query("SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 20)")
def audit_tail(spark, sf_dir):
    return audit.tail(table(spark, sf_dir, "events").select("event_id", "event_type"), 20, "event_id")


_LABELS = f"SELECT artefact_id AS sample, entity_type, s + 2 AS s, e + 1 AS e FROM (SELECT DISTINCT * FROM ({_SPANS})) WHERE (s + artefact_id) % 3 = 0"
_MATCH = "a.sample = b.sample AND a.s < b.e AND b.s < a.e"
_BENCH = f"WITH f AS (SELECT DISTINCT artefact_id AS sample, entity_type, s, e FROM ({_SPANS})), l AS ({_LABELS})"


def _bench(spark, sf_dir):
    f = _span_rows(spark, sf_dir).withColumnRenamed("artefact_id", "sample")
    labels = f.where((F.col("start") + F.col("sample")) % 3 == 0).select("sample", "entity_type", (F.col("start") + 2).alias("start"), (F.col("end") + 1).alias("end"))
    f = f.select("sample", "entity_type", "start", "end", "detector", Policy.default().entity_class(F.col("entity_type")).alias("class"))
    return f, labels


@query(
    f"""{_BENCH}
SELECT round((SELECT count(*) FROM l a WHERE EXISTS (SELECT 1 FROM f b WHERE {_MATCH} AND a.entity_type = b.entity_type)) / (SELECT count(*) FROM l), 9) AS recall,
       round((SELECT count(*) FROM f a WHERE EXISTS (SELECT 1 FROM l b WHERE {_MATCH} AND a.entity_type = b.entity_type)) / (SELECT count(*) FROM f), 9) AS "precision",
       round((SELECT count(*) FROM f a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE {_MATCH} AND a.entity_type = b.entity_type)) / (SELECT count(*) FROM f), 9) AS false_positive_rate"""
)
def benchmark_metrics(spark, sf_dir):
    row = benchmark.metrics(*_bench(spark, sf_dir))
    return row.select(*[F.round(c, 9).alias(c) for c in row.columns])


@query(f"{_BENCH} SELECT sample, entity_type, s AS start, e AS \"end\" FROM l a WHERE EXISTS (SELECT 1 FROM f b WHERE {_MATCH} AND a.entity_type = b.entity_type)")
def label_overlap_semi(spark, sf_dir):
    f, labels = _bench(spark, sf_dir)
    return benchmark.matched(labels, f)


@query(f"{_BENCH} SELECT sample, entity_type, s AS start, e AS \"end\" FROM f a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE {_MATCH})")
def label_overlap_anti(spark, sf_dir):
    f, labels = _bench(spark, sf_dir)
    return benchmark.matched(f, labels, "left_anti", same_type=False).select("sample", "entity_type", "start", "end")


@query(
    f"""{_BENCH}
SELECT CASE WHEN entity_type = 'Secret' THEN 'secret' ELSE 'pii' END AS kind, count(*) AS total,
       count(CASE WHEN EXISTS (SELECT 1 FROM f b WHERE {_MATCH} AND a.entity_type = b.entity_type) THEN 1 END) AS matched FROM l a GROUP BY 1"""
)
def recall_split(spark, sf_dir):
    return benchmark.recall_split(*_bench(spark, sf_dir))


@query(
    f"""{_BENCH}
SELECT 'x' AS detector, count(*) AS total, count(CASE WHEN NOT EXISTS (SELECT 1 FROM l b WHERE {_MATCH}) THEN 1 END) AS false_positives,
       count(CASE WHEN sample % 4 = 1 AND NOT EXISTS (SELECT 1 FROM l b WHERE {_MATCH}) THEN 1 END) AS benign_false_positives FROM f a"""
)
def detector_false_positives(spark, sf_dir):
    f, labels = _bench(spark, sf_dir)
    return benchmark.detector_false_positives(f, labels, f.where("sample % 4 = 1").select("sample").distinct())


@query("SELECT quantile_disc(value, 0.95) AS p FROM events")
def p95_nearest_rank(spark, sf_dir):
    return benchmark.nearest_rank(table(spark, sf_dir, "events"), "value")


@query(
    f"""
WITH v AS (SELECT DISTINCT doc_id, lang, text, unnest(regexp_extract_all(text, '{_EMAIL}')) AS value FROM documents)
SELECT DISTINCT doc_id, 'Email' AS entity_type FROM v WHERE contains(CASE WHEN lang = 'en' THEN regexp_replace(text, '{_EMAIL}', '[REDACTED:EMAIL]', 'g') ELSE text END, value)"""
)
def zero_raw_values(spark, sf_dir):
    """Values that a text still holds: here after a mask that passed over all languages but one."""
    rows = docs(spark, sf_dir)
    found = rows.select(F.col("artefact_id").alias("sample"), F.explode(detect.email(view(F.col("content")))).alias("f"))
    labels = found.select("sample", "f.entity_type", unview(F.col("f.value")).alias("value"))
    policy = Policy.of({"entities": {"default": "irreversible-redact"}})
    seen = mask.analyse(rows.withColumn("content", F.when(F.col("lang") == "en", F.col("content")).otherwise("")), policy, {"email": detect.email})
    masked = seen.select("artefact_id", unview(mask.splice(F.col("bytes"), F.col("findings"), lambda f: keying.redaction_marker(f["entity_type"]))).alias("masked"))
    packs = rows.join(masked, "artefact_id").select(F.col("artefact_id").alias("sample"), F.when(F.col("lang") == "en", F.col("masked")).otherwise(F.col("content")).alias("text"))
    return benchmark.raw_left(packs, labels).distinct().withColumnRenamed("sample", "doc_id")


@query("SELECT p_partkey, n AS start, n + length(w) AS \"end\" FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS w, p_name || ' é ' || split_part(p_name, ' ', 1) AS t, "
       "unnest([0, strlen(p_name) + 4]) AS n FROM part) WHERE len(string_split(t, w)) = 3")
def label_occurrences(spark, sf_dir):
    """Every place of a label's value, in bytes."""
    word = F.substring_index("p_name", " ", 1)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" é "), word).alias("t"), word.alias("w"))
    rows = rows.select("p_partkey", artefacts.occurrences(F.col("t"), F.col("w")).alias("at")).where(F.size("at") == 2)
    return rows.select("p_partkey", F.explode("at").alias("at")).select("p_partkey", F.col("at.start").cast("long").alias("start"), F.col("at.end").cast("long").alias("end"))


# --- parsers -----------------------------------------------------------------


def _parsed(df: DataFrame, id_: str, text, kind: str) -> DataFrame:
    ship(df.sparkSession)
    rows = spread(df.select(id_, text.alias("b"))).select(id_, view(F.col("b")).alias("b")).select(id_, "b", parse.parse(F.col("b"), kind).alias("spans"))
    rows = rows.select(id_, "b", F.explode("spans").alias("s"))
    value = unview(F.substr("b", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")))
    return rows.select(id_, F.col("s.start").alias("start"), "s.node_kind", "s.node_arg", value.alias("value"))


@query("SELECT event_id, unnest(json_keys(props)) AS value FROM events")
def parse_json_keys(spark, sf_dir):
    return _parsed(table(spark, sf_dir, "events"), "event_id", F.col("props"), "json").where("node_kind = 'Key'").select("event_id", "value")


@query(
    """
SELECT event_id, 'Field' AS node_kind, 'timestamp' AS node_arg, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS value FROM events
UNION ALL SELECT event_id, 'Field', 'level', 'WARN' FROM events
UNION ALL SELECT event_id, 'Value', NULL, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' WARN ' || event_type FROM events"""
)
def parse_log(spark, sf_dir):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return _parsed(table(spark, sf_dir, "events"), "event_id", F.concat(F.lit("\n"), stamp, F.lit(" WARN "), F.col("event_type"), F.lit("\r\n  \n")), "log").drop("start")


@query(
    """
SELECT event_id, 'Key' AS node_kind, 'USER' AS value FROM events UNION ALL SELECT event_id, 'Value', CAST(user_id AS VARCHAR) FROM events
UNION ALL SELECT event_id, 'Comment', '# ' || event_type FROM events UNION ALL SELECT event_id, 'Key', 'BARE' FROM events"""
)
def parse_env(spark, sf_dir):
    text = F.concat(F.lit(' export USER = "'), F.col("user_id"), F.lit('" \n# '), F.col("event_type"), F.lit("\n\nBARE"))
    return _parsed(table(spark, sf_dir, "events"), "event_id", text, "env").select("event_id", "node_kind", "value")


@query(
    """
SELECT event_id, 'Field' AS node_kind, 'path' AS node_arg, 'a/' || event_type AS value FROM events UNION ALL SELECT event_id, 'Other', 'hunk', '@@ -1 +1 @@' FROM events
UNION ALL SELECT event_id, 'Field', 'removed', CAST(user_id AS VARCHAR) FROM events UNION ALL SELECT event_id, 'Field', 'added', CAST(event_id AS VARCHAR) FROM events
UNION ALL SELECT event_id, 'Value', NULL, 'same' FROM events"""
)
def parse_diff(spark, sf_dir):
    text = F.concat(F.lit("--- a/"), F.col("event_type"), F.lit("\n@@ -1 +1 @@\n-"), F.col("user_id"), F.lit("\n+"), F.col("event_id"), F.lit("\n same\n"))
    return _parsed(table(spark, sf_dir, "events"), "event_id", text, "diff").drop("start")


@query(
    """
SELECT c_custkey, 'Key' AS node_kind, NULL AS node_arg, 'name' AS value FROM customer UNION ALL SELECT c_custkey, 'Key', NULL, 'seg' FROM customer
UNION ALL SELECT c_custkey, 'Field', 'name', c_name || ', ""x""' FROM customer UNION ALL SELECT c_custkey, 'Field', 'seg', c_mktsegment FROM customer
UNION ALL SELECT c_custkey, 'Value', NULL, 'more' FROM customer"""
)
def parse_csv(spark, sf_dir):
    text = F.concat(F.lit('name,seg\r\n"'), F.col("c_name"), F.lit(', ""x""",'), F.col("c_mktsegment"), F.lit(",more\n"))
    return _parsed(table(spark, sf_dir, "customer"), "c_custkey", text, "csv").drop("start")


@query(
    """
SELECT c_custkey, 'Key' AS node_kind, 'name' AS value FROM customer UNION ALL SELECT c_custkey, 'Value', c_name FROM customer
UNION ALL SELECT c_custkey, 'Comment', '# ' || c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'Value', 'item' FROM customer"""
)
def parse_yaml(spark, sf_dir):
    text = F.concat(F.lit("---\nname: "), F.col("c_name"), F.lit(" # "), F.col("c_mktsegment"), F.lit("\n- - item\n"))
    return _parsed(table(spark, sf_dir, "customer"), "c_custkey", text, "yaml").select("c_custkey", "node_kind", "value")


@query(
    """
SELECT c_custkey, 'Key' AS node_kind, '[owner]' AS value FROM customer UNION ALL SELECT c_custkey, 'Key', 'name' FROM customer
UNION ALL SELECT c_custkey, 'Value', '"' || c_name || ' # no"' FROM customer UNION ALL SELECT c_custkey, 'Comment', '# ' || c_mktsegment FROM customer"""
)
def parse_toml(spark, sf_dir):
    text = F.concat(F.lit('[owner]\nname = "'), F.col("c_name"), F.lit(' # no" # '), F.col("c_mktsegment"))
    return _parsed(table(spark, sf_dir, "customer"), "c_custkey", text, "toml").select("c_custkey", "node_kind", "value")


@query(
    """
SELECT c_custkey, 'Identifier' AS node_kind, 'x' AS value FROM customer UNION ALL SELECT c_custkey, 'StringLiteral', '"' || c_name || '"' FROM customer
UNION ALL SELECT c_custkey, 'Comment', '// ' || c_mktsegment FROM customer"""
)
def parse_rust(spark, sf_dir):
    text = F.concat(F.lit('let x = "'), F.col("c_name"), F.lit('"; // '), F.col("c_mktsegment"))
    return _parsed(table(spark, sf_dir, "customer"), "c_custkey", text, "rust").select("c_custkey", "node_kind", "value")


@query(
    """
SELECT page_id, CASE CAST(page_id % 6 AS INTEGER) WHEN 0 THEN 'json' WHEN 1 THEN 'env' WHEN 2 THEN 'toml' WHEN 3 THEN 'log' WHEN 4 THEN 'yaml' END AS parser FROM pages"""
)
def parser_dispatch(spark, sf_dir):
    n = F.col("page_id") % 6
    path = F.when(n == 0, "a/b.JSON").when(n == 1, "x/.env.local").when(n == 2, "Cargo.lock").when(n == 3, "y.log").otherwise("plain")
    kind = parse.parser_of(path, F.when(n == 4, "YAML"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("parser"))


# --- hooks and streams ---------------------------------------------------------


def _events(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    n = F.col("conv_id") * 1000 + F.col("turn")
    prompt = F.to_json(F.struct(F.col("text").alias("prompt")))
    payload = F.when(n % 5 == 0, "{}").when(n % 5 == 1, "not json").otherwise(prompt)
    return rows.select(n.alias("event_id"), F.when(n % 2 == 0, "user-prompt-submit").otherwise("UserPromptSubmit").alias("event"), payload.alias("payload"))


_N = "(conv_id * 1000 + turn)"


@query(
    f"""
SELECT {_N} AS event_id, CASE WHEN {_N} % 5 > 1 AND text <> '' THEN text END AS subject,
       CASE WHEN {_N} % 5 = 0 THEN 'no field prompt' WHEN {_N} % 5 = 1 THEN 'not JSON' WHEN text IS NULL THEN 'no field prompt' END AS drift FROM conversations"""
)
def hook_subjects(spark, sf_dir):
    return hooks.subjects(_events(spark, sf_dir)).select("event_id", "subject", "drift")


_PROMPTS = f"SELECT {_N} AS id, text FROM conversations WHERE {_N} % 5 > 1 AND text <> ''"


@query(
    f"""WITH {_analysed(_PROMPTS)}, z AS (SELECT * FROM {_spliced(f"'[REDACTED:' || {_TAG} || ']'")}),
d AS (SELECT {_N} AS event_id, z.text AS masked, CASE WHEN {_N} % 5 <= 1 OR c.text IS NULL THEN 'block' WHEN c.text = '' OR z.text = c.text THEN 'pass' ELSE 'transform' END AS decision
      FROM conversations c LEFT JOIN z ON z.id = {_N})
SELECT event_id, 'UserPromptSubmit' AS event, decision, CASE WHEN decision = 'block' THEN 2 ELSE 0 END AS exit_code,
       CASE WHEN decision = 'transform' THEN CAST(json_object('decision', 'block', 'reason', '{hooks.RESUBMIT}' || masked) AS VARCHAR) END AS output FROM d"""
)
def hook_answers(spark, sf_dir):
    ship(spark)
    found = hooks.subjects(_events(spark, sf_dir))
    of = found.where("subject is not null").select(F.col("event_id").alias("artefact_id"), F.col("subject").alias("content"), "path")
    return hooks.answers(found, mask.redact(of))


@query(f"SELECT doc_id AS artefact_id, regexp_replace(text, '{_EMAIL}', '[REDACTED:EMAIL]', 'g') AS text FROM documents")
def stream_redact_emails(spark, sf_dir):
    """A stream of all documents that are there now, written and read."""
    out = f"{shared_dir(spark)}/maskloom/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "documents").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]").select(F.col("doc_id").alias("artefact_id"), F.col("text").alias("content"))
    policy = Policy.of({"entities": {"default": "irreversible-redact"}})
    rows = mask.analyse(rows, policy, {"email": detect.email})
    put = mask.splice(F.col("bytes"), F.col("findings"), lambda f: keying.redaction_marker(f["entity_type"]))
    writer = rows.select("artefact_id", unview(put).alias("text")).writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint")
    writer.trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query(
    """
SELECT event_id AS request_id, CASE WHEN k = 0 THEN 'session' WHEN k = 2 THEN 'repo' END AS ns_kind,
       CASE WHEN k = 0 THEN '00000000-0000-4000-8000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') WHEN k = 2 THEN 'r' || (event_id % 5) END AS ns_id,
       CASE WHEN k = 1 THEN 'invalid namespace header 00000000-0000-0000-0000-000000000000' WHEN k = 3 THEN 'unregistered address 127.0.0.1:' || (9000 + event_id % 5) END AS error
FROM (SELECT event_id, CAST(event_id % 4 AS INTEGER) AS k FROM events)"""
)
def session_resolve(spark, sf_dir):
    """Header first, then address; nil headers and unknown addresses are refused."""
    from maskloom.operators import sessions

    e, k = F.col("event_id"), F.col("event_id") % 4
    header = F.when(k == 0, F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(e.cast("string"), 12, "0"))).when(k == 1, "00000000-0000-0000-0000-000000000000")
    address = F.concat(F.lit("127.0.0.1:"), F.when(k == 3, 9000).otherwise(8000) + e % 5)
    requests = table(spark, sf_dir, "events").select(e.alias("request_id"), header.alias("header"), address.alias("address"))
    registry = spark.createDataFrame([(f"127.0.0.1:{8000 + i}", "repo", f"r{i}") for i in range(5)], "address string, ns_kind string, ns_id string")
    return sessions.resolve(requests, registry)


@query("SELECT count(DISTINCT c_custkey % 40) AS stable, count(DISTINCT c_custkey % 40) AS total FROM customer")
def placeholder_consistency(spark, sf_dir):
    """A value twice in a text becomes one placeholder."""
    value = F.concat(F.lit("user"), F.col("c_custkey") % 40, F.lit("@x.org"))
    labels = table(spark, sf_dir, "customer").select(F.lit("Email").alias("entity_type"), value.alias("value"))
    return benchmark.placeholder_consistency(labels, _vault(spark))


@query("SELECT 'p' || p_partkey AS sample, p_partkey % 2 = 0 AS decoy_minted, p_partkey % 2 = 0 AS corrupted FROM part")
def display_collisions(spark, sf_dir):
    """Texts that hold a look-alike: those equal to a placeholder made are restored wrongly."""
    k = F.col("p_partkey")
    decoy = F.when(k % 2 == 0, "EMAIL_001").otherwise("EMAIL_900")
    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), k).alias("name"), F.concat(F.lit("ask a@x.org or "), decoy).alias("content"), F.array(decoy).alias("decoys")
    )
    return benchmark.display_collisions(rows, _vault(spark))


@query("SELECT p_partkey % 3 = 0 AS blocked, 'artefact-block-fires' AS name, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT true, 'masked-json-still-parses', count(*) FROM part")
def structural_checks(spark, sf_dir):
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    corpus = parts.select(k.cast("string").alias("name"), F.array(F.lit("artefact-block"), F.lit("json-payload")).alias("slices"))
    packs = parts.select(k.cast("string").alias("sample"), F.to_json(F.struct("p_name")).alias("text"), (k % 3 == 0).alias("blocked"))
    out = benchmark.structural_checks(corpus, packs)
    return out.groupBy(F.col("passed").alias("blocked"), "name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS sample, CAST(1 AS BIGINT) AS residual FROM part WHERE p_partkey % 2 = 1")
def residual_secrets(spark, sf_dir):
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    corpus = parts.select(k.cast("string").alias("name"), F.concat(F.lit("é pin "), k).alias("content"), F.array(k.cast("string")).alias("residual_secrets"))
    found = parts.where(k % 2 == 0).select(k.cast("string").alias("sample"), F.lit(7).alias("start"), F.lit(8).alias("end"))
    return benchmark.residuals(corpus, found)
