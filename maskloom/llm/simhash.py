"""SimHash near-duplicates, found by pigeonring filtering.

Documents that share a fingerprint are one class from the start. Two classes
are linked when their fingerprints differ in at most ``bits`` of 64. Cut into m
segments on a ring, such a pair has (pigeonhole) m - bits segments that are
equal: the join key. It also has (pigeonring) a segment from which every chain
of 1, 2, .., m consecutive segments differs in at most (chain length * bits / m)
bits in all: what prunes candidates, inside the join, before the Hamming check.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskloom.llm.components import components
from maskloom.llm.util import fresh, materialise, session, spread

WORDS, BITS, SEGMENTS, SEED = 3, 3, 5, 42


def simhash(text: str | None, words: int = WORDS) -> int:
    """The fingerprint as a signed 64-bit integer; see ``fingerprints``."""
    import xxhash

    found = (text or "").encode().lower().split()  # both of ASCII only
    if not found:
        return 0
    hashed = xxhash.xxh64_intdigest
    runs = zip(*(found[i:] for i in range(words))) if len(found) >= words else [found]
    return majority(np.fromiter((hashed(b" ".join(x), SEED) for x in runs), dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """As a signed integer the bits that over half of the 64-bit ``h`` have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):  # of a long text, a part at a time
        part = h[at : at + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` (doc_id, text, others are kept) with the column fp, a long.

    A-Z are lower-cased, words are what ASCII white space parts, shingles are
    ``words`` of them (a shorter text is one shingle; repeats count), hashed by
    XXH64. A bit is set if more than half the hashes have it. Null, empty and
    blank texts have fingerprint 0.
    """
    session(docs)
    name = fresh(docs, "fp")

    def add(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            fp = pa.array([simhash(x, words) for x in batch.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, fp], [*batch.schema.names, name])

    return spread(docs).mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def _masks(segments: int) -> list[int]:
    edges = [64 * i // segments for i in range(segments + 1)]
    return [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def ring_passes(apart, bits: int = BITS, segments: int = SEGMENTS):
    """Whether the xor ``apart`` has a segment all of whose chains stay in budget.
    Of a list of xors, segments are those of all of them together."""
    words = apart if isinstance(apart, list) else [apart]
    d = [reduce(lambda x, y: x + y, [F.bit_count(w.bitwiseAND(F.lit(_signed(m)))) for w in words]) for m in _masks(segments)]
    starts = []
    for i in range(segments):
        chain, tests = None, []
        for k in range(segments):
            box = d[(i + k) % segments]
            chain = box if chain is None else chain + box
            tests.append(chain <= (k + 1) * bits // segments)
        starts.append(reduce(lambda x, y: x & y, tests))
    return reduce(lambda x, y: x | y, starts)


def links(fps: DataFrame, bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """(a, b) for every two different values of ``fps.fp`` at most ``bits`` apart.

    Every pair that differs meets under some key of segments - bits equal
    segments; keys of one table only meet keys of the same. No candidate leaves
    the join. More segments make keys longer and buckets smaller, for more rows
    (6 segments: 20 rows of 32 bits a fingerprint), for tables of billions.
    """
    masks = _masks(segments)
    keys = [sum(masks[i] for i in c) for c in combinations(range(segments), segments - bits)]
    rows = fps.select("fp").distinct().select(
        "fp", F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(keys)])).alias("x")
    ).select("fp", "x.t", "x.key")
    left, right = rows.alias("l"), rows.alias("r")
    apart = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    near = (F.col("l.fp") < F.col("r.fp")) & F.when(ring_passes(apart, bits, segments), F.bit_count(apart) <= bits).otherwise(False)
    pairs = left.join(right, (F.col("l.t") == F.col("r.t")) & (F.col("l.key") == F.col("r.key")) & near)
    return pairs.select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """Per document doc_id, fingerprint (16 hex digits) and component_id, the
    smallest doc_id reachable over links. Rows with a null or repeated doc_id
    take part and stay; a component of null ids has a null id. Empty stays empty.
    """
    rows = materialise(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words).drop("text"), "fingerprints")
    found = components(links(rows, bits, segments))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = classes.join(found, classes["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = materialise(rooted.join(named, "root").select("fp", "component_id"), "groups", rows.count())
    out = rows.join(groups, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (null
    ids last), of the smallest row hash where that is repeated. All columns stay."""
    from maskloom.llm.util import row_hash

    key = fresh(docs, "row_key")
    keyed = docs.withColumn(key, row_hash(docs))
    narrow = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(key).alias("key"))
    rows = materialise(fingerprints(narrow, words).drop("text"), "fingerprints")
    found = components(links(rows, bits, segments))
    return keep_least(keyed, key, rows, found, "fp").select(*docs.columns)


def keep_least(keyed: DataFrame, key: str, rows: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """The rows of ``keyed`` (row hashes in ``key``) that stay: one a component
    ``found`` of the classes ``by`` in ``rows`` (doc_id, key, ``by``)."""
    times = fresh(keyed, "row_times")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    classes = rows.groupBy(by).agg(F.min(order).alias("least"))
    rooted = classes.join(found, classes[by] == found["node"], "left")
    kept = rooted.groupBy(F.coalesce("root", by).alias("root")).agg(F.min("least").alias("least"))
    kept = kept.select(F.col("least.key").alias("key"))
    again = rows.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    kept = materialise(kept.join(again, "key").select(F.col("key").alias(key), F.col("times").alias(times)), "kept", rows.count())
    # a merge join at every size: the rows kept grow with the table
    whole = keyed.join(kept.hint("merge"), key)
    once = whole.where(F.col(times) == 1)
    repeated = whole.where(F.col(times) > 1).dropDuplicates([key])
    return once.unionByName(repeated)
