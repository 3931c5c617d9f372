"""Mixing sources to target weights by pivotal dependent rounding.

A source's target sets how often each of its documents is to be taken: a whole
number of times, and once more with a fractional probability. Fractions are
paired; a random transfer between two, which keeps both expected values and the
words they take together, makes one of them integral.

At the leaves of the reduction tree a block holds documents of one source and one
fraction. Its largest document is paired with all the others, which share their
fraction and so move as one; then the next largest with what is left of them. So
large documents are settled while smaller ones can make up for their words, and
the block's open fraction is as a rule its smallest document's. Open fractions go
to the next levels of the tree and are paired one with another. A source ends with
a single fraction, settled by its own probability: every document is taken at its
rate on average, and a source's words are off its target by less than one document's.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm.util import fresh, materialise, row_hash, session, spread

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BLOCK = 64
SEED = 20_11
#: Repeats of one row are made in runs of so many.
RUN = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text; none if it is null. Runs of other characters become one
    letter each and white space goes, so that only lengths are counted."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _turns(by: DataFrame) -> DataFrame:
    """``by`` (source, one row each, and others) with the column turn: 0, 1, .. by
    code point, null last. A distributed sort numbers rows within its ranges; how
    many rows the ranges before hold, a number a range, comes to the driver."""
    sorted_ = by.orderBy(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id())
    sorted_ = materialise(sorted_, "turns")
    part = F.shiftright("place", 33).cast("int")
    before, bases = 0, []
    for r in sorted(sorted_.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
        bases.append((r["part"], before))
        before += r["n"]
    base = by.sparkSession.createDataFrame(bases, "part int, base long")
    turned = sorted_.withColumn("part", part).join(F.broadcast(base), "part")  # a row a range
    within = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return turned.withColumn("turn", F.col("base") + within).drop("part", "base", "place")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes``: source, size. Per source (null is one): source_size, target.

    Sources take ``weights`` in turn by code point, null last, and share the sum
    of all sizes by weight. A target stops at ``most`` times its source's size;
    the excess is shared again by weight until none is above. A round is one
    aggregate over the table of sources, which may be long.
    """
    by = _turns(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    by = by.select("source", "source_size", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("stop"))
    by = materialise(by, "weights", by.count())
    total, level, held = by.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        over = F.col("stop") < F.lit(level) * F.col("weight")
        n, stops, open_ = by.agg(F.count(F.when(over, 1)), F.sum(F.when(over, F.col("stop"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == held or not open_:  # held ones stay held: the level only rises
            break
        level, held = max(0.0, total - (stops or 0.0)) / open_, n
    # of a table that is written: a source's target is a projection of its row
    return by.select("source", "source_size", F.least("stop", F.lit(level) * F.col("weight")).alias("target"))


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, inside a lambda too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chance(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *keys), 11).cast("double") / float(1 << 53)


def _snap(x: Column) -> Column:
    return F.when(x < 1e-9, 0.0).when(x > 1 - 1e-9, 1.0).otherwise(x)


def _transfer(state: Column, b: Column) -> Column:
    """Pair the block's open fraction with document ``b``'s."""

    def step(s: Column) -> Column:
        a = s["open"]
        up = F.least(1 - a["x"], b["x"] * b["size"] / a["size"])  # a gains, b loses
        down = F.least(a["x"], (1 - b["x"]) * b["size"] / a["size"])

        def moved(m: Column) -> Column:
            by = F.when(_chance(a["id"], b["id"]) * (m["up"] + m["down"]) < m["down"], m["up"]).otherwise(-m["down"])

            def settled(t: Column) -> Column:
                ax, bx = _snap(a["x"] + t), _snap(b["x"] - t * a["size"] / b["size"])
                new_a, new_b = a.withField("x", ax), b.withField("x", bx)
                whole = ax.isin(0.0, 1.0)
                return F.struct(
                    F.when(whole, new_b).otherwise(new_a).alias("open"),
                    F.concat(s["done"], F.array(F.when(whole, new_a).otherwise(new_b))).alias("done"),
                )

            return _bind(by, settled)

        return F.when(a.isNull(), F.struct(b.alias("open"), s["done"].alias("done"))).otherwise(
            F.when(a["x"].isin(0.0, 1.0), F.struct(b.alias("open"), F.concat(s["done"], F.array(a)).alias("done"))).otherwise(
                _bind(F.struct(up.alias("up"), down.alias("down")), moved)
            )
        )

    return _bind(state, step)


#: A document in a block; larger ones come first.
ITEM = "struct<order:bigint,id:bigint,key:bigint,copy:bigint,size:bigint,whole:bigint,x:double>"


def _settle_equal(s: Column, b: Column) -> Column:
    """Pair document ``b`` of the block with the documents after it, ``rest`` words
    in all, that share the fraction ``y`` and move together."""
    rest = s["rest"] - b["size"]
    y = s["y"]
    add = lambda x: F.concat(s["done"], F.array(b.withField("x", x)))
    state = lambda y, open_, done: F.struct(y.alias("y"), rest.alias("rest"), open_.alias("open"), done.alias("done"))
    none = F.lit(None).cast(ITEM)
    ratio = rest / b["size"]
    up, down = F.least(1 - y, y * ratio), F.least(y, (1 - y) * ratio)  # b gains, the rest lose; and back

    def moved(t: Column) -> Column:
        bx, left = _snap(y + t), _snap(y - t / ratio)
        both = F.struct(bx.alias("bx"), left.alias("left"))
        return _bind(both, lambda m: F.when(m["bx"].isin(0.0, 1.0), state(m["left"], none, add(m["bx"]))).otherwise(state(F.round(m["left"]), b.withField("x", m["bx"]), s["done"])))

    paired = _bind(F.when(_chance(F.lit(0), b["id"]) * (up + down) < down, up).otherwise(-down), moved)
    return F.when(y.isin(0.0, 1.0), state(y, s["open"], add(y))).when(rest == 0, state(y, b.withField("x", y), s["done"])).otherwise(paired)


def _leaves(items: DataFrame) -> DataFrame:
    """``items``: source, x, block, item; those of a block share x. Gives source,
    done (documents settled) and open (the one that may not be, or null)."""
    block = items.groupBy("source", "x", "block").agg(F.array_sort(F.collect_list("item")).alias("items"), F.sum("item.size").alias("rest"))
    none, empty = F.lit(None).cast(ITEM), F.array().cast(f"array<{ITEM}>")
    start = F.struct(F.col("x").alias("y"), F.col("rest").alias("rest"), none.alias("open"), empty.alias("done"))
    folded = block.select("source", F.aggregate("items", start, lambda s, b: _bind(s, lambda t: _settle_equal(t, b))).alias("f"))
    return folded.select("source", "f.open", "f.done")


def _pairs(items: DataFrame) -> DataFrame:
    """A level of the tree above. ``items``: source, last, block, item. Gives
    source, last, done (the documents settled) and open (that which may not be)."""
    start = F.struct(F.lit(None).cast(ITEM).alias("open"), F.array().cast(f"array<{ITEM}>").alias("done"))
    block = items.groupBy("source", "last", "block").agg(F.array_sort(F.collect_list("item")).alias("items"))
    folded = block.select("source", "last", F.aggregate("items", start, _transfer).alias("f"))
    return folded.select("source", "last", "f.open", "f.done")


def _dealt(items: DataFrame, by: list[str], block: int, level: int) -> DataFrame:
    """``items`` with blocks of about ``block`` rows within ``by``, dealt by the
    hash of their document: last (whether there is one block only) and block."""
    blocks = F.ceil(F.count(F.lit(1)) / block)
    many = items.groupBy(*[F.col(c).alias(f"of_{c}") for c in by]).agg(blocks.alias("blocks"))
    on = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by]
    dealt = items.join(many, on).drop(*[f"of_{c}" for c in by])
    at = F.pmod(F.xxhash64(F.lit(SEED + level), "item.id"), F.col("blocks"))
    return dealt.withColumn("block", at).withColumn("last", F.col("blocks") == 1).drop("blocks")


def dependent_rounding(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """``units``: source, key, copy, size (over 0), rate (times to take it, any
    number of at least 0); source, key, copy and size together tell a unit. Gives
    source, key, copy, size and taken (whole times). A unit's expected taken is its
    rate; the sum of size * taken of a source is less than one of its units off
    that of size * rate."""
    id_ = F.xxhash64(F.lit(SEED), "source", "key", "copy", "size")
    whole = F.floor("rate")
    item = F.struct((-F.col("size")).alias("order"), id_.alias("id"), "key", "copy", "size", whole.cast("long").alias("whole"), _snap(F.col("rate") - whole).alias("x")).cast(ITEM)
    rows = units.select("source", item.alias("item")).withColumn("x", F.col("item.x"))
    done = materialise(_leaves(_dealt(rows, ["source", "x"], block, 0)), "leaves")
    n = done.count()  # blocks, of an open document each at most
    settled = [done.select("source", F.explode("done").alias("item"))]
    level = 1
    while True:
        open_ = done.where("open is not null").select("source", F.col("open").alias("item"))
        dealt = materialise(_dealt(open_, ["source"], block, level), "open", n)
        n = dealt.count()
        if not n:
            break
        done = materialise(_pairs(dealt), "paired", n)
        settled.append(done.select("source", F.explode("done").alias("item")))
        ends = done.where("last").select("source", F.col("open").alias("item"))
        by_chance = F.when(_chance(F.lit(-1), F.col("item.id")) < F.col("item.x"), 1.0).otherwise(0.0)
        settled.append(ends.withColumn("item", F.col("item").withField("x", by_chance)))
        done, level = done.where("not last"), level + 1
    out = settled[-1]
    for part in settled[:-1]:
        out = out.unionByName(part)
    return out.select("source", "item.key", "item.copy", "item.size", (F.col("item.whole") + F.col("item.x").cast("long")).alias("taken"))


def _repeat(df: DataFrame, times: str, name: str) -> DataFrame:
    """Each row ``times`` times, with its number from 0 as ``name``, in runs."""
    run, at = fresh(df, name + "_run"), fresh(df, name + "_at")
    df = df.where(F.col(times) > 0)
    df = df.withColumn(run, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / RUN))))
    last = F.least(F.lit(RUN), F.col(times) - F.col(run) * RUN) - 1
    df = df.withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    return df.withColumn(name, F.col(run) * RUN + F.col(at)).drop(run, at)


def mix(sized: DataFrame, weights=WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """``sized``: key (equal for rows that are repeats of one), source, size.
    Per row: key, size, source, source_size, target, taken (words, a multiple of
    its size, ``most`` times at most). Rows of size 0 take none. Reruns agree,
    however rows are dealt out."""
    kinds = materialise(sized.groupBy("source", "key", "size").agg(F.count(F.lit(1)).alias("rows")), "kinds")
    targets = source_targets(kinds.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, most)
    same = F.col("k.source").eqNullSafe(F.col("t.source"))
    with_target = kinds.alias("k").join(targets.alias("t"), same).select("k.*", "source_size", "target")
    units = _repeat(with_target, "rows", "copy")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    some = units.where("size > 0").select("source", "key", "copy", "size", rate.alias("rate"))
    rounded = dependent_rounding(some, block).select("source", "key", "size", (F.col("size") * F.col("taken")).alias("taken"))
    none = units.where("size = 0").select("source", "key", "size", F.lit(0).cast("long").alias("taken"))
    taken = rounded.unionByName(none).alias("k")
    return taken.join(targets.alias("t"), same).select("k.key", "k.size", "k.source", "source_size", "target", "k.taken")


def mix_documents(docs: DataFrame, **kind) -> DataFrame:
    """Per document doc_id, size, source_size, target, taken. Null texts have
    size 0; a null source is a source; repeated doc_ids and null ones stay rows
    of their own; an empty table stays empty; other columns have no effect."""
    session(docs)
    texts = spread(docs.select(F.col("doc_id").cast("long").alias("key"), "source", "text"))
    sized = texts.select("key", "source", n_words(F.col("text")).alias("size"))
    return mix(sized, **kind).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, **kind) -> DataFrame:
    """The mix itself: each row of ``docs``, all columns, as often as it is taken."""
    session(docs)
    key, times, nth, repeats = (fresh(docs, x) for x in ("row_key", "row_times", "row_nth", "row_repeats"))
    keyed = docs.withColumn(key, row_hash(docs))
    sized = keyed.select(F.col(key).alias("key"), "source", n_words(F.col("text")).alias("size"))
    plan = mix(sized, **kind).groupBy("key").agg(
        F.sum(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0)).cast("long").alias(times), F.count(F.lit(1)).alias(repeats)
    )
    plan = materialise(plan.where(F.col(times) > 0).withColumnRenamed("key", key), "plan", keyed.count())
    # a merge join at every size: the plan grows with the table
    whole = keyed.join(plan.hint("merge"), key)
    once = whole.where(F.col(repeats) == 1)
    repeated = whole.where(F.col(repeats) > 1).dropDuplicates([key])
    return _repeat(once.unionByName(repeated), times, nth).select(*docs.columns)
