"""Byte offsets from character functions.

A text's UTF-8 bytes are viewed as Latin-1: one character a byte, so lengths and
positions are those of bytes. Patterns then see bytes too; ``\\b`` in them must be
ASCII, while Java's would take some bytes over 127 for letters: see ``ascii``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[0-9A-Za-z_]"
BOUNDARY = f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"
SPAN = "struct<start:int,end:int,text:string>"


def ascii_boundaries(pattern: str) -> str:
    """``pattern`` with each ``\\b`` as an ASCII word boundary."""
    return pattern.replace(r"\b", BOUNDARY)


def view(content: Column, binary: bool = False) -> Column:
    """The bytes of ``content`` (a string, or binary) as Latin-1 text."""
    if binary:
        return F.decode(content, "ISO-8859-1")
    # ASCII is its own view
    return F.when(F.octet_length(content) == F.length(content), content).otherwise(F.decode(F.encode(content, "UTF-8"), "ISO-8859-1"))


def unview(text: Column) -> Column:
    """The string whose bytes ``text`` shows; bad UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(F.encode(text, "ISO-8859-1").cast("string"))


def bind(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running_sum(numbers: Column, part: int = 256) -> Column:
    """Sums of an integer array up to each place. Long arrays are summed part by
    part, as an array that grows by one is copied each time."""
    none = F.array().cast("array<int>")

    def plain(xs: Column, base: Column) -> Column:
        add = lambda done, x: F.concat(done, F.array((F.coalesce(F.try_element_at(done, F.lit(-1)), base) + x).cast("int")))
        return F.aggregate(xs, none, add)

    def by_parts(xs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(xs), F.lit(part))
        parts = F.transform(starts, lambda i: F.slice(xs, i, F.lit(part)))
        totals = plain(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: (a + x).cast("int"))), F.lit(0))
        before = F.concat(F.array(F.lit(0)), F.slice(totals, 1, F.size(totals) - 1))
        return F.flatten(F.zip_with(parts, before, plain))

    return F.when(F.size(numbers) <= part, plain(numbers, F.lit(0))).otherwise(by_parts(numbers))


#: Stands in no view: put around matches to cut a text at them.
MARK = "\u0100"


def find_spans(text: Column, pattern: str, prefilter: Column | None = None, shift: Column | None = None) -> Column:
    """array of struct(start, end, text): all matches that do not overlap, from
    left to right, in one pass over a view. ``prefilter``: a cheap test that every
    text with a match passes. ``shift`` is added to all positions."""
    from_ = F.lit(0) if shift is None else shift
    none = F.array().cast(f"array<{SPAN}>")
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)  # a gap, a match, ..., a gap

    def placed(x: Column) -> Column:
        def span(i: Column) -> Column:
            end, found = F.element_at(x["ends"], i), F.element_at(x["parts"], i)
            return F.struct((end - F.length(found) + from_).cast("int").alias("start"), (end + from_).cast("int").alias("end"), found.alias("text"))

        return F.transform(F.sequence(F.lit(2), F.size(x["parts"]) - 1, F.lit(2)), span)

    def spans(ps: Column) -> Column:
        ends = running_sum(F.transform(ps, lambda p: F.length(p)))
        return F.when(F.size(ps) > 1, bind(F.struct(ps.alias("parts"), ends.alias("ends")), placed)).otherwise(none)

    found = bind(parts, spans)
    return found if prefilter is None else F.when(prefilter, found).otherwise(none)


def lines(text: Column) -> Column:
    """array of struct(start, text): lines without their ends; none after the last."""
    parts = F.split(text, "\n", -1)
    parts = F.when(F.endswith(text, F.lit("\n")) | (F.length(text) == 0), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)

    def placed(ps: Column) -> Column:
        sizes = F.transform(ps, lambda p: F.length(p) + 1)
        line = lambda end, p: F.struct((end - F.length(p) - 1).alias("start"), F.regexp_replace(p, "\r$", "").alias("text"))
        return F.zip_with(running_sum(sizes), ps, line)

    return bind(parts, placed)


def cut(text: Column, start: Column, end: Column) -> Column:
    """The bytes from ``start`` to before ``end``, clipped to the text."""
    from_ = F.greatest(start, F.lit(0))
    return F.substr(text, from_ + 1, F.greatest(end - from_, F.lit(0)))
