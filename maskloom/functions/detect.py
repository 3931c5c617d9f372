"""Detectors: Column of bytes (see ``bytesview.view``) -> array of findings.

A detector is a function of the viewed text that returns FINDING arrays; users'
own may be any such function. All run inside one projection, without a shuffle.
``value`` holds the matched bytes for later steps and is not for output.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskloom.functions.bytesview import ascii_boundaries, bind, cut, find_spans
from maskloom.schema import FINDING, ORDER

# Patterns, confidences, lengths and words that detection is defined by.
ATEXT = r"A-Za-z0-9.!#$%&'*+/=?^_`{|}~-"
EMAIL_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
EMAIL = rf"\b[{ATEXT}]++@{EMAIL_LABEL}(?:\.{EMAIL_LABEL})+\b"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4_BARE = OCTET + r"(?:\." + OCTET + r"){3}"
IPV4 = rf"\b{IPV4_BARE}\b"
H = "[A-Fa-f0-9]{1,4}"
IPV6 = "|".join(
    (
        rf"::[Ff]{{4}}:{IPV4_BARE}",
        rf"(?:{H}:){{7}}{H}",
        rf"(?:{H}:){{1,7}}:",
        rf"(?:{H}:){{1,6}}:{H}",
        rf"(?:{H}:){{1,5}}(?::{H}){{1,2}}",
        rf"(?:{H}:){{1,4}}(?::{H}){{1,3}}",
        rf"(?:{H}:){{1,3}}(?::{H}){{1,4}}",
        rf"(?:{H}:){{1,2}}(?::{H}){{1,5}}",
        rf"{H}:(?:(?::{H}){{1,6}})",
        rf":(?:(?::{H}){{1,7}}|:)",
    )
)
IBAN = r"(?i)\b[A-Z]{2}[0-9]{2}(?:[ ][A-Z0-9]{4}){2,7}(?:[ ][A-Z0-9]{1,3})?\b|\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b"
SORT_CODE = r"\b[0-9]{2}[- ][0-9]{2}[- ][0-9]{2}\b"
PHONE = r"\+?\(?[0-9]{1,4}\)?(?:[-. ]?[0-9]{2,4}){1,5}"
PHONE_DIGITS = 7, 15
ISO_DATE = r"^(?:19|20)[0-9]{2}[-.](?:0[1-9]|1[0-2])[-.](?:0[1-9]|[12][0-9]|3[01])$"
ISBN_REACH, MARKER_REACH = 24, 16
TOKEN_CHARACTERS = r"[A-Za-z0-9+/=_.!@#$%^&*-]"
TOKEN_LENGTH, ENTROPY_THRESHOLD = 20, 3.5
SHA_WORDS = ("commit", "sha1", "sha256", "sha", "rev")
CONFIDENCE = {"email": 0.9, "phone": 0.7, "ip": 0.85, "iban-sortcode": 0.75}
#: How far back a word before a commit id is looked for.
SHA_REACH = 256
#: What a text must hold for most detectors: two digits, with at most a mark between
#: them. Few texts do, and for the others one pass stands for five.
DIGITS = r"[0-9](?:[0-9]|[-. ()][0-9])"


def _finding(entity: str, detector: str, span: Column, confidence: Column | None = None) -> Column:
    sure = F.lit(CONFIDENCE[detector]) if confidence is None else confidence
    return F.struct(
        F.lit(entity).alias("entity_type"),
        F.lit(ORDER[entity]).alias("type_ord"),
        span["start"].alias("start"),
        span["end"].alias("end"),
        sure.cast("float").alias("confidence"),
        F.lit(detector).alias("detector"),
        span["text"].alias("value"),
    )


def _findings(entity: str, detector: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: _finding(entity, detector, s))


def email(b: Column) -> Column:
    """Runs of address characters that hold an ``@`` are cut out first, in linear
    time; an address lies in one of them."""
    run = rf"(?<![@{ATEXT}])[{ATEXT}]*+@[@{ATEXT}]*+"
    runs = find_spans(b, run, F.contains(b, F.lit("@")))
    inside = F.transform(runs, lambda r: find_spans(r["text"], ascii_boundaries(EMAIL), shift=r["start"]))
    return _findings("Email", "email", F.flatten(inside))


def ip(b: Column) -> Column:
    """IPv4 within an IPv6 finding is that finding's."""
    v4 = find_spans(b, ascii_boundaries(IPV4), F.rlike(b, F.lit(r"[0-9]\.[0-9]")))
    v6 = find_spans(b, IPV6, F.rlike(b, F.lit(":(?::|(?<=[A-Fa-f0-9]:)[A-Fa-f0-9])")))
    both = F.struct(v4.alias("v4"), v6.alias("v6"))
    kept = lambda x: F.concat(F.filter(x["v4"], lambda a: ~F.exists(x["v6"], lambda c: (c["start"] <= a["start"]) & (a["end"] <= c["end"]))), x["v6"])
    return _findings("InternalIp", "ip", bind(both, kept))


def iban_sortcode(b: Column) -> Column:
    iban = find_spans(b, ascii_boundaries(IBAN), F.rlike(b, F.lit("[0-9](?<=[A-Za-z]{2}[0-9])[0-9][A-Za-z0-9 ]")))
    code = find_spans(b, ascii_boundaries(SORT_CODE), F.rlike(b, F.lit("[0-9]{2}[- ][0-9]{2}[- ][0-9]{2}")))
    return F.concat(_findings("Iban", "iban-sortcode", iban), _findings("SortCode", "iban-sortcode", code))


def marker_before(b: Column, at: Column, word: str, reach: int = MARKER_REACH) -> Column:
    """A whole word, in any case, that starts in the ``reach`` bytes before ``at``."""
    free = "(?![0-9A-Za-z_])"
    near = cut(b, at - reach - 1, at + 1)
    far = F.rlike(near, F.lit(f"(?i)(?<=[^0-9A-Za-z_]){word}{free}"))
    return F.when(at > reach, far).otherwise(F.rlike(near, F.lit(f"(?i)(?<![0-9A-Za-z_]){word}{free}")))


def isbn13_valid(digits: Column) -> Column:
    one = lambda i: F.substr(digits, F.lit(i + 1), F.lit(1)).cast("int")
    total = reduce(lambda x, y: x + y, [one(i) * (1 if i % 2 == 0 else 3) for i in range(13)])
    return F.when(F.rlike(digits, F.lit("^97[89][0-9]{10}$")), total % 10 == 0).otherwise(False)


def isbn10_valid(digits: Column) -> Column:
    one = lambda i: F.substr(digits, F.lit(i + 1), F.lit(1)).cast("int")
    total = reduce(lambda x, y: x + y, [one(i) * (10 - i) for i in range(10)])
    return F.when(F.rlike(digits, F.lit("^[0-9]{10}$")), total % 11 == 0).otherwise(False)


def _isbn(b: Column, s: Column) -> Column:
    left = F.regexp_extract(cut(b, s["start"] - ISBN_REACH, s["start"]), "[0-9-]*$", 0)
    right = F.regexp_extract(cut(b, s["end"], s["end"] + ISBN_REACH), "^[0-9-]*", 0)
    digits = F.regexp_replace(F.concat(left, s["text"], right), "[^0-9]", "")
    start = s["start"] - F.length(left)
    return bind(digits, lambda d: F.when(isbn13_valid(d), True).when(isbn10_valid(d), marker_before(b, start, "isbn")).otherwise(False))


def phone(b: Column) -> Column:
    """Digit runs with a phone's marks, less dates, book numbers and postcodes."""
    spans = find_spans(b, PHONE, F.rlike(b, F.lit(DIGITS)))

    def is_phone(s: Column) -> Column:
        n = F.length(F.regexp_replace(s["text"], "[^0-9]", ""))
        plausible = n.between(*PHONE_DIGITS) & F.rlike(s["text"], F.lit("[-+(). ]")) & ~F.rlike(s["text"], F.lit(ISO_DATE))
        postcode = F.when(
            F.rlike(s["text"], F.lit("^[0-9]{5}-[0-9]{4}$")), marker_before(b, s["start"], "zip") | marker_before(b, s["start"], "postal")
        ).otherwise(False)
        return F.when(plausible, ~postcode & ~_isbn(b, s)).otherwise(False)

    return _findings("Phone", "phone", F.filter(spans, is_phone))


def entropy_bits(text: Column) -> Column:
    """Shannon entropy, in bits a byte."""
    n = F.length(text).cast("double")
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    parts = F.transform(F.array_distinct(F.split(text, "")), lambda c: bind(share(c), lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(0.0)))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def structured_segments(text: Column) -> Column:
    """Two or more segments between ``/._-``, each of letters or of up to 8 digits."""
    segments = F.filter(F.split(text, "[/._-]"), lambda x: x != "")
    return bind(segments, lambda s: (F.size(s) >= 2) & F.forall(s, lambda x: F.rlike(x, F.lit("^(?:[A-Za-z]+|[0-9]{1,8})$"))))


def structured_identifier(text: Column) -> Column:
    at = F.instr(text, "=")
    key, value = F.substr(text, F.lit(1), at - 1), F.substr(text, at + 1)
    pair = F.when((at > 1) & (F.length(value) > 0), structured_segments(key) & structured_segments(value)).otherwise(False)
    return F.when(structured_segments(text), True).otherwise(pair)


def commit_id(b: Column, start: Column, token: Column) -> Column:
    before = F.regexp_extract(cut(b, start - SHA_REACH, start), r"([0-9A-Za-z]*)[ \t:]*$", 1)
    return F.when(F.rlike(token, F.lit("^[0-9a-f]{7,64}$")), F.lower(before).isin(*SHA_WORDS)).otherwise(False)


def entropy(b: Column, least: int = TOKEN_LENGTH, threshold: float = ENTROPY_THRESHOLD) -> Column:
    """Long tokens of high entropy that are neither structured names nor commit ids."""
    # a run is looked at from its first character only
    pattern = f"(?<!{TOKEN_CHARACTERS}){TOKEN_CHARACTERS}{{{least},}}+"
    # it lies in a run of as many characters but white space, after such or the beginning
    long_run = F.rlike(b, F.lit(rf"\s\S{{{least}}}")) | F.rlike(F.left(b, F.lit(least)), F.lit(rf"^\S{{{least}}}"))
    tokens = find_spans(b, pattern, long_run)

    def scored(s: Column) -> Column:
        plain = F.when(structured_identifier(s["text"]), True).otherwise(commit_id(b, s["start"], s["text"]))
        return F.struct(s.alias("s"), F.when(plain, -1.0).otherwise(entropy_bits(s["text"])).alias("bits"))

    found = F.filter(F.transform(tokens, scored), lambda x: x["bits"] >= threshold - 1e-9)
    sure = lambda e: F.least(F.lit(0.95), F.greatest(F.lit(0.5), 0.5 + (e - threshold) / 2.0 * 0.45))
    return F.transform(found, lambda x: _finding("Secret", "entropy", x["s"], sure(x["bits"])))


#: In the order they run.
DETECTORS = {"email": email, "phone": phone, "ip": ip, "iban-sortcode": iban_sortcode, "entropy": entropy}
#: Those that find nothing in a text without DIGITS.
NUMERIC = (phone, iban_sortcode)
#: Of the detectors that made a result.
PROVENANCE = "+".join(sorted(DETECTORS))


def scan(b: Column, detectors=None) -> Column:
    """All detectors' findings, one after the other, unusable spans left out; those
    of Python functions (see ``extend.of_python``) after the others'."""
    fs = list((DETECTORS if detectors is None else detectors).values())
    python, plain = [f for f in fs if hasattr(f, "python")], [f for f in fs if not hasattr(f, "python")]
    none = F.array().cast(f"array<{FINDING}>")
    seen = lambda x, f: F.when(x["digits"], f(x["b"])).otherwise(none) if f in NUMERIC else f(x["b"])
    read = lambda v: F.struct(v.alias("b"), F.rlike(v, F.lit(DIGITS)).alias("digits"))
    found = bind(b, lambda v: bind(read(v), lambda x: F.concat(*[seen(x, f) for f in plain]))) if plain else none
    if python:  # which no lambda may hold
        found = F.concat(found, *[f(b) for f in python])
    return F.filter(found, lambda f: (f["start"] < f["end"]) & (f["end"] <= F.length(b)))
