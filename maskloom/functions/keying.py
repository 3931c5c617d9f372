"""Canonical values, their keys, and checksums."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskloom.functions.bytesview import bind
from maskloom.schema import CUSTOM, CUSTOM_TAG, TAGS

#: Fixed: types whose values are the same in any case.
CASELESS = ("Email", "Hostname", "InternalIp", "Iban", "SortCode", "Postcode", "TraceId")
SEPARATOR = b"\x1f"
SPACE = r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def canonicalize(value: Column, entity_type: Column) -> Column:
    """White space collapsed, separators that only decorate dropped, lower case
    where case means nothing."""
    collapsed = F.regexp_replace(F.regexp_replace(value, f"{SPACE}+", " "), "^ | $", "")
    plain = (
        F.when(entity_type.isin("Iban", "SortCode"), F.regexp_replace(collapsed, "[ -]", ""))
        .when(entity_type == "Phone", F.regexp_replace(collapsed, "[ .()-]", ""))
        .otherwise(collapsed)
    )
    return F.when(entity_type.isin(*CASELESS), F.lower(plain)).otherwise(plain)


def display_tag(entity_type: Column) -> Column:
    """What placeholders of a type show: all custom types share a tag."""
    tags = F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])
    return F.coalesce(F.try_element_at(tags, entity_type), F.lit(CUSTOM_TAG))


def keying_tag(entity_type: Column) -> Column:
    custom = F.concat(F.lit(f"{CUSTOM_TAG}:"), F.substr(entity_type, F.lit(len(CUSTOM) + 1)))
    return F.when(F.startswith(entity_type, F.lit(CUSTOM)), custom).otherwise(display_tag(entity_type))


def namespace_tag(kind: Column, id_: Column) -> Column:
    return F.concat(F.upper(kind), F.lit(":"), id_)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hexadecimal HMAC-SHA256 of a binary column, from ``sha2``. Note that a
    plan shows its literals: keep event logs and plans as private as the key."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def placeholder_key(salt: bytes, value: Column, entity_type: Column, ns_kind: Column, ns_id: Column) -> Column:
    """The identity of a value within a namespace."""
    utf8 = lambda c: F.encode(c, "UTF-8")
    parts = [utf8(canonicalize(value, entity_type)), F.lit(SEPARATOR), utf8(keying_tag(entity_type)), F.lit(SEPARATOR), utf8(namespace_tag(ns_kind, ns_id))]
    return hmac_sha256(salt, F.concat(*parts))


def display(tag: Column, ordinal: Column) -> Column:
    return F.format_string("%s_%03d", tag, ordinal)


def redaction_marker(entity_type: Column) -> Column:
    return F.concat(F.lit("[REDACTED:"), display_tag(entity_type), F.lit("]"))


def luhn_valid(value: Column) -> Column:
    """Two digits or more, spaces and hyphens aside, whose Luhn sum is 0 by 10."""
    digits = F.regexp_replace(value, f"{SPACE}|-", "")
    return F.rlike(digits, F.lit("^[0-9]{2,}$")) & F.call_function("luhn_check", digits)


def iban_valid(value: Column) -> Column:
    """Five characters or more, letters and digits only but for spaces, whose
    rotated number leaves 1 by 97."""
    plain = F.upper(F.regexp_replace(value, f"{SPACE}", ""))

    def remainder(v: Column) -> Column:
        turned = F.concat(F.substr(v, F.lit(5)), F.substr(v, F.lit(1), F.lit(4)))
        worth = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        step = lambda r, c: bind(worth(c), lambda w: F.pmod(r * F.when(w > 9, 100).otherwise(10) + w, F.lit(97)).cast("int"))
        return F.aggregate(F.split(turned, ""), F.lit(0), step)

    return bind(plain, lambda v: F.when(F.rlike(v, F.lit("^[0-9A-Z]{5,}$")), remainder(v) == 1).otherwise(False))
