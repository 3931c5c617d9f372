"""Policies: layered rules, merged and checked on the driver, then Columns.

A policy says how each kind of entity is handled (mask, irreversible-redact,
block, pass), which whole artefacts are blocked, and where masked text may be
restored. Later layers win key by key; destinations win field by field.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskloom.schema import BLOCK, CUSTOM, ENTITY_TYPES, HARD_DENY, MASK, PASS, POLICY_KEYS, REDACT


class PolicyError(ValueError):
    """A layer that cannot be read, or a rule that means nothing."""


DEFAULT = {
    "version": "maskloom-default-v1",
    "entities": {
        "default": MASK,
        "overrides": {
            "hostname": PASS,
            **dict.fromkeys(("password", "secret", "private-key", "api-key", "access-token"), REDACT),
        },
    },
    "artefacts": {"default": PASS, "by_extension": {"env": BLOCK, "pem": BLOCK}},
    "destinations": {
        **{d: {"masked_only": True, "demask_allowed": False} for d in HARD_DENY},
        "local-patch": {"masked_only": False, "demask_allowed": True},
        "local-test-fixture": {"masked_only": False, "demask_allowed": True},
        "local-explanation-buffer": {"masked_only": False, "demask_allowed": False},
    },
}


def accept(path: str, data: bytes) -> None:
    """The check of a layer's signature before its bytes are trusted: none so far.
    Another such function raises PolicyError for what it does not accept."""


def read_layer(path: str, verify=accept) -> dict:
    try:
        with open(path, "rb") as f:
            data = f.read()
        verify(path, data)
        layer = json.loads(data.decode("utf-8"))
    except (OSError, ValueError) as why:
        raise PolicyError(f"cannot read policy layer {path}: {why}") from why
    if not isinstance(layer, dict):
        raise PolicyError(f"policy layer {path} is not an object")
    return layer


def merge(*layers: dict) -> dict:
    """One set of rules; null counts as not said, unknown keys have no effect."""
    out: dict = {"entities": {"overrides": {}}, "artefacts": {}, "destinations": {}}
    for layer in layers:
        for key in ("version", "signature"):
            if layer.get(key) is not None:
                out[key] = layer[key]
        for part, maps in (("entities", ("overrides",)), ("artefacts", ("by_extension", "by_language", "by_mime"))):
            said = layer.get(part) or {}
            if said.get("default") is not None:
                out[part]["default"] = said["default"]
            for m in maps:
                out[part][m] = {**out[part].get(m, {}), **(said.get(m) or {})}
        for name, rule in (layer.get("destinations") or {}).items():
            said = {k: v for k, v in rule.items() if v is not None}
            out["destinations"][name] = {**out["destinations"].get(name, {}), **said}
    return out


def handling(name: str) -> str:
    known = {"mask": MASK, "irreversible-redact": REDACT, "redact": REDACT, "block": BLOCK, "pass": PASS}
    if name not in known:
        raise PolicyError(f"unknown handling class {name!r}")
    return known[name]


@dataclass(frozen=True)
class Policy:
    version: str = "maskloom-unversioned"
    entity_default: str = MASK
    entities: dict = field(default_factory=dict)
    artefact_default: str = PASS
    by_extension: dict = field(default_factory=dict)
    by_language: dict = field(default_factory=dict)
    by_mime: dict = field(default_factory=dict)
    destinations: dict = field(default_factory=dict)

    @staticmethod
    def of(*layers: dict) -> "Policy":
        """Merged and checked. Artefacts can only be passed or blocked; a version
        is up to 64 of ``[A-Za-z0-9._-]``, as it is copied into outputs."""
        raw = merge(*layers)
        entities, artefacts = raw["entities"], raw["artefacts"]
        version = raw.get("version", "maskloom-unversioned")
        if not re.fullmatch(r"[A-Za-z0-9._-]{0,64}", version):
            raise PolicyError("a policy version is at most 64 of [A-Za-z0-9._-]")
        classes = {m: {k: handling(v) for k, v in artefacts.get(m, {}).items()} for m in ("by_extension", "by_language", "by_mime")}
        classes["by_extension"] = {k.lower(): v for k, v in classes["by_extension"].items()}
        default = handling(artefacts.get("default", PASS))
        if not {default, *(c for m in classes.values() for c in m.values())} <= {PASS, BLOCK}:
            raise PolicyError("a whole artefact can only be passed or blocked")
        return Policy(
            version=version,
            entity_default=handling(entities.get("default", MASK)),
            entities={k: handling(v) for k, v in entities["overrides"].items()},
            artefact_default=default,
            destinations={
                k: {"masked_only": v.get("masked_only", True), "demask_allowed": v.get("demask_allowed", False), "demask_roles": list(v.get("demask_roles", []))}
                for k, v in raw["destinations"].items()
            },
            **classes,
        )

    @staticmethod
    def load(*paths: str, verify=accept) -> "Policy":
        """Of layer files, each verified before it is read."""
        return Policy.of(*(read_layer(p, verify) for p in paths))

    @staticmethod
    def default() -> "Policy":
        return Policy.of(DEFAULT)

    def classify(self, entity_type: str) -> str:
        key = entity_type.removeprefix(CUSTOM) if entity_type.startswith(CUSTOM) else POLICY_KEYS[entity_type]
        return self.entities.get(key, self.entity_default)

    def masked_only(self, destination: str) -> bool:
        return destination in HARD_DENY or self.destinations.get(destination, {}).get("masked_only", True)

    def demask_allowed(self, destination: str, roles=()) -> bool:
        rule = self.destinations.get(destination)
        if destination in HARD_DENY or rule is None or not rule["demask_allowed"]:
            return False
        return not rule["demask_roles"] or bool(set(roles) & set(rule["demask_roles"]))

    # --- as Columns -------------------------------------------------------

    def entity_class(self, entity_type: Column) -> Column:
        """The handling of a type's name; custom types go by their own name."""
        fixed = {name: self.classify(name) for name, _, _ in ENTITY_TYPES}
        custom = {CUSTOM + k: v for k, v in self.entities.items() if k not in POLICY_KEYS.values()}
        return F.coalesce(_lookup({**fixed, **custom}, entity_type), F.lit(self.entity_default))

    def artefact_class(self, path: Column, language: Column, mime: Column) -> Column:
        """By extension, then language, then mime type, else the default."""
        last, first = extensions(path)
        tried = [_lookup(self.by_extension, last), _lookup(self.by_extension, first), _lookup(self.by_language, language), _lookup(self.by_mime, mime)]
        return F.coalesce(*tried, F.lit(self.artefact_default))

    def demask_gate(self, destination: Column, roles: Column) -> Column:
        allowed = F.lit(False)
        for name, rule in self.destinations.items():
            if name not in HARD_DENY and rule["demask_allowed"]:
                has_role = F.arrays_overlap(roles, F.array(*map(F.lit, rule["demask_roles"]))) if rule["demask_roles"] else F.lit(True)
                allowed = F.when(destination == name, F.coalesce(has_role, F.lit(False))).otherwise(allowed)
        return allowed

    def masked_only_gate(self, destination: Column) -> Column:
        open_ = [d for d in self.destinations if not self.masked_only(d)]
        return ~F.coalesce(destination.isin(open_), F.lit(False)) if open_ else F.lit(True)

    def table(self):
        """(type, key, handling) of every fixed type."""
        return [(name, key, self.classify(name)) for name, key, _ in ENTITY_TYPES]


def _lookup(known: dict, key: Column) -> Column:
    if not known:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), key)


def extensions(path: Column) -> tuple[Column, Column]:
    """A path's last extension, and what follows the dot of a dotfile's name, in
    lower case; null where there is none."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    last = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    has = F.rlike(name, F.lit(r"^.+\.[^.]*$")) & (name != "..")
    first = F.regexp_extract(name, r"^\.([^.]+)", 1)
    return F.when(has, F.lower(last)), F.when(first != "", F.lower(first))
