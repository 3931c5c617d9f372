"""Format parsers: viewed bytes -> array of struct(start, end, node_kind, node_arg).

Spans describe structure only; detection never depends on them. JSON, env, log
and diff are Column expressions; TOML, YAML, CSV and Rust need state and run as
one Arrow UDF.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskloom.functions.bytesview import ascii_boundaries, bind, lines

SPANS = "array<struct<start:int,end:int,node_kind:string,node_arg:string>>"
WS = r"[ \t\n\f\r]"

# What each parser claims, in the order parsers are asked.
CLAIMS = (
    ("json", ("json", "jsonl", "ndjson"), ("json", "jsonc", "jsonl"), ("json",), ()),
    ("yaml", ("yaml", "yml"), ("yaml", "yml"), ("yaml", "x-yaml"), ()),
    ("toml", ("toml",), ("toml",), ("toml",), (r"^cargo\.lock$",)),
    ("csv", ("csv", "tsv"), ("csv", "tsv"), ("csv", "tab-separated"), ()),
    ("env", ("env",), ("dotenv", "env"), (), (r"^\.env(?:\..*)?$",)),
    ("log", ("log",), ("log",), ("x-log",), ()),
    ("diff", ("diff", "patch"), ("diff", "patch"), ("x-diff", "x-patch"), ()),
    ("rust", ("rs",), ("rust", "rs"), ("rust", "x-rust"), ()),
)
TIMESTAMP = (
    r"(?:\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)"
    r"|(?:[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
)
LEVEL = r"(?i)\b(?:TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|ERR|FATAL|CRITICAL)\b"
JSON_TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\\z)?|[0-9+.eEtrufalsn-]++'
DIFF_META = r"^(?:diff --git|index |new file|deleted file|rename |similarity )"


def _span(start: Column, end: Column, kind: str | Column, arg: str | None = None) -> Column:
    name = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), name.alias("node_kind"), F.lit(arg).cast("string").alias("node_arg"))


def _none() -> Column:
    return F.array().cast(SPANS)


def _some(test: Column, span: Column) -> Column:
    return F.when(test, F.array(span)).otherwise(_none())


def _trimmed(text: Column, start: Column, kind: str, arg: str | None = None) -> Column:
    """The text's span without outer white space, if anything is left."""
    left = F.length(text) - F.length(F.regexp_replace(text, f"^{WS}+", ""))
    core = F.regexp_replace(text, f"^{WS}+|{WS}+$", "")
    return _some(core != "", _span(start + left, start + left + F.length(core), kind, arg))


def parse_json(b: Column) -> Column:
    from maskloom.functions.bytesview import find_spans

    def spans(tokens: Column) -> Column:
        nexts = F.concat(F.transform(F.slice(tokens, 2, F.size(tokens)), lambda t: t["start"]), F.array(F.length(b)))

        def one(t: Column, after: Column) -> Column:
            is_string = F.startswith(t["text"], F.lit('"'))
            closed = F.rlike(t["text"], F.lit(r'(?s)^"[^"\\]*+(?:\\.[^"\\]*+)*+"$'))
            end = F.when(closed, t["end"] - 1).otherwise(F.length(b))
            colon = F.rlike(F.substr(b, t["end"] + 1, F.greatest(after - t["end"], F.lit(0))), F.lit(r"^[ \t\r\n]*:"))
            kind = F.when(closed & colon, "Key").otherwise("StringLiteral")
            return F.when(is_string, _span(t["start"] + 1, end, kind)).otherwise(_span(t["start"], t["end"], "Value"))

        return F.zip_with(tokens, nexts, one)

    return bind(find_spans(b, JSON_TOKEN), lambda ts: F.when(F.size(ts) > 0, spans(ts)).otherwise(_none()))


def parse_log(b: Column) -> Column:
    def line(x: Column) -> Column:
        def first(pattern: str, name: str) -> Column:
            at = F.regexp_instr(x["text"], F.lit(pattern)) - 1
            size = F.length(F.regexp_substr(x["text"], F.lit(pattern)))
            return _some(at >= 0, _span(x["start"] + at, x["start"] + at + size, "Field", name))

        whole = F.array(_span(x["start"], x["start"] + F.length(x["text"]), "Value"))
        found = F.concat(whole, first(TIMESTAMP, "timestamp"), first(ascii_boundaries(LEVEL), "level"))
        return F.when(F.rlike(x["text"], F.lit(r"[^ \t\n\f\r]")), found).otherwise(_none())

    return F.flatten(F.transform(lines(b), line))


def parse_diff(b: Column) -> Column:
    def line(x: Column) -> Column:
        text, start = x["text"], x["start"]
        end = start + F.length(text)
        starts = lambda p: F.startswith(text, F.lit(p))
        content = lambda kind, arg=None: _some(F.length(text) > 1, _span(start + 1, end, kind, arg))
        return (
            F.when(text == "", _none())
            .when(starts("--- ") | starts("+++ "), _trimmed(F.substr(text, F.lit(5)), start + 4, "Field", "path"))
            .when(starts("@@"), F.array(_span(start, end, "Other", "hunk")))
            .when(F.rlike(text, F.lit(DIFF_META)), F.array(_span(start, end, "Value")))
            .when(starts("+"), content("Field", "added"))
            .when(starts("-"), content("Field", "removed"))
            .when(starts(" "), content("Value"))
            .otherwise(F.array(_span(start, end, "Value")))
        )

    return F.flatten(F.transform(lines(b), line))


def parse_env(b: Column) -> Column:
    def line(x: Column) -> Column:
        core = F.regexp_replace(x["text"], f"^{WS}+|{WS}+$", "")
        left = F.length(x["text"]) - F.length(F.regexp_replace(x["text"], f"^{WS}+", ""))
        skip = F.length(F.regexp_extract(core, f"^export {WS}*", 0))
        parts = F.struct(core.alias("core"), (x["start"] + left).cast("int").alias("at"), skip.alias("skip"))

        def spans(p: Column) -> Column:
            rest, at = F.substr(p["core"], p["skip"] + 1), p["at"] + p["skip"]
            eq = F.instr(rest, "=")
            value = F.substr(rest, eq + 1)
            bare = F.regexp_replace(value, f"^{WS}+|{WS}+$", "")
            quoted = F.rlike(bare, F.lit(r"""(?s)^(?:"[^\x{10FFFF}]*"|'[^\x{10FFFF}]*')$""")) & (F.length(bare) >= 2)
            from_ = at + eq + F.length(value) - F.length(F.regexp_replace(value, f"^{WS}+", ""))
            edge = quoted.cast("int")
            pair = F.concat(
                _trimmed(F.substr(rest, F.lit(1), eq - 1), at, "Key"), _some(bare != "", _span(from_ + edge, from_ + F.length(bare) - edge, "Value"))
            )
            return (
                F.when(p["core"] == "", _none())
                .when(F.startswith(p["core"], F.lit("#")), F.array(_span(p["at"], p["at"] + F.length(p["core"]), "Comment")))
                .when(eq > 0, pair)
                .otherwise(_trimmed(rest, at, "Key"))
            )

        return bind(parts, spans)

    return F.flatten(F.transform(lines(b), line))


# --- with state, in Python over Latin-1 text ---------------------------------


def _lines(text: str):
    at = 0
    for part in text.split("\n"):
        if at < len(text):
            yield at, part.removesuffix("\r")
        at += len(part) + 1


def _core(text: str, start: int, end: int) -> tuple[int, int]:
    piece = text[start:end]
    left = len(piece) - len(piece.lstrip(" \t\n\f\r"))
    core = piece.strip(" \t\n\f\r")
    return start + left, start + left + len(core)


def toml_spans(text: str):
    mark = re.compile(r'''"(?:\\.|[^"\\])*(?:"|\\?$)|'[^']*(?:'|$)|[#=]''')
    for at, line in _lines(text):
        eq, stop = None, len(line)
        for m in mark.finditer(line):
            if m.group() == "#":
                stop = m.start()
                yield at + stop, at + len(line), "Comment", None
                break
            if m.group() == "=" and eq is None:
                eq = m.start()
        a, b = _core(line, 0, stop)
        if a == b:
            continue
        if line[a] == "[":
            yield at + a, at + b, "Key", None
        elif eq is not None and a < eq < stop:
            for (x, y), kind in ((_core(line, a, eq), "Key"), (_core(line, eq + 1, b), "Value")):
                if x < y:
                    yield at + x, at + y, kind, None
        else:
            yield at + a, at + b, "Value", None


def yaml_spans(text: str):
    found = list(_yaml_lines(text))
    return found if found or not _flow_is_whole(text) else _json_spans(text)


def _yaml_lines(text: str):
    for at, line in _lines(text):
        comment = re.search(r"(?:^|(?<=[ \t\n\f\r]))#", line)
        stop = comment.start() if comment else len(line)
        if comment:
            yield at + stop, at + len(line), "Comment", None
        a, b = _core(line, 0, stop)
        if a == b or line[a:b] in ("---", "...") or line[a] == "%":
            continue
        items = re.match(r"(?:-[ \t\n\f\r]+)*(?:-$)?", line[a:b])
        a += items.end()
        if a >= b or line[a] in "{[":
            continue
        colon = re.search(r":(?=[ \t\n\f\r]|$)", line[a:b])
        if not colon:
            yield at + a, at + b, "Value", None
            continue
        c = a + colon.start()
        for x, y, kind in ((a, c, "Key"), (c + 1, b, "Value")):
            if x < y:
                x, y = _core(line, x, y) if line[x:y].strip(" \t\n\f\r") else (x, x)
                yield at + x, at + y, kind, None


def _flow_is_whole(text: str) -> bool:
    """Stands for a YAML parser: JSON, or brackets that pair outside of strings."""
    try:
        json.loads(text)
        return True
    except ValueError:
        bare = re.sub(r'"(?:\\.|[^"\\])*"|\'[^\']*\'', "", text)
        open_ = []
        for c in re.findall(r"[\[\]{}]", bare):
            if c in "[{":
                open_.append(c)
            elif not open_ or open_.pop() + c not in ("[]", "{}"):
                return False
        return not open_ and '"' not in bare and "'" not in bare


def _json_spans(text: str):
    for m in re.finditer(r'(?s)"((?:[^"\\]|\\.)*)(?:"|\\?\Z)|[0-9+.eEtrufalsn-]+', text):
        if m.group(1) is None:
            yield m.start(), m.end(), "Value", None
        else:
            closed = m.end() > m.end(1) and text[m.end() - 1] == '"'
            key = closed and re.match(r"[ \t\r\n]*:", text[m.end() :])
            yield m.start(1), m.end(1) if closed else len(text), "Key" if key else "StringLiteral", None


def csv_spans(text: str):
    cell = re.compile(r'(?:"(?:[^"]|"")*(?:"|\Z))?[^,\n]*')
    at = row = col = 0
    names: list[str] = []
    while at < len(text) or col:
        end = cell.match(text, at).end()
        stop = text[end : end + 1]
        last = end - 1 if stop == "\n" and end > at and text[end - 1] == "\r" else end
        if stop != "\n" or col or last > at:
            a, b = (at + 1, last - 1) if last - at >= 2 and text[at] == text[last - 1] == '"' else (at, last)
            if row == 0:
                names.append(text[a:b].encode("latin-1").decode("utf-8", "replace"))
                yield a, b, "Key", None
            elif col < len(names) and names[col]:
                yield a, b, "Field", names[col]
            else:
                yield a, b, "Value", None
        if not stop:
            return
        at = end + 1
        row, col = (row + 1, 0) if stop == "\n" else (row, col + 1)


RUST_WORDS = frozenset(
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self static "
    "struct super trait true type union unsafe use where while bool char str u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64".split()
)


def rust_spans(text: str):
    token = re.compile(
        r"(?s)(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>b?r(?P<h>#*)\".*?(?:\"(?P=h)|\Z)|b?\"(?:\\.|[^\"\\])*(?:\"|\Z)|b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\])')|(?P<i>[A-Za-z_][A-Za-z0-9_]*)"
    )
    for m in token.finditer(text):
        if m["c"] is not None:
            yield m.start(), m.end(), "Comment", None
        elif m["s"] is not None:
            yield m.start(), m.end(), "StringLiteral", None
        elif m["i"] not in RUST_WORDS and m["i"] != "_" and text[max(0, m.start() - 1) : m.start()] != "'":
            yield m.start(), m.end(), "Identifier", None


STATEFUL = {"toml": toml_spans, "yaml": yaml_spans, "csv": csv_spans, "rust": rust_spans}


def stateful(kind: str):
    """An Arrow UDF over viewed bytes."""
    f = STATEFUL[kind]

    @F.pandas_udf(SPANS)
    def spans(text):
        rows = [[{"start": a, "end": b, "node_kind": k, "node_arg": v} for a, b, k, v in f(x or "")] for x in text]
        import pandas as pd

        return pd.Series(rows)

    return spans


NATIVE = {"json": parse_json, "env": parse_env, "log": parse_log, "diff": parse_diff}


def parser_of(path: Column, language: Column, mime: Column) -> Column:
    """The first parser that claims an artefact by its hints; null if none does."""
    from maskloom.plans.policy import extensions

    last, _ = extensions(path)
    name = F.lower(F.regexp_extract(path, r"([^/]*)/*$", 1))
    out = F.lit(None).cast("string")
    for kind, exts, langs, mimes, names in reversed(CLAIMS):
        test = last.isin(*exts) | F.lower(language).isin(*langs)
        for m in mimes:
            test = F.coalesce(test, F.lit(False)) | F.contains(F.lower(mime), F.lit(m))
        for n in names:
            test = F.coalesce(test, F.lit(False)) | F.rlike(name, F.lit(n))
        out = F.when(F.coalesce(test, F.lit(False)), kind).otherwise(out)
    return out


def parse(b: Column, kind: str) -> Column:
    return NATIVE[kind](b) if kind in NATIVE else stateful(kind)(b)
