import pytest
from pyspark.sql import functions as F

from maskloom.functions import parse
from maskloom.functions.bytesview import running_sum, view

VECTORS = {
    "json": ('{"msg": "he said \\"hi\\" to me", "n": -1.5e3, "o": tru, "open": "é', [("msg", "Key"), ('he said \\"hi\\" to me', "StringLiteral"), ("n", "Key"), ("-1.5e3", "Value"), ("o", "Key"), ("tru", "Value"), ("open", "Key"), ("é", "StringLiteral")]),
    "env": ('# c\nexport API_KEY="sk-live-abc123"\nPASSWORD=p#ssw0rd#123\n\nFOO\n A = b \r\nE=\nQ=\'x"\n', [("# c", "Comment"), ("API_KEY", "Key"), ("sk-live-abc123", "Value"), ("PASSWORD", "Key"), ("p#ssw0rd#123", "Value"), ("FOO", "Key"), ("A", "Key"), ("b", "Value"), ("E", "Key"), ("Q", "Key"), ("'x\"", "Value")]),
    "log": ("2026-01-02T03:04:05Z ERROR é\n \nJul  2 03:04:05 host warn x\r\n", [("2026-01-02T03:04:05Z ERROR é", "Value"), ("2026-01-02T03:04:05Z", "timestamp"), ("ERROR", "level"), ("Jul  2 03:04:05 host warn x", "Value"), ("Jul  2 03:04:05", "timestamp"), ("warn", "level")]),
    "diff": ("--- a/x\n+++ b/x \n@@ -1 +1 @@\n-old\n+new\n ctx\nindex 12\n+\nfoo\n\n", [("a/x", "path"), ("b/x", "path"), ("@@ -1 +1 @@", "hunk"), ("old", "removed"), ("new", "added"), ("ctx", "Value"), ("index 12", "Value"), ("foo", "Value")]),
    "toml": ('# c\n[a]\nurl = "http://example.com/#frag" # t\nx=\nbare\n', [("# c", "Comment"), ("[a]", "Key"), ("# t", "Comment"), ("url", "Key"), ('"http://example.com/#frag"', "Value"), ("x", "Key"), ("bare", "Value")]),
    "yaml": ("# c\nstart: 12:30:00\n- a: b\n- - c\nk:\n---\n- x #y\n{z: 1}\n-\n", [("# c", "Comment"), ("start", "Key"), ("12:30:00", "Value"), ("a", "Key"), ("b", "Value"), ("c", "Value"), ("k", "Key"), ("#y", "Comment"), ("x", "Value")]),
    "csv": ('name,email\r\njane,"j,""x"\n\nbob,b@x.org,more\n,', [("name", "Key"), ("email", "Key"), ("jane", "name"), ('j,""x', "email"), ("bob", "name"), ("b@x.org", "email"), ("more", "Value"), ("", "name"), ("", "email")]),
    "rust": ("fn main() { let s = r#\"a\"b\"#; // hi\n let c = 'x'; /* y */ }", [("main", "Identifier"), ("s", "Identifier"), ('r#"a"b"#', "StringLiteral"), ("// hi", "Comment"), ("c", "Identifier"), ("'x'", "StringLiteral"), ("/* y */", "Comment")]),
}
BATTERY = ["", "{" * 10_000, '"' * 8192, "".join(map(chr, range(256))), "\0\0", "a,b\n" * 3, "\n" * 700, '{"a": "b', "\\", '"\\']


@pytest.mark.parametrize("kind", VECTORS)
def test_vectors(spark, kind):
    text, want = VECTORS[kind]
    rows = spark.createDataFrame([(text,)], "t string").select(parse.parse(view(F.col("t")), kind).alias("s")).first()["s"]
    data = text.encode()
    assert [(data[s["start"] : s["end"]].decode(), s["node_arg"] or s["node_kind"]) for s in rows] == want


@pytest.mark.parametrize("kind", VECTORS)
def test_battery(spark, kind):
    df = spark.createDataFrame([(t,) for t in BATTERY], "t string").withColumn("b", view(F.col("t")))
    for r in df.select(F.length("b").alias("n"), parse.parse(F.col("b"), kind).alias("s")).collect():
        assert all(0 <= s["start"] <= s["end"] <= r["n"] for s in r["s"])


def test_flow_yaml(spark):
    rows = spark.createDataFrame([('{"host": "h"}',), ("{a: [b",)], "t string").select(parse.parse(view(F.col("t")), "yaml").alias("s")).collect()
    assert [[s["node_kind"] for s in r["s"]] for r in rows] == [["Key", "StringLiteral"], []]


def test_long_sums(spark):
    rows = spark.range(1).select(running_sum(F.sequence(F.lit(1), F.lit(1000))).alias("s"), running_sum(F.array().cast("array<int>")).alias("e")).first()
    assert rows["s"] == [i * (i + 1) // 2 for i in range(1, 1001)] and rows["e"] == []
