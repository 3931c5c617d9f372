import pytest
from pyspark.sql import functions as F

from maskloom.functions import detect
from maskloom.functions.bytesview import view
from maskloom.schema import ORDER

VECTORS = [
    ("contact jane.doe+test@example.co.uk today", ["jane.doe+test@example.co.uk"], "email"),
    ("user@localhost", [], "email"),
    ("éb@example.org and êb@example.org", ["b@example.org", "b@example.org"], "email"),
    ("@@ a@b@c.de", ["b@c.de"], "email"),
    ("code 999.999.999.999", [], "ip"),
    ("remote=::ffff:192.168.1.1 connected", ["::ffff:192.168.1.1"], "ip"),
    ("v4 10.0.0.1 and v6 fe80::1", ["10.0.0.1", "fe80::"], "ip"),
    ("chapter 1.2.3.4.5", ["1.2.3.4"], "ip"),
    ("std::fs", ["d::"], "ip"),
    ("iban GB29NWBK60161331926819 sort code 12-34-56", ["GB29NWBK60161331926819", "12-34-56"], "iban-sortcode"),
    ("pay GB29 NWBK 6016 1331 9268 19 now", ["GB29 NWBK 6016 1331 9268 19"], "iban-sortcode"),
    ("pin 123456", [], "iban-sortcode"),
    ("call +1-415-555-2671 now", ["+1-415-555-2671"], "phone"),
    ("reach me at 555-1234", ["555-1234"], "phone"),
    ("+14155552671", ["+14155552671"], "phone"),
    ("dial 911", [], "phone"),
    ("order id 415555267188", [], "phone"),
    ("logged 2026.07.16", [], "phone"),
    ("logged 2026-13-16", ["2026-13-16"], "phone"),
    ("call 9999-99-99 now", ["9999-99-99"], "phone"),
    ("ISBN 978-3-16-148410-0 and zip 12345-6789 end", [], "phone"),
    ("call 978-3-16-148410-9 now", ["3-16-148410"], "phone"),
    ("ISBN 0-306-40615-2 recorded", [], "phone"),
    ("call 415-234-0002 now", ["415-234-0002"], "phone"),
    ("please gzip 12345-6789 x", ["12345-6789"], "phone"),
    ("zip12345-6789 recorded", ["12345-6789"], "phone"),
    ("zip_code 12345-6789", ["12345-6789"], "phone"),
    ("postal 12345-6789", [], "phone"),
    ("zip" + " " * 13 + "12345-6789", [], "phone"),
    ("zip" + " " * 14 + "12345-6789", ["12345-6789"], "phone"),
    ("export API_KEY=zQ3v9Lm2Xp7RwT6uYbN8dKfJhC1sEoAi", ["API_KEY=zQ3v9Lm2Xp7RwT6uYbN8dKfJhC1sEoAi"], "entropy"),
    ("LICENSE_KEY=ACME-2026-DEMO-KEY", [], "entropy"),
    ("AWS_SECRET_ACCESS_KEY=demo-placeholder-value", [], "entropy"),
    ("TOKEN=zQvLmXpRwTuYbNdKfJhCsEoAiPlMnQr", ["TOKEN=zQvLmXpRwTuYbNdKfJhCsEoAiPlMnQr"], "entropy"),
    ("commit 17b27d5c9a0e8f1d2c3b4a59687f0e1d2c3b4a5f merged", [], "entropy"),
    ("hash  17b27d5c9a0e8f1d2c3b4a59687f0e1d2c3b4a5f", ["17b27d5c9a0e8f1d2c3b4a59687f0e1d2c3b4a5f"], "entropy"),
    ("aaaaaaaaaaaaaaaaaaaaaaaaaaaa", [], "entropy"),
    ("", [], "email"),
]


def test_vectors(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(VECTORS)], "i int, t string").withColumn("b", view(F.col("t")))
    for name, f in detect.DETECTORS.items():
        got = {r["i"]: [x["value"] for x in r["f"]] for r in df.select("i", f(F.col("b")).alias("f")).collect()}
        for i, (text, want, which) in enumerate(VECTORS):
            if which == name:
                assert got[i] == want, text


@pytest.mark.parametrize("text, want", [("ê@ éb@example.org", (6, 19)), ("ab@cd.ef", (0, 8))])
def test_byte_offsets(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(detect.email(view(F.col("t"))).alias("f")).first()
    assert [(f["start"], f["end"]) for f in row["f"]] == [want]


def test_long_runs_end(spark):
    texts = ["1-" * 5000 + "2345678", "a." * 40000, "x" * 100_000, '"' * 8192, "a@" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.select(F.size(detect.scan(view(F.col("t")))).alias("n")).count() == len(texts)


def test_nulls_and_binary(spark):
    df = spark.createDataFrame([(None,), (bytearray(b"\xff a@b.org \xfe"),)], "t binary")
    rows = [r["f"] for r in df.select(detect.email(view(F.col("t"), True)).alias("f")).collect()]
    assert rows[0] is None or rows[0] == []
    assert [(f["start"], f["end"]) for f in rows[1]] == [(2, 9)]


@pytest.mark.parametrize("text, bits", [("abcdefghijklmnopqrstuvwxyz012345", 5.0), ("aaaa", 0.0)])
def test_entropy(spark, text, bits):
    assert abs(spark.range(1).select(detect.entropy_bits(F.lit(text)).alias("e")).first()["e"] - bits) < 1e-9


def test_detectors_of_ones_own(spark):
    from maskloom.functions import extend
    from maskloom.operators import mask
    from maskloom.plans.policy import Policy

    def codenames(data):
        at = data.find(b"bluebird")
        while at >= 0:
            yield "Custom:codename", at, at + 8, 0.5
            at = data.find(b"bluebird", at + 8)

    mine = {"codename": extend.of_python("codename", codenames), "ticket": extend.of_pattern("Custom:ticket", "ticket", r"\bTK-[0-9]+\b", 0.9), "email": detect.email}
    texts = ["é bluebird and TK-12, a@x.org bluebird", "", None, "none", b"\xff bluebird"]
    for name, declared in (("codename", "Custom:codename"), ("ticket", "Custom:ticket"), ("email", "Email")):
        extend.conforms(spark, mine[name], texts, [declared])
    for f in detect.DETECTORS.values():
        extend.conforms(spark, f, [*texts, "10.0.0.1 +44 20 7946 0958 GB29NWBK60161331926819 12-34-56 zQ3v9Lm2Xp7RwT6uYbN8dKfJhC1sEoAi"], list(ORDER))
    df = spark.createDataFrame([(i, t if isinstance(t, str) else None) for i, t in enumerate(texts)], "artefact_id long, content string")
    rows = mask.analyse(df, Policy.of({"entities": {"default": "mask"}}), mine)
    got = {r["artefact_id"]: [(f["entity_type"], f["start"], f["end"], f["value"]) for f in r["findings"]] for r in rows.collect()}
    assert got[0] == [("Custom:codename", 3, 11, "bluebird"), ("Custom:ticket", 16, 21, "TK-12"), ("Email", 23, 30, "a@x.org"), ("Custom:codename", 31, 39, "bluebird")]
    assert not any(got[i] for i in (1, 2, 3))
    for what, bad in {"type": [("Phone", 0, 1, 0.5)], "confidence": [("Email", 0, 1, 1.5)], "outside the text": [("Email", 0, 99, 0.5)]}.items():
        with pytest.raises(AssertionError, match=what):
            extend.conforms(spark, extend.of_python("bad", lambda data, bad=bad: bad), ["abc"], ["Email"])
    with pytest.raises(ValueError, match="type"):
        extend.conforms(spark, detect.email, ["abc"], ["Mail"])
