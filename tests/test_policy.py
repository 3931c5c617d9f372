import json

import pytest
from pyspark.sql import functions as F

from maskloom.functions import keying, routes
from maskloom.plans.policy import DEFAULT, Policy, PolicyError

REPO = {"entities": {"overrides": {"hostname": "irreversible-redact", "customer-id": "mask"}}, "destinations": {"local-explanation-buffer": {"demask_allowed": True, "demask_roles": ["reviewer", "admin"]}}}
SESSION = {"version": "session-1", "entities": {"overrides": {"email": "irreversible-redact", "person": "block"}}}


def test_layers():
    p = Policy.of(DEFAULT, REPO, SESSION)
    assert [p.classify(t) for t in ("Email", "Person", "Hostname", "CustomerId", "Phone")] == ["irreversible-redact", "block", "irreversible-redact", "mask", "mask"]
    assert p.version == "session-1"
    assert p.demask_allowed("local-explanation-buffer", ["admin"]) and not p.demask_allowed("local-explanation-buffer", ["guest"])
    assert not p.destinations["local-explanation-buffer"]["masked_only"]


def test_hard_deny():
    p = Policy.of(DEFAULT, {"destinations": {d: {"masked_only": False, "demask_allowed": True} for d in ("remote-model-prompt", "observability-sink")}})
    for d in ("remote-model-prompt", "observability-sink"):
        assert p.masked_only(d) and not p.demask_allowed(d)
    assert p.masked_only("nowhere") and not p.demask_allowed("nowhere")


@pytest.mark.parametrize("layer", [{"entities": {"overrides": {"email": "encrypt"}}}, {"artefacts": {"default": "mask"}}, {"version": "a b"}, {"version": "x" * 65}])
def test_refused(layer):
    with pytest.raises(PolicyError):
        Policy.of(layer)


def test_files(tmp_path):
    good, bad = tmp_path / "a.json", tmp_path / "b.json"
    good.write_text(json.dumps(SESSION))
    bad.write_text("{ this is not json")
    assert Policy.load(str(good)).classify("Email") == "irreversible-redact"
    for path in (bad, tmp_path / "none.json"):
        with pytest.raises(PolicyError):
            Policy.load(str(path))


def test_artefacts(spark):
    rows = [("a/production.ENV", None, None, "block"), ("README.md", None, None, "pass"), (".env", None, None, "block"), (".env.local", None, None, "block"), ("x/key.pem/", None, None, "block"),
            ("environment", None, None, "pass"), (None, "dotenv", None, "block"), (None, None, "text/x", "pass"), (None, None, None, "pass")]
    p = Policy.of(DEFAULT, {"artefacts": {"by_language": {"dotenv": "block"}}})
    df = spark.createDataFrame(rows, "p string, l string, m string, want string")
    assert [r["want"] for r in df.select("want", p.artefact_class(F.col("p"), F.col("l"), F.col("m")).alias("got")).collect() if r["want"] != r["got"]] == []


def test_routes(spark):
    rows = [("POST", "/v1/messages?beta=true", "Mask"), ("POST", "/v1/messages/count_tokens", "Mask"), ("GET", "/v1/messages", "Block"), ("HEAD", "/", "Pass"), ("GET", "/v1/models?x", "Pass"),
            ("POST", "/model/m/invoke", "Mask"), ("POST", "/model/m/invoke-with-response-stream", "Mask"), ("POST", "/model//invoke", "Block"), ("POST", "/model/a/b/invoke", "Block"),
            ("POST", "/model/m/converse", "Block"), ("POST", "/v1/messages/batches", "Block"), ("post", "/v1/messages", "Block"), ("POST", "/model/a%2Fb/invoke", "Mask")]
    df = spark.createDataFrame(rows, "m string, t string, want string")
    assert [tuple(r) for r in df.select("*", routes.route_verdict(F.col("m"), F.col("t")).alias("got")).collect() if r["want"] != r["got"]] == []


def test_checksums_and_keys(spark):
    import hashlib
    import hmac

    one = spark.range(1)
    check = lambda f, x: one.select(f(F.lit(x)).alias("v")).first()["v"]
    assert check(keying.luhn_valid, "7992-7398 713") and not check(keying.luhn_valid, "79927398714") and not check(keying.luhn_valid, "5") and not check(keying.luhn_valid, "79x")
    assert check(keying.iban_valid, "gb29 NWBK 6016 1331 9268 19") and not check(keying.iban_valid, "GB29NWBK60161331926818") and not check(keying.iban_valid, "GB29")
    key = lambda v, t: one.select(keying.placeholder_key(b"salt", F.lit(v), F.lit(t), F.lit("repo"), F.lit("x/y")).alias("k")).first()["k"]
    assert key(" Jane@Example.com ", "Email") == hmac.new(b"salt", b"jane@example.com\x1fEMAIL\x1fREPO:x/y", hashlib.sha256).hexdigest()
    assert key("GB29 NWBK 6016 1331 9268 19", "Iban") == key("gb29nwbk60161331926819", "Iban")
    assert key("12-34-56", "SortCode") == key("12 34 56", "SortCode")
    assert len({key(v, "Phone") for v in ("+1 (415) 555.2671", "+14155552671", "+1-415-555-2671")}) == 1
    assert key("x", "Custom:a") != key("x", "Custom:b") and key("X", "Secret") != key("x", "Secret")
    long = one.select(keying.hmac_sha256(b"k" * 100, F.lit(b"m")).alias("k")).first()["k"]
    assert long == hmac.new(b"k" * 100, b"m", hashlib.sha256).hexdigest()


def test_layers_are_verified_before_they_are_read(tmp_path):
    first, second = tmp_path / "a.json", tmp_path / "b.json"
    first.write_text('{"version": "v1", "signature": "s"}')
    second.write_text('{"entities": {"default": "pass"}}')
    seen = []
    assert Policy.load(str(first), str(second), verify=lambda path, data: seen.append((path, data))).entity_default == "pass"
    assert seen == [(str(first), first.read_bytes()), (str(second), second.read_bytes())]

    def refuse(path, data):
        raise PolicyError(f"{path} is not signed")

    second.write_text("not even JSON")
    with pytest.raises(PolicyError, match="not signed"):
        Policy.load(str(second), verify=refuse)


def test_small_tables_are_dealt_out(spark, tmp_path):
    from maskloom import SMALL, spread

    rows = spark.range(1000).withColumn("text", F.lit("x" * 50))
    assert spread(rows).rdd.getNumPartitions() == rows.rdd.getNumPartitions()  # of no file
    rows.coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    dealt = spread(one)
    assert SMALL and dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert dealt.exceptAll(one).count() == 0 and dealt.count() == 1000
    rows.repartition(9).write.parquet(f"{tmp_path}/many")
    many = spark.read.parquet(f"{tmp_path}/many")
    assert spread(many) is many
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/one")
    assert spread(stream) is stream
