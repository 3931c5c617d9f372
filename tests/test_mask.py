import json

import pytest
from pyspark.sql import functions as F

from maskloom.operators import benchmark, hooks, mask
from maskloom.operators.vault import Vault, VaultError
from maskloom.plans.policy import DEFAULT, Policy
from maskloom.sources import artefacts, audit, packs

KEY = b"0123456789abcdef"
NOTE = "jane@x.org wrote to ops@x.org; jane@x.org again, GB29NWBK60161331926819, token zQ3v9Lm2Xp7RwT6uYbN8dKfJhC1sEoAi on 2026-01-02 in src/lib/main.rs"


@pytest.fixture
def vault(spark, tmp_path):
    return Vault(spark, f"file://{tmp_path}/vault", b"0123456789abcdef", b"salt")


def table(spark, *rows):
    return spark.createDataFrame([(i, t, p) for i, t, p in rows], "artefact_id long, content string, path string")


def test_mask_and_restore(spark, vault):
    rows = table(spark, (1, NOTE, "a.log"), (2, "KEY=1 jane@x.org", ".env"), (3, "OPS@x.org é EMAIL_0011 EMAIL_900", None), (4, None, None))
    made = {r["artefact_id"]: r for r in mask.mask(rows, vault, "repo", "acme", now=1).collect()}
    assert made[1]["text"] == "EMAIL_001 wrote to EMAIL_002; EMAIL_001 again, IBAN_001, token [REDACTED:SECRET] on 2026-01-02 in src/lib/main.rs"
    assert made[1]["counts"] == {"Email": 3, "Iban": 1, "Secret": 1} and len(made[1]["bindings"]) == 3
    assert (made[2]["text"], made[2]["blocked_artefacts"], made[2]["raw_counts"]) == ("", 1, {})
    assert made[3]["text"] == "EMAIL_002 é EMAIL_0011 EMAIL_900" and made[4]["text"] == ""
    assert vault.stats()["mappings"] == 3
    held = spark.createDataFrame(list(made.values()), mask.mask(rows, vault, "repo", "acme", now=1).schema)
    back = {r["artefact_id"]: r for r in mask.rehydrate(held, vault, "local-patch", now=2).collect()}
    assert back[1]["text"] == NOTE.replace("zQ3v9Lm2Xp7RwT6uYbN8dKfJhC1sEoAi", "[REDACTED:SECRET]") and back[1]["unresolved"] == []
    assert back[3]["text"] == "ops@x.org é EMAIL_0011 EMAIL_900"  # the spelling first seen
    for to in ("remote-model-prompt", "observability-sink", "local-explanation-buffer", "nowhere"):
        assert [r["text"] for r in mask.rehydrate(held, vault, to, now=2).collect()] == [None] * 4
    assert vault.events().count() == 4
    assert mask.restorations(held, spark.createDataFrame(list(back.values()), "artefact_id long, allowed boolean, text string, unresolved array<string>")).where("not restored").count() == 0


def test_displays_beside_words_are_restored(spark, vault, tmp_path):
    """A value within a longer word, or beside another, leaves a display that is no
    word of its own; what looks like one but was not made by the mask stays."""
    policy = Policy.of({"entities": {"default": "mask"}, "destinations": {"local-patch": {"demask_allowed": True}}})
    texts = {1: "call 555-9331 now", 2: "+1 (836) 555-9331 4913187196670932 53.121.55.90 que", 3: "jane@x.org EMAIL_0015 xEMAIL_001 é+1 (836) 555-9331é", 4: "a 10.0.0.1 b", 5: "id_555-9331_x and 555-9331"}
    made = mask.mask(table(spark, *((i, t, None) for i, t in texts.items())), vault, "repo", "acme", policy, now=1)
    assert [r["artefact_id"] for r in made.where(F.size("glued") > 0).orderBy("artefact_id").collect()] == [2, 5]
    packs.save(made, str(tmp_path / "packs"))
    for held in (made, packs.load(spark, str(tmp_path / "packs"))):
        back = mask.rehydrate(held, vault, "local-patch", policy=policy, now=2)
        same = {r["artefact_id"]: r["text"] for r in back.collect()}
        flat = lambda t: t.translate(str.maketrans("", "", " .()-"))
        assert {i: flat(t) for i, t in same.items()} == {i: flat(t) for i, t in texts.items()}
        assert mask.restorations(held, back).where("not restored").count() == 0
    bad = made.withColumn("glued", F.array(F.struct(F.lit("ab").alias("word"), F.array(F.lit("a")).alias("parts"))))
    packs.save(bad, str(tmp_path / "bad"))
    with pytest.raises(Exception, match="trusted"):
        packs.load(spark, str(tmp_path / "bad")).select("text").collect()
    texts = spark.createDataFrame([("x\u0100A_1\u0101\u0100B_2\u0101 \u0100A_1\u0101 A_1\u0100B_2\u0101",)], "t string").select(mask.glued_words(F.col("t")).alias("g"))
    assert [(g["word"], g["parts"]) for g in texts.first()["g"]] == [("xA_1B_2", ["x", "A_1", "", "B_2", ""]), ("A_1B_2", ["A_1", "B_2", ""])]


def test_reopen_ttl_purge(spark, vault):
    mask.mask(table(spark, (1, "a@x.org b@x.org", None)), vault, "repo", "r", now=10, ttl=5)
    again = Vault(spark, vault.path, vault.key, vault.salt)
    first = {r["display"]: r["mapping_ref"] for r in again.mapping().collect()}
    out = mask.mask(table(spark, (2, "a@x.org c@x.org", None)), again, "repo", "r", now=20, ttl=5)
    assert out.first()["text"] == "EMAIL_001 EMAIL_003"
    rows = {r["display"]: r for r in again.mapping().collect()}
    assert rows["EMAIL_001"]["mapping_ref"] == first["EMAIL_001"] and rows["EMAIL_001"]["expires_at"] == 25
    assert again.purge(20) == 1 and again.purge(20) == 0 and again.mapping().count() == 2
    other = mask.mask(table(spark, (1, "c@x.org", None)), again, "repo", "other", now=21)
    assert other.first()["text"] == "EMAIL_001"
    expired = mask.rehydrate(out, again, "local-patch", now=30).first()
    assert expired["text"] == "EMAIL_001 EMAIL_003" and expired["unresolved"] == ["EMAIL_001", "EMAIL_003"]


def test_commits_add_up(spark, vault, monkeypatch):
    from maskloom.operators import vault as module

    monkeypatch.setattr(module, "COMPACT", 2)
    for i in range(4):
        made = mask.mask(table(spark, (i, f"u{i}@x.org u0@x.org", None)), vault, "repo", "r", now=i).first()
        assert made["text"] == f"EMAIL_{i + 1:03d} EMAIL_001"
        assert len(vault._folders(vault.version())) <= 2
    assert vault.mapping().count() == 4


def test_one_writer(spark, vault):
    base = vault.version()
    vault.commit(vault.mapping(), base)
    with pytest.raises(VaultError):
        vault.commit(vault.mapping(), base)


def test_packs_and_audit(spark, vault, tmp_path):
    made = mask.mask(table(spark, (1, NOTE, None), (2, "x", ".env")), vault, "repo", "acme", now=1).cache()
    packs.save(made, str(tmp_path / "packs"))
    assert packs.load(spark, str(tmp_path / "packs")).select(made.columns[0], "text").exceptAll(made.select("artefact_id", "text")).count() == 0
    log = str(tmp_path / "audit")
    audit.write(audit.events_of(made, "r1"), log)
    rows = audit.read(spark, log).collect()
    assert sorted(r["event"]["kind"] for r in rows) == ["block", "scan"]
    scan = next(r["event"] for r in rows if r["event"]["kind"] == "scan")
    assert {c["entity_type"]: c["count"] for c in scan["counts"]} == {"email": 3, "iban": 1, "secret": 1} and scan["detector_version"] == "email+entropy+iban-sortcode+ip+phone"
    assert audit.get(spark, log, rows[0]["id"]).count() == 1
    for line in ('{"schema_version":9}', "torn", json.dumps({"schema_version": 1, "id": rows[0]["id"], "event": {"kind": "scan"}})):
        spark.createDataFrame([(line,)], "value string").write.mode("overwrite").text(log + "2")
        audit.write(audit.events_of(made, "r1"), log + "2")
        with pytest.raises(Exception, match="audit log"):
            audit.read(spark, log + "2").collect()
    spark.createDataFrame([('{"schema_version":2,"text":""}',)], "value string").write.text(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="trusted"):
        packs.load(spark, str(tmp_path / "bad")).collect()


def test_a_line_broken_off_is_no_part_of_the_log(spark, tmp_path):
    made = mask.mask(table(spark, (1, NOTE, None), (2, "x", ".env"), (3, "y", None)), Vault(spark, str(tmp_path / "v"), KEY), "repo", "a", now=1)
    audit.write(audit.events_of(made, "r1").coalesce(1), str(tmp_path / "log"))
    file = next((tmp_path / "log").glob("part*"))
    for crc in (tmp_path / "log").glob(".*.crc"):
        crc.unlink()
    whole = file.read_text()
    for tail in ('{"schema_version":1,"id":"trunc', whole.splitlines()[0].replace('"id":"', '"id":"0')):
        file.write_text(whole + tail)
        assert audit.read(spark, str(tmp_path / "log")).count() == 3 and audit.torn(spark, str(tmp_path / "log")) == 1
        assert [r["line"] for r in audit.last(spark, str(tmp_path / "log"), 2).orderBy("nth").collect()] == whole.splitlines()[1:]
    audit.write(audit.events_of(made, "r2"), str(tmp_path / "log/later"))
    assert audit.read(spark, str(tmp_path / "log")).count() == 6
    first = json.loads(whole.splitlines()[0])["id"]
    assert audit.get(spark, str(tmp_path / "log"), first).count() == 1 and audit.get(spark, str(tmp_path / "log"), "none").count() == 0
    file.write_text(whole + "{not json}\n")
    with pytest.raises(Exception, match="audit log"):
        audit.read(spark, str(tmp_path / "log")).collect()
    assert audit.get(spark, str(tmp_path / "log"), first).count() == 1
    (tmp_path / "one").write_text(whole + "{a secret\n")
    assert [r["line"] for r in audit.last(spark, str(tmp_path / "one"), 2).orderBy("nth").collect()] == [whole.splitlines()[-1], audit.WITHHELD]


def test_a_vault_knows_its_key_and_keeps_its_salt(spark, tmp_path):
    path = str(tmp_path / "kept")
    made = Vault(spark, path, KEY)
    assert len(made.salt) == 32 and Vault(spark, path, KEY).salt == made.salt
    with pytest.raises(VaultError, match="key"):
        Vault(spark, path, b"x" * len(KEY))
    with pytest.raises(VaultError, match="salt"):
        Vault(spark, path, KEY, b"another")
    assert made.salt not in (tmp_path / "kept/meta/salt").read_bytes()
    mask.mask(table(spark, (1, "a@x.org", None)), made, "repo", "a", now=1).collect()
    again = mask.mask(table(spark, (2, "b@x.org a@x.org", None)), Vault(spark, path, KEY), "repo", "a", now=2).first()
    assert again["text"] == "EMAIL_002 EMAIL_001"


def test_a_vault_refuses_repeats(spark, tmp_path):
    held = Vault(spark, str(tmp_path / "v"), KEY)
    mask.mask(table(spark, (1, "a@x.org b@x.org", None)), held, "repo", "a", now=1).collect()
    held.check()
    rows = held.mapping()
    other = rows.withColumn("key_hex", F.concat(F.lit("x"), "key_hex")).withColumn("mapping_ref", F.concat(F.lit("x"), "mapping_ref"))
    for bad in (rows.union(rows), rows.union(other), rows.withColumn("key_hex", F.lit("k")), rows.withColumn("mapping_ref", F.lit("m"))):
        with pytest.raises(ValueError, match="twice"):
            held.commit(bad, held.version())
    assert held.version() == 1 and held.mapping().count() == 2
    held.commit(other, 1, held._folders(1))  # each sound alone
    with pytest.raises(VaultError, match="ordinal"):
        held.check()


def test_half_a_version_is_never_met(spark, tmp_path):
    held = Vault(spark, str(tmp_path / "v"), KEY)
    (tmp_path / "v/versions").mkdir()
    assert held._put("versions/1", b"a") and not held._put("versions/1", b"b")
    assert (tmp_path / "v/versions/1").read_bytes() == b"a" and not [p for p in (tmp_path / "v/aside").iterdir() if not p.name.startswith(".")]
    assert held.version() == 1


def test_numbers_of_one_hot_artefact(spark):
    from maskloom.operators.vault import numbered

    df = spark.range(30_000).select(F.when(F.col("id") < 20_000, 7).otherwise(F.col("id")).alias("seen"), (F.col("id") % 3).alias("tag"), F.col("id").alias("start")).repartition(9)
    got = numbered(df, ["tag"], ["seen", "start"]).toPandas().sort_values(["tag", "seen", "start"])
    assert all((g["number"].values == range(1, len(g) + 1)).all() for _, g in got.groupby("tag"))


def test_hooks(spark):
    rows = [
        (1, "user-prompt-submit", json.dumps({"prompt": "mail jane@x.org"})),
        (2, "PreToolUse", json.dumps({"tool_input": {"file_path": "a.txt", "b": "call jane@x.org", "n": 1.5, "l": [None, True]}})),
        (3, "post_tool_use", json.dumps({"tool_input": {"file_path": ".env"}, "tool_response": {"a": "K"}})),
        (4, "PreToolUse", "{bad"), (5, "PreToolUse", "{}"), (6, "UserPromptSubmit", '{"prompt":""}'), (7, "UserPromptSubmit", '{"prompt":3}'),
        (8, "PostToolUse", '{"tool_response":"say \\"hi\\" 10.0.0.1"}'), (9, "Other", "{}"), (10, "PreToolUse", '{"tool_input":"plain"}'),
    ]
    found = hooks.subjects(spark.createDataFrame(rows, "event_id long, event string, payload string"))
    of = found.where("subject is not null").select(F.col("event_id").alias("artefact_id"), F.col("subject").alias("content"), "path")
    got = {r["event_id"]: r for r in hooks.answers(found, mask.redact(of)).collect()}
    assert {k: r["decision"] for k, r in got.items()} == {1: "transform", 2: "transform", 3: "block", 4: "block", 5: "block", 6: "pass", 7: "block", 8: "transform", 9: "block", 10: "pass"}
    assert json.loads(got[1]["output"])["reason"].endswith("mail [REDACTED:EMAIL]")
    assert json.loads(got[2]["output"])["hookSpecificOutput"]["updatedInput"] == {"file_path": "a.txt", "b": "call [REDACTED:EMAIL]", "n": 1.5, "l": [None, True]}
    assert json.loads(got[8]["output"])["hookSpecificOutput"]["updatedToolOutput"] == 'say "hi" [REDACTED:INTERNAL_IP]'


def test_benchmark_of_a_corpus(spark, tmp_path):
    corpus = {
        "version": 1,
        "samples": [
            {"name": "one", "content": "é jane@x.org and jane@x.org, 10.0.0.1", "expected": [{"type": "Email", "value": "jane@x.org"}, {"type": "InternalIp", "value": "10.0.0.1"}]},
            {"name": "two", "content": "token zQ3v9Lm2Xp7RwT6uYbN8dKfJhC1sEoAi", "expected": [{"type": "Secret", "value": "zQ3v9Lm2Xp7RwT6uYbN8dKfJhC1sEoAi"}], "slices": ["s"]},
            {"name": "benign", "content": "call 555-1234", "slices": ["benign-lookalike"]},
        ],
    }
    (tmp_path / "m.json").write_text(json.dumps(corpus))
    rows = artefacts.read_corpus(spark, str(tmp_path / "m.json"))
    assert sorted((r["start"], r["end"]) for r in artefacts.labels(rows).where("entity_type = 'Email'").collect()) == [(3, 13), (18, 28)]
    assert artefacts.in_slice(rows, "s").count() == 1
    report = benchmark.report(rows, {"p50_us": 1, "p95_us": 1, "max_us": 1}, 1)
    assert report["metrics"] == {"recall": 1.0, "precision": 0.8, "false_positive_rate": pytest.approx(0.2)}
    assert report["recall"] == {"secret": (1, 1), "pii": (3, 3)} and report["raw_left"] == 0 and report["verdict"] == "NoGo"
    assert "verdict: NoGo" in benchmark.render(report) and "hook: p50 1, p95 1, max 1 us" in benchmark.render(report)
    assert report["consistency"] == (2, 2) and report["structure"] == [] and report["gates"]["structural-checks"] is False and report["gates"]["placeholder-consistency"]
    whole = json.loads(json.dumps(corpus))
    whole["samples"] += [
        {"name": ".env", "artefact": {"path": "a/.env"}, "content": "x", "slices": ["artefact-block"]},
        {"name": "json", "content": '{"a": "jane@x.org"}', "expected": [{"type": "Email", "value": "jane@x.org"}], "slices": ["json-payload"]},
        {"name": "like", "content": "jane@x.org, not EMAIL_001", "expected": [{"type": "Email", "value": "jane@x.org"}], "decoys": ["EMAIL_001"], "residual_secrets": ["not"]},
    ]
    whole["samples"][2]["content"] = "nothing"
    whole["samples"][0]["content"] = "é jane@x.org and jane@x.org, then 10.0.0.1"
    (tmp_path / "whole.json").write_text(json.dumps(whole))
    full = benchmark.report(artefacts.read_corpus(spark, str(tmp_path / "whole.json")), policy={**DEFAULT, "artefacts": {**DEFAULT["artefacts"], "by_language": {"x": "block"}}})
    assert full["structure"] == [("artefact-block-fires", 1, 1), ("masked-json-still-parses", 1, 1)] and full["gates"]["structural-checks"]
    assert full["collisions"] == {"samples": 1, "minted": 1, "corrupted": 1} and full["residuals"] == (1, 1) and full["dead"] == ["x"]
    assert full["gates"]["hot-path-p95"] is None and "look-alikes: 1 samples" in benchmark.render(full) and "jane" not in benchmark.render(full)
    assert [d["benign_false_positives"] for d in report["detectors"] if d["detector"] == "phone"] == [1]
    assert [benchmark.verdict(g) for g in ([True], [True, None], [None, False])] == ["Go", "Incomplete", "NoGo"]
    corpus["samples"][0]["expected"][0]["value"] = "not there"
    (tmp_path / "m.json").write_text(json.dumps(corpus))
    with pytest.raises(Exception, match="label"):
        artefacts.labels(artefacts.read_corpus(spark, str(tmp_path / "m.json"))).collect()


def test_empty_metrics(spark):
    none = spark.createDataFrame([], "sample string, entity_type string, start int, end int, detector string, class string")
    assert tuple(benchmark.metrics(none, none).first()) == (1.0, 1.0, 0.0)


def test_stream(spark, vault, tmp_path):
    from maskloom.streaming.mask_stream import mask_stream

    src = str(tmp_path / "in")
    table(spark, (1, "a@x.org", None), (2, "b@x.org a@x.org", None)).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("artefact_id long, content string, path string").parquet(src)
    for _ in range(2):
        mask_stream(stream, vault, "repo", "s", str(tmp_path / "out"), str(tmp_path / "check"), now=1).trigger(availableNow=True).start().awaitTermination()
    got = {r["artefact_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "out/packs")).collect()}
    assert got == {1: "EMAIL_001", 2: "EMAIL_002 EMAIL_001"}
    assert spark.read.text(str(tmp_path / "out/audit")).count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "d/target").mkdir(parents=True)
    (tmp_path / "d/a.txt").write_bytes(b"\xff a@x.org")
    (tmp_path / "d/target/b.txt").write_text("b@x.org")
    (tmp_path / "d/c.bin").write_text("c@x.org")
    rows = artefacts.read_files(spark, str(tmp_path / "d"), ["txt"], ["target"])
    assert [r["text"] for r in mask.redact(rows).collect()] == ["� [REDACTED:EMAIL]"]
    assert artefacts.read_texts(spark, str(tmp_path / "d/c.bin")).count() == 1


def test_all_passed_policy(spark):
    policy = Policy.of({"entities": {"default": "pass"}})
    row = mask.redact(table(spark, (1, NOTE, None)), policy).first()
    assert row["text"] == NOTE and row["counts"] == {}
