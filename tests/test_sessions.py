import pytest

from maskloom.operators import benchmark, sessions
from maskloom.plans.policy import DEFAULT
from maskloom.sources.state import State

REGISTRY = "address string, ns_kind string, ns_id string"


def test_registry(spark):
    have = spark.createDataFrame([("127.0.0.1:1", "repo", "a"), ("127.0.0.1:2", "repo", "b")], REGISTRY)
    new = spark.createDataFrame([("127.0.0.1:2", "repo", "c"), ("[::1]:3", "repo", "d")], REGISTRY)
    assert {tuple(r) for r in sessions.register(have, new).collect()} == {("127.0.0.1:1", "repo", "a"), ("127.0.0.1:2", "repo", "c"), ("[::1]:3", "repo", "d")}
    assert [r["ns_id"] for r in sessions.conflicts(have, new).collect()] == ["c"]
    assert sessions.unregister(have, new).count() == 2 and sessions.unregister(have, have.limit(1)).count() == 1
    with pytest.raises(Exception, match="loopback"):
        sessions.register(have, spark.createDataFrame([("10.0.0.1:1", "repo", "a")], REGISTRY)).collect()


def test_resolve(spark):
    have = spark.createDataFrame([("127.0.0.1:1", "repo", "a")], REGISTRY)
    rows = [(1, None, "127.0.0.1:1"), (2, None, "127.0.0.1:9"), (3, "550E8400-E29B-41D4-A716-446655440000", "127.0.0.1:1"), (4, "0" * 32, "127.0.0.1:1"), (5, "", "127.0.0.1:1"), (6, "x" * 99, "127.0.0.1:1"),
            (7, "550e8400e29b41d4a716446655440000", None)]
    got = {r["request_id"]: r for r in sessions.resolve(spark.createDataFrame(rows, "request_id int, header string, address string"), have).collect()}
    assert (got[1]["ns_kind"], got[1]["ns_id"]) == ("repo", "a")
    assert [(got[i]["ns_kind"], got[i]["ns_id"]) for i in (3, 7)] == [("session", "550e8400-e29b-41d4-a716-446655440000")] * 2
    assert all(got[i]["ns_id"] is None and got[i]["error"] for i in (2, 4, 5, 6)) and len(got[6]["error"]) < 99


def test_state(tmp_path, monkeypatch):
    monkeypatch.delenv("MASKLOOM_STATE_DIR", raising=False)
    deep = tmp_path / "a/b"
    deep.mkdir(parents=True)
    assert State.resolve(start=str(deep)).found == "created"
    (tmp_path / ".maskloom").mkdir()
    state = State.resolve(start=str(deep))
    assert state.root == tmp_path / ".maskloom" and state.warning
    assert state.policy().classify("Secret") == "irreversible-redact"
    (state.root / "policy/session.policy.json").write_text('{"entities": {"overrides": {"secret": "block"}}}')
    assert state.policy().classify("Secret") == "block"
    monkeypatch.setenv("MASKLOOM_STATE_DIR", str(tmp_path / "x"))
    assert State.resolve().found == "pinned" and State.resolve().warning is None


def test_dead_branches():
    assert benchmark.dead_branches(DEFAULT) == []
    assert benchmark.dead_branches({"artefacts": {"by_language": {"dotenv": "block"}}}) == ["dotenv"]
