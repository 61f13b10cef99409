"""Configuration, control, plugins, provider, routing, sessions."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from hushframe import config as C
from hushframe.operators import plugins, routing, sessions
from hushframe.operators.provider import chunk_blocks, parse_detections, provider_spans, strip_honorific


def test_load(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"mode": "anonymize", "plugins": ["/x", 3], "auditLog": {"enabled": 1, "reviewThreshold": "x"}, "customCategories": [{"name": "A", "patterns": ["a"]}, {"name": "B", "enabled": False}], "ollamaEndpoint": "http://example.com:99/x"}))
    made = C.load(path)
    assert made.mode == "anonymize" and made.plugins == ("/x",) and made.audit.review_threshold == 0.8 and made.audit.enabled
    assert made.configured[-1] == "A" and made.all_patterns[0].name == "A_1" and made.endpoint == C.DEFAULT_ENDPOINT
    assert C.load(tmp_path / "none.json") == C.Config()
    path.write_text("{")
    assert C.load(path) == C.Config() and not C.load(path, {C.DISABLED_BY: "0"}).enabled


@pytest.mark.parametrize(("endpoint", "remote", "expected"), [("http://evil.example", False, C.DEFAULT_ENDPOINT), ("http://ok.example:8/x", True, "http://ok.example:8"), ("http://127.0.0.1:11434/api", False, "http://127.0.0.1:11434"), ("https://[::1]:443/", False, "https://[::1]"), ("ftp://localhost", True, C.DEFAULT_ENDPOINT), (7, True, C.DEFAULT_ENDPOINT)])
def test_endpoints(endpoint, remote, expected):
    assert C.normalize_endpoint(endpoint, remote) == expected


def test_control():
    made = C.Config().with_control(C.Control().disable("EMAIL").toggled())
    assert not made.is_enabled and "EMAIL" not in made.active and made.status()["disabledCategories"] == ["EMAIL"]
    assert made.control.reset() == C.Control() and made.control.enable("EMAIL").disabled == frozenset()
    assert made.normalize_category("%20email") == "EMAIL" and made.normalize_category("nope") is None


def test_plugins(tmp_path, capsys):
    good, bad = tmp_path / "good.py", tmp_path / "bad.py"
    good.write_text("class P:\n    name = 'X'\n    def detect(self, t):\n        yield {'start': 0, 'end': 2, 'value': t[:2], 'confidence': 5}\n        yield {'start': 0, 'end': 1, 'value': 'no'}\n        raise ValueError('a' * 300 + chr(10) + 'raw')\nplugin = P()\nplugins = [3]\n")
    bad.write_text("1 /")
    found = plugins.load_plugins([str(good), str(bad), "relative.py"])
    assert [p.name for p in found] == ["X"]
    assert plugins.plugin_spans("abc", found) == [("ab", "X", 0, 2, 1.0)]
    err = capsys.readouterr().err
    assert "raw" not in err and "relative.py" in err
    plugins.reset_plugins()


def test_provider():
    assert chunk_blocks([(0, "x" * 3000), (1, "y" * 600), (2, "z" * 9000)]) == [[(0, "x" * 3000)], [(1, "y" * 600)], [(2, "z" * 9000)]]
    answer = '```json\n[{"text":"田中さん","category":"NAME","block":1},{"text":"a@b","category":"ORG","block":1},{"text":"[NAME_1]","category":"NAME","block":1},{"text":"田","category":"X","block":1},{"text":"田中","category":"NAME","block":9}]\n```'
    assert [s[:4] for s in parse_detections(answer, [(1, "田中と田中")])] == [("田中", "NAME", 0, 2), ("田中", "NAME", 3, 5)]
    assert parse_detections("none", [(0, "x")]) == [] and parse_detections("[1", [(0, "x")]) == []
    assert strip_honorific("鈴木先生") == "鈴木"
    assert provider_spans("田中", lambda _: 1 / 0, ("NAME",)) == [] and provider_spans("田中", None, ("NAME",)) == []


def test_routing(spark):
    rows = [("POST", "/v1/messages?x", None, "anthropic", True), ("GET", "/v1/messages", "openai", "anthropic", False), ("POST", "/v1/chat/completions", None, "openai", True), ("POST", "/v1/models", " OpenAI ", "openai", False), (None, None, None, "anthropic", False)]
    df = spark.createDataFrame(rows, "m string, u string, w string, p string, f boolean")
    for r in df.select("*", routing.provider(F.col("u"), F.col("w")).alias("gp"), routing.is_filtered(F.col("m"), F.col("u")).alias("gf")).collect():
        assert (r["gp"], r["gf"]) == (r["p"], r["f"])


def test_sessions(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, at(0), {"x-session-id": "a"}, "c"), (2, at(1799), {"x-pii-session-id": "a"}, "c"), (3, at(3599), {"x-session-id": " a "}, "c"), (4, at(3600), {"x-session-id": "a", "x-pii-session-reset": "TRUE"}, "c"), (5, at(0), {}, "a"), (6, at(9999), {"x-session-id": " "}, "a")]
    got = {r["id"]: (r["session"], r["epoch"]) for r in sessions.acquire(spark.createDataFrame(rows, "id int, ts timestamp, headers map<string,string>, conn_id string")).collect()}
    assert got == {1: ("id:a", 1), 2: ("id:a", 1), 3: ("id:a", 2), 4: ("id:a", 3), 5: ("connection:a", 1), 6: ("connection:a", 1)}


def test_messages_of_one_file_are_dealt(spark, sf_dir):
    """Tables of which messages are made are often one file of one row group: all cores get rows of it."""
    from hushframe.plans.catalog import shared

    for name, key in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("events", "event_id")):
        rows = shared(spark, sf_dir, f"SELECT {key} AS id FROM {name}")
        assert rows.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
        assert rows.count() == spark.read.parquet(f"{sf_dir}/{name}.parquet").count()
