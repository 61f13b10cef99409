"""Calls to a model for many texts, table functions, the audit log, and what requests may be."""

import json
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from hushframe.config import Config
from hushframe.functions.categories import LABELS
from hushframe.operators import content, mask, reports, table_functions
from hushframe.operators.mapping import Mapping
from hushframe.operators.mask import Masker
from hushframe.operators.provider import Packer, chunk_blocks, provider_table
from hushframe.sources import requests

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests
NAMES = Config(categories=("EMAIL", "NAME"), heuristic_ner=False, provider_enabled=True)
N, E = LABELS["NAME"], LABELS["EMAIL"]


def names(blocks):
    return json.dumps([{"text": w, "category": "NAME", "block": k} for k, t in blocks for w in t.split() if w.startswith("Mr")])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=30))
def test_packing_while_streaming(lengths):
    texts = ["Mr" + "x" * n for n in lengths]
    asked, packer, found = [], Packer(lambda b: asked.append(b) or names(b), 20), []
    for t in texts:
        found += packer.add(t) or []
    found += packer.flush()
    assert [[t for _, t in b] for b in asked] == [[t for _, t in c] for c in chunk_blocks(list(enumerate(texts)), 20)]
    assert packer.calls == len(asked) and [[s[0] for s in x] for x in found] == [[t] for t in texts]


def test_calls_are_shared(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(blocks):
        calls.add(1)
        return names(blocks) if not any("fail" in t for _, t in blocks) else 1 / 0

    texts = [(k, f"Mr{k} and MrB text{'x' * 80}") for k in range(90)] + [(200, None), (201, "  "), (202, "Mr" + "y" * 5000), (203, "fail Mr1")]
    df = spark.createDataFrame(texts, "id int, text string").coalesce(1)
    rows = provider_table(df, ["id"], counted, ("NAME",)).collect()
    expected = chunk_blocks([(k, t) for k, t in texts if t and t.strip()])
    assert calls.value == len(expected) == max(r["call"] for r in rows)
    got = {r["id"]: [s["text"] for s in r["spans"]] for r in rows}
    failed = {k for c in expected if any("fail" in t for _, t in c) for k, _ in c}
    assert got == {k: [] if k in failed else [w for w in t.split() if w.startswith("Mr")] for k, t in texts if t and t.strip()}
    assert provider_table(df, ["id"], counted, ("EMAIL",)).count() == 0


def test_requests_with_a_model(spark):
    body = {"system": "Mr0", "messages": [{"role": "user", "content": "MrA a@b.co"}, {"role": "user", "content": [{"type": "tool_result", "content": [{"type": "text", "text": "MrB, MrA"}]}, {"type": "tool_use", "input": {"k": ["MrA"], "n": 1.5}}]}]}
    df = spark.createDataFrame([(1, json.dumps(body)), (2, "no json"), (3, None), (4, json.dumps({"messages": []}))], "id int, body string").repartition(2)
    rows = {r["id"]: r for r in content.mask_requests_with_provider(df, ["id"], names, NAMES).collect()}
    got = json.loads(rows[1]["masked"])
    assert got["system"] == "Mr0" and got["messages"][0]["content"] == f"[{N}A] [{E}A]"
    assert got["messages"][1]["content"][1]["input"] == {"k": [f"[{N}A]"], "n": 1.5}
    one_by_one = Mapping()
    masker = Masker(NAMES, (), names)
    expected = content.masked_body(json.dumps(body), masker, one_by_one)
    assert {r["original"]: r["category"] for r in rows[1]["mapping"]} == {r[0]: r[1] for r in one_by_one.rows} and expected.count("[") == rows[1]["masked"].count("[")
    assert [rows[k]["masked"] for k in (2, 3, 4)] == [None, None, '{"messages":[]}']


class Codes:
    name = "CODE"

    @staticmethod
    def detect(text):
        if "boom" in text:
            raise ValueError("no")
        return [{"start": k, "end": k + 2, "value": text[k : k + 2]} for k in range(len(text) - 1) if text[k] == "#"]


def test_functions_in_sql(spark):
    table_functions.register(spark, Config(categories=("EMAIL",)), (Codes,))
    spark.createDataFrame([(1, "#a b@c.co #b"), (2, None), (3, "boom #a"), (4, "")], "id int, text string").createOrReplaceTempView("function_texts")
    assert sorted((r["id"], r["value"], r["start_at"]) for r in spark.sql("SELECT id, d.* FROM function_texts, LATERAL detect_plugins(text) d").collect()) == [(1, "#a", 0), (1, "#b", 10)]
    assert sorted((r["id"], r["value"]) for r in spark.sql("SELECT id, d.* FROM function_texts, LATERAL detect_personal_data(text) d").collect()) == [(1, "#a"), (1, "#b"), (1, "b@c.co"), (3, "#a")][:3]
    with pytest.raises(Exception, match="takes one text"):
        spark.sql("SELECT * FROM detect_plugins(TABLE(function_texts))").collect()


def test_session_function_equals_a_replay(spark):
    table_functions.register(spark, Config(categories=("EMAIL",)))
    turns = spark.createDataFrame([(s, t, f"u{(s + t) % 3}@x.co and u{t % 2}@y.co", {"k": t}) for s in range(4) for t in range(6)] + [(9, 1, None, None)], "s int, t int, text string, extra map<string,int>")
    turns.createOrReplaceTempView("function_turns")
    got = spark.sql("SELECT * FROM mask_session(TABLE(function_turns) PARTITION BY s ORDER BY t)")
    assert got.columns == ["s", "t", "text", "extra", "masked"]
    exact = mask.mask_sessions_exact(turns, "s", ["t"], Config(categories=("EMAIL",)))
    assert {(r["s"], r["t"]): r["masked"] for r in got.collect()} == {(r["s"], r["t"]): r["masked"] for r in exact.collect()}


def test_a_repeated_batch_is_logged_once(spark, tmp_path):
    texts = spark.createDataFrame([(1, "a@b.co c@d.co"), (2, "none")], "id int, text string")
    events = mask.audit_events(mask.mask_documents(texts), ["id"])
    path = f"{tmp_path}/log"
    for batch in (0, 1, 1, 0):
        requests.write_audit(events, path, batch)
    log = requests.read_audit(spark, path)
    assert log.count() == 4 and "a@b.co" not in "".join(r["value"] for r in spark.read.text(path).collect())


def test_audit_stream_survives_a_lost_commit(spark, tmp_path):
    """The checkpoint's last commit goes, as if the driver had failed after the write: Spark repeats the batch."""
    spark.createDataFrame([("2024", "EMAIL", "[A]", 1.0, (0, 1), "m", False)], "timestamp string, category string, placeholder string, confidence double, position struct<start:int,end:int>, mode string, reviewRequired boolean").write.parquet(f"{tmp_path}/in")

    def run():
        events = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
        requests.audit_stream(events, f"{tmp_path}/log", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    run()
    for name in ("0", ".0.crc"):
        (tmp_path / "state" / "commits" / name).unlink()
    run()
    assert requests.read_audit(spark, f"{tmp_path}/log").count() == 1


def test_inputs(spark):
    bodies = ['{"text":"x"}', '{"text":null}', "[]", "{", None, '{"text":"a","more":[1]}', '"s"']
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    good, bad = requests.split_valid(df)
    assert sorted(r["id"] for r in good.collect()) == [0, 1, 5] and sorted(r["id"] for r in bad.collect()) == [2, 3, 4, 6]
    assert sorted(r["id"] for r in df.filter(requests.valid_analyze_input(F.col("body"))).collect()) == [0, 5]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"session":"s","x":1}\n{"session":"t"}\n')
    read = requests.read_requests(spark, f"{tmp_path}/in.jsonl", "session")
    assert sorted((r["session"], r["body"][:3]) for r in read.collect()) == [("s", '{"s'), ("t", '{"s')]
    requests.write_masked(read, f"{tmp_path}/out")
    requests.write_masked(read, f"{tmp_path}/out")
    assert requests.read_texts(spark, f"{tmp_path}/out", "json").count() == 4
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"a":1}\n')
    query = requests.stream_requests(spark, f"{tmp_path}/in").writeStream.format("memory").queryName("asked_bodies").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r["body"] for r in spark.table("asked_bodies").collect()] == ['{"a":1}']


def test_rates(spark):
    df = spark.createDataFrame([("x [A] keep", ["gone", "[A]"], ["keep", "lost"])], "masked string, redact array<string>, keep array<string>")
    r = reports.rates(df, "masked", "redact", "keep").first()
    assert (r["redacted"], r["kept"]) == (0.5, 0.5)
