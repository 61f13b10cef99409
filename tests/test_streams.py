"""Streams restored at every cut, in batches and by Structured Streaming."""

import json
import re

import pytest

from hushframe.streaming.restore import OUTPUT, SseRestorer, TextDelta, restore_chunks, restore_stream

ORIGINALS = {"[EMAIL_1]": "user@example.com", "[NAME_1]": "田中", "[" + "長" * 50 + "A]": "long"}


def whole(provider, body, cuts):
    made = SseRestorer(provider, ORIGINALS)
    out = "".join(made.process(body[a:b]) for a, b in zip([0, *cuts], [*cuts, len(body)], strict=True))
    return out + made.flush()


def anthropic(*texts):
    events = [f"event: content_block_delta\ndata: {json.dumps({'type': 'content_block_delta', 'index': 0, 'delta': {'type': 'text_delta', 'text': t}}, ensure_ascii=False)}\n\n" for t in texts]
    return "".join(events) + 'event: message_stop\ndata: {"type":"message_stop"}\n\n'


def openai(*texts):
    return "".join(f"data: {json.dumps({'choices': [{'index': 0, 'delta': {'content': t}}]}, ensure_ascii=False)}\r\n\r\n" for t in texts) + "data: [DONE]\n\n"


@pytest.mark.parametrize(("provider", "body"), [("anthropic", anthropic("Hello [EM", "AIL_1] and [", "x")), ("openai", openai("こんにちは、[NA", "ME_1]さん [" + "長" * 50, "A] [tail"))])
def test_any_cut_gives_the_same(provider, body):
    expected = whole(provider, body, [])
    assert "user@example.com" in expected or ("田中" in expected and "long" in expected)
    for cut in range(1, len(body)):
        assert whole(provider, body, [cut]) == expected


def test_tail_comes_before_the_end():
    out = whole("openai", openai("x [tail"), [])
    assert out.index("[tail") < out.index("[DONE]")
    assert "[x" in whole("anthropic", anthropic("[x"), [])


def test_text_delta_bounds():
    made = TextDelta({"[a]": "b"})
    assert made.process("1 [" + "y" * 40) == "1 [" + "y" * 40 and made.flush() == ""
    assert made.process("[[a]") == "[[a]" and made.process("[a") == "" and made.process("]") == "b"


def test_lines_that_are_no_json_pass():
    assert whole("anthropic", "data: nope\n: note\n\n", []) == "data: nope\n: note\n\n"


def rows(n):
    out = []
    for s in range(n):
        body = openai(f"hi {s} [EM", "AIL_1]!")
        cuts = [0, 7 + s, 60, len(body)]
        out += [(f"s{s}", k, "openai", body[a:b], k == 2, ORIGINALS) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    return out


SCHEMA = "stream_id string, seq int, provider string, chunk string, last boolean, originals map<string,string>"


def joined(collected):
    out = {}
    for r in sorted(collected, key=lambda r: (r["stream_id"], r["seq"])):
        out[r["stream_id"]] = out.get(r["stream_id"], "") + r["restored"]
    return out


def test_batch_and_streaming_agree(spark, tmp_path):
    df = spark.createDataFrame(rows(5), SCHEMA)
    expected = joined(restore_chunks(df).collect())
    assert all("user@example.com" in v for v in expected.values())
    for k in range(3):  # a file a micro-batch: state must carry over
        df.filter(f"seq = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = restore_stream(stream).writeStream.format("memory").queryName("restored").outputMode("append").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.sql("SELECT * FROM restored")
    assert got.schema.simpleString() == f"struct<{OUTPUT.replace(' string', ':string').replace(' int', ':int').replace(', ', ',')}>"
    assert joined(got.collect()) == expected


def test_events_at_every_cut(spark):
    """However a stream is cut, its events are those of the whole."""
    from hushframe.streaming.restore import events_of

    body = "data: a\r\n\r\ndata: b\n\n\n\nid: 1\ndata: [x\n\r\n\r\n\nrest"
    whole = [(k, e) for k, e in enumerate(re.split(r"\r\n\r\n|\n\n", body)) if e]
    rows = []
    for size in range(1, len(body) + 1):
        parts = [body[k : k + size] for k in range(0, len(body), size)]
        rows += [(f"s{size}", k, p) for k, p in enumerate(parts)] + [(f"s{size}", len(parts), None)]
    got = {}
    for r in events_of(spark.createDataFrame(rows, "stream_id string, seq int, chunk string").repartition(3)).collect():
        got.setdefault(r["stream_id"], []).append((r["event_no"], r["event"]))
    assert len(got) == len(body) and all(sorted(v) == whole for v in got.values())
