"""Sessions over request bodies, slices, token joins: against one replay in order, windows, and text by text."""

import json
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hushframe.config import Config
from hushframe.functions.categories import LABELS
from hushframe.operators import content, mask, slices
from hushframe.operators.mapping import Mapping, letters, restore_text
from hushframe.operators.mask import Masker
from hushframe.streaming import sessions

MAIL = Config(categories=("EMAIL",))
E = LABELS["EMAIL"]


@pytest.fixture(scope="module")
def grouped(spark):
    rng = np.random.default_rng(6)
    rows = [(None if g == 5 else int(g) % 4 if g > 5 else 0, int(t), k) for k, (g, t) in enumerate(zip(rng.integers(0, 12, 3000), rng.integers(0, 20_000, 3000)))]
    return spark.createDataFrame(rows, "g int, t int, id int").withColumn("ts", F.timestamp_seconds(F.col("t") * 60)).cache()


def test_numbers_are_those_of_a_window(grouped):
    made = slices.numbered(grouped, ["g"], ["t", "id"], slices=9)
    plain = grouped.withColumn("seq", F.row_number().over(Window.partitionBy("g").orderBy("t", "id")))
    key = lambda r: r["id"]
    assert sorted(made.select("g", "id", "seq").collect(), key=key) == sorted(plain.select("g", "id", "seq").collect(), key=key)


def test_no_slice_holds_a_hot_group(grouped):
    cut = slices.sliced(grouped, ["g"], ["t", "id"], 9)
    sizes = [r["count"] for r in cut.groupBy("__slice").count().collect()]
    assert grouped.filter("g = 0").count() > 1000 and max(sizes) < 2 * 3000 / 9


def test_tasks_grow_with_rows(spark, grouped, monkeypatch):
    """Slices and tasks are as many as rows ask for, not as many as Spark shuffles to, so that none grows with the table."""
    monkeypatch.setattr(slices, "PART_ROWS", 100)
    assert slices.parts_for(grouped) == 30 and slices.parts_for(grouped.limit(50)) == 4
    cut = slices.sliced(grouped, ["g"], ["t", "id"])
    assert max(r["count"] for r in cut.groupBy("__slice").count().collect()) < 300
    many = grouped.filter("g is not null").select(F.col("g").alias("k"), "id")
    few = spark.createDataFrame([(k, k * 2) for k in range(4)], "k int, v int")
    joined = slices.salted_join(many, few, ["k"], ["id"], parts=30)
    assert joined.rdd.getNumPartitions() == 30 and sorted(joined.collect()) == sorted(many.join(few, "k").collect())


def test_requests_are_dealt_to_more_tasks_the_more_they_are(spark, monkeypatch):
    rows = bodies()
    want = replayed(rows)
    monkeypatch.setattr(slices, "PART_ROWS", 5)
    monkeypatch.setattr(slices, "FEW_ROWS", 2)
    masked, _ = content.mask_session_requests(requests(spark, rows), ["id"], MAIL)
    assert masked.rdd.getNumPartitions() == 12
    assert {r["id"]: (r["session"], r["epoch"], r["masked"]) for r in masked.collect()} == want


def test_requests_that_no_key_tells_apart(spark):
    """Equal keys, or none, don't lose or repeat a request, nor leave a row's own placeholders in it."""
    text = lambda k: json.dumps({"messages": [{"role": "user", "content": f"u{k}@x.co"}]})
    rows = [(k if k > 2 else None, k, {"x-session-id": "s"}, None, text(k)) for k in range(1, 5)] + [(4, 4, {"x-session-id": "s"}, None, text(4))]
    got = [(r["body"], r["masked"]) for r in content.mask_session_requests(requests(spark, rows), ["id"], MAIL)[0].collect()]
    assert sorted(b for b, _ in got) == sorted(r[4] for r in rows)
    assert sorted(m.split(E)[1][:2] for _, m in got) == ["A]", "B]", "C]", "D]", "D]"]


def test_values_are_made_once_to_be_numbered(spark, monkeypatch):
    """The cut samples its rows first: values are stored before it, and which keys are hot is told from them."""
    read = []
    monkeypatch.setattr(mask, "stored", lambda df, name: read.append(name) or slices.stored(df, name))
    monkeypatch.setattr(slices, "hot_keys", lambda *_: pytest.fail("keys are counted again"))
    monkeypatch.setattr(slices, "FEW_ROWS", 2)
    df = spark.createDataFrame([(0, k, f"a{k}@b.co and c{k % 3}@b.co") for k in range(40)], "s int, n int, text string")
    masked, mapping = mask.mask_sessions(df, "s", ["n"], MAIL)
    assert read == ["masked", "values", "mapping"] and mapping.count() == 43
    held = {r["placeholder"]: r["original"] for r in mapping.collect()}
    assert all(restore_text(r["masked"], held) == r["text"] for r in masked.collect())


def test_epochs_are_those_of_a_window(grouped):
    resets = F.col("id") % 50 == 0
    made = slices.epochs(grouped, "g", "ts", ["id"], 1800, F.col("g") != 1, resets, slices=7)
    w = Window.partitionBy("g").orderBy("ts", "id")
    gap = F.col("ts").cast("double") - F.lag(F.col("ts").cast("double")).over(w)
    plain = grouped.withColumn("s", F.coalesce(gap.isNull() | ((F.col("g") != 1) & (gap >= 1800)) | resets, F.lit(False)).cast("int")).withColumn("epoch", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    key = lambda r: r["id"]
    rows = lambda df: sorted(df.filter("g is not null").select("id", "epoch").collect(), key=key)
    assert rows(made) == rows(plain)


def test_salted_join_is_a_join(spark):
    many = spark.createDataFrame([("hot" if k % 3 else f"k{k % 700}", k) for k in range(5000)], "k string, id int")
    few = spark.createDataFrame([("hot", 1), ("unused", 2), *((f"k{k}", k) for k in range(0, 700, 2))], "k string, v int")
    assert [r[0] for r in slices.hot_keys(many, ["k"], 0.01).collect()] == ["hot"]
    assert sorted(slices.salted_join(many, few, ["k"], ["id"], 8).collect()) == sorted(many.join(few, "k").collect())


def test_restore_joins_tokens(spark):
    mapping = [("s", f"[X{letters(k)}]", f"value {k} [XA]") for k in range(1, 60)] + [("t", "[XA]", "other"), ("u", "[XB]", None)]
    table = spark.createDataFrame([(*m, True) for m in mapping], "session string, placeholder string, original string, reversible boolean")
    texts = ["[XA] and [XB], [XA]", "none", None, "", "[[XB] [XZZ] [XC", "[XA]"]
    rows = [(s, t, k, {"a": 1}, "row", "name") for s in ("s", "t", None, "nobody") for k, t in enumerate(texts)] + [("s", "[XA]", 99, None, None, None)] * 2
    df = spark.createDataFrame(rows, "session string, text string, token int, `a.b` map<string,int>, `row` string, name string")
    got = mask.restore(df, table, "session").collect()
    assert len(got) == len(rows) and {tuple(r)[4:6] for r in got} == {("row", "name"), (None, None)}
    for r in got:
        known = {p: o for s, p, o in mapping if s == r["session"] and o is not None}
        assert r["restored"] == (None if r["text"] is None else restore_text(r["text"], known)), r
    plan = mask.restore(df, table, "session")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_tokens_that_a_text_quotes_stay(spark):
    """A session's second row gets other numbers than its own; what it quotes keeps its letters."""
    df = spark.createDataFrame([(1, 1, "a@b.co"), (1, 2, f"b@b.co said [{E}A]")], "s int, n int, text string")
    rows = {r["n"]: r["masked"] for r in mask.mask_sessions(df, "s", ["n"], MAIL)[0].collect()}
    assert rows == {1: f"[{E}A]", 2: f"[{E}B] said [{E}A]"}


def bodies():
    rng = np.random.default_rng(3)
    out, at = [], 1_000_000
    for k in range(60):
        at += int(rng.choice([0, 5, 600, 1800, 4000]))
        texts = [f"to u{rng.integers(5)}@x.example [{E}A] \"q\" and v{rng.integers(4)}@y.example" for _ in range(2)]
        body = {"system": "s", "messages": [{"role": "user", "content": texts[0]}, {"role": "user", "content": [{"type": "tool_result", "content": [{"type": "text", "text": texts[1]}]}]}], "n": 1.5}
        text = None if k == 7 else "no json" if k == 9 else "[1]" if k == 11 else json.dumps(body, ensure_ascii=False)
        out.append((k, at, {"x-session-id": " s1 "} if k % 3 == 0 else {"x-pii-session-id": "s2", "x-pii-session-reset": "1" if k % 20 == 4 else ""} if k % 3 == 1 else None, f"c{k % 2}" if k % 5 else None, text))
    return out


def replayed(rows, config=MAIL, ttl=1800):
    """Each request in order, with its session's mapping."""
    masker, held, out = Masker(config), {}, {}
    for k, at, headers, connection, body in sorted(rows, key=lambda r: (r[1], r[0])):
        h = {a: (b or "").strip() for a, b in (headers or {}).items()}
        name = h.get("x-pii-session-id") or h.get("x-session-id")
        session = f"id:{name}" if name else f"connection:{connection}" if connection else f'request:{{"id":{k}}}'
        epoch, last, mapping = held.get(session, (0, None, None))
        if mapping is None or (name and at - last >= ttl) or h.get("x-pii-session-reset") == "1":
            epoch, mapping = epoch + 1, Mapping()
        held[session] = (epoch, at, mapping)
        out[k] = (session, epoch, content.masked_body(body, masker, mapping))
    return out


def requests(spark, rows):
    return spark.createDataFrame(rows, "id int, at long, headers map<string,string>, conn_id string, body string").withColumn("ts", F.timestamp_seconds("at"))


def test_requests_in_batch_equal_a_replay(spark):
    rows = bodies()
    masked, mapping = content.mask_session_requests(requests(spark, rows), ["id"], MAIL, slices=5)
    assert {r["id"]: (r["session"], r["epoch"], r["masked"]) for r in masked.collect()} == replayed(rows)
    assert mapping.groupBy("session", "epoch", "placeholder").count().filter("count > 1").count() == 0


@pytest.fixture
def stateful(spark):
    changed = {"spark.sql.streaming.stateStore.providerClass": sessions.ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Stream:
    """Requests as files, each call one micro-batch of a query that goes on from its checkpoint."""

    def __init__(self, spark, tmp_path, **options):
        self.spark, self.where, self.options = spark, tmp_path, options

    def send(self, rows, **options):
        requests(self.spark, rows).coalesce(1).write.mode("append").parquet(f"{self.where}/in")
        source = self.spark.readStream.schema(requests(self.spark, []).schema).parquet(f"{self.where}/in")
        masked = sessions.mask_request_stream(source, ["id"], MAIL, **(self.options | options))
        masked.writeStream.format("parquet").option("path", f"{self.where}/out").option("checkpointLocation", f"{self.where}/state").trigger(availableNow=True).start().awaitTermination()
        return {r["id"]: (r["session"], r["epoch"], r["masked"]) for r in self.spark.read.parquet(f"{self.where}/out").collect()}


def test_requests_as_a_stream_equal_a_replay(stateful, tmp_path):
    rows = bodies()
    stream = Stream(stateful, tmp_path)
    stream.send(rows[:25])
    assert stream.send(rows[25:]) == replayed(rows)


def test_idle_sessions_are_cleared_by_the_clock(stateful, tmp_path):
    """Times of requests are equal, so only processing time can end the session; a connection's doesn't end."""
    body = lambda *names: json.dumps({"messages": [{"role": "user", "content": " ".join(f"{n}@x.co" for n in names)}]})
    named = {"x-session-id": "s"}
    stream = Stream(stateful, tmp_path, ttl=3)
    stream.send([(1, 5, named, "c", body("a", "b")), (2, 5, None, "c", body("a", "b"))])
    time.sleep(3.5)
    got = stream.send([(3, 5, named, "c", body("a")), (4, 5, None, "c", body("a"))])
    text = lambda k: json.loads(got[k][2])["messages"][0]["content"]
    assert text(1) == text(2) == f"[{E}B] [{E}A]"
    assert got[3][:2] == ("id:s", 2) and text(3) == f"[{E}A]"
    assert got[4][:2] == ("connection:c", 1) and text(4) == f"[{E}B]"
    got = stream.send([(5, 5, None, "c", body("a"))], generation="reloaded")
    assert got[5][:2] == ("connection:c", 2) and text(5) == f"[{E}A]"


def test_timers_clear_state_without_new_requests(stateful, tmp_path):
    """A running query clears an idle session by its timer; what is read from the state store afterwards holds no value."""
    spark = stateful
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    body = json.dumps({"messages": [{"role": "user", "content": "a@x.co"}]})
    requests(spark, [(1, 5, {"x-session-id": "s"}, "c", body)]).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(requests(spark, []).schema).parquet(f"{tmp_path}/in")
    query = sessions.mask_request_stream(source, ["id"], MAIL, ttl=2).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    held = lambda: spark.read.format("statestore").option("stateVarName", "values").load(f"{tmp_path}/state").count()
    try:
        until = time.time() + 60
        while time.time() < until and not (query.lastProgress and query.lastProgress["batchId"] >= 0 and (tmp_path / "out").exists()):
            time.sleep(0.3)
        while time.time() < until and held():
            time.sleep(1)
        assert held() == 0
    finally:
        query.stop()


def test_a_micro_batch_writes_its_last_epoch_only(spark):
    """Bodies come to the state masked; of a session's many epochs in a micro-batch the states see what stays."""
    class States(dict):
        writes = 0

        def containsKey(self, k):
            return k in self

        def updateValue(self, k, v):
            States.writes += 1
            self[k] = v

    class Seen:
        exists = staticmethod(lambda: False)
        update = staticmethod(lambda row: None)

    class Handle:
        registerTimer = staticmethod(lambda at: None)

    class Clock:
        getCurrentProcessingTimeInMs = staticmethod(lambda: 0)

    found = lambda k: json.dumps([{"original": f"u{k % 3}@x.co", "category": "EMAIL", "prefix": E, "placeholder": f"[{E}\U000f0000]"}])
    rows = [(k, float(k), k % 10 == 0, f'"[{E}\U000f0000]"', found(k)) for k in range(200)]
    masker = sessions.SessionMasker(MAIL, ["id"])
    masker.handle, masker.values, masker.counters, masker.seen = Handle(), States(), States(), Seen()
    batches = (pd.DataFrame(rows[lo : lo + 70][::-1], columns=["key0", "asked_at", "resets", "masked", "found"]) for lo in (140, 0, 70))
    out = pd.concat(masker.handleInputRows(("id:s",), batches, Clock())).sort_values("id")
    assert States.writes == 4 and out["epoch"].tolist() == [k // 10 + 1 for k in range(200)]
    held = {}
    for k, masked, mapping in out[["id", "masked", "mapping"]].itertuples(index=False):
        held = {} if k % 10 == 0 else held
        new = f"u{k % 3}@x.co" not in held
        assert masked == f'"[{E}{letters(held.setdefault(f"u{k % 3}@x.co", len(held) + 1))}]"' and len(mapping) == new


def test_restore_reads_tokens_once(spark):
    """Hot tokens and the join are told from stored ones: a text is made for its tokens (and their filter) and to be restored, no more."""
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(k):
        asked.add(1)
        return f"{k} [X{letters(k % 3 + 1)}]"

    rows = spark.range(30).repartition(2, "id").select(F.lit("s").alias("session"), "id", text(F.col("id").cast("int")).alias("text"))
    table = spark.createDataFrame([("s", f"[X{letters(k)}]", f"v{k}", True) for k in (1, 2, 3)], "session string, placeholder string, original string, reversible boolean")
    got = mask.restore(rows, table, "session").collect()
    assert sorted(r["restored"] for r in got) == sorted(f"{k} v{k % 3 + 1}" for k in range(30)) and asked.value <= 90  # a filter asks, too
