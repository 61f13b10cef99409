"""Masking, numbering, restoring: fixed cases and properties."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from hushframe.config import AuditConfig, Config, Control, CustomCategory, DictionaryEntry
from hushframe.functions.categories import CATEGORIES, LABELS
from hushframe.operators import content, mask
from hushframe.operators.mapping import Mapping, letters, restore_text
from hushframe.operators.mask import Masker

ALL = Config(categories=CATEGORIES)


def test_letters():
    assert [letters(n) for n in (1, 26, 27, 28, 702, 703)] == ["A", "Z", "AA", "AB", "ZZ", "AAA"]


def test_numbers_go_from_right_to_left():
    mapping = Mapping()
    masked, _ = Masker(ALL).mask(" ".join(f"u{k}@example.com" for k in range(28)), mapping)
    label = LABELS["EMAIL"]
    assert masked.startswith(f"[{label}AB] [{label}AA] [{label}Z]") and masked.endswith(f"[{label}A]")
    assert mapping.restore(masked) == " ".join(f"u{k}@example.com" for k in range(28))


def test_labels_that_collide_stay_apart():
    config = Config(categories=("EMAIL",), custom_categories=(CustomCategory("CODE", label=LABELS["EMAIL"], patterns=("C-[0-9]+",)),))
    mapping = Mapping()
    masked, _ = Masker(config).mask("a@b.co C-7", mapping)
    assert len(mapping.originals) == 2 and mapping.restore(masked) == "a@b.co C-7"


def test_first_category_names_a_value():
    config = Config(dictionary=(DictionaryEntry("a@b.co", "ORG"),))
    mapping = Mapping()
    masked, events = Masker(config).mask("x a@b.co", mapping)
    assert masked == f"x [{LABELS['ORG']}A]" and events[0][0] == "ORG"


def test_anonymize_keeps_no_way_back():
    mapping = Mapping(reversible=False)
    masked, _ = Masker(Config(mode="anonymize")).mask("a@b.co a@b.co", mapping)
    assert masked == " ".join([f"[{LABELS['EMAIL']}A]"] * 2) and mapping.restore(masked) == masked


def test_allowlist():
    masked, events = Masker(Config(allowlist=("ok@b.co",))).mask("ok@b.co no@b.co", Mapping())
    assert masked.startswith("ok@b.co [") and len(events) == 1


def test_nested_tokens_are_restored_once():
    assert restore_text("[[人名A] [人名B]", {"[人名A]": "[人名B]", "[人名B]": "x"}) == "[[人名B] x"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a@b.co", "x", "192.168.0.1", "田中さん", "株式会社テスト", " ", "、", "4532015112830366", "〒100-0001", "桜丘高校", "\n", "山田太郎"]), max_size=12).map("".join))
def test_round_trip(text):
    mapping = Mapping()
    masked, events = Masker(ALL).mask(text, mapping)
    assert len(set(mapping.placeholders.values())) == len(mapping.placeholders)
    if all("[" not in o for o in mapping.placeholders):
        assert mapping.restore(masked) == text


def test_documents_edge_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a@b.co"), (3, "a@b.co"), (4, "x" * 200_000 + " a@b.co")], "id int, text string")
    rows = mask.mask_documents(df, ALL).collect()
    assert [r["masked"] for r in rows[:3]] == [None, "", f"[{LABELS['EMAIL']}A]"]
    assert rows[4]["masked"].endswith("A]") and not mask.mask_documents(df.filter("id > 9"), ALL).collect()


def test_sessions_fast_equals_exact(spark, sf_dir):
    df = spark.sql(f"SELECT conv_id, turn, concat(text, ' u', turn % 3, '@c', conv_id, '.example 田中さん 10.0.0.', turn) AS text FROM parquet.`{sf_dir}/conversations.parquet`")
    fast, mapping = mask.mask_sessions(df, "conv_id", ["turn"], ALL)
    exact = mask.mask_sessions_exact(df, "conv_id", ["turn"], ALL)
    a = {(r["conv_id"], r["turn"]): r["masked"] for r in fast.collect()}
    assert a == {(r["conv_id"], r["turn"]): r["masked"] for r in exact.collect()}
    back = mask.restore(fast.select("conv_id", "turn", "masked"), mapping, "conv_id", "masked").collect()
    assert {(r["conv_id"], r["turn"]): r["restored"] for r in back} == {(r["conv_id"], r["turn"]): r["text"] for r in df.collect()}


def test_audit(spark):
    config = Config(dictionary=(DictionaryEntry("secret", "ORG"),), audit=AuditConfig(True, review_threshold=0.95))
    masked = mask.mask_documents(spark.createDataFrame([(1, "secret a@b.co")], "id int, text string"), config)
    events = mask.audit_events(masked, ["id"], config).collect()
    assert {(e["category"], e["reviewRequired"]) for e in events} == {("ORG", True), ("EMAIL", False)}
    assert "a@b.co" not in str(events) and "secret" not in str(events)


def test_request_bodies(spark):
    body = {"model": "a@b.co", "system": [{"type": "text", "text": "s@b.co"}, 3], "messages": ["x", {"role": "user", "content": [{"type": "tool_use", "input": {"p": ["a@b.co", 1, None], "a@b.co": True}}, {"type": "tool_result", "content": [{"type": "text", "text": "a@b.co"}]}, {"type": "image", "data": "a@b.co"}]}]}
    rows = spark.createDataFrame([(1, json.dumps(body)), (2, "{"), (3, None), (4, "[1]")], "id int, body string")
    out = {r["id"]: r for r in content.mask_requests(rows, ALL).collect()}
    made = json.loads(out[1]["masked"])
    label = LABELS["EMAIL"]
    assert made["model"] == "a@b.co" and made["system"][0]["text"] == f"[{label}A]"
    assert made["messages"][1]["content"][0]["input"] == {"p": [f"[{label}B]", 1, None], "a@b.co": True}
    assert made["messages"][1]["content"][2]["data"] == "a@b.co"
    assert out[2]["masked"] is None and out[3]["masked"] is None and out[4]["masked"] is None
    assert [r["id"] for r in content.invalid_json(rows).collect()] == [2, 3]
    off = content.mask_requests(rows, ALL.with_control(Control().toggled())).collect()[0]
    assert off["masked"] == json.dumps(body)


def test_native_equals_python(spark, sf_dir):
    """Stages on stages, numbers from right to left, values met twice, allowlist, user patterns, dictionary; no Python in the plan."""
    config = Config(categories=CATEGORIES, dictionary=(DictionaryEntry("erth", "ORG", exact=True), DictionaryEntry("a@b.co", "ORG")), allowlist=("10.0.0.1",), custom_categories=(CustomCategory("CODE", label="ク", patterns=("E[0-9]+",)),))
    made = ["a@b.co x@y.example a@b.co", None, "", " \n", "E1 E2 E1 10.0.0.1 10.0.0.2", "株式会社テストの田中さんと山田太郎、桜丘高校", "[x] 田中さん [田中さん]", " ".join(f"u{k}@x.example" for k in range(30))]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    df = spark.createDataFrame([*docs, *((-k - 1, t) for k, t in enumerate(made))], "id long, text string")
    native = mask.mask_native(df, config)
    assert "Python" not in native._jdf.queryExecution().executedPlan().toString()
    rows = lambda f: {r["id"]: (r["masked"], r["mapping"], r["events"]) for r in f.collect()}
    assert rows(native) == rows(mask.mask_documents(df, config))
    off = config.with_control(Control().toggled())
    assert rows(mask.mask_native(df, off)) == rows(mask.mask_documents(df, off))


def test_anonymized_mappings_hold_no_originals(spark):
    config = Config(mode="anonymize")
    df = spark.createDataFrame([(1, 1, "a@b.co b@b.co"), (1, 2, "b@b.co")], "s int, n int, text string")
    sessions, mapping = mask.mask_sessions(df, "s", ["n"], config)
    assert [r["masked"] for r in sessions.orderBy("n").collect()] == [f"[{LABELS['EMAIL']}B] [{LABELS['EMAIL']}A]", f"[{LABELS['EMAIL']}A]"]
    held = [*mapping.collect(), *(m for f in (mask.mask_documents, mask.mask_native) for r in f(df, config).collect() for m in r["mapping"])]
    assert len(held) == 8 and all(m["original"] is None and not m["reversible"] for m in held)


def test_letters_sql_beyond_four_letters():
    """The SQL of pii_placeholder_letters states the rule for numbers of any length."""
    import duckdb

    from hushframe.plans.catalog import _LETTERS

    numbers = [1, 26, 27, 702, 703, 18278, 18279, 475254, 475255, 900001, 12356630, 12356631, 26**9]
    rows = duckdb.connect().execute(f"SELECT {_LETTERS} FROM (SELECT unnest({numbers}) AS id)").fetchall()
    assert [r[0] for r in rows] == [letters(n) for n in numbers]


def test_audit_events_mask_once(spark):
    """What is exploded isn't asked for its size first: that would mask each row twice, and before rows are dealt."""
    df = spark.createDataFrame([(1, "a@b.co and c@d.co"), (2, "none"), (3, None)], "id int, text string").repartition(3, "id")
    events = mask.audit_events(mask.mask_documents(df, Config(categories=("EMAIL",))), ["id"])
    assert sorted((r["id"], r["position"]["start"]) for r in events.collect()) == [(1, 0), (1, 11)]
    assert events._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
