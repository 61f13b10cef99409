"""Dictionaries, allowlists and spans as tables, against the same done one by one."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushframe.config import Config, DictionaryEntry
from hushframe.functions.automaton import EntryMatcher
from hushframe.functions.detect import dictionary_spans
from hushframe.operators import mask, span_tables
from hushframe.operators.analyze import analyze
from hushframe.operators.dictionary_table import dictionary_column, stored_dictionary

LETTERS = st.sampled_from(list("abAB ＡｂaİK_1-"))
ENTRY = st.builds(DictionaryEntry, st.text(LETTERS, max_size=4), st.sampled_from(["X", "Y"]), st.booleans(), st.booleans(), st.booleans())


@settings(max_examples=300, deadline=None)
@given(st.lists(ENTRY, max_size=6), st.text(LETTERS, max_size=30))
def test_together_as_one_by_one(entries, text):
    assert EntryMatcher(entries).spans(text) == dictionary_spans(text, entries, ("X", "Y"))


def made_entries():
    rng = np.random.default_rng(2)
    return [(f"{'Ab'[k % 2]}{rng.integers(300)}", "XY"[k % 2], bool(k % 3 == 0), bool(k % 5 == 0), bool(k % 7 == 0)) for k in range(600)]


def test_table_as_dictionary(spark):
    rows = made_entries()
    texts = [None, "", "a12 A12 b7 xA12", "Ａ１２ b299b299", " ".join(f"A{k} b{k}" for k in range(300)) * 3]
    entries = [(*e, k, {"m": 1}) for k, e in enumerate(rows)] + [(None, "X", False, False, False, 1, None), ("", "X", False, False, False, 1, None), ("A1", None, False, False, False, 1, None), (*rows[0], 9000, None)]
    table = spark.createDataFrame(entries, "text string, category string, exact boolean, case_sensitive boolean, fold_width boolean, rank long, `a.b` map<string,int>")
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    plain = list(dict.fromkeys(DictionaryEntry(*r) for r in rows))
    expected = {k: [tuple(s) for s in EntryMatcher(plain).spans(t)] for k, t in enumerate(texts)}
    for shard_chars in (1_000_000, 300):
        dictionary = stored_dictionary(table, shard_chars=shard_chars)
        assert len(dictionary.uris) > 1 or shard_chars > 300
        got = docs.select("id", dictionary_column("text", dictionary).alias("s"))
        assert {r["id"]: [tuple(x) for x in r["s"]] for r in got.collect()} == expected
    assert "b7" not in got._jdf.queryExecution().toString()
    assert stored_dictionary(table.limit(0)).find(["a12"]) == [[]]


def test_rank_without_one(spark):
    """Equal spans of two categories: the order of category and text decides."""
    table = spark.createDataFrame([("same", "Z"), ("same", "B")], "text string, category string")
    docs = spark.createDataFrame([(1, "the same")], "id int, text string")
    config = Config(categories=("B", "Z"), heuristic_ner=False)
    assert [s["category"] for s in analyze(docs, config, dictionary=stored_dictionary(table)).first()["spans"]] == ["B"]
    masked = mask.mask_documents(docs, config, dictionary=stored_dictionary(table)).first()
    assert masked["masked"] == "the [BA]" and masked["events"][0]["category"] == "B"


def test_long_configured_dictionaries_leave_the_plan(spark):
    entries = tuple(DictionaryEntry(f"name{k}", "ORG", exact=True) for k in range(2000))
    docs = spark.createDataFrame([(1, "name7 name1999 name2000 xname3")], "id int, text string")
    found = analyze(docs, Config(categories=("ORG",), dictionary=entries, heuristic_ner=False))
    assert [s["text"] for s in found.first()["spans"]] == ["name7", "name1999"]
    assert len(found._jdf.queryExecution().toString()) < 20_000


def spans_table(spark, rows):
    return spark.createDataFrame(rows, "id int, value string, start_at int, end_at int, __bin int")


def test_allowlist_tables(spark):
    rows = [(k, "hot" if k % 3 else f"v{k % 40}", 0, 1, 7) for k in range(3000)] + [(1, None, 0, 1, 7)]
    spans = spans_table(spark, rows)
    allowed = spark.createDataFrame([("hot",), ("v3",), ("v3",), (None,), ("other",)], "value string")
    expected = sorted((r[0], r[1] or "") for r in rows if r[1] not in ("hot", "v3"))
    for limit in (span_tables.BROADCAST_BYTES, 0):
        kept = span_tables.without_allowed(spans, allowed, broadcast_bytes=limit)
        assert sorted((r["id"], r["value"] or "") for r in kept.collect()) == expected
        assert kept.columns == spans.columns
    assert span_tables.without_allowed(spans, allowed.limit(0)).count() == len(rows)


def overlap(a, b):
    return a[0] == b[0] and a[2] < b[3] and b[2] < a[3] and a[2] < a[3] and b[2] < b[3]


def test_overlaps(spark):
    rng = np.random.default_rng(9)
    draw = lambda n: [(int(rng.integers(4)), f"v{k}", int(a), int(a + rng.choice([0, 1, 3, 63, 64, 65, 128, 700])), k) for k, a in enumerate(rng.integers(0, 6000, n))]
    left, right = draw(250) + [(None, "n", 0, 9, 1), (1, "n", None, 9, 1), (2, "twice", 5, 9, 1), (2, "twice", 5, 9, 1)], draw(40) + [(None, "n", 0, 9, 1)]
    l, r = spans_table(spark, left), spans_table(spark, right)  # noqa: E741
    kept = span_tables.without_overlapped(l.drop("__bin"), r.drop("__bin"), ["id"])
    fine = lambda x: x[0] is not None and x[2] is not None
    expected = [a[:4] for a in left if not (fine(a) and any(fine(b) and overlap(a, b) for b in right))]
    key = lambda x: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in x)
    assert 20 < len(expected) < len(left) and sorted(map(tuple, kept.collect()), key=key) == sorted(expected, key=key)
    pairs = span_tables.overlap_pairs(l, r, ["id"])
    got = sorted((p["left"]["value"], p["right"]["value"]) for p in pairs.collect())
    assert got == sorted((a[1], b[1]) for a in left if fine(a) for b in right if fine(b) and overlap(a, b))
    for df in (kept, pairs):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_spans(spark):
    none = spans_table(spark, []).drop("__bin")
    some = none.union(spark.range(1).select(F.lit(1), F.lit("v"), F.lit(0), F.lit(3)))
    assert span_tables.without_overlapped(none, some, ["id"]).count() == 0 and span_tables.without_overlapped(some, none, ["id"]).count() == 1
    assert span_tables.overlap_pairs(none, some, ["id"]).count() == 0


def test_names_of_columns_do_not_clash(spark):
    """Names that operators use inside, a dotted one, a map; a column named like a result is replaced."""
    names = ["__text", "__found", "__patterns", "__", "___text", "__masked", "masked", "events", "spans", "node"]
    docs = spark.createDataFrame([(1, "to a@b.co")], "id int, text string").selectExpr("*", *[f"'{n}' AS `{n}`" for n in names], "id AS `a.b`", "map('k', id) AS held")
    for made, replaced in ((analyze(docs), {"spans"}), (mask.mask_documents(docs), {"masked", "mapping", "events"})):
        row = made.first().asDict()
        assert len(made.columns) == len(set(made.columns)) == len(set(docs.columns) | replaced)
        assert all(row[n] == n for n in names if n not in replaced) and row["a.b"] == 1 and row["held"] == {"k": 1} and row["text"] == "to a@b.co"
    assert analyze(docs).first()["spans"][0]["text"] == "a@b.co" and mask.mask_documents(docs).first()["masked"].endswith("A]")


@given(st.lists(ENTRY, max_size=6), st.lists(st.one_of(st.none(), st.text(LETTERS, max_size=30)), max_size=4))
def test_entry_index_is_the_automaton(entries, texts):
    from hushframe.functions.entry_index import EntryIndex

    fields = ("text", "category", "exact", "case_sensitive", "fold_width")
    made = EntryIndex(*([getattr(e, f) for e in entries] for f in fields), list(range(len(entries))))
    assert made.find(texts) == [EntryMatcher(entries).ranked(t) for t in texts]


def test_stretches_are_bounded():
    """What a task holds of its finds doesn't grow with the batch."""
    import pyarrow as pa

    from hushframe.operators.arrow import parts_of

    batch = pa.array(["x" * 100, None, "y" * 900, "z" * 50, ""] * 20)
    parts = list(parts_of(batch, rows=7, chars=1000))
    assert pa.concat_arrays(parts).equals(batch)
    assert all(len(p) <= 7 and sum(len(t or "") for t in p.to_pylist()) <= 1000 for p in parts)


def test_spans_are_found_once_beside_a_shuffled_allowlist(spark):
    """Hot texts and the rest are told from stored spans: detectors run once a row."""
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def found(k):
        asked.add(1)
        return f"v{k % 5}"

    spans = spark.range(60).repartition(3, "id").select("id", found(F.col("id").cast("int")).alias("value"))
    allowed = spark.createDataFrame([("v1",), ("v2",)], "value string")
    kept = span_tables.without_allowed(spans, allowed, broadcast_bytes=0).collect()
    assert sorted(r["id"] for r in kept) == [k for k in range(60) if k % 5 not in (1, 2)] and asked.value == 60


def test_a_text_of_entries_costs_little_a_find():
    """Every word is an entry: finds are worked out together; one by one, this took 5.9 s."""
    import re
    import time

    from hushframe.functions.entry_index import EntryIndex

    rng = np.random.default_rng(6)
    words = [f"w{k}é_" if k % 5 == 0 else f"w{k}" for k in range(4000)]
    texts = [" ".join(words[k] + "!x"[k % 7 == 0] * (k % 3) for k in rng.integers(0, 4000, 2000).tolist()) for _ in range(100)] + [None, ""]
    n = len(words)
    made = EntryIndex(words, ["T"] * n, [True] * n, [True] * n, [False] * n, list(range(n)))
    made.find(texts[:1])
    began = time.process_time()
    found = made.found(texts)
    assert time.process_time() - began < 2
    known = {w: k for k, w in enumerate(words)}
    expected = [sorted((known[m[0]], (m[0], "T", m.start(), m.end(), 0.9)) for m in re.finditer(r"\w+", t or "") if m[0] in known) for t in texts]
    assert len(found.starts) == sum(map(len, expected)) > 150_000 and made.find(texts) == expected


def test_equal_ranks_and_entries_that_overlap_themselves():
    """Order among equal ranks is by start, then as entries come; what is passed over hides what overlaps it."""
    from hushframe.functions.entry_index import EntryIndex

    rows = [("a-a", "X", True, True, False, 1), ("a", "Y", True, True, False, 1), ("a", "Z", False, False, True, 1), ("aa", "X", False, True, False, 0)]
    found = EntryIndex(*zip(*rows, strict=True)).find(["xa-a-a", "aaaaa"])
    assert [(r, *s[1:4]) for r, s in found[0]] == [(1, "Z", 1, 2), (1, "Z", 3, 4), (1, "Y", 3, 4), (1, "Z", 5, 6), (1, "Y", 5, 6)]
    assert [(r, *s[1:4]) for r, s in found[1]] == [(0, "X", 0, 2), (0, "X", 2, 4), *((1, "Z", k, k + 1) for k in range(5))]
