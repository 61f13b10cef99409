"""Columns of any name and type come through the pipeline's stages unchanged."""

import pytest

from hushframe.llm import mixing, simhash, toxicity

NAMES = ["node", "label", "row", "of", "place", "p", "size", "content", "epochs", "copies", "number", "more", "m", "__node", "__label", "__place", "__size", "__own", "__copies", "__toxicity", "score", "bucket", "a", "b", "n", "fp"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("extra"))
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    text = lambda k: " ".join(words[(k * 5 + j * (k % 4 + 1)) % 12] + str((k + j) % 9) for j in range(40)) + (" you idiot loser" if k % 4 == 0 else "")
    docs = [(k, text(k), "en", "ab"[k % 2], 1) for k in range(60)] + [(100, text(1), "en", "a", 1), (None, None, None, None, None), (101, "", "en", None, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def widened(df):
    """``df`` with all the names that stages use inside, a dotted one, a map, a variant and a struct."""
    extra = [f"concat('{n}', coalesce(doc_id, -1)) AS `{n}`" for n in NAMES]
    return df.selectExpr("*", *extra, "doc_id AS `a.b`", "map('k', doc_id) AS held", "parse_json(concat('{\"x\":', coalesce(doc_id, 0), '}')) AS free", "struct(doc_id AS doc_id, source AS text) AS `of it`")


@pytest.mark.parametrize("stage", [toxicity.without_toxic, simhash.one_of_each, mixing.mixed_documents], ids=lambda f: f.__name__)
def test_columns_come_back(spark, folder, stage):
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    wide = widened(plain)
    got = stage(spark, wide, folder)
    assert got.schema.simpleString() == wide.schema.simpleString()
    key = lambda r: str(r)
    rows = got.selectExpr(*[f"`{c}`" for c in plain.columns], *[f"`{n}`" for n in NAMES], "`a.b`", "to_json(held) AS held", "to_json(free) AS free", "`of it`.text AS inner").collect()
    assert rows and sorted((tuple(r)[:5] for r in rows), key=key) == sorted(map(tuple, stage(spark, plain, folder).collect()), key=key)
    for r in rows:
        at = -1 if r["doc_id"] is None else r["doc_id"]
        assert all(r[n] == f"{n}{at}" for n in NAMES) and r["a.b"] == r["doc_id"] and r["inner"] == r["source"]
        assert r["free"] == f'{{"x":{max(at, 0)}}}'
