"""The engine's queries, each with DuckDB SQL for the same rows.

Queries run over the tables' texts, or over messages made from their columns by SQL that both engines share,
so that detectors of which the texts have no example grow with the tables as well.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.config import Config, Control, CustomCategory, CustomPattern, DictionaryEntry
from hushframe.functions import ner
from hushframe.functions.categories import CATEGORIES, LABELS
from hushframe.functions.dictionary import dictionary_spans
from hushframe.functions.patterns import BY_NAME
from hushframe.functions.spans import pattern_spans, resolve, splice, utf16_offset
from hushframe.operators import content, mask, reports, routing, sessions, span_tables, table_functions
from hushframe.operators.analyze import analyze, exploded, span_udf, spread
from hushframe.operators.dictionary_table import StoredDictionary, dictionary_column, stored_dictionary
from hushframe.operators.mapping import letters_column, restore_column
from hushframe.operators.provider import chunk_blocks, parse_detections, provider_table, strip_honorific_column
from hushframe.operators.storage import shared_folder, stored
from hushframe.plans import oracle as O
from hushframe.sources import requests
from hushframe.streaming.restore import events_of, restore_chunks
from hushframe.streaming.sessions import ROCKSDB, mask_request_stream

Query = Callable[[SparkSession, str], DataFrame]
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()
#: Tables whose texts cost more to search than to move.
LONG_TEXTS = ("documents", "pages")
#: Tables of which messages are made, with the column that tells their rows apart: often one file of one row group.
DEALT = {"customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey", "events": "event_id"}
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

DOCS = "SELECT doc_id AS id, text FROM documents"
PAGES = "SELECT page_id AS id, html AS text FROM pages"


def shared(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Rows of SQL over the tables it names."""
    for name in TABLES:
        if name in sql:
            rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            dealt = spread(rows, DEALT.get(name)) if name in LONG_TEXTS or name in DEALT else rows
            dealt.createOrReplaceTempView(name)
    return spark.sql(sql)


def add(name: str, run: Query, sql: str | None = None) -> None:
    _queries[name] = run
    if sql is not None:
        _oracles[name] = sql


def rows_of(df: DataFrame, spans, keys: Sequence[str] = ("id",), category: bool = False) -> DataFrame:
    """``keys, value, start_at, end_at`` and, if asked for, ``category``."""
    e = exploded(df, keys, spans)
    return e.select(*keys, F.col("x.text").alias("value"), *([F.col("x.category").alias("category")] if category else []), F.col("x.start").alias("start_at"), F.col("x.end").alias("end_at"))


def customers(text: str) -> str:
    return f"SELECT c_custkey AS id, {text} AS text FROM customer"


def padded(n: int, value: str = "c_custkey") -> str:
    return f"lpad(cast({value} as string), {n}, '0')"


def text_of(*parts: str) -> str:
    """A concat of literals (marked ``=``) and expressions over ``customer``."""
    return "concat(" + ", ".join(O.quoted(p[1:]) if p.startswith("=") else f"cast({p} as string)" for p in parts) + ")"


K, K7, K12 = "c_custkey", padded(7, "(c_custkey * 7919) % 10000000"), padded(12, "c_custkey * 79190017")
MADE = {
    "P1": text_of("=token sk-", padded(9), "=abcdefghijklm and AKIA1234567", padded(9), "= end"),
    "P4": text_of("=no. ", f"substr({K12}, 1, 4)", "=-", f"substr({K12}, 5, 4)", "=-", f"substr({K12}, 9, 4)", "=です"),
    "P5": text_of("=マイナンバー: ", K12, "=です"),
    "P7": text_of("=call +44 ", padded(4), "=-", K7, "=!"),
    "P8": text_of("=届け先は東京都千代田区丸の内", f"{K} % 9 + 1", "=-", f"{K} % 30 + 1", "=-", f"{K} % 7 + 1", "=です"),
    "P9": text_of("=三丁目", f"{K} % 90 + 1", "=番地", f"{K} % 9 + 1", "=号と十番"),
    "P10": text_of(f"{K} % 9 + 1", "=-", f"{K} % 30 + 1", "= サンプルマンション ", f"{K} % 900 + 1", "=号室"),
    "P11": text_of("=see https://u", K, "=:pw", K, "=@host", f"{K} % 9", "=.example.com/x"),
    "P12": text_of("=Author: User ", K, "= <u", K, "=@x.example>"),
    "P13": text_of("=SSN ", padded(3, f"{K} % 1000"), "=-", padded(2, f"{K} % 97"), "=-", padded(4, f"{K} % 9973"), "=."),
    "P15": text_of("=ip 2001:db8:0:0:0:0:", f"{K} % 10000", "=:", f"{K} % 97"),
    "P16": text_of("=〒", padded(3, f"{K} % 1000"), "=-", padded(4, f"{K} % 10000")),
    "P18": text_of("=iban GB", padded(2, f"{K} % 100"), "= NWBK 6016 1331 9268 19."),
    "P19": text_of("=銀行コード: ", padded(4, f"{K} % 10000"), "= 支店番号: ", padded(3, f"{K} % 1000"), "=、口座番号: ", K7),
    "P20": text_of("=口座番号: 普通 ", K7, "=です"),
    "P21": text_of("=免許証番号: ", K12, "=です"),
    "P22": text_of("=passport no. AB", K7, "= ok"),
    "P23": text_of("=ETH 0x", f"lpad(cast({K} as string), 40, 'a')", "= ok"),
    "P24": text_of("=生年月日: ", f"1950 + {K} % 50", "=年", f"{K} % 12 + 1", "=月", f"{K} % 28 + 1", "=日"),
    "P25": text_of("=患者番号: ab-", K7, "=です"),
    "P26": text_of("=保険証番号: 記号 A", f"{K} % 1000", "=x、番号 ", K7),
    "P27": text_of("=健康保険証番号: ", padded(8), "=です"),
    "P28": text_of("=被保険者番号: 13-ABC-", K7),
    "P29": text_of("=医師免許証番号: ", padded(6, f"{K} % 1000000")),
}


def _pattern(name: str, base: str) -> Query:
    return lambda spark, d: rows_of(shared(spark, d, base), pattern_spans("text", BY_NAME[name]))


for _name, _made in MADE.items():
    add(f"pii_regex_{_name.lower()}_{BY_NAME[_name].category.lower()}", _pattern(_name, customers(_made)), "SELECT id, value, start_at, end_at FROM (" + O.pattern_spans(customers(_made), _name) + ")")
for _name in ("P1", "P2", "P3", "P6", "P7", "P14", "P17"):
    add(f"pii_documents_{_name.lower()}_{BY_NAME[_name].category.lower()}", _pattern(_name, DOCS), "SELECT id, value, start_at, end_at FROM (" + O.pattern_spans(DOCS, _name) + ")")
for _name in ("P2", "P14"):
    add(f"pii_pages_{_name.lower()}_{BY_NAME[_name].category.lower()}", _pattern(_name, PAGES), "SELECT id, value, start_at, end_at FROM (" + O.pattern_spans(PAGES, _name) + ")")

# Analyze: all detectors, resolution over all of them.
CORPUS = ("P1", "P2", "P3", "P6", "P7", "P13", "P14", "P17")
_all = " UNION ALL ".join(f"SELECT *, {k} AS ord FROM ({O.pattern_spans(DOCS, p)})" for k, p in enumerate(CORPUS))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared(spark, sf_dir, DOCS)
    return rows_of(analyze(docs, Config()), F.col("spans"), category=True)


add("pii_analyze_documents", flagship, O.resolved(_all))
add("pii_resolve_overlaps", lambda s, d: rows_of(shared(s, d, DOCS), resolve(F.concat(*[pattern_spans("text", BY_NAME[p]) for p in CORPUS])), category=True), O.resolved(_all))
add("pii_counts_by_category_lang", lambda s, d: reports.counts(rows_of(analyze(shared(s, d, "SELECT doc_id AS id, text, lang FROM documents"), Config()), F.col("spans"), ("id", "lang"), True).withColumnRenamed("value", "text"), "category", "lang"), f"SELECT category, lang, count(*) AS n_spans, count(DISTINCT value) AS n_values FROM ({O.resolved(_all)}) JOIN documents ON doc_id = id GROUP BY ALL")
add("pii_cube_category_source", lambda s, d: reports.cube(rows_of(analyze(shared(s, d, "SELECT doc_id AS id, text, source FROM documents"), Config()), F.col("spans"), ("id", "source"), True), "category", "source"), f"SELECT category, source, CAST(grouping_id(category, source) AS BIGINT) AS level, count(*) AS n_spans FROM ({O.resolved(_all)}) JOIN documents ON doc_id = id GROUP BY CUBE (category, source)")
add("pii_top_sources", lambda s, d: reports.top(rows_of(analyze(shared(s, d, "SELECT doc_id AS id, text, source FROM documents"), Config()), F.col("spans"), ("id", "source"), True), "source", 5), f"SELECT source, count(*) AS n_spans FROM ({O.resolved(_all)}) JOIN documents ON doc_id = id GROUP BY source ORDER BY n_spans DESC, source LIMIT 5")
add("pii_category_pruning", lambda s, d: rows_of(analyze(shared(s, d, DOCS), Config().with_control(Control().disable("PHONE").disable("POSTAL_CODE"))), F.col("spans"), category=True), O.resolved(" UNION ALL ".join(f"SELECT *, {k} AS ord FROM ({O.pattern_spans(DOCS, p)})" for k, p in enumerate(("P1", "P2", "P3", "P13", "P14")))))
_IPS = "SELECT s_suppkey AS id, concat('ip 10.0.', cast(s_suppkey % 3 as string), '.7 and 123-4567') AS text FROM supplier"
add("pii_allowlist", lambda s, d: rows_of(analyze(shared(s, d, _IPS), Config(allowlist=("10.0.0.7", "123-4567"))), F.col("spans"), category=True), f"SELECT * FROM ({O.pattern_spans(_IPS, 'P14')}) WHERE value <> '10.0.0.7'")
# An allowed winner still hides what it overlapped: the card's phone-like tail doesn't come back.
_CARDS = customers(text_of("=Card 4532015112830366 of ", K))
add("pii_allowlist_hides_losers", lambda s, d: analyze(shared(s, d, _CARDS), Config(categories=("CREDIT_CARD", "PHONE", "SSN"), allowlist=("4532015112830366",))).select("id", F.size("spans").cast("int").alias("n_spans")), "SELECT c_custkey AS id, CAST(0 AS INT) AS n_spans FROM customer")
add("pii_utf16_offsets", lambda s, d: rows_of(shared(s, d, customers(text_of("=😀 mail u", K, "=@x.example 😀"))), pattern_spans("text", BY_NAME["P2"])).select("id", "value", F.lit(None).cast("string").alias("none"), "start_at").join(shared(s, d, customers(text_of("=😀 mail u", K, "=@x.example 😀"))), "id").select("id", "start_at", utf16_offset(F.col("text"), F.col("start_at")).alias("utf16_start")), "SELECT c_custkey AS id, CAST(7 AS INT) AS start_at, CAST(8 AS INT) AS utf16_start FROM customer")

# Validators on made numbers.
_NUMBERS = f"SELECT c_custkey AS id, {padded(16, 'c_custkey * 7919')} AS card, {K12} AS own, concat('GB', {padded(2, 'c_custkey % 100')}, 'NWBK', {padded(14, 'c_custkey * 104729')}) AS account FROM customer"


def _validators(spark: SparkSession, d: str) -> DataFrame:
    from hushframe.functions import validators as V

    return shared(spark, d, _NUMBERS).select("id", V.luhn(F.col("card")).alias("luhn"), V.my_number(F.col("own")).alias("my_number"), V.iban(F.col("account")).alias("iban"))


add("pii_validators", _validators, f"SELECT id, {O.luhn('card')} AS luhn, {O.my_number('own')} AS my_number, {O.iban('account')} AS iban FROM ({_NUMBERS})")

# Dictionaries, custom patterns and categories.
_NATIONS = "SELECT n_nationkey AS id, concat(upper(n_name), ' and ', n_name, ', x', n_name, 'y ', lower(n_name), '.') AS text, n_name AS word FROM nation"


def _dictionary(exact: bool, case: bool) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        # The nation names are a dimension of 25 rows: here they are the dictionary.
        names = [r[0] for r in shared(spark, d, "SELECT n_name FROM nation").collect()]
        entries = tuple(DictionaryEntry(n, "PLACE", exact, case) for n in names)
        return rows_of(shared(spark, d, _NATIONS), dictionary_spans("text", entries))

    return run


def _dictionary_sql(exact: bool, case: bool) -> str:
    low = (lambda x: x) if case else (lambda x: f"lower({x})")
    at = f"list_filter(range(1, length(text) + 1), lambda i: substr({low('text')}, i, length(w)) = {low('w')})"
    keep = "NOT regexp_matches(substr(text, p - 1, CASE WHEN p > 1 THEN 1 ELSE 0 END), '[\\p{L}\\p{N}_]') AND NOT regexp_matches(substr(text, p + length(w), 1), '[\\p{L}\\p{N}_]')" if exact else "true"
    return f"SELECT id, substr(text, p, length(w)) AS value, CAST(p - 1 AS INT) AS start_at, CAST(p - 1 + length(w) AS INT) AS end_at FROM (SELECT a.id, a.text, b.n_name AS w, unnest({at.replace('(w)', '(b.n_name)')}) AS p FROM ({_NATIONS}) a, nation b) WHERE {keep}"


for _exact in (False, True):
    for _case in (False, True):
        add(f"pii_dictionary_{'exact' if _exact else 'partial'}_{'case' if _case else 'nocase'}", _dictionary(_exact, _case), _dictionary_sql(_exact, _case))
_WIDE = customers(text_of("=社名 ＡＢＣ－", K, "= と abc-", K, "= です"))
add("pii_dictionary_width", lambda s, d: rows_of(shared(s, d, _WIDE), dictionary_spans("text", (DictionaryEntry("Abc-", "ORG", fold_width=True),))), "SELECT c_custkey AS id, unnest(['ＡＢＣ－', 'abc-']) AS value, unnest([CAST(3 AS INT), CAST(10 + length(CAST(c_custkey AS VARCHAR)) AS INT)]) AS start_at, unnest([CAST(7 AS INT), CAST(14 + length(CAST(c_custkey AS VARCHAR)) AS INT)]) AS end_at FROM customer")
_EMP = customers(text_of("=社員番号は EMP-", padded(4, f"{K} % 10000"), "= です。PRJ-", K, "= も"))
add("pii_custom_patterns", lambda s, d: rows_of(analyze(shared(s, d, _EMP), Config(categories=(), custom_patterns=(CustomPattern("EMPLOYEE_ID", "EMP-[0-9]{4}"),), custom_categories=(CustomCategory("PROJECT", patterns=("PRJ-[0-9]+",)), CustomCategory("OFF", enabled=False, patterns=("も",))))), F.col("spans"), category=True), f"SELECT id, g AS value, 'EMPLOYEE_ID' AS category, s AS start_at, CAST(s + length(g) AS INT) AS end_at FROM ({O.matches(_EMP, 'EMP-[0-9]{4}')}) UNION ALL SELECT id, g, 'PROJECT', s, CAST(s + length(g) AS INT) FROM ({O.matches(_EMP, 'PRJ-[0-9]+')})")


class _Projects:
    """A plugin, as a user would write one."""

    name = "PROJECT_CODE"

    @staticmethod
    def detect(text: str):
        at = text.find("PRJ-")
        return [{"start": at, "end": at + 5, "value": text[at : at + 5], "confidence": 2}] if at >= 0 else []


def _plugin(spark: SparkSession, d: str) -> DataFrame:
    from hushframe.operators.plugins import plugin_spans

    return rows_of(shared(spark, d, _EMP), span_udf(lambda t: plugin_spans(t, (_Projects,)))(F.col("text")), category=True)


add("pii_plugin", _plugin, f"SELECT id, g AS value, 'PROJECT_CODE' AS category, s AS start_at, CAST(s + 5 AS INT) AS end_at FROM ({O.matches(_EMP, 'PRJ-.')})")

# Heuristic rules.
_SURNAME = f"CASE {K} % 4 WHEN 0 THEN '田中' WHEN 1 THEN '佐々木' WHEN 2 THEN '林' ELSE '珍名' END"
_TITLE = f"CASE {K} % 3 WHEN 0 THEN 'さん' WHEN 1 THEN '様' ELSE '先生' END"


def _rule(base: str, rule) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rows_of(shared(spark, d, base), rule("text", ner.bracket_ranges("text")))

    return run


from hushframe.functions.ner_data import ROMAJI, SURNAMES  # noqa: E402

_R1 = customers(f"concat('あ', {_SURNAME}, {_TITLE}, 'と[', {_SURNAME}, 'さん]')")
_known = "('" + "', '".join(SURNAMES) + "')"
add("pii_ner_honorifics", _rule(_R1, lambda t, r: ner.honorific_names(t, r, SURNAMES)), f"SELECT id, m AS value, CAST(1 AS INT) AS start_at, CAST(1 + length(m) AS INT) AS end_at FROM (SELECT id, regexp_extract(text, '^あ(\\p{{Han}}+?)(?:さん|様|先生)', 1) AS m FROM ({_R1})) WHERE m IN {_known} OR length(m) >= 2")
_R1D = customers(f"concat(CASE {K} % 4 WHEN 0 THEN 'お客' WHEN 1 THEN '看護師' WHEN 2 THEN '担当' ELSE '皆' END, 'さん')")
add("pii_ner_not_names", _rule(_R1D, lambda t, r: ner.honorific_names(t, r, SURNAMES)), "SELECT c_custkey AS id, '担当' AS value, CAST(0 AS INT) AS start_at, CAST(2 AS INT) AS end_at FROM customer WHERE c_custkey % 4 = 2")
_R3 = customers(f"concat('は', CASE {K} % 3 WHEN 0 THEN '山田' WHEN 1 THEN '高橋' ELSE '東' END, CASE {K} % 5 WHEN 0 THEN '太郎' WHEN 1 THEN ' 花子' WHEN 2 THEN 'さくら' WHEN 3 THEN 'さん' ELSE '部長' END, 'です')")
add("pii_ner_full_names", _rule(_R3, lambda t, r: ner.full_names(t, r, SURNAMES)), f"SELECT id, m AS value, CAST(1 AS INT) AS start_at, CAST(1 + length(m) AS INT) AS end_at FROM (SELECT id, regexp_extract(text, '^は((?:山田|高橋|東)(?:太郎| 花子))', 1) AS m FROM ({_R3})) WHERE m <> ''")
_R4 = customers(text_of("=担当者： 珍名", K, "=、氏名:甲乙丙丁 終"))
add("pii_ner_labelled", _rule(_R4, ner.labelled_names), f"SELECT id, g AS value, CAST(s + length(m) - length(g) AS INT) AS start_at, CAST(s + length(m) AS INT) AS end_at FROM ({O.matches(_R4, '(?:氏名|名前|担当者|担当)[:：][ ]*([^ 、。,.!?:：;；]{2,20})', 1)})")
_R5 = customers(f"concat('by Taro ', CASE {K} % 3 WHEN 0 THEN 'Yamada' WHEN 1 THEN 'Smith' ELSE 'Sato' END, ' and Mori Ann ', cast({K} as string))")
add("pii_ner_romaji", _rule(_R5, ner.romaji_names), f"SELECT id, g AS value, s AS start_at, CAST(s + length(g) AS INT) AS end_at FROM ({O.matches(_R5, r'\b[A-Z][a-z]{1,15} [A-Z][a-z]{1,15}\b')}) WHERE lower(split_part(g, ' ', 1)) IN {ROMAJI!r} OR lower(split_part(g, ' ', 2)) IN {ROMAJI!r}")
_O1 = customers(text_of("=は株式会社テスト", K, "=と契約。甲乙商事(株) は"))
add("pii_ner_legal_forms", _rule(_O1, ner.legal_form_orgs), f"SELECT id, g AS value, s AS start_at, CAST(s + length(g) AS INT) AS end_at FROM ({O.matches(_O1, '株式会社[\\p{Han}\\p{Katakana}A-Za-z0-9・ー]{2,20}')}) UNION ALL SELECT id, g, s, CAST(s + length(g) AS INT) FROM ({O.matches(_O1, '[\\p{Han}\\p{Katakana}A-Za-z0-9・ー]{2,20}\\(株\\)')})")
_O3 = customers(text_of("=from Acme Widgets", K, "=, Inc. and Foo Corporation, ok"))
add("pii_ner_english_orgs", _rule(_O3, ner.english_orgs), f"SELECT id, g AS value, s AS start_at, CAST(s + length(g) AS INT) AS end_at FROM ({O.matches(_O3, r'\b[A-Z][A-Za-z0-9&.-]*(?:[ ][A-Z][A-Za-z0-9&.-]*){0,3},?[ ](?:Inc|Corporation|Corp)\b')})")
_S1 = customers(f"concat('は', CASE {K} % 4 WHEN 0 THEN '桜丘高等学校' WHEN 1 THEN '私立高校' WHEN 2 THEN '国際大学院大学' ELSE '東京大学教授' END, 'に')")
add("pii_ner_schools", _rule(_S1, ner.schools), f"SELECT id, m AS value, CAST(1 AS INT) AS start_at, CAST(1 + length(m) AS INT) AS end_at FROM (SELECT id, regexp_extract(text, '^は(桜丘高等学校|国際大学院大学)', 1) AS m FROM ({_S1})) WHERE m <> ''")
_NER = customers(f"concat('は', CASE {K} % 2 WHEN 0 THEN '東都大学' ELSE '田中太郎' END, 'の個別事例')")
add("pii_ner_claimed", lambda s, d: rows_of(analyze(shared(s, d, _NER), Config()), F.col("spans"), category=True), f"SELECT id, substr(text, 2, 4) AS value, CASE WHEN id % 2 = 0 THEN 'SCHOOL' ELSE 'NAME' END AS category, CAST(1 AS INT) AS start_at, CAST(5 AS INT) AS end_at FROM ({_NER})")

# Masking, numbering, restoring.
_MAIL = customers(text_of("=to a", K, "=@x.example and b", f"{K} % 3", "=@y.example, again a", K, "=@x.example"))
_LABEL = LABELS["EMAIL"]
_masked = f"replace(replace(text, concat('a', cast(id as string), '@x.example'), '[{_LABEL}A]'), concat('b', cast(id % 3 as string), '@y.example'), '[{_LABEL}B]')"
add("pii_mask_documents", lambda s, d: mask.mask_documents(shared(s, d, _MAIL), Config()).select("id", "masked", F.size("events").cast("int").alias("n_events"), F.size("mapping").cast("int").alias("n_values")), f"SELECT id, {_masked} AS masked, CAST(3 AS INT) AS n_events, CAST(2 AS INT) AS n_values FROM ({_MAIL})")
add("pii_mask_native", lambda s, d: mask.mask_native(shared(s, d, _MAIL), Config()).select("id", "masked", F.size("events").cast("int").alias("n_events"), F.size("mapping").cast("int").alias("n_values")), _oracles["pii_mask_documents"])
add("pii_mask_anonymize", lambda s, d: mask.mask_documents(shared(s, d, _MAIL), Config(mode="anonymize")).select("id", "masked", F.exists("mapping", lambda m: m["reversible"]).alias("reversible")), f"SELECT id, {_masked} AS masked, false AS reversible FROM ({_MAIL})")
add("pii_mask_passthrough", lambda s, d: mask.mask_documents(shared(s, d, _MAIL), Config().with_control(Control().toggled())).select("id", "masked"), f"SELECT id, text AS masked FROM ({_MAIL})")
add("pii_mask_label_collision", lambda s, d: mask.mask_documents(shared(s, d, _EMP), Config(categories=("EMAIL",), custom_categories=(CustomCategory("CODE", label=_LABEL, patterns=("EMP-[0-9]{4}",)), CustomCategory("PRJ", placeholder=_LABEL, patterns=("PRJ-[0-9]+",))))).select("id", "masked"), f"SELECT id, regexp_replace(regexp_replace(text, 'EMP-[0-9]{{4}}', '[{_LABEL}B]'), 'PRJ-[0-9]+', '[{_LABEL}A]') AS masked FROM ({_EMP})")
add("pii_redact_native", lambda s, d: shared(s, d, DOCS).select("id", F.sha2(splice(F.col("text"), resolve(pattern_spans("text", BY_NAME["P14"])), lambda x: F.lit("[IP]")), 256).alias("sha")), f"SELECT doc_id AS id, sha256(regexp_replace(text, {O.quoted(BY_NAME['P14'].re2)}, '[IP]', 'g')) AS sha FROM documents")


def _round_trip(spark: SparkSession, d: str) -> DataFrame:
    masked = mask.mask_documents(shared(spark, d, DOCS), Config(categories=CATEGORIES))
    originals = F.map_from_entries(F.transform("mapping", lambda m: F.struct(m["placeholder"], m["original"])))
    return masked.select("id", F.sha2(restore_column(F.col("masked"), originals), 256).alias("sha"))


add("pii_mask_restore_documents", _round_trip, "SELECT doc_id AS id, sha256(text) AS sha FROM documents")
_TURNS = "SELECT conv_id, turn, concat(text, ' mail u', cast(turn % 3 as string), '@c', cast(conv_id as string), '.example') AS text FROM conversations"
_first = "SELECT conv_id, concat('u', cast(turn % 3 as string), '@c', cast(conv_id as string), '.example') AS original, min(turn) AS t FROM conversations GROUP BY ALL"
_numbered = f"SELECT conv_id, original, row_number() OVER (PARTITION BY conv_id ORDER BY t) AS seq FROM ({_first})"
_MAIL_ONLY = Config(categories=("EMAIL",))
add("pii_mask_sessions", lambda s, d: mask.mask_sessions(shared(s, d, _TURNS), "conv_id", ["turn"], _MAIL_ONLY)[0].select("conv_id", "turn", F.regexp_extract("masked", r"(\[[^\[\]]*\])$", 1).alias("token")), f"SELECT c.conv_id, c.turn, concat('[{_LABEL}', chr(CAST(64 + seq AS INT)), ']') AS token FROM conversations c JOIN ({_numbered}) n ON n.conv_id = c.conv_id AND n.original = concat('u', cast(c.turn % 3 as string), '@c', cast(c.conv_id as string), '.example')")
add("pii_session_mapping", lambda s, d: mask.mask_sessions(shared(s, d, _TURNS), "conv_id", ["turn"], _MAIL_ONLY)[1].select("conv_id", "original", F.col("seq").cast("int").alias("seq"), "placeholder"), f"SELECT conv_id, original, CAST(seq AS INT) AS seq, concat('[{_LABEL}', chr(CAST(64 + seq AS INT)), ']') AS placeholder FROM ({_numbered})")
add("pii_mask_sessions_exact", lambda s, d: mask.mask_sessions_exact(shared(s, d, _TURNS), "conv_id", ["turn"], _MAIL_ONLY).select("conv_id", "turn", F.regexp_extract("masked", r"(\[[^\[\]]*\])$", 1).alias("token")), _oracles["pii_mask_sessions"])


def _sessions_restored(spark: SparkSession, d: str) -> DataFrame:
    masked, mapping = mask.mask_sessions(shared(spark, d, _TURNS), "conv_id", ["turn"], _MAIL_ONLY)
    return mask.restore(masked.select("conv_id", "turn", "masked"), mapping, "conv_id", "masked").select("conv_id", "turn", F.col("restored").alias("text"))


add("pii_restore_sessions", _sessions_restored, _TURNS)
add("pii_restore_nested_token", lambda s, d: shared(s, d, customers(text_of("=[[人名A] [人名B] x", K))).select("id", restore_column(F.col("text"), F.create_map(F.lit("[人名A]"), F.lit("[人名B]"))).alias("restored")), "SELECT c_custkey AS id, concat('[[人名B] [人名B] x', c_custkey) AS restored FROM customer")
#: SQL of ``letters``: the k-th letter from the right is there from the first number on that has more than k letters; 13 letters number any long that occurs.
_LETTERS = " || ".join(f"CASE WHEN id > {sum(26**j for j in range(1, k + 1))} THEN chr(CAST(65 + ((id - 1 - {sum(26**j for j in range(1, k + 1))}) // {26**k}) % 26 AS INT)) ELSE '' END" for k in range(12, -1, -1))
add("pii_placeholder_letters", lambda s, d: shared(s, d, "SELECT c_custkey + 1 AS id FROM customer").select("id", letters_column(F.col("id")).alias("letters")), f"SELECT id, {_LETTERS} AS letters FROM (SELECT c_custkey + 1 AS id FROM customer)")
add("pii_audit_events", lambda s, d: mask.audit_events(mask.mask_documents(shared(s, d, _MAIL), Config()), ["id"], Config()).select("id", "category", "placeholder", "confidence", F.col("position.start").alias("start_at"), F.col("position.end").alias("end_at"), "mode", "reviewRequired"), f"SELECT id, 'EMAIL' AS category, CASE WHEN value[1] = 'b' THEN '[{_LABEL}B]' ELSE '[{_LABEL}A]' END AS placeholder, CAST(1 AS DOUBLE) AS confidence, start_at, end_at, 'pseudonymize' AS mode, false AS \"reviewRequired\" FROM ({O.pattern_spans(_MAIL, 'P2')})")
_REVIEW = customers(text_of("=secret of 田中さん ", K))
add("pii_audit_review", lambda s, d: mask.audit_events(mask.mask_documents(shared(s, d, _REVIEW), Config(dictionary=(DictionaryEntry("secret", "ORG"),))), ["id"], Config()).groupBy("category").agg(F.count("*").alias("n"), F.count_if("reviewRequired").alias("to_review")), "SELECT unnest(['ORG', 'NAME']) AS category, count(*) AS n, CAST(0 AS BIGINT) AS to_review FROM customer GROUP BY 1")

# Sessions and headers.
_EVENTS = "SELECT event_id, user_id, ts, event_type FROM events"
_starts = "CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE {} THEN 1 ELSE 0 END"
_sql = "SELECT event_id, user_id, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM (SELECT *, " + _starts + " AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
_ordered = lambda s, d: shared(s, d, "SELECT event_id, user_id, ts, event_type FROM events")
add("pii_sessionize", lambda s, d: sessions.sessionize(_ordered(s, d), "user_id", "ts").select("event_id", "user_id", "session_no"), _sql.format(""))
add("pii_sessionize_reset", lambda s, d: sessions.sessionize(_ordered(s, d), "user_id", "ts", F.col("event_type") == "click").select("event_id", "user_id", "session_no"), _sql.format("OR event_type = 'click'"))
_HEADERS = f"SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN concat(' s', cast(c_custkey % 7 as string), ' ') ELSE ' ' END AS h1, CASE WHEN c_custkey % 2 = 0 THEN concat('t', cast(c_custkey % 5 as string)) END AS h2, concat('c', cast(c_custkey % 11 as string)) AS conn FROM customer"
add("pii_session_keys", lambda s, d: shared(s, d, _HEADERS).select("id", sessions.session_key(F.create_map(F.lit("x-pii-session-id"), F.col("h1"), F.lit("x-session-id"), F.col("h2")), F.col("conn")).alias("session")), f"SELECT id, coalesce('id:' || nullif(trim(h1), ''), 'id:' || h2, 'connection:' || conn) AS session FROM ({_HEADERS})")
_ROUTES = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'GET' ELSE 'POST' END AS method, CASE o_orderkey % 4 WHEN 0 THEN '/v1/messages?beta=1' WHEN 1 THEN '/v1/chat/completions' WHEN 2 THEN '/v1/models' ELSE '/health' END AS url, CASE o_orderkey % 5 WHEN 0 THEN ' OpenAI ' WHEN 1 THEN 'other' END AS wish FROM orders"
add("pii_routing", lambda s, d: shared(s, d, _ROUTES).select("id", routing.provider(F.col("url"), F.col("wish")).alias("provider"), routing.is_filtered(F.col("method"), F.col("url")).alias("filtered")), f"SELECT id, CASE WHEN split_part(url, '?', 1) = '/v1/messages' THEN 'anthropic' WHEN split_part(url, '?', 1) = '/v1/chat/completions' OR lower(trim(wish)) = 'openai' THEN 'openai' ELSE 'anthropic' END AS provider, method = 'POST' AND split_part(url, '?', 1) IN ('/v1/messages', '/v1/chat/completions') AS filtered FROM ({_ROUTES})")


def _control(spark: SparkSession, d: str) -> DataFrame:
    config = Config(custom_categories=(CustomCategory("PROJECT"),)).with_control(Control().disable("EMAIL").disable("SSN"))
    return spark.createDataFrame([(c,) for c in config.active], "category string")


add("pii_active_categories", _control, "SELECT unnest([" + ", ".join(f"'{c}'" for c in CATEGORIES if c not in ("EMAIL", "SSN", "URL_USER")) + ", 'PROJECT']) AS category")

# Request bodies, streams, the language-model stage's fixed parts.
_BODY = """SELECT c_custkey AS id, concat('{"model":"m","system":"sys u', cast(c_custkey as string), '@x.example","messages":[{"role":"user","content":"hi a', cast(c_custkey as string), '@x.example"},{"role":"assistant","content":[{"type":"text","text":"ok"},{"type":"tool_use","input":{"path":"b', cast(c_custkey as string), '@x.example","n":3}},{"type":"tool_result","content":[{"type":"text","text":"deep"}]}]}]}') AS body FROM customer"""
add("pii_json_leaves", lambda s, d: shared(s, d, _BODY).select("id", F.explode(content.leaves(F.col("body"))).alias("x")).select("id", "x.section", F.col("x.msg_idx").cast("int").alias("msg_idx"), "x.path", "x.role", F.col("x.text").alias("value")), " UNION ALL ".join(f"SELECT id, '{a}' AS section, CAST({b} AS INT) AS msg_idx, '{c}' AS path, {e} AS role, json_extract_string(body, '{f}') AS value FROM ({_BODY})" for a, b, c, e, f in (("system", -1, "system", "NULL", "$.system"), ("messages", 0, "content", "'user'", "$.messages[0].content"), ("messages", 1, "content.0.text", "'assistant'", "$.messages[1].content[0].text"), ("messages", 1, "content.1.input.path", "'assistant'", "$.messages[1].content[1].input.path"), ("messages", 1, "content.2.content.0.text", "'assistant'", "$.messages[1].content[2].content[0].text"))))
_body_masked = f"replace(replace(replace(body, concat('u', id, '@x.example'), '[{_LABEL}A]'), concat('a', id, '@x.example'), '[{_LABEL}B]'), concat('b', id, '@x.example'), '[{_LABEL}C]')"
add("pii_mask_requests", lambda s, d: content.mask_requests(shared(s, d, _BODY), Config()).select("id", "masked"), f"SELECT id, {_body_masked} AS masked FROM ({_BODY})")


def _responses(spark: SparkSession, d: str) -> DataFrame:
    masked = content.mask_requests(shared(spark, d, _BODY), Config())
    originals = F.map_from_entries(F.transform("mapping", lambda m: F.struct(m["placeholder"], m["original"])))
    return masked.select("id", content.restore_json(F.col("masked"), originals).alias("body"))


add("pii_restore_json", _responses, _BODY)
_SSE = """SELECT c_custkey AS id, concat('data: {"choices":[{"index":0,"delta":{"content":"hello [EM"}}]}', chr(10), chr(10), 'data: {"choices":[{"index":0,"delta":{"content":"AIL', cast(c_custkey as string), '] bye [x"}}]}', chr(10), chr(10), 'data: [DONE]', chr(10), chr(10)) AS body FROM customer"""


def _chunks(spark: SparkSession, d: str, base: str = _SSE, provider: str = "openai") -> DataFrame:
    """Bodies cut in three at places that depend on the row."""
    cut = (F.col("id") % 90 + 5).cast("int")
    parts = F.array(F.substring("body", F.lit(1), cut), F.substring(F.col("body"), cut + 1, F.lit(40)), F.substring(F.col("body"), cut + 41, F.length("body")))
    rows = shared(spark, d, base).select("id", F.posexplode(parts).alias("seq", "chunk"))
    originals = F.create_map(F.concat(F.lit("[EMAIL"), F.col("id").cast("string"), F.lit("]")), F.concat(F.lit("u"), F.col("id").cast("string"), F.lit("@x.example")))
    return rows.select(F.col("id").cast("string").alias("stream_id"), "seq", F.lit(provider).alias("provider"), "chunk", (F.col("seq") == 2).alias("last"), originals.alias("originals"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    done = restore_chunks(_chunks(spark, d))
    return done.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "restored"))), lambda x: x["restored"]), "").alias("restored"))


add("pii_restore_stream_chunks", _stream, """SELECT CAST(c_custkey AS VARCHAR) AS stream_id, concat('data: {"choices":[{"index":0,"delta":{"content":"hello "}}]}', chr(10), chr(10), 'data: {"choices":[{"index":0,"delta":{"content":"u', c_custkey, '@x.example bye "}}]}', chr(10), chr(10), 'data: {"choices":[{"index":0,"delta":{"content":"[x"}}]}', chr(10), 'data: [DONE]', chr(10), chr(10)) AS restored FROM customer""")
add("pii_sse_events", lambda s, d: events_of(_chunks(s, d)).select("stream_id", F.col("event_no").cast("int").alias("event_no"), "event"), f"SELECT CAST(id AS VARCHAR) AS stream_id, CAST(i - 1 AS INT) AS event_no, string_split(body, chr(10) || chr(10))[i] AS event FROM (SELECT id, body, unnest([1, 2, 3]) AS i FROM ({_SSE}))")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    answer = lambda t: '```json\n[{"text": "田中様", "category": "NAME", "block": 0}, {"text": "http://x", "category": "ORG", "block": 0}]\n```'
    return rows_of(shared(spark, d, customers(text_of("=田中と", K, "=、田中"))), span_udf(lambda t: parse_detections(answer(t), [(0, t)]))(F.col("text")), category=True)


add("pii_provider_answers", _answers, "SELECT c_custkey AS id, '田中' AS value, 'NAME' AS category, unnest([CAST(0 AS INT), CAST(4 + length(CAST(c_custkey AS VARCHAR)) AS INT)]) AS start_at, unnest([CAST(2 AS INT), CAST(6 + length(CAST(c_custkey AS VARCHAR)) AS INT)]) AS end_at FROM customer")


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("array<int>")
    def sizes(texts):
        return texts.map(lambda ts: [len(c) for c in chunk_blocks(list(enumerate(ts)))])

    rows = shared(spark, d, "SELECT c_custkey AS id FROM customer")
    made = F.transform(F.sequence(F.lit(1), (F.col("id") % 7 + 1).cast("int")), lambda _: F.repeat(F.lit("x"), 1000))
    return rows.select("id", sizes(made).alias("sizes")).select("id", F.size("sizes").cast("int").alias("n_chunks"), F.element_at("sizes", -1).alias("last"))


add("pii_provider_chunks", _blocks, "SELECT c_custkey AS id, CAST((c_custkey % 7 + 1 + 2) // 3 AS INT) AS n_chunks, CAST((c_custkey % 7) % 3 + 1 AS INT) AS last FROM customer")


def _stripped(spark: SparkSession, d: str) -> DataFrame:
    return shared(spark, d, f"SELECT c_custkey AS id, concat({_SURNAME}, {_TITLE}) AS text FROM customer").select("id", strip_honorific_column(F.col("text")).alias("name"))


add("pii_strip_honorific", _stripped, f"SELECT c_custkey AS id, {_SURNAME} AS name FROM customer")


# Sessions over request bodies, in batch and as a stream; half of all requests are of one session.
_REQUESTS = f"""SELECT event_id AS id, ts, CASE WHEN user_id % 2 = 0 THEN 's0' WHEN user_id % 3 = 0 THEN concat('s', cast(user_id % 5 as string)) END AS sid, concat('c', cast(user_id % 4 as string)) AS conn_id, event_type = 'signup' AND event_id % 4 = 0 AS resets, concat('a', cast(event_id % 5 as string), '@x.example') AS a, concat('b', cast(event_id % 7 as string), '@y.example') AS b, concat('{{"messages":[{{"role":"user","content":"to a', cast(event_id % 5 as string), '@x.example and b', cast(event_id % 7 as string), '@y.example, not [{_LABEL}A]"}}]}}') AS body FROM events"""
_EPOCHS = f"""k AS (SELECT *, coalesce('id:' || sid, 'connection:' || conn_id) AS session FROM ({_REQUESTS})),
e AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR (sid IS NOT NULL AND ts - lag(ts) OVER w >= INTERVAL 30 MINUTE) OR resets THEN 1 ELSE 0 END AS n FROM k WINDOW w AS (PARTITION BY session ORDER BY ts, id)),
r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY session ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM e),
f AS (SELECT session, epoch, original, min({{'ts': ts, 'id': id, 'place': place}}) AS first FROM (SELECT session, epoch, ts, id, 1 AS place, b AS original FROM r UNION ALL SELECT session, epoch, ts, id, 2, a FROM r) GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY session, epoch ORDER BY first) AS seq FROM f)"""
_SESSION_MASKED = f"WITH {_EPOCHS} SELECT r.id, r.session, r.epoch, replace(replace(r.body, r.a, concat('[{_LABEL}', chr(CAST(64 + x.seq AS INT)), ']')), r.b, concat('[{_LABEL}', chr(CAST(64 + y.seq AS INT)), ']')) AS masked FROM r JOIN m x ON x.session = r.session AND x.epoch = r.epoch AND x.original = r.a JOIN m y ON y.session = r.session AND y.epoch = r.epoch AND y.original = r.b"


def _headed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("headers", F.create_map(F.lit("x-pii-session-id"), F.col("sid"), F.lit("x-pii-session-reset"), F.when(F.col("resets"), F.lit("true"))))


add("pii_session_requests", lambda s, d: content.mask_session_requests(_headed(shared(s, d, _REQUESTS)), ["id"], _MAIL_ONLY)[0].select("id", "session", "epoch", "masked"), _SESSION_MASKED)
add("pii_session_requests_mapping", lambda s, d: content.mask_session_requests(_headed(shared(s, d, _REQUESTS)), ["id"], _MAIL_ONLY)[1].select("session", "epoch", "original", "seq", "placeholder"), f"WITH {_EPOCHS} SELECT session, epoch, original, CAST(seq AS INT) AS seq, concat('[{_LABEL}', chr(CAST(64 + seq AS INT)), ']') AS placeholder FROM m")


def _request_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same requests as a stream whose sessions live in state; its output is a table that is read again."""
    where = f"{shared_folder(spark)}/hushframe-stream-{uuid.uuid4().hex[:12]}"
    shared(spark, d, "SELECT * FROM events")
    schema = spark.table("events").schema
    spark.readStream.schema(schema).parquet(f"{d}/[e]vents.parquet").createOrReplaceTempView("event_stream")
    masked = mask_request_stream(_headed(spark.sql(_REQUESTS.replace("FROM events", "FROM event_stream"))), ["id"], _MAIL_ONLY)
    changed = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        masked.select("id", "session", "epoch", "masked").writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema("id long, session string, epoch long, masked string").parquet(f"{where}/out")


add("pii_session_requests_stream", _request_stream, _SESSION_MASKED)

# One session that has most of a table's values: numbered over slices, restored by joining tokens.
_SOLD = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 3 ELSE -1 END AS session, concat('order ', cast(o_orderkey as string), ' of u', cast(o_custkey as string), '@x.example and o', cast(o_orderkey as string), '@y.example') AS text FROM orders"
_SOLD_VALUES = f"SELECT session, original, min(pos) AS first FROM (SELECT session, regexp_extract(text, 'o[0-9]+@y.example') AS original, id * 2 AS pos FROM ({_SOLD}) UNION ALL SELECT session, regexp_extract(text, 'u[0-9]+@x.example'), id * 2 + 1 AS pos FROM ({_SOLD})) GROUP BY ALL"
add("pii_number_hot_session", lambda s, d: mask.mask_sessions(shared(s, d, _SOLD), "session", ["id"], _MAIL_ONLY)[1].select("session", "original", "seq"), f"SELECT session, original, CAST(row_number() OVER (PARTITION BY session ORDER BY first) AS INT) AS seq FROM ({_SOLD_VALUES})")


def _hot_restored(spark: SparkSession, d: str) -> DataFrame:
    masked, mapping = mask.mask_sessions(shared(spark, d, _SOLD), "session", ["id"], _MAIL_ONLY)
    sent = masked.select("id", "session", F.concat(F.col("masked"), F.lit(" [unknown] [["), F.col("masked")).alias("reply"))
    return mask.restore(sent, mapping, "session", "reply").select("id", "session", "restored")


add("pii_restore_hot_session", _hot_restored, f"SELECT id, session, concat(text, ' [unknown] [[', text) AS restored FROM ({_SOLD})")

# Dictionaries that are tables.
_WORD = r"[\p{L}\p{N}_]+"


def _terms(spark: SparkSession, d: str) -> DataFrame:
    """Every word of the benchmark's passages, as an entry that stands alone and keeps its case."""
    words = spark.read.parquet(f"{d}/benchmark.parquet").select(F.explode(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).alias("text")).distinct()
    return words.select("text", F.lit("TERM").alias("category"), F.lit(True).alias("exact"), F.lit(True).alias("case_sensitive"))


add("pii_dictionary_table", lambda s, d: rows_of(shared(s, d, DOCS), dictionary_column(F.col("text"), stored_dictionary(_terms(s, d)))), f"SELECT w.id, w.value, CAST(w.e - length(w.value) AS INT) AS start_at, CAST(w.e AS INT) AS end_at FROM (SELECT id, value, sum(length(gap) + length(value)) OVER (PARTITION BY id ORDER BY i) AS e FROM (SELECT doc_id AS id, unnest(regexp_extract_all(text, {O.quoted(_WORD)})) AS value, unnest(string_split_regex(text, {O.quoted(_WORD)})[1:len(regexp_extract_all(text, {O.quoted(_WORD)}))]) AS gap, unnest(range(1, len(regexp_extract_all(text, {O.quoted(_WORD)})) + 1)) AS i FROM documents)) w JOIN (SELECT DISTINCT unnest(regexp_extract_all(text, {O.quoted(_WORD)})) AS value FROM benchmark) t ON t.value = w.value")
_BUYERS = "SELECT o_orderkey AS id, concat('Sold to CUSTOMER#', lpad(cast(o_custkey as string), 9, '0'), ', not customer#', lpad(cast(o_orderkey as string), 10, '0'), ' or xCustomer#000000001; Customer#', lpad(cast(o_orderkey * 7 % 200000 as string), 9, '0'), '.') AS text FROM orders"


def _names(spark: SparkSession, d: str) -> StoredDictionary:
    """Names of all customers and parts; small shards, so that a task takes several."""
    rows = shared(spark, d, "SELECT c_name AS text, 'CUSTOMER' AS category, true AS exact FROM customer").unionByName(spark.read.parquet(f"{d}/part.parquet").selectExpr("p_name AS text", "'PART' AS category", "false AS exact"))
    return stored_dictionary(rows, shard_chars=200_000)


add("pii_dictionary_names", lambda s, d: rows_of(analyze(shared(s, d, _BUYERS), Config(categories=(), heuristic_ner=False), dictionary=_names(s, d)), F.col("spans"), category=True), f"SELECT id, value, 'CUSTOMER' AS category, start_at, end_at FROM (SELECT id, g AS value, s AS start_at, CAST(s + length(g) AS INT) AS end_at, substr(t, s, 1) AS before, substr(t, s + length(g) + 1, 1) AS after FROM ({O.matches(_BUYERS, '(?i)customer#[0-9]{9}')})) JOIN customer ON lower(c_name) = lower(value) WHERE NOT regexp_matches(before, '[a-z0-9]') AND NOT regexp_matches(after, '[0-9]')")
add("pii_dictionary_names_masked", lambda s, d: mask.mask_documents(shared(s, d, _BUYERS), Config(categories=("CUSTOMER", "PART"), heuristic_ner=False), dictionary=_names(s, d)).select("id", F.size("mapping").cast("int").alias("n_values")), f"SELECT o_orderkey AS id, CAST((o_custkey < n) AS INT) + CAST((o_orderkey * 7 % 200000 < n) AS INT) AS n_values FROM orders, (SELECT count(*) AS n FROM customer)")

# Allowlists that are tables, after resolution; spans that another table's overlap.
_ALLOWED = "SELECT concat('a', cast(c_custkey as string), '@x.example') AS value FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'b1@y.example'"
_KEPT = f"SELECT * FROM ({O.pattern_spans(_MAIL, 'P2')}) WHERE value NOT IN ({_ALLOWED})"


def _allowed(limit: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = rows_of(analyze(shared(spark, d, _MAIL), Config()), F.col("spans"), category=True)
        return span_tables.without_allowed(found, shared(spark, d, _ALLOWED), broadcast_bytes=limit)

    return run


add("pii_allowlist_table", _allowed(span_tables.BROADCAST_BYTES), _KEPT)
add("pii_allowlist_table_shuffled", _allowed(0), _KEPT)
_of = lambda s, d, *names: rows_of(shared(s, d, DOCS), F.concat(*[pattern_spans("text", BY_NAME[n]) for n in names]))
_LEFT, _RIGHT = f"SELECT * FROM ({O.pattern_spans(DOCS, 'P6')}) UNION ALL SELECT * FROM ({O.pattern_spans(DOCS, 'P14')})", f"SELECT * FROM ({O.pattern_spans(DOCS, 'P3')}) UNION ALL SELECT * FROM ({O.pattern_spans(DOCS, 'P7')}) UNION ALL SELECT * FROM ({O.pattern_spans(DOCS, 'P14')})"
add("pii_spans_not_overlapped", lambda s, d: span_tables.without_overlapped(_of(s, d, "P6", "P14"), _of(s, d, "P3", "P7"), ["id"]), f"SELECT id, value, start_at, end_at FROM ({_LEFT}) l WHERE NOT EXISTS (SELECT 1 FROM ({O.pattern_spans(DOCS, 'P3')} UNION ALL {O.pattern_spans(DOCS, 'P7')}) r WHERE r.id = l.id AND r.start_at < l.end_at AND l.start_at < r.end_at)")
add("pii_overlap_pairs", lambda s, d: span_tables.overlap_pairs(_of(s, d, "P6", "P14"), _of(s, d, "P3", "P7", "P14"), ["id"]).select("id", F.col("left.value").alias("value"), F.col("right.value").alias("other"), F.col("left.start_at").alias("start_at"), F.col("right.start_at").alias("other_at")), f"SELECT l.id, l.value, r.value AS other, l.start_at, r.start_at AS other_at FROM ({_LEFT}) l JOIN ({_RIGHT}) r ON r.id = l.id AND r.start_at < l.end_at AND l.start_at < r.end_at")


# Language-model calls over many texts; table functions; the audit log; inputs and rates.
def _model(blocks: list[tuple[int, str]]) -> str:
    """Stands for a model: names what is before a title, in each block."""
    found = [(k, m) for k, text in blocks for m in re.findall(r"client (\w+)様", text)]
    return "```json\n" + json.dumps([{"text": f"{name}様", "category": "NAME", "block": k} for k, name in found] + [{"text": "http://x", "category": "ORG", "block": 0}]) + "\n```"


_TALKS = "SELECT conv_id, turn, concat(text, ' client Kunde', cast(conv_id % 7 as string), '様, Kunde', cast(conv_id % 7 as string)) AS text FROM conversations"
add("pii_provider_table", lambda s, d: provider_table(shared(s, d, _TALKS), ["conv_id", "turn"], _model, ("NAME",)).select("conv_id", "turn", F.explode("spans").alias("x")).select("conv_id", "turn", F.col("x.text").alias("value"), F.col("x.start").alias("start_at")), "SELECT conv_id, turn, concat('Kunde', conv_id % 7) AS value, unnest([CAST(length(text) + 8 AS INT), CAST(length(text) + 17 AS INT)]) AS start_at FROM conversations")
_PLEAS = f"""SELECT c_custkey AS id, concat('{{"system":"client Nobody様","messages":[{{"role":"user","content":"client Kunde', cast(c_custkey as string), '様 a', cast(c_custkey as string), '@x.example"}},{{"role":"user","content":[{{"type":"text","text":"again Kunde', cast(c_custkey as string), ' and client Gast様"}}]}}]}}') AS body FROM customer"""
_NAMES_ONLY = Config(categories=("EMAIL", "NAME"), heuristic_ner=False, provider_enabled=True)
add("pii_provider_requests", lambda s, d: content.mask_requests_with_provider(shared(s, d, _PLEAS), ["id"], _model, _NAMES_ONLY).select("id", "masked", F.size("mapping").cast("int").alias("n_values")), f"SELECT id, replace(replace(replace(body, concat('client Kunde', id, '様'), 'client [{LABELS['NAME']}A]様'), concat('a', id, '@x.example'), '[{_LABEL}A]'), 'client Gast様', 'client [{LABELS['NAME']}B]様') AS masked, CAST(3 AS INT) AS n_values FROM ({_PLEAS})")


def _lateral(spark: SparkSession, d: str) -> DataFrame:
    table_functions.register(spark, plugins=(_Projects,))
    shared(spark, d, _EMP).createOrReplaceTempView("plugin_texts")
    return spark.sql("SELECT id, d.value, d.category, d.start_at, d.end_at FROM plugin_texts, LATERAL detect_plugins(text) d")


add("pii_plugin_lateral", _lateral, _oracles["pii_plugin"])


def _partitioned(spark: SparkSession, d: str) -> DataFrame:
    table_functions.register(spark, _MAIL_ONLY)
    shared(spark, d, _TURNS).createOrReplaceTempView("session_turns")
    return spark.sql(r"SELECT conv_id, turn, regexp_extract(masked, '(\\[[^\\[\\]]*\\])$', 1) AS token FROM mask_session(TABLE(session_turns) PARTITION BY conv_id ORDER BY turn)")


add("pii_mask_sessions_sql", _partitioned, _oracles["pii_mask_sessions"])


def _audit_log(spark: SparkSession, d: str) -> DataFrame:
    """Written twice, as by a micro-batch that is repeated, and read back."""
    path = f"{shared_folder(spark)}/hushframe-audit-{uuid.uuid4().hex[:12]}"
    events = stored(mask.audit_events(mask.mask_documents(shared(spark, d, _MAIL), Config()), ["id"], Config()), "audit")
    for _ in range(2):
        requests.write_audit(events, path, 0)
    log = requests.read_audit(spark, path)
    return log.select("category", "placeholder", F.col("position.start").alias("start_at"), F.col("position.end").alias("end_at"), "mode", F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$").alias("dated"))


add("pii_audit_log", _audit_log, f"SELECT 'EMAIL' AS category, CASE WHEN value[1] = 'b' THEN '[{_LABEL}B]' ELSE '[{_LABEL}A]' END AS placeholder, start_at, end_at, 'pseudonymize' AS mode, true AS dated FROM ({O.pattern_spans(_MAIL, 'P2')})")
_MIXED = """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN concat('{"text":"order ', cast(o_orderkey as string), '"}') WHEN 1 THEN '{"text":5}' WHEN 2 THEN '[1]' WHEN 3 THEN '{"text":' WHEN 4 THEN '{}' END AS body FROM orders"""
add("pii_requests_accepted", lambda s, d: requests.split_valid(shared(s, d, _MIXED))[0].select("id", requests.valid_analyze_input(F.col("body")).alias("analyzable")), f"SELECT id, id % 6 = 0 AS analyzable FROM ({_MIXED}) WHERE id % 6 IN (0, 1, 4)")
add("pii_requests_rejected", lambda s, d: requests.split_valid(shared(s, d, _MIXED))[1].select("id", "error"), f"SELECT id, 'Invalid JSON body' AS error FROM ({_MIXED}) WHERE id % 6 IN (2, 3, 5)")
_SOME = Config(allowlist=("b1@y.example",))
_items = lambda df: df.withColumns({"redact": F.array(F.concat(F.lit("a"), F.col("id").cast("string"), F.lit("@x.example")), F.concat(F.lit("b"), (F.col("id") % 3).cast("string"), F.lit("@y.example"))), "keep": F.array(F.lit("again"), F.lit("@x.example"), F.lit("to "))})
add("pii_redaction_rates", lambda s, d: reports.rates(_items(mask.mask_documents(shared(s, d, _MAIL), _SOME)).withColumn("part", F.col("id") % 2), "masked", "redact", "keep", "part"), f"SELECT id % 2 AS part, 1 - sum(CAST(id % 3 = 1 AS INT)) / sum(2) AS redacted, 1 - sum(1) / sum(3) AS kept FROM ({_MAIL}) GROUP BY 1")
_BLOCK_SSE = """SELECT c_custkey AS id, concat('event: content_block_delta', chr(10), 'data: {"type":"content_block_delta","index":0,"delta":{"type":"text_delta","text":"hello [EM"}}', chr(10), chr(10), 'event: content_block_delta', chr(10), 'data: {"type":"content_block_delta","index":0,"delta":{"type":"text_delta","text":"AIL', cast(c_custkey as string), '] bye"}}', chr(10), chr(10), 'event: message_stop', chr(10), 'data: {"type":"message_stop"}', chr(10), chr(10)) AS body FROM customer"""


def _events_stream(spark: SparkSession, d: str) -> DataFrame:
    done = restore_chunks(_chunks(spark, d, _BLOCK_SSE, "anthropic"))
    return done.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "restored"))), lambda x: x["restored"]), "").alias("restored"))


add("pii_restore_stream_anthropic", _events_stream, f"""SELECT CAST(id AS VARCHAR) AS stream_id, replace(replace(body, '"text":"hello [EM"', '"text":"hello "'), concat('AIL', id, '] bye'), concat('u', id, '@x.example bye')) AS restored FROM ({_BLOCK_SSE})""")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
