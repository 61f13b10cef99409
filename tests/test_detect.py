"""Golden rows of the detectors; the built-in expressions and the Python form must agree on every one."""

import pytest

from hushframe.config import Config, CustomCategory, CustomPattern, DictionaryEntry
from hushframe.functions.categories import CATEGORIES
from hushframe.functions.detect import Detector, iban, luhn, my_number, select
from hushframe.functions.ner_data import SURNAMES
from hushframe.operators.analyze import analyze

ALL = Config(categories=CATEGORIES)
# text, category, what is found (None: nothing of that category)
GOLDEN = [
    ("IBAN: GB29 NWBK 6016 1331 9268 19", "IBAN", "GB29 NWBK 6016 1331 9268 19"),
    ("IBAN: GB29 NWBK 6016 1331 9268 18", "IBAN", None),
    ("金融機関コード: 0001 支店コード: 001 口座番号: 1234567", "BANK_ACCOUNT", "金融機関コード: 0001 支店コード: 001 口座番号: 1234567"),
    ("免許証番号: 12-3456-7890-12", "DRIVER_LICENSE", "12-3456-7890-12"),
    ("パスポート番号: AB1234567", "PASSPORT", "AB1234567"),
    ("ETH: 0x742d35Cc6634C0532925a3b844Bc454e4438f44e", "CRYPTO_WALLET", "0x742d35Cc6634C0532925a3b844Bc454e4438f44e"),
    ("生年月日: 1990年4月1日", "DATE_TIME", "1990年4月1日"),
    ("Birthday: April 1, 1990", "DATE_TIME", "April 1, 1990"),
    ("release date 2026-07-02", "DATE_TIME", None),
    ("健康保険証番号: 12345678", "HEALTH_INSURANCE", "12345678"),
    ("被保険者番号: 13-ABC-123456", "HEALTH_INSURANCE", "13-ABC-123456"),
    ("医師免許証番号: 123456", "MEDICAL_RECORD", "123456"),
    ("個人番号: 123456789018", "MY_NUMBER", "123456789018"),
    ("個人番号: 123456789012", "MY_NUMBER", None),
    ("+81-90-1111-2222", "PHONE", "+81-90-1111-2222"),
    ("SSN: 123-45-6789", "SSN", "123-45-6789"),
    ("Server: 192.168.1.100", "IP_ADDRESS", "192.168.1.100"),
    ("住所: 〒100-0001", "POSTAL_CODE", "〒100-0001"),
    ("Card: 4532015112830366", "CREDIT_CARD", "4532015112830366"),
    ("Card: 4532015112830366", "PHONE", None),
    ("田中0901111222です", "PHONE", "0901111222"),
    ("田中さんと打ち合わせ", "NAME", "田中"),
    ("山田太郎です", "NAME", "山田太郎"),
    ("氏名: 珍名一郎", "NAME", "珍名一郎"),
    ("皆さん", "NAME", None),
    ("お客さんは", "NAME", None),
    ("株式会社テストコーポと契約", "ORG", "株式会社テストコーポ"),
    ("Acme Widgets Inc. に発注", "ORG", "Acme Widgets Inc"),
    ("私立高校に通う", "SCHOOL", None),
    ("桜丘高等学校", "SCHOOL", "桜丘高等学校"),
    ("東都大学の個別事例", "SCHOOL", "東都大学"),
    ("東都大学の個別事例", "NAME", None),
    ("Taro Yamada <taro@example.com>", "NAME", "Taro Yamada"),
    ("Author: Author <x>", "NAME", "Author"),
    ("", "NAME", None),
    (" 　\n", "NAME", None),
]
MORE = ["住所詳細: 三丁目12番地5号、1-2-3 サンプルマンション 405号室", "[田中さん] 鈴木一郎さん 佐々木花子。山田 たろう、田中です 王様 看護師さん 高橋部長", "東京都千代田区丸の内1-2-3 東京タワー 101号室", "大学院大学と国際大学院大学に 東都短期大学へ 東京大学教授", "合同会社会福祉法人てすと (株)甲乙 ㈱甲乙㈲丙丁株式会社", "https://user:pass@host.example.com/x 2001:0db8:85a3:0000:0000:8a2e:0370:7334 555-7209 +1 (487) 555-7209", "😀 a@b.co 😀 0312345678 x" * 3]


@pytest.fixture(scope="module")
def analyzed(spark):
    texts = sorted({g[0] for g in GOLDEN} | set(MORE))
    rows = analyze(spark.createDataFrame([(t,) for t in texts], "text string"), ALL).collect()
    return {r["text"]: [tuple(s) for s in r["spans"]] for r in rows}


@pytest.mark.parametrize(("text", "category", "expected"), GOLDEN)
def test_golden(analyzed, text, category, expected):
    found = [s[0] for s in analyzed[text] if s[1] == category]
    assert found == ([] if expected is None else [expected])


def test_both_forms_agree(analyzed):
    detector = Detector(ALL)
    for text, spans in analyzed.items():
        assert spans == detector.analyze(text)
        for found, _, start, end, _ in spans:
            assert text[start:end] == found
        assert all(a[3] <= b[2] for a, b in zip(spans, spans[1:], strict=False))


def test_forms_agree_on_documents(spark, sf_dir):
    rows = analyze(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text"), ALL).collect()
    detector = Detector(ALL)
    assert rows
    for r in rows:
        assert [tuple(s) for s in r["spans"]] == detector.analyze(r["text"])


def test_checks():
    assert luhn("4532-0151-1283-0366") and not luhn("4532015112830367")
    assert iban("GB29 NWBK 6016 1331 9268 19") and not iban("GB29-NWBK-6016-1331-9268-19")
    assert my_number("1234-5678-9018") and not my_number("12345678901")


def test_resolution_prefers_left_then_long_then_first():
    assert [s[1] for s in select([("b", "B", 2, 5, 1.0), ("a", "A", 0, 3, 1.0), ("c", "C", 3, 4, 1.0), ("d", "D", 0, 3, 1.0)])] == ["A", "C"]


def test_settings(spark):
    config = Config(
        categories=("ORG",),
        custom_patterns=(CustomPattern("EMPLOYEE_ID", r"EMP-[0-9]{4}"),),
        custom_categories=(CustomCategory("CODE", dictionary=("secret",)), CustomCategory("OFF", enabled=False, dictionary=("plan",))),
        dictionary=(DictionaryEntry("abc社", "ORG", fold_width=True), DictionaryEntry("İx", "ORG")),
        allowlist=("abc社",),
        heuristic_ner=False,
    )
    text = "EMP-1234 ＡＢＣ社 abc社 Secret plan İX"
    found = [s[0] for s in analyze(spark.createDataFrame([(text,), (None,)], "text string"), config).collect()[0]["spans"]]
    assert found == ["EMP-1234", "ＡＢＣ社", "Secret", "İX"]
    assert found == [s[0] for s in Detector(config).analyze(text)]


def test_invalid_patterns_are_ignored(spark):
    config = Config(categories=(), custom_patterns=(CustomPattern("BAD", "(a"), CustomPattern("GOOD", "b+")))
    rows = analyze(spark.createDataFrame([("(a abb",)], "text string"), config).collect()
    assert [tuple(s)[:2] for s in rows[0]["spans"]] == [("bb", "GOOD")] == [s[:2] for s in Detector(config).analyze("(a abb")]


def test_spans_are_found_once(spark, sf_dir):
    """No filter with a detector in it, and a table of one file is dealt to all cores."""
    from hushframe.plans.catalog import flagship

    plan = flagship(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line.split("[")[0]]
    assert filters and not any("RLIKE" in f or "regexp" in f for f in filters) and "Repartition 4" in plan


def test_no_active_category(spark):
    assert analyze(spark.createDataFrame([("a@b.co",)], "text string"), Config(categories=())).collect()[0]["spans"] == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([("a@b.co", 1, "x")], "text string, spans int, __found string")
    assert len(analyze(df, ALL, output="pii").collect()[0]["pii"]) == 1


def test_all_surnames_of_the_reference(spark):
    """Names beyond the commonest 120: full names, and a surname alone after other Han letters."""
    cases = [("久保田健一が来た", ["久保田健一"], 1), ("内藤花子は休み", ["内藤花子"], 1), ("昨日北村さんと", ["北村"], 0.9), ("今日岸さんと", ["岸"], 0.9), ("前川様", ["前川"], 0.9)]
    rows = analyze(spark.createDataFrame([(t,) for t, _, _ in cases], "text string"), ALL).collect()
    for (text, names, sure), r in zip(cases, rows, strict=True):
        found = [s for s in r["spans"] if s["category"] == "NAME"]
        assert [s["text"] for s in found] == names and all(s["confidence"] == sure for s in found if sure < 1)
        assert [s[0] for s in Detector(ALL).analyze(text) if s[1] == "NAME"] == names
    assert len(set(SURNAMES)) == 368
