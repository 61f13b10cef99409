"""Categories of personal data and their labels."""

from __future__ import annotations

# The built-in categories with the labels that placeholders show.
LABELS = {
    "EMAIL": "メールアドレス",
    "PHONE": "電話番号",
    "ADDRESS": "住所",
    "URL_USER": "認証URL",
    "API_KEY": "APIキー",
    "CREDIT_CARD": "クレジットカード",
    "MY_NUMBER": "マイナンバー",
    "NAME": "人名",
    "ORG": "組織名",
    "SCHOOL": "学校名",
    "SSN": "社会保障番号",
    "IP_ADDRESS": "IPアドレス",
    "POSTAL_CODE": "郵便番号",
    "IBAN": "IBAN",
    "BANK_ACCOUNT": "銀行口座",
    "DRIVER_LICENSE": "運転免許証",
    "PASSPORT": "パスポート",
    "CRYPTO_WALLET": "暗号資産ウォレット",
    "DATE_TIME": "生年月日",
    "MEDICAL_RECORD": "医療記録",
    "HEALTH_INSURANCE": "健康保険証",
}
CATEGORIES = tuple(LABELS)
DEFAULT_CATEGORIES = tuple(c for c in CATEGORIES if c != "URL_USER")
NER_CATEGORIES = ("NAME", "ORG", "SCHOOL")

SPAN = "struct<text: string, category: string, start: int, end: int, confidence: double>"
SPANS = f"array<{SPAN}>"
