"""The detectors' regular expressions, in one notation that Java, Python and RE2 forms are made from.

The notation is what Java and Python's ``regex`` share, with marks: ``<b>`` is a word boundary
for ASCII words (``<(b>`` and ``<b)>`` where a word character follows or precedes), ``<s>`` inside a class is Unicode white space, and ``<.>`` is any character but a line end.
"""

from __future__ import annotations

from dataclasses import dataclass

# The white space and line ends that the patterns mean.
SPACE_JAVA = r"\t\n\x0B\f\r\x20\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACE_RE2 = r"\t\n\x0B\f\r\x20\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACE_CHARS = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
LINE_ENDS_JAVA = r"\n\r\u2028\u2029"
LINE_ENDS_RE2 = r"\n\r\x{2028}\x{2029}"
BEFORE_WORD, AFTER_WORD = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


@dataclass(frozen=True)
class Pattern:
    """A detector; ``needs``: literals of which a text must hold one, ``hint``: a simpler pattern that must
    be found first. Both are asked before the pattern, as they are cheap."""

    name: str
    category: str
    source: str
    group: int = 0
    check: str | None = None
    needs: tuple[str, ...] = ()
    hint: str = ""

    @property
    def java(self) -> str:
        return java(self.source)

    @property
    def re2(self) -> str:
        return re2(self.source)


def java(source: str) -> str:
    """For Spark and for Python's ``regex``."""
    return source.replace("<(b>", BEFORE_WORD).replace("<b)>", AFTER_WORD).replace("<b>", BOUNDARY).replace("<s>", SPACE_JAVA).replace("<.>", f"[^{LINE_ENDS_JAVA}]")


def re2(source: str) -> str:
    return source.replace("<(b>", r"\b").replace("<b)>", r"\b").replace("<b>", r"\b").replace("<s>", SPACE_RE2).replace("<.>", f"[^{LINE_ENDS_RE2}]").replace("\\p{script=Han}", "\\p{Han}").replace("\\p{script=Hiragana}", "\\p{Hiragana}").replace("\\p{script=Katakana}", "\\p{Katakana}")


_D, _A = "[0-9]", "[A-Za-z0-9]"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_KANJI = "[一二三四五六七八九十百千〇零0-9]+"
_AFTER = "[:：]?[<s>]*"

# The patterns, in order of precedence.
PATTERNS = (
    Pattern("P1", "API_KEY", rf"<(b>(?:sk-{_A}{{20,}}|ghp_{_A}{{36,}}|gho_{_A}{{36,}}|github_pat_[A-Za-z0-9_]{{22,}}|AKIA[0-9A-Z]{{16}}|xox[bpras]-[A-Za-z0-9\-]{{10,}}|sk-ant-[A-Za-z0-9\-]{{20,}})<b>", needs=("sk-", "ghp_", "gho_", "github_pat_", "AKIA", "xox")),
    Pattern("P2", "EMAIL", r"[A-Za-z0-9_.+\-]+@[A-Za-z0-9_\-]+\.[A-Za-z0-9_.\-]+", needs=("@",)),
    Pattern("P3", "CREDIT_CARD", r"<(b>[0-9]{4}[-<s>]?[0-9]{4}[-<s>]?[0-9]{4}[-<s>]?[0-9]{4}<b)>", check="luhn", hint=r"[0-9]{4}"),
    Pattern("P4", "MY_NUMBER", r"<(b>[0-9]{4}[-<s>][0-9]{4}[-<s>][0-9]{4}<b)>", check="my_number", hint=r"[0-9]{4}"),
    Pattern("P5", "MY_NUMBER", rf"(?:マイナンバー|個人番号){_AFTER}([0-9]{{12}}|[0-9]{{4}}[-<s>][0-9]{{4}}[-<s>][0-9]{{4}})<b)>", 1, "my_number", ("マイナンバー", "個人番号")),
    Pattern("P6", "PHONE", r"(?:\+81[-<s>]?|0)[0-9]{1,4}[-<s>]?[0-9]{1,4}[-<s>]?[0-9]{3,4}<b)>", check="phone", hint=r"0[0-9]|\+81"),
    Pattern("P7", "PHONE", r"\+[0-9]{1,3}[-<s>][0-9]{1,14}(?:[-<s>][0-9]{1,14}){0,4}<b)>", needs=("+",)),
    Pattern("P8", "ADDRESS", r"(?:北海道|東京都|(?:大阪|京都)府|<.>{2,3}県)<.>{1,8}(?:市|区|町|村|郡)<.>{1,20}?(?:[0-9]{1,4}[-ー][0-9]{1,4}(?:[-ー][0-9]{1,4})?|[一二三四五六七八九十百]+丁目)", needs=("北海道", "東京都", "府", "県")),
    Pattern("P9", "ADDRESS", rf"(?:{_KANJI}丁目)?{_KANJI}番(?:地)?(?:{_KANJI}号)?", needs=("番",)),
    Pattern("P10", "ADDRESS", r"[0-9]{1,4}[-ー][0-9]{1,4}(?:[-ー][0-9]{1,4})?[<s>]*[\p{script=Han}\p{script=Hiragana}\p{script=Katakana}A-Za-z0-9ー・\-<s>]{2,30}(?:マンション|アパート|ハイツ|コーポ|レジデンス|ビル|タワー|荘)[<s>]*[0-9]{1,4}(?:号室|号)?", needs=("マンション", "アパート", "ハイツ", "コーポ", "レジデンス", "ビル", "タワー", "荘")),
    Pattern("P11", "URL_USER", r"https?://[^<s>/@]+:[^<s>/@]+@[^<s>/]+", needs=("://",)),
    Pattern("P12", "NAME", r"(?:Author|Committer):[<s>]+(<.>+?)[<s>]+<[^>]+>", 1, needs=("Author:", "Committer:")),
    Pattern("P13", "SSN", r"<(b>(?!000|666|9[0-9]{2})[0-9]{3}[-<s>]?(?!00)[0-9]{2}[-<s>]?(?!0000)[0-9]{4}<b)>", hint=r"[0-9]{3}"),
    Pattern("P14", "IP_ADDRESS", rf"<(b>(?:{_OCTET}\.){{3}}{_OCTET}<b)>", needs=(".",), hint=r"[0-9]\.[0-9]"),
    Pattern("P15", "IP_ADDRESS", r"<(b>(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}<b)>", needs=(":",), hint=r"[0-9a-fA-F]:[0-9a-fA-F]"),
    Pattern("P16", "POSTAL_CODE", r"〒[0-9]{3}-[0-9]{4}", needs=("〒",)),
    Pattern("P17", "POSTAL_CODE", r"<(b>[0-9]{3}-[0-9]{4}(?![0-9])", needs=("-",), hint=r"[0-9]-[0-9]"),
    Pattern("P18", "IBAN", r"<(b>[A-Z]{2}[0-9]{2}(?:[-<s>]?[A-Z0-9]){11,30}<b)>", check="iban", hint=r"[A-Z]{2}[0-9]{2}"),
    Pattern("P19", "BANK_ACCOUNT", rf"(?:金融機関コード|銀行コード){_AFTER}[0-9]{{4}}[、,<s>]+(?:支店コード|支店番号){_AFTER}[0-9]{{3}}[、,<s>]+(?:口座番号){_AFTER}[0-9]{{7}}<b)>", needs=("口座番号",)),
    Pattern("P20", "BANK_ACCOUNT", rf"(?:口座番号){_AFTER}(?:普通|当座)?[<s>]*[0-9]{{7}}<b)>", needs=("口座番号",)),
    Pattern("P21", "DRIVER_LICENSE", rf"(?:運転免許証番号|免許証番号|免許番号){_AFTER}([0-9]{{12}}|[0-9]{{2}}[-<s>]?[0-9]{{4}}[-<s>]?[0-9]{{4}}[-<s>]?[0-9]{{2}})<b)>", 1, needs=("免許",)),
    Pattern("P22", "PASSPORT", rf"(?i)(?:旅券番号|パスポート番号|Passport(?: No\.| Number)?){_AFTER}([A-Z]{{2}}[0-9]{{7}}|[0-9]{{9}})<b)>", 1, hint=r"(?i)passport|旅券|パスポート"),
    Pattern("P23", "CRYPTO_WALLET", r"<(b>(?:bc1[ac-hj-np-z02-9]{11,71}|[13][a-km-zA-HJ-NP-Z1-9]{25,34}|0x[a-fA-F0-9]{40})<b)>", hint=r"bc1|0x[a-fA-F0-9]|[13][A-Za-z0-9]{25}"),
    Pattern("P24", "DATE_TIME", rf"(?:生年月日|誕生日|Birthday|DOB|Date of Birth){_AFTER}((?:[0-9]{{4}}[/.-][0-9]{{1,2}}[/.-][0-9]{{1,2}})|(?:[0-9]{{4}}年[0-9]{{1,2}}月[0-9]{{1,2}}日)|(?:[0-9]{{1,2}}[/.-][0-9]{{1,2}}[/.-][0-9]{{4}})|(?:[A-Z][a-z]+ [0-9]{{1,2}}, [0-9]{{4}})|(?:(?:明治|大正|昭和|平成|令和)[0-9]{{1,2}}年[0-9]{{1,2}}月[0-9]{{1,2}}日))", 1, needs=("生年月日", "誕生日", "Birthday", "DOB", "Date of Birth")),
    Pattern("P25", "MEDICAL_RECORD", rf"(?i)(?:診察券番号|患者番号|カルテ番号|医療記録番号){_AFTER}([A-Z0-9-]{{6,20}})<b>", 1, needs=("番号",)),
    Pattern("P26", "HEALTH_INSURANCE", rf"(?i)(?:保険証番号|健康保険証番号){_AFTER}(?:記号[<s>]*)?(?:[A-Z0-9-]{{2,12}})[、,<s>]+(?:番号[<s>]*)?(?:[A-Z0-9-]{{2,12}})", needs=("保険証番号",)),
    Pattern("P27", "HEALTH_INSURANCE", rf"(?:保険証番号|健康保険証番号){_AFTER}([0-9]{{8}})<b)>", 1, needs=("保険証番号",)),
    Pattern("P28", "HEALTH_INSURANCE", rf"(?i)(?:被保険者番号){_AFTER}([A-Z0-9-]{{6,20}})<b>", 1, needs=("被保険者番号",)),
    Pattern("P29", "MEDICAL_RECORD", rf"(?:医師免許証番号|医師免許番号){_AFTER}([0-9]{{6}})<b)>", 1, needs=("医師免許",)),
)
BY_NAME = {p.name: p for p in PATTERNS}
