"""The same detectors for one text in Python, for operators that go text by text: exact masking with a
session's state, streams, plugins. ``Detector`` is built once a worker; spans are plain tuples
``(text, category, start, end, confidence)`` with offsets in code points."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache

import regex

from hushframe.config import Config, DictionaryEntry
from hushframe.functions import ner as R
from hushframe.functions import ner_data as D
from hushframe.functions.automaton import EntryMatcher
from hushframe.functions.categories import NER_CATEGORIES
from hushframe.functions.dictionary import CONFIDENCE, fold
from hushframe.functions.patterns import PATTERNS, SPACE_CHARS

#: More entries than these are looked for together.
MANY_ENTRIES = 20
Span = tuple[str, str, int, int, float]
_PATTERNS = tuple((p, regex.compile(p.java)) for p in PATTERNS)
_HONORIFIC, _LABELLED = regex.compile(R.HONORIFIC), regex.compile(R.LABELLED)
_ROMAJI, _ENGLISH = regex.compile(R.ROMAJI_NAME), regex.compile(R.ENGLISH_ORG)
_AFTER, _BRACKETS = regex.compile(R.AFTER_SURNAME), regex.compile(R.BRACKETS)
_HAN_END = regex.compile(R.HAN + r"{1,3}\Z")
_ORG_START, _ORG_END = regex.compile(R.ORG_CHARS + "{2,}"), regex.compile(R.ORG_CHARS + r"{2,}\Z")
_SCHOOL_END, _SCHOOL_CHAR = regex.compile(R.SCHOOL_CHARS + r"{2,}\Z"), regex.compile(R.SCHOOL_CHARS)
_LETTER = regex.compile(r"[\p{L}\p{N}_]")
_NOT_NAME = regex.compile(f"(?:{R.alternation(D.NOT_NAMES)})\\Z")
#: Of these lists, what a text of ASCII alone may hold.
_ASCII_FORMS, _ASCII_ENDINGS = (tuple(x for x in xs if x.isascii()) for xs in (D.LEGAL_FORMS, D.SCHOOL_ENDINGS))
_SPACE = regex.compile("[" + regex.escape(SPACE_CHARS) + "]")


def is_blank(text: str | None) -> bool:
    return not (text or "").strip(SPACE_CHARS)


def luhn(text: str) -> bool:
    digits = [int(c) for c in text if c in "0123456789"][::-1]
    return (sum(digits[::2]) + sum(2 * d - 9 * (d > 4) for d in digits[1::2])) % 10 == 0


def iban(text: str) -> bool:
    plain = _SPACE.sub("", text).upper()
    if not regex.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", plain):
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def my_number(text: str) -> bool:
    digits = _SPACE.sub("", text).replace("-", "")
    if not regex.fullmatch("[0-9]{12}", digits):
        return False
    rest = sum(int(d) * w for d, w in zip(digits, (6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2), strict=False)) % 11
    return int(digits[11]) == (0 if rest <= 1 else 11 - rest)


def phone(text: str) -> bool:
    return len(_SPACE.sub("", text).replace("-", "")) >= 10


_CHECKS: dict[str | None, Callable[[str], bool]] = {"luhn": luhn, "iban": iban, "my_number": my_number, "phone": phone, None: lambda _: True}


@lru_cache(64)
def _asked(categories: tuple[str, ...], ascii_only: bool) -> tuple:
    """Active patterns that a text may hold; one of ASCII alone holds none that needs another character."""
    return tuple((p, c, p.needs) for p, c in _PATTERNS if p.category in categories and not (ascii_only and p.needs and not any(n.isascii() for n in p.needs)))


def _holds(text: str, needs: Sequence[str]) -> bool:
    for n in needs:
        if n in text:
            return True
    return False


def regex_spans(text: str, categories: Sequence[str]) -> list[Span]:
    out = []
    for p, compiled, needs in _asked(tuple(categories), text.isascii()):
        if needs and not _holds(text, needs):
            continue
        for m in compiled.finditer(text):
            found = m[p.group]
            if _CHECKS[p.check](found):
                start = m.start() + (m[0].index(found) if p.group else 0)
                out.append((found, p.category, start, start + len(found), 1.0))
    return out


@lru_cache(256)
def _custom(source: str):
    try:
        return regex.compile(source)
    except regex.error:  # a malformed pattern finds nothing
        return None


def custom_spans(text: str, source: str, category: str) -> list[Span]:
    compiled = _custom(source)
    return [(m[0], category, m.start(), m.end(), 1.0) for m in compiled.finditer(text) if m[0]] if compiled else []


def dictionary_spans(text: str, entries: Iterable[DictionaryEntry], categories: Sequence[str]) -> list[Span]:
    out = []
    for e in entries:
        needle = fold(e.text, e)
        if e.category not in categories or not needle:
            continue
        haystack, n = fold(text, e), len(needle)
        at = haystack.find(needle)
        while at >= 0:
            inside = (at > 0 and _LETTER.match(text[at - 1])) or (at + n < len(text) and _LETTER.match(text[at + n]))
            if not (e.exact and inside):
                out.append((text[at : at + n], e.category, at, at + n, CONFIDENCE))
            at = haystack.find(needle, at + n)
    return out


class NameRules:
    def __init__(self, surnames: Sequence[str] | None = None):
        listed = D.SURNAMES if surnames is None else tuple(surnames)
        self.surnames = frozenset(listed)
        self.surname = regex.compile(R.alternation(listed)) if listed else None
        #: Honorifics and labels aren't ASCII; are all surnames that a text may hold?
        self.han = not any(s.isascii() for s in listed)

    def honorifics(self, text: str, free) -> list[Span]:
        out = []
        for m in _HONORIFIC.finditer(text):
            at = m.start()
            run = _HAN_END.search(text[max(0, at - 3) : at])
            if not run or not free(at, m.end()):
                continue
            n = next((k for k in (3, 2, 1) if len(run[0]) >= k and run[0][-k:] in self.surnames), 0)
            if not n and (len(run[0]) < 2 or _NOT_NAME.search(text[max(0, at - 4) : at])):
                continue
            start = at - (n or len(run[0]))
            if free(start, at):
                out.append((text[start:at], "NAME", start, at, 0.9 if n else 0.75))
        return out

    def full(self, text: str, free) -> list[Span]:
        out = []
        for m in self.surname.finditer(text) if self.surname else ():
            rest = _AFTER.match(text[m.end() : m.end() + 7])
            if rest and free(m.start(), m.end() + len(rest[0])):
                end = m.end() + len(rest[0])
                out.append((text[m.start() : end], "NAME", m.start(), end, 0.8))
        return out

    @staticmethod
    def labelled(text: str, free) -> list[Span]:
        return [(m[1], "NAME", m.end() - len(m[1]), m.end(), 0.85) for m in _LABELLED.finditer(text) if free(m.end() - len(m[1]), m.end())]

    @staticmethod
    def romaji(text: str, free) -> list[Span]:
        return [(m[0], "NAME", m.start(), m.end(), 0.8) for m in _ROMAJI.finditer(text) if any(w.lower() in D.ROMAJI for w in m[0].split(" ")) and free(m.start(), m.end())]


def places(text: str, needle: str, step: int) -> Iterable[int]:
    at = text.find(needle)
    while at >= 0:
        yield at
        at = text.find(needle, at + step)


def org_spans(text: str, free) -> list[Span]:
    out = []
    for form in _ASCII_FORMS if text.isascii() else D.LEGAL_FORMS:
        n, spots = len(form), list(places(text, form, len(form)))
        for at in spots:
            after = _ORG_START.match(text[at + n : at + n + R.MAX_ORG])
            if after and free(at, at + n + len(after[0])):
                out.append((form + after[0], "ORG", at, at + n + len(after[0]), 0.9))
        for at in spots:
            left = _ORG_END.search(text[max(0, at - R.MAX_ORG) : at])
            if left and free(at - len(left[0]), at + n):
                out.append((left[0] + form, "ORG", at - len(left[0]), at + n, 0.9))
    return out + [(m[0], "ORG", m.start(), m.end(), 0.85) for m in _ENGLISH.finditer(text) if free(m.start(), m.end())]


def school_spans(text: str, free) -> list[Span]:
    longest: dict[int, int] = {}
    for ending in _ASCII_ENDINGS if text.isascii() else D.SCHOOL_ENDINGS:
        for at in places(text, ending, 1):
            longest[at + len(ending)] = max(len(ending), longest.get(at + len(ending), 0))
    out = []
    for end, n in longest.items():
        if end < len(text) and _SCHOOL_CHAR.match(text[end]):
            continue
        left = _SCHOOL_END.search(text[max(0, end - n - R.MAX_SCHOOL) : end - n])
        if left and left[0] not in D.NOT_SCHOOLS and free(end - n - len(left[0]), end):
            start = end - n - len(left[0])
            out.append((text[start:end], "SCHOOL", start, end, 0.85))
    return out


def select(spans: Iterable[Span]) -> list[Span]:
    """Winners in ascending order; the sort is stable, so of equal spans the first found stays."""
    out, last = [], -1
    for s in sorted(spans, key=lambda s: (s[2], s[2] - s[3])):
        if s[2] >= last:
            out.append(s)
            last = s[3]
    return out


class Detector:
    """All detectors of a configuration, stage by stage."""

    def __init__(self, config: Config, plugins: Sequence = (), provider: Callable | None = None):
        self.config, self.plugins, self.provider = config, tuple(plugins), provider
        self.categories = config.active
        self.names = NameRules(config.surnames)
        listed = [e for e in config.all_dictionary if e.category in self.categories]
        self.entries = EntryMatcher(listed) if len(listed) > MANY_ENTRIES else None

    @property
    def idle(self) -> bool:
        return not self.categories and not self.plugins

    def dictionary(self, text: str) -> list[Span]:
        return self.entries.spans(text) if self.entries else dictionary_spans(text, self.config.all_dictionary, self.categories)

    def patterns(self, text: str) -> list[Span]:
        out = regex_spans(text, self.categories)
        for p in self.config.all_patterns:
            if p.target in self.categories:
                out += custom_spans(text, p.pattern, p.target)
        return out

    def heuristic(self, text: str) -> list[Span]:
        wanted = [c for c in NER_CATEGORIES if c in self.categories]
        if not wanted or not self.config.heuristic_ner or not text:
            return []
        ranges = [m.span() for m in _BRACKETS.finditer(text)] if "[" in text else []
        free = lambda a, b: not any(a < hi and b > lo for lo, hi in ranges)
        claimed = (org_spans(text, free) if "ORG" in wanted else []) + (school_spans(text, free) if "SCHOOL" in wanted else [])
        if "NAME" not in wanted:
            return claimed
        rules = (self.names.romaji,) if text.isascii() and self.names.han else (self.names.honorifics, self.names.full, self.names.labelled, self.names.romaji)
        names = [s for rule in rules for s in rule(text, free)]
        return claimed + [s for s in names if not any(s[2] < c[3] and s[3] > c[2] for c in claimed)]

    def from_plugins(self, text: str) -> list[Span]:
        from hushframe.operators.plugins import plugin_spans

        return plugin_spans(text, self.plugins)

    def from_provider(self, text: str) -> list[Span]:
        from hushframe.operators.provider import provider_spans

        return provider_spans(text, self.provider, self.categories)

    def analyze(self, text: str | None, use_provider: bool = False) -> list[Span]:
        """Every stage on the original text; one resolution over all; then the allowlist."""
        if is_blank(text) or self.idle:
            return []
        found = (self.dictionary(text) + self.patterns(text) + self.heuristic(text)) if self.categories else []
        found += self.from_plugins(text)
        if use_provider and self.config.provider_enabled:
            found += self.from_provider(text)
        return [s for s in select(found) if s[0] not in self.config.allowlist]
