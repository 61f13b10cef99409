"""Dictionary detection in built-in expressions: each entry's literal occurrences, folded as it asks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.config import DictionaryEntry
from hushframe.functions.spans import find_all, literal, no_spans, span

CONFIDENCE = 0.9
#: Full-width forms and the ASCII characters they are forms of; the ideographic space isn't one.
FULL = "".join(map(chr, range(0xFF01, 0xFF5F)))
HALF = "".join(map(chr, range(0x21, 0x7F)))
LETTER = r"[\p{L}\p{N}_]"


def folded(text: str, entry: DictionaryEntry) -> str:
    """SQL; keeps the number of characters: only those whose lower case is one character are lowered."""
    if entry.fold_width:
        text = f"translate({text}, {literal(FULL)}, {literal(HALF)})"
    if entry.case_sensitive:
        return text
    # Lower-casing I with a dot above gives two characters; a private one keeps its place.
    return f"lower(translate({text}, '\u0130', '\ue130'))"


def fold(text: str, entry: DictionaryEntry) -> str:
    if entry.fold_width:
        text = text.translate(dict(zip(map(ord, FULL), HALF, strict=True)))
    return text if entry.case_sensitive else text.replace("\u0130", "\ue130").lower()


def entry_spans(text: str, entry: DictionaryEntry) -> Column:
    """Occurrences from left to right that don't overlap; an occurrence without the boundary it needs is
    passed over whole."""
    needle, whole = fold(entry.text, entry), F.expr(text)
    if not needle:
        return no_spans()
    n = len(needle)
    haystack = folded(text, entry)
    found = find_all(haystack, "".join(f"\\{c}" if c.isascii() and not c.isalnum() else c for c in needle))
    if entry.exact:
        found = F.filter(found, lambda x: ~F.substring(whole, x["s"], F.when(x["s"] > 0, 1).otherwise(0)).rlike(LETTER) & ~F.substring(whole, x["s"] + n + 1, F.lit(1)).rlike(LETTER))
    made = F.transform(found, lambda x: span(F.substring(whole, x["s"] + 1, F.lit(n)), entry.category, x["s"], x["s"] + n, CONFIDENCE))
    return F.when(F.expr(f"contains({haystack}, {literal(needle)})"), made).otherwise(no_spans())


def dictionary_spans(text: str, entries: tuple[DictionaryEntry, ...], categories: tuple[str, ...] | None = None) -> Column:
    parts = [entry_spans(text, e) for e in entries if categories is None or e.category in categories]
    return F.concat(*parts) if parts else no_spans()
