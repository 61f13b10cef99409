"""Placeholders: numbering by visible prefix, and the two ways through a session's mapping."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"\[[^\[\]]*\]"
_TOKEN = re.compile(TOKEN)
MAPPING = "array<struct<original: string, category: string, prefix: string, seq: int, placeholder: string, reversible: boolean>>"


def letters(n: int) -> str:
    """1 is A, 26 is Z, 27 is AA."""
    out = ""
    while n > 0:
        n, digit = divmod(n - 1, 26)
        out = chr(65 + digit) + out
    return out


def letters_column(n: Column) -> Column:
    start = F.struct(n.cast("long").alias("v"), F.lit("").alias("s"))
    step = lambda acc, _: F.when(acc["v"] > 0, F.struct(F.floor((acc["v"] - 1) / 26).cast("long").alias("v"), F.concat(F.chr(((acc["v"] - 1) % 26 + 65).cast("int")), acc["s"]).alias("s"))).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda acc: acc["s"])


#: Characters of private use that number a row's own placeholders until its session has numbered them.
PRIVATE_FIRST, PRIVATE_COUNT = 0xF0000, 65_534


def private(n: int) -> str:
    """A number as private characters, so that a row's own placeholders are told from any that its text quotes."""
    out = ""
    while n > 0:
        n, digit = divmod(n - 1, PRIVATE_COUNT)
        out = chr(PRIVATE_FIRST + digit) + out
    return out


class Mapping:
    """One session's placeholders. The text alone is the key: the category that met it first names it."""

    name = staticmethod(letters)

    def __init__(self, reversible: bool = True):
        self.reversible = reversible
        self.placeholders: dict[str, str] = {}
        self.originals: dict[str, str] = {}
        self.counters: dict[str, int] = {}
        self.rows: list[tuple] = []

    def register(self, original: str, category: str, prefix: str) -> str:
        known = self.placeholders.get(original)
        if known is not None:
            return known
        self.counters[prefix] = n = self.counters.get(prefix, 0) + 1
        made = self.placeholders[original] = f"[{prefix}{self.name(n)}]"
        if self.reversible:
            self.originals[made] = original
        self.rows.append((original, category, prefix, n, made, self.reversible))
        return made

    @property
    def shown(self) -> list[tuple]:
        """The rows to give out: without originals where there is no way back."""
        return self.rows if self.reversible else [(None, *r[1:]) for r in self.rows]

    @classmethod
    def of(cls, rows: list[dict], reversible: bool = True) -> Mapping:
        """A mapping that goes on from its rows."""
        made = cls(reversible)
        for r in rows:
            made.placeholders[r["original"]] = r["placeholder"]
            made.counters[r["prefix"]] = max(r["seq"], made.counters.get(r["prefix"], 0))
            if reversible:
                made.originals[r["placeholder"]] = r["original"]
            made.rows.append((r["original"], r["category"], r["prefix"], r["seq"], r["placeholder"], r["reversible"]))
        return made

    def restore(self, text: str) -> str:
        return restore_text(text, self.originals)

    def clear(self) -> None:
        self.__init__(self.reversible)

    @property
    def longest(self) -> int:
        return max(map(len, self.originals), default=0)


class OpenMapping(Mapping):
    """A mapping that a later step goes on with, and that therefore shows its originals in any mode."""

    @property
    def shown(self) -> list[tuple]:
        return self.rows


class RowMapping(OpenMapping):
    """The placeholders of one row of a session. An original that holds another's placeholder is kept as it was at first."""

    name = staticmethod(private)

    def register(self, original: str, category: str, prefix: str) -> str:
        known = len(self.rows)
        made = super().register(original, category, prefix)
        if len(self.rows) > known and "[" in original:
            whole = _TOKEN.sub(lambda m: next((r[0] for r in self.rows if r[4] == m[0]), m[0]), original)
            self.rows[-1] = (whole, *self.rows[-1][1:])
        return made


def restore_text(text: str, originals: dict[str, str]) -> str:
    """All placeholders in one pass, longest first; what is put back isn't looked at again."""
    if not originals or "[" not in text and not any(p in text for p in originals):
        return text
    if all(_TOKEN.fullmatch(p) for p in originals):
        return _TOKEN.sub(lambda m: originals.get(m[0], m[0]), text)
    return re.sub("|".join(map(re.escape, sorted(originals, key=len, reverse=True))), lambda m: originals[m[0]], text)


def restore_column(text: Column, originals: Column) -> Column:
    """The same for a ``map<placeholder, original>`` column, in built-in expressions."""
    tokens, between = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.split(text, TOKEN, -1)
    pieces = F.zip_with(between, tokens, lambda gap, t: F.concat(gap, F.when(t.isNull(), F.lit("")).otherwise(F.coalesce(F.try_element_at(originals, F.coalesce(t, F.lit(""))), t))))
    return F.when(originals.isNull() | ~F.contains(text, F.lit("[")), text).otherwise(F.array_join(pieces, ""))
