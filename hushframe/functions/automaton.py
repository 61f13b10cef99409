"""Dictionaries of any length for one text at a time: all entries found in one pass over the text.

The same spans as entry by entry (``functions.dictionary``): an entry's occurrences from left to right that don't overlap, one
without the boundary it needs passed over whole; entries in their order, each one's occurrences in ascending order.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import ahocorasick
import regex

from hushframe.config import DictionaryEntry
from hushframe.functions.dictionary import CONFIDENCE, fold

_LETTER = regex.compile(r"[\p{L}\p{N}_]")


class EntryMatcher:
    """An automaton for each way of folding that entries ask for (at most four)."""

    def __init__(self, entries: Iterable[DictionaryEntry], ranks: Sequence[int] | None = None):
        """ranks: the entries' order, where it isn't that in which they come."""
        self.entries = list(entries)
        self.ranks = list(range(len(self.entries))) if ranks is None else list(ranks)
        keyed: dict[tuple[bool, bool], dict[str, list[int]]] = {}
        for k, e in enumerate(self.entries):
            needle = fold(e.text, e)
            if needle:
                keyed.setdefault((e.case_sensitive, e.fold_width), {}).setdefault(needle, []).append(k)
        self.automata = []
        for needles in keyed.values():
            made = ahocorasick.Automaton()
            for needle, found in needles.items():
                made.add_word(needle, (len(needle), tuple(found)))
            made.make_automaton()
            self.automata.append((self.entries[next(iter(needles.values()))[0]], made))

    def ranked(self, text: str | None) -> list[tuple[int, tuple]]:
        """``rank, (text, category, start, end, confidence)`` by rank, then start."""
        out, past = [], {}
        if not text:
            return out
        for like, automaton in self.automata:
            for last, (n, found) in automaton.iter(fold(text, like)):
                start, end = last - n + 1, last + 1
                inside = None
                for k in found:
                    if start < past.get(k, 0):
                        continue
                    past[k] = end
                    e = self.entries[k]
                    if e.exact:
                        if inside is None:
                            inside = bool((start and _LETTER.match(text[start - 1])) or (end < len(text) and _LETTER.match(text[end])))
                        if inside:
                            continue
                    out.append((self.ranks[k], (text[start:end], e.category, start, end, CONFIDENCE)))
        out.sort(key=lambda x: (x[0], x[1][2]))
        return out

    def spans(self, text: str | None) -> list[tuple]:
        return [s for _, s in self.ranked(text)]
