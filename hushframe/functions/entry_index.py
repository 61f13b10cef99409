"""Dictionaries of millions of entries for many texts at a time: windows of each length that entries have, looked up by hash.

The same spans as ``automaton.EntryMatcher``. An entry takes its characters and some 40 bytes. Hashes are polynomial, so all windows'
come from one running sum over the texts; each hit is then compared letter by letter, so a hash never decides. Entries of letters alone
that must stand alone can only be whole runs of letters, so of these only runs are looked up. Finds are columns throughout: a text of
words may hold as many as it has words.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from hushframe.config import DictionaryEntry
from hushframe.functions.dictionary import CONFIDENCE, fold

_LETTERS = regex.compile(r"[\p{L}\p{N}_]+")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Bits of the table that tells most windows apart from entries.
TABLE_BITS = (12, 26)
#: Powers that are kept, enough for a usual stretch of texts.
_KEPT = 1 << 20


def _made_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_kept_powers = lru_cache(2)(_made_powers)


def _powers(base: int, n: int) -> np.ndarray:
    return _kept_powers(base, _KEPT)[: n + 1] if n <= _KEPT else _made_powers(base, n)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


#: Whether code points are letters, of those 256 at a time that were asked for.
_letter, _page_known = np.zeros(0x110000, bool), np.zeros(0x1100, bool)


def _letters(codes: np.ndarray) -> np.ndarray:
    pages = codes >> 8
    if not _page_known[pages].all():
        for page in np.unique(pages).tolist():
            for m in _LETTERS.finditer("".join(map(chr, range(256 * page, 256 * page + 256)))):
                _letter[256 * page + m.start() : 256 * page + m.end()] = True
            _page_known[page] = True
    return _letter[codes]


class _Strings:
    """A text whose windows are given as Arrow strings."""

    def __init__(self, text: str, codes: np.ndarray):
        self.data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        self.at = np.arange(len(codes) + 1)
        if len(self.data) > len(codes):
            self.at[1:] += np.cumsum((codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000), dtype=np.int64)

    def windows(self, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
        low = self.at[starts]
        sizes = self.at[ends] - low
        offsets = np.zeros(len(low) + 1, np.int64)
        np.cumsum(sizes, out=offsets[1:])
        data = self.data[np.arange(offsets[-1]) + np.repeat(low - offsets[:-1], sizes)]
        return pa.LargeStringArray.from_buffers(len(low), pa.py_buffer(offsets), pa.py_buffer(data))


class _Windows:
    """Hashes of all windows of a text."""

    def __init__(self, codes: np.ndarray):
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * _powers(_BASE, len(codes))[: len(codes)], out=self.sums[1:])
        self.back = _powers(_INVERSE, len(codes))

    def hashes(self, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.back[starts] * _MIX

    def of_length(self, n: int) -> np.ndarray:
        last = len(self.sums) - n
        return self.hashes(slice(0, last), slice(n, None)) if last > 0 else np.zeros(0, np.uint64)


class _Group(NamedTuple):
    """Entries that are folded alike, in order of their hashes; ``alike`` tells how many from each on have its hash, ``place`` where each stands among all."""

    kind: int
    alone: bool
    lengths: list[int]
    hashes: np.ndarray
    alike: np.ndarray
    table: np.ndarray
    shift: np.uint64
    held: pa.Array
    place: np.ndarray

    def met(self, words: _Strings, asked: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of windows with their hashes: starts, ends and entries, where one is an entry."""
        at = np.flatnonzero(self.table[asked >> self.shift])
        low = np.searchsorted(self.hashes, asked[at])
        hit = self.hashes[np.minimum(low, len(self.hashes) - 1)] == asked[at]
        at, k = at[hit], low[hit]
        times = self.alike[k]
        if (times > 1).any():
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            at, k = np.repeat(at, times), np.repeat(k, times) + nth
        starts, ends = starts[at], ends[at]
        same = pc.equal(words.windows(starts, ends), self.held.take(pa.array(k))).to_numpy(zero_copy_only=False)
        return (starts, ends, k) if same.all() else (starts[same], ends[same], k[same])


def _apart(starts: np.ndarray, k: np.ndarray, n: int) -> np.ndarray:
    """Which windows of ``n`` characters, from left to right, don't overlap one of the same entry before them."""
    order = np.lexsort((starts, k))
    near = (np.diff(k[order]) == 0) & (np.diff(starts[order]) < n)
    keep = np.ones(len(k), bool)
    past = {}
    for x in np.flatnonzero(np.concatenate([[False], near]) | np.concatenate([near, [False]])).tolist():
        entry, start = k[order[x]], starts[order[x]]
        if start < past.get(entry, 0):
            keep[order[x]] = False
        else:
            past[entry] = start + n
    return keep


class Found(NamedTuple):
    """Finds as columns: each one's text, rank, value, category, and where it starts and ends within the text."""

    text_of: np.ndarray
    ranks: np.ndarray
    values: pa.Array
    categories: pa.Array
    starts: np.ndarray
    ends: np.ndarray


class EntryIndex:
    """Entries as columns; ``found`` gives the finds of some texts by text, rank and start, ``find`` each text's as ``(rank, (text, category, start, end, confidence))``."""

    def __init__(self, texts: Sequence[str], categories: Sequence[str], exact: Sequence[bool], case_sensitive: Sequence[bool], fold_width: Sequence[bool], ranks: Sequence[int]):
        self.groups: list[_Group] = []
        self.kinds = np.array(case_sensitive, np.int8) * np.int8(2) + np.array(fold_width, np.int8)
        self.ranks, self.exact = np.array(ranks, np.int64), np.array(exact, bool)
        different, self.turns = np.unique(self.ranks, return_inverse=True)
        self.turns, self.ranked = self.turns.astype(np.int32), len(different) == len(self.ranks)
        categories = pa.array(categories, pa.string()).dictionary_encode()
        self.names, self.codes = categories.dictionary, categories.indices.to_numpy()
        for kind in np.unique(self.kinds).tolist():
            of_kind = np.flatnonzero(self.kinds == kind)
            folded = [fold(texts[k], _like(kind)) for k in of_kind]
            runs = np.fromiter((bool(e and _LETTERS.fullmatch(x)) for e, x in zip(self.exact[of_kind].tolist(), folded, strict=True)), bool, len(folded))
            for alone in (False, True):
                which = np.flatnonzero(runs == alone)
                needles = [folded[k] for k in which.tolist()]
                ends = np.cumsum([0, *map(len, needles)])
                sizes, hashes = np.diff(ends), _Windows(_codes("".join(needles))).hashes(ends[:-1], ends[1:])
                order = np.argsort(hashes, kind="stable")
                order = order[sizes[order] > 0]
                if not len(order):
                    continue
                hashes = hashes[order]
                bits = int(np.clip(np.ceil(np.log2(8 * len(order) + 1)), *TABLE_BITS))
                table = np.zeros(1 << bits, bool)
                table[hashes >> np.uint64(64 - bits)] = True
                held = pa.array([needles[k] for k in order], pa.large_string())
                alike = (np.searchsorted(hashes, hashes, "right") - np.arange(len(hashes))).astype(np.int32)
                self.groups.append(_Group(kind, alone, np.unique(sizes[order]).tolist(), hashes, alike, table, np.uint64(64 - bits), held, of_kind[which][order].astype(np.int32)))

    def found(self, texts: Sequence[str | None]) -> Found:
        plain = [t or "" for t in texts]
        begins = np.cumsum([0, *(len(t) + 1 for t in plain)])
        whole = "\n".join(plain)
        codes = _codes(whole)
        strings = _Strings(whole, codes)
        letter = np.zeros(len(codes) + 2, bool)  # at k + 1, as there are characters before the first and behind the last
        letter[1:-1] = _letters(codes)
        parts, kind = [(np.zeros(0, np.int64),) * 3], None
        for g in self.groups:
            if g.kind != kind:
                kind, folded = g.kind, fold(whole, _like(g.kind))
                same = folded == whole
                codes_of, words = (codes, strings) if same else (_codes(folded), _Strings(folded, _codes(folded)))
                windows = _Windows(codes_of)
                # If folding changed what is a letter, runs would not do.
                runs = same or bool((_letters(codes_of) == letter[1:-1]).all())
            if g.alone and runs:
                turns = np.flatnonzero(letter[1:] != letter[:-1])
                starts, ends = turns[::2], turns[1::2]
                starts, ends, k = g.met(words, windows.hashes(starts, ends), starts, ends)
                parts.append((starts, ends, g.place[k]))
                continue
            for n in g.lengths:
                asked = windows.of_length(n)
                starts = np.arange(len(asked))
                starts, ends, k = g.met(words, asked, starts, starts + n)
                inside = ends < begins[np.searchsorted(begins, starts, "right")]
                starts, ends, k = starts[inside], ends[inside], k[inside]
                place = g.place[k]
                keep = _apart(starts, k, n) & ~(self.exact[place] & (letter[starts] | letter[ends + 1]))
                parts.append((starts[keep], ends[keep], place[keep]))
        starts, ends, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        text_of = np.searchsorted(begins, starts, "right") - 1
        turns = self.turns[place] if len(place) else place
        if self.ranked and len(texts) * len(self.ranks) * (len(whole) + 1) < 1 << 62:
            order = np.argsort((text_of * len(self.ranks) + turns) * (len(whole) + 1) + starts)
        else:
            order = np.lexsort((place, ends - starts, self.kinds[place], starts, turns, text_of))
        starts, ends, place, text_of = starts[order], ends[order], place[order], text_of[order]
        values = strings.windows(starts, ends).cast(pa.string())
        return Found(text_of, self.ranks[place], values, self.names.take(pa.array(self.codes[place])), starts - begins[text_of], ends - begins[text_of])

    def find(self, texts: Sequence[str | None]) -> list[list[tuple[int, tuple]]]:
        out: list[list] = [[] for _ in texts]
        found = self.found(texts)
        for t, rank, *span in zip(*(x.to_pylist() if isinstance(x, pa.Array) else x.tolist() for x in found), strict=True):
            out[t].append((rank, (*span, CONFIDENCE)))
        return out


def _like(kind: int) -> DictionaryEntry:
    return DictionaryEntry("x", "X", False, bool(kind & 2), bool(kind & 1))
