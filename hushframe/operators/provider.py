"""The language-model stage: what is deterministic about it, and a provider that can be put in.

A provider takes a list of ``(number, text)`` blocks and returns the model's answer as text, or None. None
is built in: without one the stage finds nothing.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.categories import NER_CATEGORIES, SPANS
from hushframe.functions.patterns import SPACE_CHARS, SPACE_JAVA

MAX_CHARS = 3500
BUDGET_SECONDS = 4.0
CONFIDENCE = 0.8
# Honorifics that a model's answer may end with.
_HONORIFIC = re.compile("(?:さん|さま|様|殿|氏|先生|くん|君|ちゃん|先輩|後輩|部長|課長|社長|会長|教授|博士)\\Z")
_TOKEN = re.compile(r"\[[A-Z_]+_[0-9]+\]")
_FENCE = re.compile(r"^```(?:json)?[ \t]*\n?", re.M)
_FENCE_END = re.compile(r"\n?```\s*$", re.M)


def chunk_blocks(blocks: Sequence[tuple[int, str]], most: int = MAX_CHARS) -> list[list[tuple[int, str]]]:
    """Blocks in order, together while they stay within the limit; none is split."""
    out: list[list[tuple[int, str]]] = []
    held = 0
    for block in blocks:
        if not out or (out[-1] and held + len(block[1]) > most):
            out.append([])
            held = 0
        out[-1].append(block)
        held += len(block[1])
    return out


def prompt_of(blocks: Sequence[tuple[int, str]]) -> str:
    return "\n".join(f"---BLOCK_{k}---\n{text}" for k, text in blocks)


def strip_honorific(name: str) -> str:
    return _HONORIFIC.sub("", name).strip(SPACE_CHARS)


def strip_honorific_column(name: Column) -> Column:
    """The same in built-in expressions."""
    return F.regexp_replace(F.regexp_replace(name, _HONORIFIC.pattern.replace("\\Z", "\\z"), ""), f"^[{SPACE_JAVA}]+|[{SPACE_JAVA}]+\\z", "")


def parse_detections(answer: str, blocks: Sequence[tuple[int, str]]) -> list[tuple]:
    """Spans from an answer: the outermost JSON array in it, every occurrence of each name in its block."""
    plain = _FENCE_END.sub("", _FENCE.sub("", answer, count=1), count=1).strip()
    lo, hi = plain.find("["), plain.rfind("]")
    if lo < 0 or hi < lo:
        return []
    try:
        rows = json.loads(plain[lo : hi + 1])
    except ValueError:
        return []
    texts, out = dict(reversed([*blocks])), []
    for row in rows if isinstance(rows, list) else ():
        text, category = (row.get("text"), row.get("category")) if isinstance(row, dict) else (None, None)
        if not isinstance(text, str) or not text or category not in NER_CATEGORIES:
            continue
        if "@" in text or text.startswith("http") or _TOKEN.fullmatch(text):
            continue
        name = strip_honorific(text) if category == "NAME" else text
        inside = texts.get(row.get("block")) if isinstance(row.get("block"), int) else None
        if not name or inside is None:
            continue
        at = inside.find(name)
        while at >= 0:
            out.append((name, category, at, at + len(name), CONFIDENCE))
            at = inside.find(name, at + len(name))
    return out


def provider_spans(text: str, provider: Callable | None, categories: Sequence[str], budget: float = BUDGET_SECONDS) -> list[tuple]:
    """What the provider finds, within a budget of time; failures find nothing."""
    if provider is None or not text or not set(NER_CATEGORIES) & set(categories):
        return []
    out, began = [], time.monotonic()
    for blocks in chunk_blocks([(0, text)]):
        if time.monotonic() - began >= budget:
            break
        try:
            out += parse_detections(provider(blocks) or "", blocks)
        except Exception:  # noqa: BLE001, S112  a failing model must not stop masking
            continue
    return out


class Packer:
    """Texts as they come, packed to calls: one is due when the next text would pass the limit. None is split."""

    def __init__(self, provider: Callable, most: int = MAX_CHARS):
        self.provider, self.most = provider, most
        self.blocks: list[tuple[int, str]] = []
        self.chars = self.calls = 0

    def add(self, text: str) -> list[list[tuple]] | None:
        """Spans of the texts before this one, if their call was due."""
        done = self.flush() if self.blocks and self.chars + len(text) > self.most else None
        self.blocks.append((len(self.blocks), text))
        self.chars += len(text)
        return done

    def flush(self) -> list[list[tuple]]:
        blocks, self.blocks, self.chars = self.blocks, [], 0
        found: list[list[tuple]] = [[] for _ in blocks]
        if not blocks:
            return found
        self.calls += 1
        try:
            answer = self.provider(blocks) or ""
            for k, block in enumerate(blocks):
                found[k] = parse_detections(answer, [block])
        except Exception:  # noqa: BLE001  a failing model must not stop masking
            found = [[] for _ in blocks]
        return found


def provider_table(texts: DataFrame, keys: Sequence[str], provider: Callable, categories: Sequence[str], text: str = "text", most: int = MAX_CHARS) -> DataFrame:
    """``keys, spans, call``: what the provider finds in each text, asked for many texts at a time.

    The texts of a partition are packed to calls while they stream by, up to ``most`` characters each, and an answer goes back to its
    texts by block number; ``call`` numbers a partition's calls. Null and blank texts are not asked about and give no row. A
    failed call finds nothing in its texts.
    """
    names = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in names) + f", spans {SPANS}, call int"
    wanted = bool(set(NER_CATEGORIES) & set(categories))
    fields = ("text", "category", "start", "end", "confidence")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, waiting = Packer(provider, most), []

        def rows(found: list[list[tuple]]) -> pd.DataFrame:
            made = [(*key, [dict(zip(fields, s, strict=True)) for s in spans if s[1] in categories], packer.calls) for key, spans in zip(waiting, found, strict=True)]
            return pd.DataFrame(made, columns=[*names, "spans", "call"])

        for batch in batches:
            for *key, value in batch.itertuples(index=False, name=None):
                if (found := packer.add(value)) is not None:
                    yield rows(found)
                    waiting.clear()
                waiting.append(tuple(key))
        if waiting:
            yield rows(packer.flush())

    asked = texts.select(*names, F.col(text)).filter(F.col(text).isNotNull() & (F.trim(F.col(text)) != ""))
    return (asked if wanted else asked.limit(0)).mapInPandas(run, schema)
