"""Analyze: every detector on the original text, one resolution over all, then the allowlist."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.config import Config
from hushframe.functions.categories import NER_CATEGORIES, SPANS
from hushframe.functions.dictionary import dictionary_spans
from hushframe.functions.automaton import EntryMatcher
from hushframe.functions.detect import MANY_ENTRIES, Detector
from hushframe.functions.ner import bracket_ranges, claimed_apart, claimed_spans, name_spans
from hushframe.functions.patterns import PATTERNS
from hushframe.operators.dictionary_table import StoredDictionary, dictionary_column
from hushframe.functions.spans import compiles, custom_spans, drop_allowed, is_blank, no_spans, regex_spans, resolve


#: Parts for each core, so that a slow one doesn't keep the rest waiting.
DEALS = 4


def span_udf(find: Callable[[str], list[tuple]]):
    """An Arrow-batched function from texts to arrays of spans."""

    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("text", "category", "start", "end", "confidence"), s, strict=True)) for s in (find(t) if t else ())] for t in texts])

    return run


def dictionary_part(t: str, config: Config) -> Column | None:
    """Spans of the configuration's dictionary; a long one isn't part of the plan."""
    listed = [e for e in config.all_dictionary if e.category in config.active]
    if len(listed) > MANY_ENTRIES:
        return span_udf(EntryMatcher(listed).spans)(F.col(t))
    return dictionary_spans(t, tuple(listed), config.active) if listed else None


def pattern_part(t: str, config: Config) -> Column | None:
    """Spans of all active patterns, then of the user's."""
    built_in = [regex_spans(t, config.active)] if any(p.category in config.active for p in PATTERNS) else []
    own = [custom_spans(t, p.pattern, p.target) for p in config.all_patterns if p.target in config.active and compiles(p.pattern)]
    return F.concat(*built_in, *own) if built_in or own else None


def heuristic_parts(t: str, config: Config, stage: Callable[[str, Column], Column]) -> list[Column]:
    """Spans of the name rules. ``stage`` makes a column of an expression that several rules use."""
    active, parts = config.active, []
    if config.heuristic_ner and set(active) & set(NER_CATEGORIES):
        ranges = stage("ranges", bracket_ranges(t))
        claimed = stage("claimed", claimed_spans(t, ranges, active))
        parts.append(claimed)
        if "NAME" in active:
            names = stage("names", name_spans(t, ranges, config.surnames))
            parts.append(claimed_apart(names, claimed))
    return parts


def analyze(df: DataFrame, config: Config | None = None, text: str = "text", output: str = "spans", plugins: Sequence = (), provider: Callable | None = None, dictionary: StoredDictionary | None = None) -> DataFrame:
    """``df`` with an array of spans: a narrow transformation, without a shuffle.

    Stages are columns of their own, so that what several rules use (bracket ranges, claimed spans) is
    computed once a row; inactive categories cost nothing, as they aren't planned. Null and blank texts
    have no spans. A column named as ``output`` is replaced; all others come back as they were. Custom patterns that aren't valid are ignored. The configuration's ``enabled`` and passthrough don't matter here.
    ``dictionary``: entries of a table, after those of the configuration; neither they nor more than ``MANY_ENTRIES`` of
    the configuration's are part of the plan.
    """
    config = config or Config()
    active, own_names, column = config.active, apart(df), F.col(text)
    t = own_names + "text"
    parts: list[Column] = []
    out = df.withColumn(t, column)

    def stage(name: str, spans: Column) -> Column:
        nonlocal out
        out = out.withColumn(own_names + name, spans)
        return F.col(own_names + name)

    if (found := dictionary_part(t, config)) is not None:
        parts.append(stage("dictionary", found))
    if dictionary is not None:
        parts.append(stage("listed", dictionary_column(column, dictionary)))
    if (found := pattern_part(t, config)) is not None:
        parts.append(stage("patterns", found))
    parts += heuristic_parts(t, config, stage)
    if plugins:
        parts.append(stage("plugins", span_udf(Detector(config, plugins).from_plugins)(column)))
    if provider is not None and config.provider_enabled:
        parts.append(stage("provider", span_udf(Detector(config, (), provider).from_provider)(column)))
    found = stage("found", F.concat(*parts) if parts else no_spans())
    spans = F.when(is_blank(column), no_spans()).otherwise(drop_allowed(resolve(found), config.allowlist))
    made = out.withColumn(output, spans)
    return made.drop(*[c for c in made.columns if c.startswith(own_names)])


def apart(df: DataFrame) -> str:
    """What no column's name of the user's begins with."""
    start = "__"
    while any(c.startswith(start) for c in df.columns):
        start += "_"
    return start


def exploded(df: DataFrame, keys: Sequence[str], spans: str | Column = "spans") -> DataFrame:
    """One row a span: ``keys`` and ``x``, the span.

    Rows without spans go after the explode, not before: a plain ``explode`` makes Spark infer a filter on the
    array's size and push it below the projections, and then all detectors would run twice.
    """
    return df.select(*keys, F.explode_outer(spans).alias("x")).filter("x is not null")


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows dealt to all cores if the input has fewer files than there are cores; else as read.

    Detection is narrow and costs far more than moving the text, so a table of one row group would keep one core busy. Rows
    with a ``key`` that tells them apart are dealt by it, ``DEALS`` parts a core, which needs no sort of the few tasks that read them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores) if key is None else df.repartition(DEALS * cores, key)
