"""Reports over spans: counts by category and other columns, and rates of redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(spans: DataFrame, *by: str) -> DataFrame:
    return spans.groupBy(*by).agg(F.count("*").cast("long").alias("n_spans"), F.countDistinct("text").cast("long").alias("n_values"))


def cube(spans: DataFrame, *by: str) -> DataFrame:
    """All subtotals; ``level`` tells them apart from null values."""
    return spans.cube(*by).agg(F.grouping_id().cast("long").alias("level"), F.count("*").cast("long").alias("n_spans"))


def top(spans: DataFrame, by: str, n: int) -> DataFrame:
    return spans.groupBy(by).agg(F.count("*").cast("long").alias("n_spans")).orderBy(F.desc("n_spans"), by).limit(n)


def redaction(masked: Column, items: Column) -> tuple[Column, Column]:
    """How many of some items are gone from a masked text, and how many there were."""
    return F.size(F.filter(items, lambda x: ~F.contains(masked, x))), F.size(items)


def rates(df: DataFrame, masked: str, redact: str, keep: str, *by: str) -> DataFrame:
    """Share of what should go that went, and of what should stay that stayed."""
    gone, wanted = redaction(F.col(masked), F.col(redact))
    lost, present = redaction(F.col(masked), F.col(keep))
    return df.groupBy(*by).agg((F.sum(gone) / F.sum(wanted)).alias("redacted"), (1 - F.sum(lost) / F.sum(present)).alias("kept"))

