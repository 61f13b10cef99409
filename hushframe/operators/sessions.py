"""Sessions: which one a request belongs to, and when a new one begins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions.patterns import SPACE_JAVA
from hushframe.operators.slices import epochs

TTL_SECONDS = 30 * 60
# Headers that name a session, by precedence, and the one that resets it.
SESSION_HEADERS = ("x-pii-session-id", "anthropic-session-id", "x-session-id")
RESET_HEADER = "x-pii-session-reset"


def trimmed(value: Column) -> Column:
    """Without white space at its ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(value, f"^[{SPACE_JAVA}]+|[{SPACE_JAVA}]+\\z", ""), F.lit(""))


def header(headers: Column, *names: str) -> Column:
    """The first of some headers that isn't blank."""
    return F.coalesce(*[trimmed(F.try_element_at(headers, F.lit(n))) for n in names])


def session_key(headers: Column, connection: Column) -> Column:
    """An explicit session's name, else the connection's; the two can't be mistaken for each other."""
    return F.coalesce(F.concat(F.lit("id:"), header(headers, *SESSION_HEADERS)), F.concat(F.lit("connection:"), connection))


def is_reset(headers: Column) -> Column:
    return F.coalesce(F.lower(header(headers, RESET_HEADER)).isin("1", "true"), F.lit(False))


def sessionize(df: DataFrame, key: str, time: str, reset: Column | None = None, ttl: int = TTL_SECONDS, output: str = "session_no") -> DataFrame:
    """Numbers each key's sessions from 1. A gap of ``ttl`` seconds or more begins a new one, as does a reset;
    a gap of exactly that long has expired already. Connections (keys that say so) don't expire."""
    by_time = Window.partitionBy(key).orderBy(time)
    seconds = F.col(time).cast("timestamp").cast("double")
    gap = seconds - F.lag(seconds).over(by_time)
    starts = gap.isNull() | (gap >= ttl)
    if reset is not None:
        starts = starts | reset
    return df.withColumn("__starts", starts.cast("int")).withColumn(output, F.sum("__starts").over(by_time.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__starts")


def acquire(df: DataFrame, time: str = "ts", headers: str = "headers", connection: str = "conn_id", order: Sequence[str] = (), ttl: float = TTL_SECONDS, slices: int | None = None) -> DataFrame:
    """``df`` with ``session`` and ``epoch``: together the mapping a request uses.

    Requests of a session are taken by ``time``, then ``order``, which should tell equal times apart. Only sessions that
    a header names expire.
    """
    keyed = df.withColumn("session", session_key(F.col(headers), F.col(connection)))
    named = F.coalesce(F.startswith("session", F.lit("id:")), F.lit(False))
    return epochs(keyed, "session", time, order, ttl, named, is_reset(F.col(headers)), slices=slices)
