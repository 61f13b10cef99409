"""Tables of spans, one a row: without those that a table allows, without those that another table's overlap, pairs that overlap.

A span covers ``[start, end)``. Joins are by key and bin of offsets, so that no pair is compared that isn't near, and
whether a span is overlapped at all is told from bits: which offsets of a bin the other table covers is one number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.operators.slices import hot_keys
from hushframe.operators.storage import stored

#: An allowlist of more bytes isn't broadcast.
BROADCAST_BYTES = 16 * 1024 * 1024
BIN = 64


def without_allowed(spans: DataFrame, allowlist: DataFrame, value: str = "value", allowed: str = "value", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Spans whose text isn't in a table of allowed texts. Apply it after overlaps are resolved, as an allowed winner hides what it overlapped.

    A small allowlist is broadcast, after its size was measured. Beyond that, both sides are shuffled by text; texts of more than a
    thousandth of all spans each (so fewer than a thousand) are looked up first and broadcast, so that none fills one task.
    Null texts stay.
    """
    rows = allowlist.select(F.col(allowed).alias("__allowed")).filter("__allowed is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("__allowed") + 32)).first()[0] or 0
    if size <= broadcast_bytes:
        return spans.join(F.broadcast(rows), F.col(value) == F.col("__allowed"), "left_anti")
    spans = stored(spans, "spans")  # read three times from here on
    common = hot_keys(spans.filter(F.col(value).isNotNull()), [value])
    hot = stored(common.join(rows, F.col(value) == F.col("__allowed"), "left_semi").select(F.col(value).alias("__hot")), "allowed")
    rest = spans.join(F.broadcast(hot), F.col(value) == F.col("__hot"), "left_anti")
    return rest.join(rows.hint("shuffle_merge"), F.col(value) == F.col("__allowed"), "left_anti")


def _bins(start: Column, end: Column, width: int = BIN) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor((end - 1) / width)))


def _bits(start: Column, end: Column, bin_: Column) -> Column:
    """The offsets of a bin of 64 that a span covers, as bits of a long."""
    low = F.greatest(start - bin_ * BIN, F.lit(0)).cast("int")
    n = (F.least(end - bin_ * BIN, F.lit(BIN)) - low).cast("int")
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), F.lit(BIN) - n)  # n is 1 at least
    return F.call_function("shiftleft", ones, low)


def without_overlapped(spans: DataFrame, others: DataFrame, keys: Sequence[str], start: str = "start_at", end: str = "end_at") -> DataFrame:
    """Spans that no span of ``others`` with the same keys overlaps. Empty spans, and those without keys or offsets, overlap nothing.

    For each (keys, bin), what the others cover is gathered to one number while it is read, however many they are; a span
    then meets one row a bin. No two spans are ever paired.
    """
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    binned = lambda df: df.filter(s < e).select(*keys, s.alias("__s"), e.alias("__e")).distinct().select("*", _bins(F.col("__s"), F.col("__e")).alias("__bin"))
    bits = _bits(F.col("__s"), F.col("__e"), F.col("__bin"))
    covered = binned(others).groupBy(*keys, "__bin").agg(F.bit_or(bits).alias("__covered"))
    met = binned(spans).join(covered, [*keys, "__bin"]).filter(bits.bitwiseAND(F.col("__covered")) != 0)
    hit = met.select(*keys, F.col("__s").alias("__hit_s"), F.col("__e").alias("__hit_e")).distinct()
    on = [spans[k] == hit[k] for k in keys] + [spans[start] == hit["__hit_s"], spans[end] == hit["__hit_e"]]
    return spans.join(hit, on, "left_anti")


def overlap_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], start: str = "start_at", end: str = "end_at", width: int = BIN) -> DataFrame:
    """``keys, left, right``: pairs of rows (as structs) whose spans overlap, each once: in the first bin that both reach."""
    side = lambda df, name: df.select(*keys, F.struct(*df.columns).alias(name), F.col(start).cast("long").alias(f"{name}_s"), F.col(end).cast("long").alias(f"{name}_e")).filter(F.col(f"{name}_s") < F.col(f"{name}_e")).select("*", _bins(F.col(f"{name}_s"), F.col(f"{name}_e"), width).alias("__bin"))
    met = side(left, "left").join(side(right, "right"), [*keys, "__bin"])
    first = F.floor(F.greatest("left_s", "right_s") / width)
    return met.filter((F.col("left_s") < F.col("right_e")) & (F.col("right_s") < F.col("left_e")) & (F.col("__bin") == first)).select(*keys, "left", "right")
