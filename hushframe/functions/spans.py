"""Spans as arrays of structs, in built-in expressions: finding matches with offsets, resolving overlaps,
splicing replacements. Offsets count code points; ``utf16_offset`` converts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.functions.categories import SPANS
from hushframe.functions.patterns import PATTERNS, SPACE_JAVA, Pattern
from hushframe.functions.validators import CHECKS

NO_SPANS = f"cast(array() as {SPANS})"


def no_spans() -> Column:
    return F.expr(NO_SPANS)


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{SPACE_JAVA}]")


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def find_all(text: str, pattern: str, group: int = 0) -> Column:
    """``array<struct<m, s, g>>``: each match, its offset, and its group's text.

    ``text`` is a column's name or SQL: the expression is given to Spark as one SQL text, which is much
    quicker to build than node by node. What lies between matches, by ``split``, gives the offsets.
    """
    p = literal(pattern)
    pairs = f"zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (gap, m) -> struct(gap, m))"
    if group:
        pairs = f"zip_with({pairs}, regexp_extract_all({text}, {p}, {group}), (x, g) -> struct(x.gap as gap, x.m as m, g))"
    # The piece after the last match has no match beside it and goes.
    return F.expr(
        f"""aggregate(filter({pairs}, x -> x.m is not null),
        struct(0 as at, cast(array() as array<struct<m: string, s: int, g: string>>) as out),
        (acc, x) -> struct(acc.at + length(x.gap) + length(x.m) as at, concat(acc.out, array(struct(x.m as m, acc.at + length(x.gap) as s, {"x.g" if group else "x.m"} as g))) as out),
        acc -> acc.out)"""
    )


def span(text: Column, category: str, start: Column, end: Column, confidence: float) -> Column:
    return F.struct(text.alias("text"), F.lit(category).alias("category"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(float(confidence)).alias("confidence"))


def spans_of(found: Column, category: str, confidence: float, offset: Callable[[Column], Column] | None = None) -> Column:
    """Matches' groups as spans."""
    at = offset or (lambda x: x["s"])
    return F.transform(found, lambda x: span(x["g"], category, at(x), at(x) + F.length(x["g"]), confidence))


def guarded(text: str, made: Column, needs: Sequence[str] = (), hint: str = "") -> Column:
    """Spans if the text holds one of some literals and a simple pattern; else none, without looking."""
    asked = [" or ".join(f"contains({text}, {literal(n)})" for n in needs)] if needs else []
    asked += [f"{text} rlike {literal(hint)}"] if hint else []
    return F.when(F.expr(" and ".join(f"({a})" for a in asked)), made).otherwise(no_spans()) if asked else made


def pattern_spans(text: str, p: Pattern) -> Column:
    """Spans of one pattern. A group's offset is its first place within the match."""
    found = find_all(text, p.java, p.group)
    if p.check:
        found = F.filter(found, lambda x: CHECKS[p.check](x["g"]))
    at = (lambda x: x["s"] + F.instr(x["m"], x["g"]) - 1) if p.group else None
    return guarded(text, spans_of(found, p.category, 1.0, at), p.needs, p.hint)


def regex_spans(text: str, categories: tuple[str, ...] | None = None) -> Column:
    """Spans of all active patterns, in order of precedence."""
    parts = [pattern_spans(text, p) for p in PATTERNS if categories is None or p.category in categories]
    return F.concat(*parts) if parts else no_spans()


def compiles(pattern: str) -> bool:
    """Whether Spark can use a user's pattern; those it can't are left out, as they are by the Python detector."""
    from pyspark.errors import IllegalArgumentException
    from pyspark.sql import SparkSession

    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def custom_spans(text: str, source: str, category: str) -> Column:
    """Spans of a user's pattern; empty matches don't count."""
    return spans_of(F.filter(find_all(text, source), lambda x: F.length(x["m"]) > 0), category, 1.0)


def resolve(spans: Column) -> Column:
    """Non-overlapping winners in ascending order: leftmost first, then longest, then first found.

    Touching spans both stay. The fold is over spans sorted once; each keeps its place as tie-break.
    """
    placed = F.transform(spans, lambda x, i: F.struct(x["start"].alias("a"), (x["start"] - x["end"]).alias("b"), i.alias("c"), x.alias("x")))
    ordered = F.transform(F.array_sort(placed), lambda p: p["x"])
    start = F.struct(F.lit(-1).alias("last"), no_spans().alias("kept"))
    keep = lambda acc, x: F.when(x["start"] >= acc["last"], F.struct(x["end"].alias("last"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)
    return F.aggregate(ordered, start, keep, lambda acc: acc["kept"])


def drop_allowed(spans: Column, allowlist: tuple[str, ...]) -> Column:
    """After resolution, so that an allowed winner still hides what it overlapped."""
    if not allowlist:
        return spans
    return F.filter(spans, lambda x: ~x["text"].isin(list(allowlist)))


def splice(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """The text with each of some ascending, non-overlapping spans replaced."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, x: F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), replacement(x)).alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def utf16_offset(text: Column, offset: Column) -> Column:
    return (F.octet_length(F.encode(F.substring(text, F.lit(1), offset), "UTF-16BE")) / 2).cast("int")
