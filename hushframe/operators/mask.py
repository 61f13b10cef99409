"""Masking: stages one after the other, each on what the last one left, with numbered placeholders.

``mask_documents`` numbers within each row and needs no shuffle. ``mask_sessions`` numbers within a session:
rows are masked where they are, the values they hold are numbered over slices of the session, and the rows' own
placeholders are then replaced; a session of any size is spread over tasks, and no session's mapping is ever in
one row or task. ``mask_sessions_exact`` replays a session's rows in order with its state, for configurations
whose detectors look into placeholders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.config import Config
from hushframe.functions.detect import Detector, Span, is_blank, select
from hushframe.functions.spans import drop_allowed, literal, no_spans, resolve, splice
from hushframe.functions.spans import is_blank as is_blank_column
from hushframe.operators.analyze import apart, dictionary_part, heuristic_parts, pattern_part
from hushframe.operators.arrow import listed_structs, parts_of
from hushframe.operators.dictionary_table import StoredDictionary
from hushframe.operators.mapping import MAPPING, TOKEN, Mapping, RowMapping, letters_column, restore_column
from hushframe.operators.slices import dealt, is_few, numbered, parts_for, salted_join
from hushframe.operators.storage import stored

EVENTS = "array<struct<category: string, placeholder: string, confidence: double, start: int, end: int>>"
MASKED = f"struct<masked: string, mapping: {MAPPING}, events: {EVENTS}>"
_ROW = ("original", "category", "prefix", "seq", "placeholder", "reversible")
_EVENT = ("category", "placeholder", "confidence", "start", "end")


class Masker:
    """Masks one text at a time into a session's mapping."""

    def __init__(self, config: Config, plugins: Sequence = (), provider: Callable | None = None):
        self.config, self.detector = config, Detector(config, plugins, provider)

    def _apply(self, text: str, spans: list[Span], mapping: Mapping, events: list[tuple]) -> str:
        # From right to left, so a text's last value gets the first number.
        for found, category, start, end, confidence in reversed(select(spans)):
            if found in self.config.allowlist:
                continue
            made = mapping.register(found, category, self.config.prefix(category))
            events.append((category, made, confidence, start, end))
            text = text[:start] + made + text[end:]
        return text

    def mask(self, text: str | None, mapping: Mapping, use_provider: bool = True, listed: Sequence[Span] = ()) -> tuple[str | None, list[tuple]]:
        """The masked text and an event for each occurrence; positions are in the stage's own input.

        listed: what a stored dictionary found in the text, for the first stage.
        """
        events: list[tuple] = []
        if is_blank(text) or (self.detector.idle and not listed):
            return text, events
        d = self.detector
        stages = [lambda t: d.dictionary(t) + list(listed), d.patterns, d.heuristic] if d.categories else []
        stages.append(d.from_plugins)
        if use_provider and self.config.provider_enabled:
            stages.append(d.from_provider)
        for stage in stages:
            found = stage(text)
            if found:
                text = self._apply(text, found, mapping, events)
        return text, events


def mapping_array(rows: Sequence[Sequence[tuple]]) -> pa.ListArray:
    return listed_structs(rows, _ROW, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_()))


def events_array(events: Sequence[Sequence[tuple]]) -> pa.ListArray:
    return listed_structs(events, _EVENT, (pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32()))


def _packed(masked: str | None, mapping: Mapping, events: list[tuple]) -> dict:
    return {"masked": masked, "mapping": [dict(zip(_ROW, r, strict=True)) for r in mapping.shown], "events": [dict(zip(_EVENT, e, strict=True)) for e in events]}


def mask_documents(df: DataFrame, config: Config | None = None, text: str = "text", plugins: Sequence = (), provider: Callable | None = None, mapping_class: type[Mapping] = Mapping, dictionary: StoredDictionary | None = None) -> DataFrame:
    """``df`` with ``masked``, ``mapping`` and ``events``, each row a session of its own.

    A configuration that is disabled or in passthrough leaves texts as they are. Null texts stay null. In anonymize mode
    the mapping has no originals. Columns of those three
    names are replaced; all others come back as they were. ``dictionary``: entries
    of a table, after those of the configuration.
    """
    config = config or Config()

    @F.arrow_udf(MASKED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        masker = Masker(config, plugins, provider)
        for texts in (b for batch in batches for b in parts_of(batch)):
            known = texts.to_pylist()
            found = dictionary.find(known) if dictionary is not None and config.is_enabled else [()] * len(known)
            masked, rows, events = [], [], []
            for t, listed in zip(known, found, strict=True):
                mapping = mapping_class(config.reversible)
                made, met = masker.mask(t, mapping, listed=listed) if config.is_enabled else (t, [])
                masked.append(made)
                rows.append(mapping.shown)
                events.append(met)
            yield pa.StructArray.from_arrays([pa.array(masked, pa.string()), mapping_array(rows), events_array(events)], ["masked", "mapping", "events"])

    return with_fields(df, run(text), "masked", "mapping", "events")


def mask_native(df: DataFrame, config: Config | None = None, text: str = "text") -> DataFrame:
    """``mask_documents`` in built-in expressions, for configurations without plugins and provider: the same columns and values.

    Stage after stage, on what the last one left: its winners are folded from right to left over the row's mapping so far,
    which names the values it doesn't have yet, and are then spliced. A row's values are looked up one by one, so for
    texts of thousands of different values ``mask_documents`` is the quicker one.
    """
    config = config or Config()
    own = apart(df)
    out = df.withColumns({f"{own}t0": F.col(text), f"{own}rows": F.expr(f"cast(array() as {MAPPING})"), f"{own}events": F.expr(f"cast(array() as {EVENTS})")})
    last = 0
    for name in ("dictionary", "patterns", "heuristic") if config.is_enabled and config.active else ():
        t = f"{own}t{last}"

        def stage(part: str, made: Column) -> Column:
            nonlocal out
            out = out.withColumn(f"{own}{name}_{part}", made)  # noqa: B023
            return F.col(f"{own}{name}_{part}")  # noqa: B023

        if name == "heuristic":
            parts = heuristic_parts(t, config, stage)
        else:
            found = (dictionary_part if name == "dictionary" else pattern_part)(t, config)
            parts = [] if found is None else [stage("found", found)]
        if not parts:
            continue
        spans = stage("spans", F.when(is_blank_column(F.col(text)), no_spans()).otherwise(F.reverse(drop_allowed(resolve(F.concat(*parts)), config.allowlist))))
        rows = stage("rows", F.expr(_registering(f"{own}{name}_spans", f"{own}rows", config)))
        names = stage("names", F.map_from_entries(F.transform(rows, lambda r: F.struct(r["original"], r["placeholder"]))))
        events = F.transform(spans, lambda x: F.struct(x["category"].alias("category"), F.element_at(names, x["text"]).alias("placeholder"), x["confidence"].alias("confidence"), x["start"].alias("start"), x["end"].alias("end")))  # noqa: B023
        masked = splice(F.col(t), F.reverse(spans), lambda x: F.element_at(names, x["text"]))  # noqa: B023
        last += 1
        out = out.withColumns({f"{own}t{last}": F.when(F.size(spans) > 0, masked).otherwise(F.col(t)), f"{own}rows": rows, f"{own}events": F.concat(F.col(f"{own}events"), events)})
    if not config.reversible:
        hidden = F.transform(f"{own}rows", lambda r: r.withField("original", F.lit(None).cast("string")))
        out = out.withColumn(f"{own}rows", hidden)
    outputs = {"masked": f"{own}t{last}", "mapping": f"{own}rows", "events": f"{own}events"}
    return out.select(*[F.col(_quoted(c)) for c in df.columns if c not in outputs], *[F.col(c).alias(n) for n, c in outputs.items()])


def _registering(spans: str, rows: str, config: Config) -> str:
    """SQL of the fold: a mapping goes on with spans' texts, each named by its prefix's next number if it isn't there yet.

    As one text it is built much quicker than node by node.
    """
    prefix = "case x.category " + " ".join(f"when {literal(c)} then {literal(config.prefix(c))}" for c in config.active) + " end"
    letters = "aggregate(sequence(1, 14), named_struct('v', bigint(n), 's', ''), (a, i) -> if(a.v > 0, named_struct('v', (a.v - 1) div 26, 's', concat(chr((a.v - 1) % 26 + 65), a.s)), a), a -> a.s)"
    made = f"named_struct('original', y.x.text, 'category', y.x.category, 'prefix', y.p, 'seq', n, 'placeholder', concat('[', y.p, {letters}, ']'), 'reversible', {str(config.reversible).lower()})"
    more = f"concat(held, transform(array(1 + size(filter(held, r -> r.prefix = y.p))), n -> {made}))"
    return f"aggregate(transform({spans}, x -> named_struct('x', x, 'p', {prefix})), {rows}, (held, y) -> if(exists(held, r -> r.original = y.x.text), held, {more}))"


def with_fields(df: DataFrame, made: Column, *names: str) -> DataFrame:
    """``df`` with the fields of a struct, which take the place of columns that are named like them."""
    own = "__"
    while any(c.startswith(own) for c in df.columns):
        own += "_"
    kept = [F.col(_quoted(c)) for c in df.columns if c not in names]
    return df.withColumn(own, made).select(*kept, *[F.col(f"{own}.{n}").alias(n) for n in names])


def mask_sessions(df: DataFrame, session: str, order: Sequence[str], config: Config | None = None, text: str = "text", plugins: Sequence = (), provider: Callable | None = None, slices: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``masked``, and the mapping ``session, original, category, prefix, seq, placeholder, reversible``.

    ``session`` and ``order`` together identify a row; rows without a session aren't of one, and stay as they are
    but for what each of them holds by itself. Equal to the exact replay unless a detector finds something within a
    placeholder's letters.
    """
    config = config or Config()
    rows = stored(mask_documents(df, config, text, plugins, provider, RowMapping), "masked")
    parts = parts_for(rows)
    mapping, renamed = number_rows(rows, [session], order, config.reversible, slices=slices, parts=parts)
    out = dealt(rows, parts, session, *order).join(renamed.hint("shuffle_merge"), [session, *order], "left").withColumn("masked", restore_column(F.col("masked"), F.col("__new")))
    return out.drop("mapping", "events", "__new"), mapping


def number_rows(rows: DataFrame, session: Sequence[str], order: Sequence[str], reversible: bool, spelled: Callable[[Column], Column] = lambda c: c, slices: int | None = None, row: Sequence[str] = (), parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The sessions' mapping, and each row's ``__new``: what its own placeholders become.

    ``rows`` hold ``session``, ``order`` and the ``mapping`` of a ``RowMapping``. A value's number is its place among those of
    its prefix, by first row and place therein. ``spelled`` is how a placeholder stands in the masked text. ``row``: what
    tells rows apart, ``session`` and ``order`` by default. ``parts``: tasks to shuffle the rows to, if more than Spark's.
    """
    row = row or (*session, *order)
    told = [*session, *order, *(c for c in row if c not in (*session, *order))]
    held = rows.select(*told, F.posexplode("mapping").alias("place", "m")).select(*told, "place", "m.original", "m.category", "m.prefix", F.col("m.placeholder").alias("local"))
    # A struct's least is told by sorting, in the task that reads the rows as well: those are dealt evenly first if they are many.
    first = dealt(held, parts, *row).groupBy(*session, "original").agg(F.min(F.struct(*order, "place", "prefix", "category")).alias("first"), F.count("*").alias("__n"))
    values = stored(first.select(*session, "original", "first.category", "first.prefix", F.struct(*[F.col(f"first.{c}") for c in (*order, "place")]).alias("at"), "__n"), "values")
    placed = numbered(values.drop("__n"), [*session, "prefix"], ["at"], slices=slices)
    placeholder = F.concat(F.lit("["), F.col("prefix"), letters_column(F.col("seq")), F.lit("]"))
    mapping = stored(placed.select(*session, "original", "category", "prefix", "seq", placeholder.alias("placeholder"), F.lit(reversible).alias("reversible")), "mapping")
    keys = [*session, "original"]
    known = mapping.select(*keys, "placeholder")
    named = held.join(F.broadcast(known), keys) if is_few(known) else salted_join(held, known, keys, row, parts=parts, counts=values.select(*keys, "__n"))
    # A row's own values only: as bounded as the row.
    renamed = dealt(named, parts, *row).groupBy(*row).agg(F.map_from_entries(F.collect_list(F.struct(spelled(F.col("local")).alias("k"), spelled(F.col("placeholder")).alias("v")))).alias("__new"))
    shown = mapping if reversible else mapping.withColumn("original", F.lit(None).cast("string"))
    return shown, renamed


def mask_sessions_exact(df: DataFrame, session: str, order: Sequence[str], config: Config | None = None, text: str = "text", plugins: Sequence = (), provider: Callable | None = None, resets: str | None = None) -> DataFrame:
    """``session, *order, masked, mapping, events``: rows replayed in order, one session after the other.

    A task streams through its sessions and holds one mapping, not a session's rows. ``resets``: a boolean
    column that starts a new mapping. ``mapping`` has what the row added.
    """
    config = config or Config()
    columns = [session, *order, text, *([resets] if resets else [])]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (session, *order)) + f", masked string, mapping {MAPPING}, events {EVENTS}"

    def run(batches):
        masker, current, mapping = Masker(config, plugins, provider), object(), Mapping(config.reversible)
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                values = dict(zip(columns, row, strict=True))
                if values[session] != current or (resets and values[resets]):
                    current, mapping = values[session], Mapping(config.reversible)
                known = len(mapping.rows)
                masked, events = masker.mask(values[text], mapping) if config.is_enabled else (values[text], [])
                packed = _packed(masked, mapping, events)
                out.append([*(values[c] for c in (session, *order)), masked, packed["mapping"][known:], packed["events"]])
            yield pd.DataFrame(out, columns=[session, *order, "masked", "mapping", "events"])

    return df.select(*columns).repartition(session).sortWithinPartitions(session, *order).mapInPandas(run, schema)


def audit_events(masked: DataFrame, keys: Sequence[str], config: Config | None = None) -> DataFrame:
    """Metadata of each masked occurrence, never its text."""
    config = config or Config()
    # As in ``exploded``: a plain explode would mask all rows twice, the first time in the few tasks that read them.
    e = masked.select(*keys, F.explode_outer("events").alias("e")).filter("e is not null")
    return e.select(*keys, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), "e.category", "e.placeholder", "e.confidence", F.struct("e.start", "e.end").alias("position"), F.lit(config.mode).alias("mode"), (F.col("e.confidence") < config.audit.review_threshold).alias("reviewRequired"))


def restore(df: DataFrame, mapping: DataFrame, session: str, text: str = "text", output: str = "restored", config: Config | None = None) -> DataFrame:
    """``df`` with placeholders of its session put back; what is put back isn't looked at again. In anonymize mode nothing is.

    Each text's tokens are joined to the mapping by session and token, and the text is put together again from the few
    that it holds: a session's mapping is never in one place. Texts are told apart by session and SHA-256, so equal
    ones are looked up once. Rows without session or text stay as they are.
    """
    config = config or Config()
    if not config.reversible:
        return df.withColumn(output, F.col(text))
    # All of the user's columns travel as one, so none can clash with a name used here.
    rows = df.select(F.struct(*[F.col(_quoted(c)) for c in df.columns]).alias("row"), F.col(_quoted(session)).alias("session"), F.col(_quoted(text)).alias("text"))
    rows = rows.withColumn("name", F.sha2(F.col("text"), 256))
    tokens = rows.filter(F.contains("text", F.lit("["))).select("session", "name", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))).alias("token")).filter("session is not null").distinct()
    tokens = stored(tokens, "tokens")  # read three times from here on
    known = mapping.filter("reversible").select(F.col(_quoted(session)).alias("session"), F.col("placeholder").alias("token"), "original")
    found = salted_join(tokens, known, ["session", "token"], ["name"])
    held = found.groupBy("session", "name").agg(F.map_from_entries(F.collect_list(F.struct("token", "original"))).alias("originals"))
    out = rows.join(held, ["session", "name"], "left").select("row", restore_column(F.col("text"), F.col("originals")).alias("restored"))
    kept = [F.col(f"row.{_quoted(c)}").alias(c) for c in df.columns if c != output]
    return out.select(*kept, F.col("restored").alias(output))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
