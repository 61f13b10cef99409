"""Request and response bodies as JSON: which strings are masked or restored, and which stay."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from itertools import count

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.config import Config
from hushframe.operators.analyze import apart
from hushframe.operators.mapping import MAPPING, Mapping, OpenMapping, RowMapping, restore_column, restore_text
from hushframe.operators.mask import Masker, _packed, mapping_array, number_rows, parts_of, with_fields
from hushframe.operators.provider import MAX_CHARS, provider_table
from hushframe.operators.sessions import TTL_SECONDS, acquire
from hushframe.operators.slices import dealt, parts_for
from hushframe.operators.storage import stored

LEAVES = "array<struct<section: string, msg_idx: int, path: string, role: string, text: string>>"


def walk_strings(value, change: Callable[[str], str]):
    """Every string value at any depth; keys, numbers, booleans and nulls stay."""
    if isinstance(value, str):
        return change(value)
    if isinstance(value, list):
        return [walk_strings(x, change) for x in value]
    if isinstance(value, dict):
        return {k: walk_strings(x, change) for k, x in value.items()}
    return value


def walk_content(content, change: Callable[[str], str]):
    """A message's content: text blocks, tool results (also nested), all strings of a tool's input."""
    if isinstance(content, str):
        return change(content)
    if not isinstance(content, list):
        return content
    out = []
    for block in content:
        if isinstance(block, dict):
            kind, inner = block.get("type"), block.get("content")
            if kind == "text" and isinstance(block.get("text"), str):
                block = block | {"text": change(block["text"])}
            elif kind == "tool_result" and isinstance(inner, (str, list)):
                block = block | {"content": walk_content(inner, change)}
            elif kind == "tool_use" and "input" in block:
                block = block | {"input": walk_strings(block["input"], change)}
        out.append(block)
    return out


def walk_request(body: dict, change: Callable[[str, bool], str]) -> dict:
    """``system``, then ``messages`` in order; nothing else. ``change`` also gets whether the language-model
    stage may run: not for the top-level system text."""
    out = dict(body)
    plain = lambda t: change(t, False)
    system = out.get("system")
    if isinstance(system, str):
        out["system"] = plain(system)
    elif isinstance(system, list):
        out["system"] = [b | {"text": plain(b["text"])} if isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str) else b for b in system]
    if isinstance(out.get("messages"), list):
        out["messages"] = [m | {"content": walk_content(m["content"], lambda t: change(t, True))} if isinstance(m, dict) and "content" in m else m for m in out["messages"]]
    return out


def parsed(body: str | None) -> dict | None:
    try:
        found = json.loads(body)
    except (TypeError, ValueError):
        return None
    return found if isinstance(found, dict) else None


def leaves_of(body: dict) -> Iterator[tuple]:
    """``section, msg_idx, path, role, text`` of each string that masking would see, in its order."""
    def inside(value, path):
        if isinstance(value, str):
            yield path, value
        elif isinstance(value, (list, dict)):
            for k, x in enumerate(value) if isinstance(value, list) else value.items():
                yield from inside(x, f"{path}.{k}")

    def content(value, path):
        if isinstance(value, str):
            yield path, value
        for k, b in enumerate(value) if isinstance(value, list) else ():
            if not isinstance(b, dict):
                continue
            if b.get("type") == "text" and isinstance(b.get("text"), str):
                yield f"{path}.{k}.text", b["text"]
            elif b.get("type") == "tool_result":
                yield from content(b.get("content"), f"{path}.{k}.content")
            elif b.get("type") == "tool_use" and "input" in b:
                yield from inside(b["input"], f"{path}.{k}.input")

    system = body.get("system")
    if isinstance(system, str):
        yield "system", -1, "system", None, system
    for k, b in enumerate(system) if isinstance(system, list) else ():
        if isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str):
            yield "system", -1, f"system.{k}.text", None, b["text"]
    for k, m in enumerate(body["messages"]) if isinstance(body.get("messages"), list) else ():
        if isinstance(m, dict) and "content" in m:
            for path, text in content(m["content"], "content"):
                yield "messages", k, path, m.get("role") if isinstance(m.get("role"), str) else None, text


def leaves(body: Column) -> Column:
    @F.pandas_udf(LEAVES)
    def run(bodies: pd.Series) -> pd.Series:
        names = ("section", "msg_idx", "path", "role", "text")
        return pd.Series([[dict(zip(names, x, strict=True)) for x in leaves_of(found)] if (found := parsed(b)) is not None else None for b in bodies])

    return run(body)


def invalid_json(df: DataFrame, body: str = "body") -> DataFrame:
    """The rows whose body isn't JSON."""
    return df.filter(F.try_parse_json(F.col(body)).isNull())


def masked_body(body: str | None, masker: Masker, mapping: Mapping) -> str | None:
    """One body masked into a session's mapping, as compact JSON; None if it isn't a JSON object."""
    found = parsed(body)
    if found is None or not masker.config.is_enabled:
        return body if found is not None else None
    made = walk_request(found, lambda t, llm: masker.mask(t, mapping, llm)[0])
    return json.dumps(made, ensure_ascii=False, separators=(",", ":"))


def mask_requests(df: DataFrame, config: Config | None = None, body: str = "body", plugins: Sequence = (), provider: Callable | None = None, mapping_class: type[Mapping] = Mapping) -> DataFrame:
    """``df`` with ``masked`` (the body as compact JSON) and ``mapping``; each body is a session.

    Invalid bodies give null. A disabled configuration returns the body as it is.
    """
    config = config or Config()

    @F.arrow_udf(f"struct<masked: string, mapping: {MAPPING}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        masker = Masker(config, plugins, provider)
        for bodies in (b for batch in batches for b in parts_of(batch)):
            masked, rows = [], []
            for b in bodies.to_pylist():
                mapping = mapping_class(config.reversible)
                masked.append(masked_body(b, masker, mapping))
                rows.append(mapping.shown)
            yield pa.StructArray.from_arrays([pa.array(masked, pa.string()), mapping_array(rows)], ["masked", "mapping"])

    return with_fields(df, run(body), "masked", "mapping")


def mask_requests_with_provider(df: DataFrame, keys: Sequence[str], provider: Callable, config: Config | None = None, body: str = "body", plugins: Sequence = (), most: int = MAX_CHARS) -> DataFrame:
    """``mask_requests`` with a language model asked last, about many texts of many bodies a call.

    ``keys`` tell bodies apart and aren't null. What the other stages left of each message's texts is packed to calls within a
    partition; a body's finds are then masked into its own mapping, text by text in order. The top-level system text isn't asked about.
    """
    config = config or Config()
    rows = stored(mask_requests(df, config, body, plugins, mapping_class=OpenMapping), "masked")
    texts = rows.select(*keys, F.posexplode(leaves(F.col("masked"))).alias("leaf", "x")).filter("x.section = 'messages'").select(*keys, "leaf", "x.text")
    found = provider_table(texts, [*keys, "leaf"], provider, config.active if config.is_enabled else (), "text", most)
    # A body's own texts only: as bounded as the body.
    by_body = found.filter(F.size("spans") > 0).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("leaf", "spans"))).alias("__found"))

    @F.pandas_udf(f"struct<masked: string, mapping: {MAPPING}>")
    def put(bodies: pd.Series, mappings: pd.Series, finds: pd.Series) -> pd.DataFrame:
        masker, out = Masker(config), []
        for text, rows_, at in zip(bodies, mappings, finds, strict=True):
            known = [dict(r) for r in rows_]
            if at is None or text is None:
                out.append((text, _packed(None, Mapping.of(known, config.reversible), [])["mapping"]))
                continue
            spans = {int(k): [(s["text"], s["category"], s["start"], s["end"], s["confidence"]) for s in v] for k, v in dict(at).items()}
            mapping, leaf = Mapping.of(known, config.reversible), count()
            change = lambda t, _: masker._apply(t, spans.get(next(leaf), []), mapping, [])  # noqa: B023, E731
            out.append((json.dumps(walk_request(json.loads(text), change), ensure_ascii=False, separators=(",", ":")), _packed(None, mapping, [])["mapping"]))
        return pd.DataFrame(out, columns=["masked", "mapping"])

    met = rows.join(by_body, list(keys), "left")
    return with_fields(met, put("masked", "mapping", "__found"), "masked", "mapping").drop("__found")


def in_json(text: Column) -> Column:
    """A text as it stands within a JSON string, for texts without control characters."""
    return F.regexp_replace(text, r'(["\\])', r"\\$1")


def mask_session_requests(df: DataFrame, keys: Sequence[str], config: Config | None = None, body: str = "body", time: str = "ts", headers: str = "headers", connection: str = "conn_id", plugins: Sequence = (), provider: Callable | None = None, ttl: float = TTL_SECONDS, slices: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Requests masked with their sessions' mappings: ``df`` with ``session``, ``epoch``, ``masked``, and the mapping of all
    sessions, ``session, epoch, original, category, prefix, seq, placeholder, reversible``.

    A session's requests share one mapping, in order of ``time``, then ``keys`` (which tell requests apart), until it
    expires or a header resets it; then a new epoch begins. A request with neither a session's name nor a connection is a
    session of its own. Bodies are masked where they are and their values numbered over slices, so one
    session may hold most requests; the bodies themselves are shuffled once, at the end. Invalid bodies give null and take part in the order only.
    """
    config = config or Config()
    row = apart(df) + "row"
    rows = stored(mask_requests(df.withColumn(row, F.monotonically_increasing_id()), config, body, plugins, provider, RowMapping), "requests")
    parts, order = parts_for(rows), [time, *(k for k in keys if k != time)]
    alone = F.concat(F.lit("request:"), F.to_json(F.struct(*keys)))
    asked = rows.select(row, *dict.fromkeys([*order, headers, connection]))
    taken = stored(acquire(asked, time, headers, connection, keys, ttl, slices).select(row, F.coalesce("session", alone).alias("session"), "epoch", *order), "taken")
    held = dealt(rows.filter(F.size("mapping") > 0).select(row, "mapping"), parts, row).join(dealt(taken, parts, row).hint("shuffle_merge"), row)
    mapping, renamed = number_rows(stored(held, "held"), ["session", "epoch"], order, config.reversible, in_json, slices, [row], parts)
    names = dealt(taken.select(row, "session", "epoch"), parts, row).join(renamed.hint("shuffle_merge"), row, "left")
    out = dealt(rows.drop("session", "epoch"), parts, row).join(names.hint("shuffle_merge"), row).withColumn("masked", restore_column(F.col("masked"), F.col("__new")))
    return out.drop("mapping", "__new", row), mapping


def restore_json(body: Column, originals: Column, config: Config | None = None) -> Column:
    """Every string of a response restored; bodies that aren't JSON stay as they are."""
    config = config or Config()
    if not config.is_enabled or not config.reversible:
        return body

    @F.pandas_udf("string")
    def run(bodies: pd.Series, maps: pd.Series) -> pd.Series:
        out = []
        for b, m in zip(bodies, maps, strict=True):
            try:
                known = dict(m) if m is not None else {}
                out.append(json.dumps(walk_strings(json.loads(b), lambda t: restore_text(t, known)), ensure_ascii=False, separators=(",", ":")))  # noqa: B023
            except (TypeError, ValueError):
                out.append(b)
        return pd.Series(out)

    return run(body, originals)
