"""Restoring placeholders in streams of server-sent events, however chunks cut them.

``SseRestorer`` holds one stream's state; ``restore_stream`` runs it over a streaming DataFrame, with the state
kept by Spark between micro-batches, and ``restore_chunks`` over a batch.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_PENDING = 32
_BOUNDARY = re.compile(r"\r\n\r\n|\n\n")
_LINE = re.compile(r"\r?\n")


class TextDelta:
    """Text as it comes in: what may begin a placeholder waits until it ends or grows too long."""

    def __init__(self, originals: Mapping[str, str], pending: str = ""):
        self.originals, self.pending = originals, pending
        self.most = max(MIN_PENDING, max(map(len, originals), default=0))

    def process(self, text: str) -> str:
        rest, out = self.pending + text, []
        while rest:
            plain, bracket, tail = rest.partition("[")
            out.append(plain)
            rest = bracket + tail
            close = rest.find("]")
            if not rest or (close < 0 and len(rest) <= self.most):
                break
            if close < 0:  # too long for a placeholder: its bracket is text
                out.append("[")
                rest = rest[1:]
            else:
                token = rest[: close + 1]
                out.append(self.originals.get(token, token))
                rest = rest[close + 1 :]
        self.pending = rest
        return "".join(out)

    def flush(self) -> str:
        tail, self.pending = self.pending, ""
        return tail


def _dump(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


class SseRestorer:
    """Events of a stream; ``provider`` decides where in an event's JSON the text is."""

    def __init__(self, provider: str, originals: Mapping[str, str], state: Sequence | None = None):
        self.provider = provider
        buffer, pending, index = state if state is not None else ("", "", 0)
        self.buffer, self.index, self.text = buffer, index, TextDelta(originals, pending)

    @property
    def state(self) -> tuple[str, str, int]:
        return self.buffer, self.text.pending, self.index

    def process(self, chunk: str) -> str:
        self.buffer += chunk
        out = []
        while (m := _BOUNDARY.search(self.buffer)) is not None:
            event, self.buffer = self.buffer[: m.start()], self.buffer[m.end() :]
            out += [self._event(event), m[0]]
        return "".join(out)

    def flush(self) -> str:
        out = self._event(self.buffer) if self.buffer else ""
        self.buffer = ""
        tail = self.text.flush()
        if not tail:
            return out
        return out + "\n".join(self._tail(tail)) + ("\n\n" if self.provider == "openai" else "\n")

    def _tail(self, tail: str) -> list[str]:
        if self.provider == "openai":
            return [f"data: {_dump({'choices': [{'index': self.index, 'delta': {'content': tail}}]})}"]
        return ["event: content_block_delta", f"data: {_dump({'type': 'content_block_delta', 'index': self.index, 'delta': {'type': 'text_delta', 'text': tail}})}", ""]

    def _event(self, event: str) -> str:
        lines = _LINE.split(event)
        names = [x[6:].strip() for x in lines if x.startswith("event:")]
        change = self._openai if self.provider == "openai" else self._anthropic
        out: list[str] = []
        for line in lines:
            payload = line[5:].lstrip() if line.startswith("data:") else ""
            if payload == "[DONE]" and self.provider == "openai":
                tail = self.text.flush()
                out += [*(self._tail(tail) if tail else ()), "data: [DONE]"]
                continue
            try:
                parsed = json.loads(payload) if payload and payload != "[DONE]" else None
            except ValueError:
                parsed = None
            if parsed is None:
                out.append(line)
                continue
            if isinstance(parsed, dict):
                out += change(parsed, names[-1] if names else None)
            out.append(f"data: {_dump(parsed)}")
        return "\n".join(out)

    def _anthropic(self, parsed: dict, name: str | None) -> list[str]:
        kinds = (parsed.get("type"), name)
        if "content_block_delta" in kinds:
            if _number(parsed.get("index")):
                self.index = parsed["index"]
            delta = parsed.get("delta")
            if isinstance(delta, dict) and delta.get("type") == "text_delta" and isinstance(delta.get("text"), str):
                delta["text"] = self.text.process(delta["text"])
        tail = self.text.flush() if "message_stop" in kinds else ""
        return self._tail(tail) if tail else []

    def _openai(self, parsed: dict, name: str | None) -> list[str]:
        choices = parsed.get("choices")
        for choice in choices if isinstance(choices, list) else ():
            if not isinstance(choice, dict):
                continue
            if _number(choice.get("index")):
                self.index = choice["index"]
            delta = choice.get("delta")
            if isinstance(delta, dict) and isinstance(delta.get("content"), str):
                delta["content"] = self.text.process(delta["content"])
        return []


def _number(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


OUTPUT = "stream_id string, seq int, restored string"
STATE = "buffer string, pending string, last_index int, provider string, originals map<string,string>"


def _rows(frames: Iterator[pd.DataFrame]) -> list[tuple]:
    found = [r for f in frames for r in f[["seq", "provider", "chunk", "last", "originals"]].itertuples(index=False, name=None)]
    return sorted(found, key=lambda r: r[0])


def restore_stream(chunks: DataFrame, timeout: str = "NoTimeout") -> DataFrame:
    """Restored chunks of a streaming DataFrame ``stream_id, seq, provider, chunk, last, originals``.

    Rows of a stream are taken by ``seq`` within a micro-batch. ``last`` ends a stream: what waits is given out
    and its state goes. ``originals`` (placeholder to original) counts from a stream's first row on.
    """
    from pyspark.sql.streaming.state import GroupState

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _rows(frames)
        buffer, pending, index, provider, originals = state.get if state.exists else ("", "", 0, rows[0][1], dict(rows[0][4] or {}))
        made, out = SseRestorer(provider, dict(originals), (buffer, pending, index)), []
        ended = False
        for seq, _, chunk, last, _ in rows:
            text = made.process(chunk or "")
            if last:
                text += made.flush()
                ended = True
            out.append((key[0], seq, text))
        if ended:
            state.remove()
        else:
            state.update((*made.state, provider, originals))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "restored"])

    return chunks.groupBy("stream_id").applyInPandasWithState(run, OUTPUT, STATE, "append", timeout)


def restore_chunks(chunks: DataFrame) -> DataFrame:
    """The same for a batch; a task goes through its streams chunk by chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, made = object(), None
        for batch in batches:
            out = []
            for stream, seq, provider, chunk, last, originals in batch.itertuples(index=False, name=None):
                if stream != current:
                    current, made = stream, SseRestorer(provider, dict(originals if originals is not None else {}))
                text = made.process(chunk or "")
                out.append((stream, seq, text + made.flush() if last else text))
            yield pd.DataFrame(out, columns=["stream_id", "seq", "restored"])

    columns = ["stream_id", "seq", "provider", "chunk", "last", "originals"]
    return chunks.select(*columns).repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInPandas(run, OUTPUT)


def events_of(chunks: DataFrame) -> DataFrame:
    """Events of streams (``stream_id, seq, chunk``): ``stream_id, event_no, event``.

    A task goes through its streams chunk by chunk and holds the event that isn't complete yet, not the stream. Empty
    events are numbered but not given; what is left at a stream's end is an event.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, rest, number, started = None, "", 0, False
        for batch in batches:
            out = []
            for stream, chunk in batch.itertuples(index=False, name=None):
                if not started or stream != current:
                    if rest:
                        out.append((current, number, rest))
                    current, rest, number, started = stream, "", 0, True
                searched = max(0, len(rest) - 3)  # a boundary may begin in what was there
                rest += chunk or ""
                begin = 0
                while (m := _BOUNDARY.search(rest, max(begin, searched))) is not None:
                    if m.start() > begin:
                        out.append((stream, number, rest[begin : m.start()]))
                    begin, number = m.end(), number + 1
                rest = rest[begin:]
            yield pd.DataFrame(out, columns=["stream_id", "event_no", "event"])
        if rest:
            yield pd.DataFrame([(current, number, rest)], columns=["stream_id", "event_no", "event"])

    kind = dict(chunks.dtypes)["stream_id"]
    return chunks.select("stream_id", "seq", "chunk").repartition("stream_id").sortWithinPartitions("stream_id", "seq").select("stream_id", "chunk").mapInPandas(run, f"stream_id {kind}, event_no int, event string")


def session_streams(chunks: DataFrame, mapping: DataFrame, session: str = "session") -> DataFrame:
    """Chunks with their session's ``originals``, for ``restore_stream``: a stream-static join."""
    maps = mapping.filter("reversible").groupBy(session).agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "original"))).alias("originals"))
    return chunks.join(maps, session, "left")


