"""Masking a stream of request bodies with their sessions' mappings, kept in Spark's state.

Bodies are masked before the state, dealt to all cores, and only their values are numbered in it: in order, over small columns;
bodies wait in a temporary file. A session's values and counters are map states, so a micro-batch reads and writes only the values
that it holds, however many its session has. A timer that each request renews clears a session that has been idle for the time to live; a
header resets it; a new ``generation`` of the configuration clears all. Batch and stream agree: ``content.mask_session_requests``.
"""

from __future__ import annotations

import json
import tempfile
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from hushframe.config import Config
from hushframe.operators.analyze import DEALS
from hushframe.operators.content import mask_requests
from hushframe.operators.mapping import MAPPING, Mapping, RowMapping, restore_text
from hushframe.operators.mask import _ROW
from hushframe.operators.sessions import TTL_SECONDS, is_reset, session_key

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds for which an idle session's last epoch number is remembered, so that a later one doesn't reuse it.
REMEMBER_SECONDS = 30 * 24 * 3600
#: Requests whose order is at hand as Python numbers at a time.
STRETCH = 100_000
WAITING = pa.schema({"masked": pa.string(), "found": pa.string()})


def _spelled(text: str) -> str:
    """A text as it stands within a JSON string."""
    return json.dumps(text, ensure_ascii=False)[1:-1]


@lru_cache(1000)
def _values(found: str) -> tuple[tuple[tuple[str, str, str], str], ...]:
    """A body's values in order: original, category and prefix, and the placeholder that stands for it until it is numbered."""
    return tuple(((v["original"], v["category"], v["prefix"]), _spelled(v["placeholder"])) for v in json.loads(found))


class StateMapping(Mapping):
    """A session's mapping in map states. What a micro-batch has met is at hand; ``rows`` are those it added to the epoch. The
    states are asked until a new epoch begins, and written once, by ``save``."""

    def __init__(self, reversible: bool, values, numbers):
        super().__init__(reversible)
        self.values, self.numbers, self.fresh = values, numbers, False

    def register(self, original: str, category: str, prefix: str) -> str:
        if not self.fresh:
            if original not in self.placeholders and self.values.containsKey((original,)):
                self.placeholders[original] = self.values.getValue((original,))[0]
            if prefix not in self.counters and self.numbers.containsKey((prefix,)):
                self.counters[prefix] = int(self.numbers.getValue((prefix,))[0])
        return super().register(original, category, prefix)

    def begin(self) -> None:
        """A new epoch: nothing of the last one counts."""
        self.placeholders, self.originals, self.counters, self.rows, self.fresh = {}, {}, {}, [], True

    def save(self) -> None:
        if self.fresh:
            self.values.clear()
            self.numbers.clear()
        for original, _, _, _, made, _ in self.rows:
            self.values.updateValue((original,), (made,))
        for prefix, n in self.counters.items():
            self.numbers.updateValue((prefix,), (n,))

    def clear(self) -> None:
        self.begin()
        self.save()


class SessionMasker(StatefulProcessor):
    """One session's requests, in order of time and keys within a micro-batch: masked as rows of their own, they get the
    session's placeholders. They come and go as they arrive; a micro-batch's times, keys and numbers are held, but no bodies."""

    def __init__(self, config: Config, keys: Sequence[str], ttl: float = TTL_SECONDS, generation: str = ""):
        self.config, self.keys, self.ttl, self.generation = config, list(keys), ttl, generation

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getMapState("values", "original string", "placeholder string")
        self.counters = handle.getMapState("counters", "prefix string", "n int")
        self.seen = handle.getValueState("seen", "epoch long, time double, wall long, timer long, generation string", int(REMEMBER_SECONDS * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        session, now = key[0], timerValues.getCurrentProcessingTimeInMs()
        named = session.startswith("id:")
        ids = [f"key{k}" for k in range(len(self.keys))]
        with tempfile.TemporaryFile() as waiting:
            parts, values, sizes, codes = [], {}, array("i"), array("i")
            with pa.ipc.new_stream(waiting, WAITING, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for batch in rows:
                    for found in batch["found"]:
                        held = _values(found)
                        sizes.append(len(held))
                        codes.extend([values.setdefault(value, len(values)) for value, _ in held])
                    out.write_batch(pa.RecordBatch.from_arrays([pa.array(batch[c], pa.string(), from_pandas=True) for c in WAITING.names], schema=WAITING))
                    parts.append(batch[["asked_at", "resets", *ids]])
            asked = pd.concat(parts, ignore_index=True)
            del parts
            order = asked.sort_values(["asked_at", *ids], kind="stable").index.to_numpy()
            times, resets, ends = asked.pop("asked_at").to_numpy(), asked.pop("resets").to_numpy(), np.cumsum(np.frombuffer(sizes, np.int32), dtype=np.int64)
            epoch, last, wall, timer, generation = self.seen.get() if self.seen.exists() else (0, None, None, 0, self.generation)
            idle = named and wall is not None and now - wall >= self.ttl * 1000
            fresh = idle or generation != self.generation  # the first request of this batch begins a new epoch
            mapping, values, names = StateMapping(self.config.reversible, self.values, self.counters), list(values), {}
            epochs = np.zeros(len(order), np.int64)
            numbers, added = array("i", bytes(4 * len(codes))), array("i", bytes(4 * len(codes)))  # of a value: its placeholder; its number, if new
            for lo in range(0, len(order), STRETCH):
                at = order[lo : lo + STRETCH]
                for k, time, reset, end in zip(at.tolist(), times[at].tolist(), resets[at].tolist(), ends[at].tolist(), strict=True):
                    gone = named and last is not None and time - last >= self.ttl
                    if epoch == 0 or fresh or gone or reset:
                        mapping.begin()
                        epoch, fresh = epoch + 1, False
                    epochs[k], last = epoch, time
                    for j in range(end - sizes[k], end):
                        known = len(mapping.rows)
                        made = mapping.register(*values[codes[j]])
                        numbers[j] = names.setdefault(made, len(names))
                        if len(mapping.rows) > known:
                            added[j] = mapping.rows[-1][3]
            mapping.save()
            if timer:
                self.handle.deleteTimer(timer)
            timer = int(now + self.ttl * 1000) if named else 0
            if timer:
                self.handle.registerTimer(timer)
            self.seen.update((epoch, last, now, timer, self.generation))
            del order, times, resets, ends, mapping
            waiting.seek(0)
            yield from self.named(session, waiting, asked, epochs, numbers, added, list(names))

    def named(self, session: str, waiting, asked: pd.DataFrame, epochs: np.ndarray, numbers: array, added: array, names: list[str]) -> Iterator[pd.DataFrame]:
        """The bodies that wait, with their session's placeholders, and the mapping that each added."""
        spelled, lo, j = [_spelled(n) for n in names], 0, 0
        for batch in pa.ipc.open_stream(waiting):
            bodies, mappings = [], []
            for masked, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held, own, more = _values(found), {}, []
                for (original, category, prefix), local in held:
                    own[local] = spelled[numbers[j]]
                    if added[j]:
                        more.append((original if self.config.reversible else None, category, prefix, added[j], names[numbers[j]], self.config.reversible))
                    j += 1
                bodies.append(masked and restore_text(masked, own))
                mappings.append([dict(zip(_ROW, r, strict=True)) for r in more])
            made = asked.iloc[lo : lo + len(batch)].set_axis(self.keys, axis=1)
            yield made.assign(session=session, epoch=epochs[lo : lo + len(batch)], masked=bodies, mapping=mappings)
            lo += len(batch)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        """What the session held goes; the next request begins a new epoch."""
        StateMapping(self.config.reversible, self.values, self.counters).clear()
        yield pd.DataFrame([], columns=[*self.keys, "session", "epoch", "masked", "mapping"])

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """State of this kind lives in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def mask_request_stream(df: DataFrame, keys: Sequence[str], config: Config | None = None, body: str = "body", time: str = "ts", headers: str = "headers", connection: str = "conn_id", ttl: float = TTL_SECONDS, generation: str = "") -> DataFrame:
    """``keys, session, epoch, masked, mapping`` of a streaming DataFrame of requests; ``mapping`` has what a request added.

    A session expires if the gap between two of its requests, by ``time`` or by the clock, is ``ttl`` seconds or more.
    Another ``generation`` than the state was kept with begins new epochs: give each configuration one of its own.
    Start the query after ``use_rocksdb``. With the trigger ``availableNow``, turn
    ``spark.sql.streaming.noDataMicroBatches.enabled`` off, or the timers keep it running.
    """
    config = config or Config()
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", session string, epoch long, masked string, mapping {MAPPING}"
    alone = F.concat(F.lit("request:"), F.to_json(F.struct(*keys)))
    # Names that begin with an underscore don't reach the processor, so the user's keys get plain ones.
    asked = df.select(
        *[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)],
        F.coalesce(session_key(F.col(headers), F.col(connection)), alone).alias("session"),
        F.col(time).cast("timestamp").cast("double").alias("asked_at"),
        is_reset(F.col(headers)).alias("resets"),
        F.col(body).alias("body"),
    )
    ids = [f"key{i}" for i in range(len(keys))]
    dealt = asked.repartition(DEALS * df.sparkSession.sparkContext.defaultParallelism, *ids)
    found = F.transform("mapping", lambda m: F.struct(*[m[c].alias(c) for c in ("original", "category", "prefix", "placeholder")]))
    masked = mask_requests(dealt, config, mapping_class=RowMapping).select(*ids, "session", "asked_at", "resets", "masked", F.to_json(found).alias("found"))
    return masked.groupBy("session").transformWithStateInPandas(SessionMasker(config, keys, ttl, generation), schema, "Append", "ProcessingTime")
