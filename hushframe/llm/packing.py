"""Packing token sequences into fixed windows by non-negative least squares.

Documents longer than the window give whole windows first; what is left has a length below the window.
Shallow combinations of two to four lengths that fill a window exactly are enumerated from the histogram
of those lengths; non-negative least squares finds how often to repeat each, so that together they use
the histogram up; counts are rounded down, topped up greedily, and the residual documents are packed end
to end, cut where a window ends. Only the last window can need padding.

The driver sees the histogram (one row a length, below the window) and one row a partition, never
documents. A document's rank among those of its length, counted partition by partition, decides its place.

Defined cases: null text counts as empty (one end id); an empty table gives no rows; repeated rows are each
packed; a null ``doc_id`` is kept; extra columns are ignored; ties of length go by the order of rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Mapping
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.llm.common import make_importable, shared_dir, table
from hushframe.llm.tokens import encoder

WINDOW = 4096
END_ID = 2
#: The most frequent lengths, from which combinations of three and four are made.
HEADS = {3: 48, 4: 14}
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations_of(histogram: Mapping[int, int], window: int = WINDOW) -> list[tuple[int, ...]]:
    """Sorted tuples of two to four lengths of the histogram whose sum is the window."""
    have = {n for n, c in histogram.items() if c > 0}
    out = {(a, window - a) for a in have if a <= window - a and window - a in have}
    often = sorted(have, key=lambda n: (-histogram[n], n))
    for depth, heads in HEADS.items():
        for chosen in combinations_with_replacement(sorted(often[:heads]), depth - 1):
            last = window - sum(chosen)
            if last in have:
                out.add(tuple(sorted((*chosen, last))))
    return sorted(out)


def nnls(columns: list[dict[int, int]], target: Mapping[int, int], sweeps: int = 60, tolerance: float = 1e-3) -> np.ndarray:
    """min |A x - b| for x >= 0 by cyclic coordinate descent on sparse columns."""
    x = [0.0] * len(columns)
    residual = {n: float(c) for n, c in target.items()}
    norms = [float(sum(v * v for v in c.values())) for c in columns]
    for _ in range(sweeps):
        moved = 0.0
        for k, column in enumerate(columns):
            step = max(-x[k], sum(residual.get(n, 0.0) * v for n, v in column.items()) / norms[k])
            if step:
                x[k] += step
                moved = max(moved, abs(step))
                for n, v in column.items():
                    residual[n] = residual.get(n, 0.0) - step * v
        if moved < tolerance:
            break
    return np.array(x)


class Plan:
    """Where the k-th document of a length goes."""

    def __init__(self, histogram: Mapping[int, int], window: int = WINDOW):
        combos = combinations_of(histogram, window)
        columns = [{n: c.count(n) for n in set(c)} for c in combos]
        repeats = nnls(columns, histogram)
        left = dict(histogram)
        self.slots: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in histogram}
        self.sequences = 0
        counts = [0] * len(combos)
        for greedy in (False, True):
            for k in sorted(range(len(combos)), key=lambda k: (-repeats[k], k)):
                fits = min(left[n] // v for n, v in columns[k].items())
                n_times = fits if greedy else min(fits, int(repeats[k]))
                counts[k] += n_times
                for n, v in columns[k].items():
                    left[n] -= v * n_times
        used = dict.fromkeys(histogram, 0)
        for combo, times in zip(combos, counts, strict=True):
            offset = 0
            for n in combo if times else ():
                self.slots[n].append((used[n], used[n] + times, self.sequences, offset))
                used[n] += times
                offset += n
            self.sequences += times
        self.used, self.base, at = used, {}, 0
        for n in sorted(histogram, reverse=True):  # what is left, end to end, longest first
            self.base[n] = at
            at += n * left[n]
        self.window, self.residual = window, at
        self.starts = {n: [s[0] for s in slots] for n, slots in self.slots.items()}

    def places(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """Pieces ``(from, to, sequence, offset)`` of that document."""
        if rank < self.used[length]:
            lo, _, sequence, offset = self.slots[length][bisect.bisect_right(self.starts[length], rank) - 1]
            return [(0, length, sequence + rank - lo, offset)]
        at, out, done = self.base[length] + (rank - self.used[length]) * length, [], 0
        while done < length:
            step = min(length - done, self.window - at % self.window)
            out.append((done, done + step, self.sequences + at // self.window, at % self.window))
            done, at = done + step, at + step
        return out


def tokenised(docs: DataFrame, folder: str, window: int, end_id: int, tokenizer: str | None) -> DataFrame:
    """Ids of all documents, in a table in the shared folder, with ranks within the partition they came from."""

    def run(batches):
        from pyspark import TaskContext

        part, ids, ranks, whole, row = TaskContext.get().partitionId(), encoder(tokenizer), {}, 0, 0
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            out, held = [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                made = np.frombuffer(ids.encode_bytes(text) + end, "<u4")
                rest = len(made) % window
                ranks[rest] = rank = ranks.get(rest, -1) + 1
                narrow = made.astype("<u2") if made.max() < 65_536 else made
                out.append((None if pd.isna(doc_id) else int(doc_id), part, len(made), rest, rank, whole, narrow.itemsize, narrow.tobytes()))
                whole += len(made) // window
                held += len(narrow) * narrow.itemsize
                if held > 8 << 20:
                    yield frame(out)
                    out, held = [], 0
            if out:
                yield frame(out)
        ids.forget()  # a pipeline's other stages run in the same worker

    names = ["doc_id", "part", "n", "rest", "rank", "whole", "bytes_each", "ids"]
    frame = lambda out: pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, part int, n long, rest int, rank long, whole long, bytes_each int, ids binary")
    made.write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(made.schema).parquet(folder)


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = docs.sparkSession
    ids = tokenised(docs, shared_dir(spark, "packing"), window, end_id, tokenizer)
    by_part = ids.groupBy("part", "rest").agg(F.count("*").alias("n"))
    histogram = {r["rest"]: r["n"] for r in by_part.filter("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    wholes = {r["part"]: r["n"] for r in ids.groupBy("part").agg(F.sum(F.expr(f"n div {window}")).alias("n")).collect()}  # one row a partition
    first, full = {}, 0
    for part in sorted(wholes):
        first[part] = full
        full += wholes[part]
    plan = Plan(histogram, window)
    before = by_part.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "rest", "before")

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, part, n, rest, rank, whole, bytes_each, raw, before_ in zip(*(batch[c] for c in ("doc_id", "part", "n", "rest", "rank", "whole", "bytes_each", "ids", "before")), strict=True):
                held = np.frombuffer(raw, f"<u{bytes_each}").astype("<u4")
                places = [(k * window, (k + 1) * window, first[part] + whole + k, 0) for k in range(n // window)]
                at = n - rest
                if rest:
                    places += [(at + a, at + b, full + sequence, offset) for a, b, sequence, offset in plan.places(rest, rank + before_)]
                for a, b, sequence, offset in places:
                    out.append((doc_id, a, b - a, zlib.crc32(held[a:b].tobytes()), n, sequence, offset))
            if out:
                yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    names = [x.split()[0] for x in PIECES.split(", ")]
    return ids.join(before, ["part", "rest"]).mapInPandas(run, PIECES)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    make_importable(spark)
    return pack(table(spark, sf_dir, "documents"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: the pieces of all documents."""
    make_importable(spark)
    return pack(docs)
