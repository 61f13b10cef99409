"""A table as dictionary: entries by the hundred thousand and more, found without growing the plan.

Entries are cut into shards of a bounded number of characters, each written to the shared folder. A worker holds an index of as many
shards as ``HELD_CHARS`` allows (usually all, then read once), goes over a bounded stretch of text with it, then takes the next ones: neither the driver
nor a task holds more, and nothing is broadcast or shuffled but the entries themselves.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.categories import SPANS
from hushframe.functions.dictionary import CONFIDENCE
from hushframe.functions.entry_index import EntryIndex
from hushframe.operators.arrow import parts_of
from hushframe.operators.storage import shared_folder, stored

#: Characters of entries in a shard.
SHARD_CHARS = 1_000_000
#: Characters of entries that a worker holds; they take two to three bytes each in an index. More are gone over group by group.
HELD_CHARS = 400_000_000
#: Bytes of text that a task goes over at a time.
TOGETHER_CHARS = 1_000_000
_SPANS = pa.list_(pa.struct([("text", pa.string()), ("category", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())]))

_held: tuple[tuple[str, ...], EntryIndex] | None = None


def _index(uris: tuple[str, ...]) -> EntryIndex:
    """Some shards' index; the last one is kept in the worker."""
    global _held
    if _held is not None and _held[0] == uris:
        return _held[1]
    import pyarrow.dataset as ds
    from pyarrow import fs

    tables = []
    _held = None  # not two at a time
    for uri in uris:
        files, path = (fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
        tables.append(ds.dataset(path, filesystem=files, format="parquet").to_table(columns=["text", "category", "exact", "case_sensitive", "fold_width", "rank"]))
    rows = pa.concat_tables(tables).to_pydict()
    made = EntryIndex(rows["text"], rows["category"], rows["exact"], rows["case_sensitive"], rows["fold_width"], rows["rank"])
    _held = (uris, made)
    return made


class StoredDictionary:
    """Entries in shards below the shared folder."""

    def __init__(self, uris: list[str], shard_chars: int = SHARD_CHARS):
        n = max(1, HELD_CHARS // shard_chars)
        self.uris = uris
        self.groups = [tuple(uris[k : k + n]) for k in range(0, len(uris), n)]

    def spans(self, texts: list[str | None]) -> pa.ListArray:
        """Spans of each text, in order of the entries, then of place."""
        found = [_index(uris).found(texts) for uris in self.groups]
        if not found:
            return pa.array([[] for _ in texts], _SPANS)
        text_of, ranks, starts, ends = (np.concatenate([getattr(f, name) for f in found]) for name in ("text_of", "ranks", "starts", "ends"))
        values, categories = (pa.concat_arrays([getattr(f, name) for f in found]) for name in ("values", "categories"))
        if len(found) > 1:
            order = np.lexsort((starts, ranks, text_of))
            text_of, starts, ends = text_of[order], starts[order], ends[order]
            values, categories = values.take(pa.array(order)), categories.take(pa.array(order))
        columns = [values, categories, pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(np.full(len(starts), CONFIDENCE))]
        offsets = np.searchsorted(text_of, np.arange(len(texts) + 1))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_SPANS.value_type)))

    def find(self, texts: list[str | None]) -> list[list[tuple]]:
        """The same as tuples."""
        return [[tuple(s.values()) for s in spans] for spans in self.spans(texts).to_pylist()]


def stored_dictionary(entries: DataFrame, categories: Sequence[str] | None = None, shard_chars: int = SHARD_CHARS) -> StoredDictionary:
    """Entries from a table ``text, category`` and, if there, ``exact, case_sensitive, fold_width, rank``.

    ``rank`` orders entries where equal spans compete; without it they are ordered by category and text. Entries that are null or
    empty are left out, repeated ones count once; other columns are ignored.
    """
    spark, there = entries.sparkSession, set(entries.columns)
    flags = [F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c) if c in there else F.lit(False).alias(c) for c in ("exact", "case_sensitive", "fold_width")]
    rank = F.col("rank").cast("long") if "rank" in there else F.lit(None).cast("long")
    rows = entries.select(F.col("text").cast("string").alias("text"), F.col("category").cast("string").alias("category"), *flags, rank.alias("rank")).filter("text <> '' and category is not null")
    if categories is not None:
        rows = rows.filter(F.col("category").isin(list(categories)))
    rows = rows.groupBy("text", "category", "exact", "case_sensitive", "fold_width").agg(F.min("rank").alias("rank"))
    if "rank" not in there:
        from hushframe.operators.slices import numbered

        rows = numbered(stored(rows, "entries"), [], ["category", "text", "exact", "case_sensitive", "fold_width"], "rank")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-chars // shard_chars)
    path = posixpath.join(shared_folder(spark), f"hushframe-dictionary-{uuid.uuid4().hex[:12]}")
    if count:
        shard = F.pmod(F.xxhash64("text", "category", "rank"), F.lit(count)).cast("int")
        rows.withColumn("shard", shard).repartition(int(count), "shard").write.partitionBy("shard").parquet(path)
    held = [r[0] for r in spark.read.parquet(path).select("shard").distinct().orderBy("shard").collect()] if count else []  # one row a shard
    return StoredDictionary([f"{path}/shard={k}" for k in held], shard_chars)


def dictionary_column(text: Column | str, dictionary: StoredDictionary) -> Column:
    """Spans of a dictionary's entries in a text column."""

    @F.arrow_udf(SPANS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # A task's texts in stretches, as what is found takes far more than they do.
        for batch in batches:
            for texts in parts_of(batch, chars=TOGETHER_CHARS):
                yield dictionary.spans(texts.to_pylist())

    return run(text)
