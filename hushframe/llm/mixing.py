"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its weight's share of the wanted words, held to ``max_epochs`` times its size; what
exceeds that is shared again by weight. A source first gives whole epochs; the rest of its target comes
from documents in ascending order of ``-ln(u) / quality``, up to the word budget. Prefix sums run over
slices of the key, so no task sees a whole source, however large.

Texts are read once: sizes, keys and hashes are stored, and rows equal in all of them become one with a
count. As the documents taken once more are those up to a place in their source's order, the pipeline's stage needs
only that place, one row a source, and texts aren't shuffled.

Defined cases: null text has size 0 and is taken with its epochs; a null source is a source of its own,
after all others; sources without words have target 0; empty tables give no rows; of repeated rows (equal in
doc_id, source and text) at the budget's edge as many are taken as come nearest to it; rows that share only a
doc_id or only a text are told apart; extra columns are ignored, and kept by the stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.llm.common import WORD, as_they_were, in_one, stored, table, tie_break, uniform

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 20240
#: Rows of a source in a slice of the key, about.
SLICE_ROWS = 64
#: Sources up to which their table, one row each, is broadcast.
MOST_BROADCAST = 10_000


def quality(text: Column, size: Column) -> Column:
    """A document's quality weight, 0.1 to 1: highest where words are about six characters long."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.1), 1 / (1 + F.pow((mean - 6.0) / 6.0, 2))), F.lit(0.1))


def share_out(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MAX_EPOCHS) -> dict[str | None, float]:
    """Targets by source: weights repeat over the sources in code point order, null last."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    w = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    cap = {s: float(most * n) for s, n in order}
    rest, open_, out = share * sum(n for _, n in order), [s for s, _ in order], {}
    while open_:
        total = sum(w[s] for s in open_)
        full = [s for s in open_ if rest * w[s] / total > cap[s]]
        if not full:
            return out | {s: rest * w[s] / total for s in open_}
        out |= {s: cap[s] for s in full}
        rest -= sum(cap[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def keys(text: Column, doc_id: Column, seed: int) -> tuple[Column, Column, Column]:
    """A document's size in words, the hash of its text, and its place ``p`` between 0 and 1 in the order of ``-ln(u) / quality``."""
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    content = F.xxhash64(text)
    return size, content, 1 - F.pow(uniform(F.coalesce(doc_id.cast("long"), F.lit(-1)), content, seed=seed), 1 / quality(text, size))


def quotas(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``source, doc_id, content, size, p, m, source_size, target, epochs, more``: ``m`` equal rows of ``docs``
    (``doc_id, text, source``), each taken ``epochs`` times, and ``more`` of them once more.

    The totals by source, one row a source, come to the driver; all else stays distributed.
    """
    spark = docs.sparkSession
    size, content, place = keys(F.col("text"), F.col("doc_id"), seed)
    keyed = stored(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), content.alias("content"), place.alias("p")), "keys")
    totals = keyed.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()  # one row a source
    targets = share_out([(r["source"], r["n"]) for r in totals], weights, share, max_epochs)
    rows = []
    for r in totals:
        n, target = r["n"], targets[r["source"]]
        epochs = min(int(target // n), int(max_epochs)) if n else 0
        budget = max(0.0, target - epochs * n) if epochs < max_epochs else 0.0
        rows.append((r["source"], n, float(target), epochs, budget, max(1, int((r["rows"] / SLICE_ROWS) ** 0.5))))
    plan = spark.createDataFrame(rows, "of string, source_size long, target double, epochs int, budget double, outer int")
    groups = keyed.groupBy("source", "doc_id", "content", "size", "p").agg(F.count("*").alias("m"))
    groups = groups.join(F.broadcast(plan) if len(rows) <= MOST_BROADCAST else plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    at = F.least(F.floor(F.col("p") * F.col("outer") * F.col("outer")), F.col("outer") * F.col("outer") - 1).cast("long")
    groups = groups.withColumn("a", F.floor(at / F.col("outer")).cast("int")).withColumn("b", (at % F.col("outer")).cast("int"))
    slices = groups.groupBy("source", "a", "b").agg(F.sum(F.col("size") * F.col("m")).alias("in_slice"))
    in_order = lambda *keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    inner = slices.withColumn("before_b", F.coalesce(F.sum("in_slice").over(in_order("source", "a", by="b")), F.lit(0)))
    outer = slices.groupBy("source", "a").agg(F.sum("in_slice").alias("in_outer"))
    outer = outer.withColumn("before_a", F.coalesce(F.sum("in_outer").over(in_order("source", by="a")), F.lit(0)))
    before = inner.alias("i").join(outer.alias("o"), F.col("i.source").eqNullSafe(F.col("o.source")) & (F.col("i.a") == F.col("o.a"))).select("i.source", "i.a", "i.b", (F.col("before_a") + F.col("before_b")).alias("before"))
    own = Window.partitionBy("source", "a", "b").orderBy("p", "doc_id", "content").rowsBetween(Window.unboundedPreceding, -1)
    local = groups.withColumn("within", F.coalesce(F.sum(F.col("size") * F.col("m")).over(own), F.lit(0)))
    joined = local.alias("l").join(before.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source")) & (F.col("l.a") == F.col("r.a")) & (F.col("l.b") == F.col("r.b"))).select("l.*", "r.before")
    # The document that crosses the budget is taken if that comes nearer to it; none after it is.
    fit = F.floor((F.col("budget") - F.col("before") - F.col("within")) / F.nullif(F.col("size"), F.lit(0)) + 0.5)
    more = F.when(F.col("budget") > 0, F.greatest(F.lit(0), F.least(fit, F.col("m")))).otherwise(0)
    return joined.select("source", "doc_id", "content", "size", "p", "m", "source_size", "target", "epochs", F.when(F.col("size") > 0, more).otherwise(0).cast("long").alias("more"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``doc_id, source, content, size, source_size, target, copies, taken`` for each row of ``docs`` (``doc_id, text, source``)."""
    groups = quotas(docs, weights, share, max_epochs, seed)
    rows = groups.withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    copies = F.col("epochs") + F.when(F.col("number") <= F.col("more"), 1).otherwise(0)
    return rows.select("doc_id", "source", "content", "size", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def copied(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. All columns come back as they were, whatever their names and types."""
    spark = docs.sparkSession
    ends = quotas(docs, weights, share, max_epochs, seed).groupBy("source").agg(F.max("epochs").alias("e"), F.max(F.when(F.col("more") > 0, F.struct("p", "doc_id", "content", "more", "m"))).alias("end"))
    # One row a source. The last document taken once more, and how many of its equal rows are.
    found = [(r["source"], r["e"], *((r["end"]["p"], r["end"]["doc_id"], r["end"]["content"], r["end"]["more"], r["end"]["m"]) if r["end"] else (None,) * 5)) for r in ends.collect()]
    plan = spark.createDataFrame(found, "of string, epochs int, p_end double, id_end long, content_end long, more long, m long")
    size, content, place = keys(F.col("text"), F.col("doc_id"), seed)
    rows = in_one(docs, size=size, content=content, p=place, doc_id=F.col("doc_id").cast("long"), source=F.col("source").cast("string"))
    rows = rows.join(F.broadcast(plan) if len(found) <= MOST_BROADCAST else plan, F.col("source").eqNullSafe(F.col("of")))
    own = F.struct("p", "doc_id", "content")
    end = F.struct(F.col("p_end").alias("p"), F.col("id_end").alias("doc_id"), F.col("content_end").alias("content"))
    last = F.col("p_end").isNotNull() & (F.col("size") > 0) & (F.col("more") < F.col("m")) & (own == end)
    once = F.col("p_end").isNotNull() & (F.col("size") > 0) & (own <= end)
    parted = any(r[5] is not None and r[5] < r[6] for r in found)  # some of the equal rows at an end
    taken = rows.filter(~last) if parted else rows
    taken = taken.withColumn("copies", F.col("epochs") + F.when(once, 1).otherwise(0))
    if parted:
        number = F.row_number().over(Window.partitionBy("source").orderBy(tie_break()))
        tied = rows.filter(last).withColumn("number", number)
        taken = taken.unionByName(tied.withColumn("copies", F.col("epochs") + F.when(F.col("number") <= F.col("more"), 1).otherwise(0)).drop("number"))
    return as_they_were(taken.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))), docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: each document as often as the mix takes it."""
    return copied(docs)
