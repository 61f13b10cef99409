"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A document's terms are its words, weighted by how often they occur. For each of ``SAMPLES`` samples a term
draws, from its own hash, ``r`` and ``c`` from Gamma(2, 1) and ``b`` from the unit interval; with weight
``w`` it stands at ``t = floor(ln w / r + b)`` and ``ln a = ln c - r (t - b + 1)``. The term with the least
``a`` is kept, with its ``t``. Two texts keep the same pair with the probability of their generalised
Jaccard similarity, so the share of equal samples estimates it.

Logarithms are the cost, so terms that can't win are told by their uniform numbers alone: the least ``a`` of
a text of ``n`` words exceeds ``REACH / n`` with probability ``exp(-REACH)``, and ``a`` is never less than
``2 (1 - v) / (1 + v) * u / w``, where ``v`` and ``u`` are the products whose negative logs are ``c`` and ``r``; a
term that occurs once has ``a = c u^(1 - b)``, never less than ``2 (1 - v) / (1 + v) * u / (1 - b + b u)``.

Words are hashed and counted inside each row; rows are exploded to (term, weight) and a hash aggregate
keeps the minima. Documents are dealt once, to slices of the id's order; that one exchange also serves
the aggregate and the windows, which look one document ahead.

Defined cases: null text counts as empty; texts without words share one fingerprint; documents of equal id
are ordered by their text's hash, descending; null ids come after all others, likewise; an id that many rows share
is sliced by that hash; rows of equal id and text follow each other; one document is its own next; empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.llm.common import make_importable, table

SAMPLES = 48
#: A text's least ``a`` is within this, over its number of words, but for one sample in 10^13 (which is then 0).
REACH = 30.0
#: Rows of a slice, about, and how many slices there may be: their list is broadcast.
SLICE_ROWS = 250
MOST_SLICES = 20_000
QUANTILES = 64
SPLIT = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def weighted_terms(text: Column) -> Column:
    """The sorted hashes of a text's words, repeats included; a single 0 if there are none."""
    words = F.split(F.btrim(text, F.lit(BLANKS)), SPLIT)  # one empty word if there is none
    return F.when(words[0] == "", F.array(F.lit(0).cast("long"))).otherwise(F.sort_array(F.transform(words, lambda x: F.xxhash64(x))))


def runs(sorted_hashes: str) -> Column:
    """Where each distinct value of a sorted array begins."""
    return F.expr(
        f"""transform(filter(sequence(0, size({sorted_hashes}) - 1), i -> i = 0 or {sorted_hashes}[i] <> {sorted_hashes}[i - 1]), (i, j) -> i)"""
    )


def signature_columns(samples: int) -> list[Column]:
    """One aggregate a sample over rows ``h, w, reach``: the least a in the upper bits, the kept pair below.
    ``reach``: the term's weight times the text's bound of the least a.

    Two hashes give five uniform numbers; the product of two makes a Gamma(2, 1) by its negative log.
    """
    out = []
    for k in range(samples):
        first, second = f"xxhash64(h, {2 * k})", f"xxhash64(h, {2 * k + 1})"
        u = f"((cast({first} & 1048575L as double) + 0.5d) * (cast(shiftright({first}, 20) & 1048575L as double) + 0.5d) * {2.0**-40}d)"
        v = f"((cast({second} & 2147483647L as double) + 0.5d) * (cast(shiftrightunsigned({second}, 33) as double) + 0.5d) * {2.0**-62}d)"
        r = f"(-ln({u}))"
        b = f"(cast(shiftrightunsigned({first}, 40) as double) * {2.0**-24}d)"
        t = f"floor(w / {r} + {b})"
        a = f"(ln(-ln({v})) - {r} * ({t} - {b} + 1d))"
        packed = f"shiftleft(cast(({a} + 64d) * 16777216d as bigint), 31) | ((shiftright(h, 31) ^ ({t} * 2654435761L)) & 2147483647L)"
        out.append(F.expr(f"min(case when 2d * (1d - {v}) * {u} <= reach * (1d + {v}) * (case when w = 0d then 1d - {b} + {b} * {u} else 1d end) then {packed} end)").alias(f"m{k}"))
    return out


def sliced(docs: DataFrame) -> tuple[DataFrame, int]:
    """``id, text, hash, slice, again``: slices in descending id; ``again`` marks a copy of the row that
    follows a slice's last, put at its end."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    cuts = rows.select("id").filter("id is not null").approxQuantile("id", [k / QUANTILES for k in range(1, QUANTILES)], 0.5 / QUANTILES)
    found, cuts = [int(c) for c in cuts], set()
    for c in found:
        cuts |= {c, c + 1} if found.count(c) > 1 else {c}  # an id of many rows has a part of its own
    cuts = sorted(cuts)
    q = F.when(F.col("id").isNull(), -1).otherwise(F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>"), lambda c: c <= F.col("id"))))
    rows = rows.withColumn("q", q)
    spread = rows.groupBy("q").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).collect()  # QUANTILES rows
    total = sum(r["n"] for r in spread)
    each = max(SLICE_ROWS, total / MOST_SLICES)
    part = F.lit(0.0)
    for r in spread:
        n = max(1, math.ceil(r["n"] / each))
        if r["q"] < 0 or r["lo"] == r["hi"]:
            inside = F.floor((F.col("hash").cast("double") / 2.0**64 + 0.5) * n)
        else:
            inside = F.floor((F.col("id").cast("double") - float(r["lo"])) / (float(r["hi"]) - float(r["lo"]) + 1.0) * n)
        part = F.when(F.col("q") == r["q"], F.least(inside, F.lit(n - 1))).otherwise(part)
    rows = rows.withColumn("slice", (F.col("q").cast("long") * (1 << 32)) + part.cast("long")).drop("q")
    top = rows.groupBy("slice").agg(F.max(F.struct("id", "hash")).alias("top")).withColumn("of", F.lag("slice").over(Window.orderBy(F.desc("slice"))))
    ends = rows.agg(F.min("slice").alias("m")).collect()[0]["m"]
    top = top.select(F.col("slice").alias("s"), F.col("top.id").alias("i"), F.col("top.hash").alias("x"), F.coalesce("of", F.lit(ends).cast("long")).alias("of"))
    # At most MOST_SLICES + QUANTILES rows of four numbers.
    found = rows.join(F.broadcast(top), (F.col("slice") == F.col("s")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("x")), "left")
    copies = F.when(F.col("of").isNotNull(), F.array(F.struct(F.col("slice").alias("slice"), F.lit(0).alias("again")), F.struct(F.col("of").alias("slice"), F.lit(1).alias("again")))).otherwise(F.array(F.struct(F.col("slice").alias("slice"), F.lit(0).alias("again"))))
    return found.select("id", "text", "hash", F.explode(copies).alias("at")).select("id", "text", "hash", "at.slice", "at.again"), total


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    rows, _ = sliced(docs)
    order = [F.asc("again"), F.desc_nulls_last("id"), F.desc("hash"), F.asc("row")]
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    ahead = Window.partitionBy("slice").orderBy(*order)
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    follow = F.lead("text").over(ahead)
    paired = rows.select("slice", "again", "id", "hash", "row", "text", n.alias("n_chars"), F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.coalesce(follow, F.lit("")), F.lit(1), half)).alias("edited"))
    both = paired.select("slice", "again", "id", "hash", "row", "n_chars", F.sha2("edited", 256).alias("sha"), F.posexplode(F.array("text", "edited")).alias("which", "words"))
    sorted_ = both.withColumn("s", weighted_terms(F.col("words"))).drop("words")
    starts = sorted_.withColumn("p", runs("s"))
    keys = ["slice", "again", "id", "hash", "row", "n_chars", "sha", "which"]
    exploded = starts.select(*keys, F.size("s").alias("all"), F.explode(F.expr("transform(p, (i, j) -> struct(s[i] as h, coalesce(try_element_at(p, j + 2), size(s)) - i as n))")).alias("x"))
    exploded = exploded.select(*keys, F.col("x.h").alias("h"), F.log(F.col("x.n").cast("double")).alias("w"), (F.col("x.n") * REACH / F.col("all")).alias("reach"))
    made = exploded.groupBy(*keys).agg(*signature_columns(samples))
    kept = made.select(*keys, F.array(*[F.coalesce(F.col(f"m{k}"), F.lit(0)).bitwiseAND(F.lit(2147483647)).cast("int") for k in range(samples)]).alias("sig"))
    after = Window.partitionBy("slice").orderBy(*order, F.asc("which"))
    share = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / float(samples)
    near = kept.select("*", F.lead("sig", 1).over(after).alias("edited_sig"), F.lead("sig", 2).over(after).alias("next_sig")).filter("which = 0 and again = 0")
    text_of = lambda c: F.concat_ws("", F.transform(c, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")))
    return near.select(F.col("id").alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"), text_of(F.col("sig")).alias("fingerprint"), text_of(F.col("edited_sig")).alias("edited_fingerprint"), share(F.col("sig"), F.col("edited_sig")).alias("near_edited"), share(F.col("sig"), F.col("next_sig")).alias("near_next"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    make_importable(spark)
    return fingerprints(table(spark, sf_dir, "documents"))
