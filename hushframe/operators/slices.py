"""Work within groups of which one may hold most rows: numbers and runs over range-cut slices, joins that salt what is hot.

``numbered`` and ``epochs`` give what windows over a group would. Rows are cut into ranges of (group, order); each slice
is worked on by itself, and what came before it is added from a table of one row per group and slice. There are as many
slices and tasks as rows ask for (``parts_for``), so that none grows with the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.operators.storage import stored

#: A key is hot if it holds more than this share of all rows: so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 0.001
SALTS = 64
#: Rows that a slice, or a task of a shuffle, has to take.
PART_ROWS = 100_000
#: A table of more rows isn't broadcast.
FEW_ROWS = 50_000


def shuffled_to(df: DataFrame) -> int:
    """Tasks that Spark shuffles to by itself."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def parts_for(df: DataFrame) -> int:
    """Tasks to shuffle rows to: more than Spark's, if those would take more than ``PART_ROWS`` each. Counts rows, which costs little if they are stored."""
    return max(shuffled_to(df), -(-df.count() // PART_ROWS))


def is_few(df: DataFrame) -> bool:
    """Whether rows may be broadcast. They are counted, as a stored table's bytes, by which Spark decides, are compressed."""
    return df.limit(FEW_ROWS + 1).count() <= FEW_ROWS


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``df`` shuffled by keys to ``parts`` tasks, if those are more than Spark's; the join or grouping by the keys that follows needs no other shuffle."""
    return df.repartition(parts, *keys) if parts and parts > shuffled_to(df) else df


def sliced(df: DataFrame, groups: Sequence[str], order: Sequence[str], slices: int | None = None) -> DataFrame:
    """Rows with ``__slice``: ascending with (groups, order), and ``__at``: ascending with them within a slice, without gaps. Stored, as the cut is by sampling."""
    cut = df.repartitionByRange(slices or parts_for(df), *groups, *order).sortWithinPartitions(*groups, *order)
    return stored(cut.withColumn("__slice", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "slices")


def _beside(cut: DataFrame, facts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Each row with its slice's facts, whose other columns have names of their own. Few facts are broadcast, others shuffled like the rows."""
    keys = ["__slice", *groups]
    named = stored(facts.select(*[F.col(k).alias(f"__of_{k}") for k in keys], *[c for c in facts.columns if c not in keys]), "facts")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys])
    return cut.join(F.broadcast(named) if is_few(named) else named.hint("shuffle_merge"), on).drop(*[f"__of_{k}" for k in keys])


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[str], output: str = "seq", slices: int | None = None) -> DataFrame:
    """``df`` with each row's place in its group, from 1 (int). ``order`` should tell rows of a group apart.

    ``df`` is read three times (to be counted, sampled and cut): store what is dear to make.
    """
    cut = sliced(df, groups, order, slices)
    before = Window.partitionBy(*groups).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy("__slice", *groups).agg(F.count("*").alias("__n"), F.min("__at").alias("__least"))
    # A group's rows of a slice follow each other.
    ahead = counts.select("__slice", *groups, (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__least") + 1).alias("__ahead"))
    return _beside(cut, ahead, groups).withColumn(output, (F.col("__ahead") + F.col("__at")).cast("int")).drop("__ahead", "__at", "__slice")


def epochs(df: DataFrame, group: str, time: str, order: Sequence[str], ttl: float, expires: Column, resets: Column, output: str = "epoch", slices: int | None = None) -> DataFrame:
    """``df`` with the number (from 1) of the run that a row of its group belongs to.

    A run begins with the first row, after a gap of ``ttl`` seconds or more where ``expires``, and where ``resets``.
    Rows of a group are in order of ``time``, then ``order``. ``df`` is read as in ``numbered``.
    """
    parts = slices or parts_for(df)
    asked = df.withColumns({"__seconds": F.col(time).cast("timestamp").cast("double"), "__expires": expires, "__resets": resets})
    cut = sliced(asked, [group], [time, *order], parts).drop("__at")
    begins = lambda gap: (gap.isNull() | (F.col("__expires") & (gap >= ttl)) | F.col("__resets")).cast("int")
    within = Window.partitionBy("__slice", group).orderBy(time, *order)
    placed = dealt(cut, parts, "__slice", group).withColumns({"__first": F.row_number().over(within) == 1, "__gap": F.col("__seconds") - F.lag("__seconds").over(within)})
    counted = placed.withColumn("__starts", F.when(F.col("__first"), 0).otherwise(begins(F.col("__gap"))))
    runs = stored(counted.withColumn("__runs", F.sum("__starts").over(within.rowsBetween(Window.unboundedPreceding, 0))).drop("__gap"), "runs")
    # The first row of a slice follows the last one of its group's slice before.
    first = {c: F.max(F.when(F.col("__first"), F.col(c))).alias(c) for c in ("__seconds", "__expires", "__resets")}
    sums = runs.groupBy("__slice", group).agg(F.sum("__starts").alias("__total"), F.max("__seconds").alias("__last"), *first.values())
    by_slice = Window.partitionBy(group).orderBy("__slice")
    begun = sums.withColumn("__begun", begins(F.col("__seconds") - F.lag("__last").over(by_slice)))
    before = F.sum(F.col("__begun") + F.col("__total")).over(by_slice.rowsBetween(Window.unboundedPreceding, -1))
    ahead = begun.select("__slice", group, (F.coalesce(before, F.lit(0)) + F.col("__begun")).alias("__ahead"))
    done = _beside(runs, ahead, [group])
    return done.withColumn(output, F.col("__ahead") + F.col("__runs")).drop("__slice", "__seconds", "__expires", "__resets", "__first", "__starts", "__runs", "__ahead")


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys with more than a share of all rows: fewer than ``1 / share``."""
    return hottest(df.groupBy(*keys).agg(F.count("*").alias("__n")), keys, share)


def hottest(counts: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> DataFrame:
    """The same of keys whose rows are counted already, as ``__n``."""
    total = counts.agg((F.sum("__n") * F.lit(share)).alias("__least"))
    return counts.join(F.broadcast(total), F.col("__n") > F.col("__least")).select(*keys)


def salted_join(many: DataFrame, few: DataFrame, keys: Sequence[str], spread: Sequence[str], salts: int = SALTS, share: float = HOT_SHARE, parts: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """``many`` joined to ``few`` (one row a key) by ``keys``, which aren't null.

    Rows of a hot key are dealt to ``salts`` tasks by a hash of ``spread``; only hot rows of ``few`` are repeated.
    ``parts``: tasks to shuffle to, if more than Spark's; nothing but hot keys is broadcast then. ``counts``: keys of ``many`` with their rows, ``__n``, if they are known.
    """
    hot = stored(hot_keys(many, keys, share) if counts is None else hottest(counts, keys, share), "hot").withColumn("__hot", F.lit(True))
    salted = many.join(F.broadcast(hot), list(keys), "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(0)).drop("__hot")
    all_salts = F.sequence(F.lit(0), F.when(F.col("__hot"), salts - 1).otherwise(0))
    copies = few.join(F.broadcast(hot), list(keys), "left").withColumn("__salt", F.explode(all_salts)).drop("__hot")
    on = [*keys, "__salt"]
    few_of = dealt(copies, parts, *on)
    return dealt(salted, parts, *on).join(few_of.hint("shuffle_merge") if parts else few_of, on).drop("__salt")
