"""Near-duplicate documents by SimHash, linked with BK-trees.

Words are runs of non-white-space of the text with A-Z lower-cased; features are 4-word shingles, repeats
included (shorter texts: the whole sequence; none: fingerprint zero). A fingerprint bit is 1 if set in more
than half of the shingles' XXH64 values (seed 42). Distinct fingerprints at ``radius`` or fewer differing
bits are linked, and components are closed over links.

Linking is exact. Two fingerprints within 4 bits agree in at least ``b - 4`` of ``b`` blocks of bits, so
each fingerprint goes to the shard of every choice of ``b - 4`` blocks; a shard's BK-tree (children keyed by
their Hamming distance to the parent) is searched along edges within the radius only. ``b`` grows with the
number of distinct fingerprints, so shards stay small. A shard gives a spanning forest, never all its
pairs; shards of many fingerprints are parted again by further blocks. Trees stay with their shard's task
and aren't broadcast, as their size has no bound.

Defined cases: null text counts as empty; equal fingerprints are one node, however many rows have them; a
null ``doc_id`` joins its component but never names it, unless it has no other; repeated rows are all
returned; empty tables give no rows; extra columns are ignored.

The pipeline's stage links texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more. Its pairs are
those that the fingerprints and BK-trees link (``proposed``), and, as a small radius finds few of the texts that are
similar and one that finds most would compare nearly all, those that MinHash bands add; each is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.llm.common import as_they_were, in_one, make_importable, stored, table, tie_break

RADIUS = 4
WORDS = 4
#: Fingerprints a shard should hold, about, and those from which it is parted again.
SHARD = 64
PART_ABOVE = 2048
#: Parts that the rows of a label in common are dealt to.
SALTS = 8
#: The pipeline's stage: words of a shingle, and the least Jaccard similarity of two texts that are linked.
SHINGLE, SIMILARITY = 5, 0.8
#: MinHash bands and values in each: a pair of similarity 0.8 shares no band once in 300,000 times.
BANDS, BAND = 24, 4
#: A pair in a band's bucket is compared exactly if so many of the bands' values agree in a byte: of those of similarity 0.8
#: three in a million don't, of those of similarity 0.5 three in a hundred do.
AGREED = 58
#: Parts that a text's shingles are dealt to by their hashes; what two texts have in common is bounded part by part.
PARTS = 64
#: Rows of a group of a bucket; pairs are looked for between two groups at a time.
BLOCK = 1024
FACTORS = np.random.default_rng(64).integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> list[int]:
    """XXH64 of each shingle of a text, repeats included."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters, ASCII white space
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def fingerprint(text: str | None, words: int = WORDS, seed: int = 42) -> int:
    """The 64-bit SimHash of a whole text."""
    hashes = shingle_hashes(text, words, seed)
    if not hashes:
        return 0
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(raw), 65_536):
        counts += np.unpackbits(raw[lo : lo + 65_536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


class BKTree:
    """Values at integer distances; each child hangs on its parent by its Hamming distance."""

    def __init__(self):
        self.root: list | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while True:
            d = (value ^ node[0]).bit_count()
            child = node[1].get(d)
            if child is None:
                node[1][d] = [value, {}]
                return
            node = child

    def within(self, value: int, radius: int) -> Iterator[int]:
        waiting = [self.root] if self.root else []
        while waiting:
            held, children = waiting.pop()
            d = (value ^ held).bit_count()
            if d <= radius:
                yield held
            if children:
                lo, hi = d - radius, d + radius
                waiting.extend(child for at, child in children.items() if lo <= at <= hi)


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (above := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(above, above)
            x = above
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def link_shard(values: list[int], radius: int, forest: Forest, depth: int = 0) -> None:
    """Joins all of a shard's values that are within the radius."""
    if len(values) > PART_ABOVE and depth < 3:
        varied = 0
        for v in values:
            varied |= v ^ values[0]
        bits = [k for k in range(64) if varied >> k & 1]
        if len(bits) > radius:
            for block in np.array_split(bits, radius + 1):
                mask, groups = sum(1 << int(k) for k in block), {}
                for v in values:
                    groups.setdefault(v & mask, []).append(v)
                if max(map(len, groups.values())) == len(values):
                    link_tree(values, radius, forest)
                    return
                for group in groups.values():
                    if len(group) > 1:
                        link_shard(group, radius, forest, depth + 1)
            return
    link_tree(values, radius, forest)


def link_tree(values: list[int], radius: int, forest: Forest) -> None:
    tree = BKTree()
    for v in values:
        for near in tree.within(v, radius):
            forest.join(v, near)
        tree.add(v)


def shard_keys(value: Column, count: int, radius: int = RADIUS, shard: int = SHARD) -> Column:
    """The shards of a fingerprint, as an array: one for each choice of blocks that may agree."""
    for blocks in range(radius + 1, radius + 5):
        if count / 2 ** (64 * (blocks - radius) / blocks) <= shard:
            break
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << cuts[k + 1]) - (1 << cuts[k])) for k in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(number), value.bitwiseAND(F.lit(signed))))
    return F.array(*keys)


def with_fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, fp`` for each row; fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            made = np.array([fingerprint(t, words) for t in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": made})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, fp long")


def links(nodes: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """Links ``a < b`` between distinct fingerprints ``fp``, a spanning forest of each shard."""

    def run(batches):
        rest_keys, rest_values = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def linked(keys, values):
            out = []
            cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if hi - lo > 1:
                    forest = Forest()
                    link_shard(values[lo:hi].view(np.uint64).tolist(), radius, forest)
                    out += [(forest.root(x), x) for x in forest.up if forest.root(x) != x]
            made = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pd.DataFrame({"a": made[:, 0], "b": made[:, 1]})

        for batch in batches:
            keys = np.concatenate([rest_keys, batch["shard"].to_numpy()])
            values = np.concatenate([rest_values, batch["fp"].to_numpy()])
            if not len(keys):
                continue
            whole = int(np.searchsorted(keys, keys[-1]))  # the last shard may go on
            if whole:
                yield linked(keys[:whole], values[:whole])
            rest_keys, rest_values = keys[whole:], values[whole:]
        if len(rest_keys):
            yield linked(rest_keys, rest_values)

    sharded = nodes.select(F.explode(shard_keys(F.col("fp"), count, radius)).alias("shard"), "fp")
    return sharded.repartition("shard").sortWithinPartitions("shard").mapInPandas(run, "a long, b long").distinct()


def looked_up(rows: DataFrame, key: str, found: DataFrame, name: str, value: str, how: str = "inner") -> DataFrame:
    """``rows`` with the ``value`` of the ``found`` row whose ``name`` is its ``key``. A key that many rows
    share is salted by their ``node``; the looked-up side, of one row a name, is repeated for each salt."""
    left = rows.withColumn("__salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    right = found.select(F.col(name).alias("__name"), F.col(value).alias("__value"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__s"))
    return left.join(right, (F.col(key) == F.col("__name")) & (F.col("__salt") == F.col("__s")), how).drop("__salt", "__name", "__s")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``node, label`` for all nodes with links; equal labels: connected. Min-label steps with pointer jumping."""
    both = edges.select(F.col("a").alias("node"), "b").union(edges.select(F.col("b").alias("node"), F.col("a").alias("b")))
    edges = stored(spark, both, "links")
    labels = stored(spark, edges.groupBy("node").agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = looked_up(edges, "b", labels, "node", "label").groupBy("node").agg(F.min("__value").alias("m"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        above = stepped.join(stepped.select(F.col("label").alias("node")).distinct(), "node", "left_semi")
        jumped = looked_up(stepped, "label", above.withColumnRenamed("label", "up"), "node", "up", "left").select("node", "was", F.coalesce("__value", "label").alias("label"))
        made = stored(spark, jumped, "labels")
        labels = made.select("node", "label")
        if made.filter("was <> label").limit(1).count() == 0:
            return labels


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs`` (``doc_id, text``)."""
    spark = docs.sparkSession
    made = stored(spark, with_fingerprints(docs, words), "fingerprints")
    nodes = stored(spark, made.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    count = nodes.count()
    found = components(spark, links(nodes, count, radius))
    joined = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    named = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = joined.join(named, "label").select("fp", "component_id", "label")
    return made.join(classes, "fp").select("doc_id", "fp", "component_id", "label")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    make_importable(spark)
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles of ``SHINGLE`` words, sorted."""
    return np.unique(np.array(shingle_hashes(text, SHINGLE), np.uint64))


def band_values(found: np.ndarray) -> np.ndarray:
    """The least values of a set under each multiplier."""
    least = np.full(len(FACTORS), ~np.uint64(0))
    for lo in range(0, len(found), 4096):
        np.minimum(least, np.multiply.outer(FACTORS, found[lo : lo + 4096]).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """A signed key for each band of ``BAND`` values."""
    import xxhash

    raw = least.tobytes()
    keys = [xxhash.xxh64_intdigest(raw[8 * BAND * k : 8 * BAND * (k + 1)], k) for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def sketch(least: np.ndarray) -> np.ndarray:
    """A byte of each value, eight in a long."""
    return (least * FACTORS[0] >> np.uint64(56)).astype(np.uint8).view(np.int64)


SKETCH = [f"s{k}" for k in range(BANDS * BAND // 8)]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets' Jaccard similarity is ``SIMILARITY`` or more; empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (len(a) + len(b) - both) - 1e-9


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of nodes whose texts are alike."""

    def run(batches):
        last, held = None, None
        for batch in batches:
            keep = []
            for a, text_a, text_b in zip(batch["a"], batch["text_a"], batch["text_b"], strict=True):
                if a != last:
                    last, held = a, shingle_set(text_a)
                keep.append(alike(held, shingle_set(text_b)))
            yield batch.loc[keep, ["a", "b"]]

    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    with_both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return with_both.select("a", "b", "text_a", "text_b").sortWithinPartitions("a").mapInPandas(run, "a long, b long")


def owned(texts: DataFrame) -> DataFrame:
    """``node, owned, at`` of ``node, text``: how many of a node's shingles no other node has (none: no row), in all and by part."""

    def run(batches):
        nodes, sets, n = [], [], 0
        for batch in batches:
            for node, text in zip(batch["node"], batch["text"], strict=True):
                found = shingle_set(text).view(np.int64)
                nodes.append(np.full(len(found), node))
                sets.append(found)
                n += len(found)
                if n > 200_000:
                    yield pd.DataFrame({"node": np.concatenate(nodes), "h": np.concatenate(sets)})
                    nodes, sets, n = [], [], 0
        if n:
            yield pd.DataFrame({"node": np.concatenate(nodes), "h": np.concatenate(sets)})

    owners = texts.select("node", "text").mapInPandas(run, "node long, h long").groupBy("h").agg(F.min("node").alias("node"), F.max("node").alias("other"))
    parts = owners.filter("node = other").groupBy("node", F.expr(f"cast(h & {PARTS - 1} as int)").alias("part")).agg(F.count("*").cast("int").alias("n"))
    return parts.groupBy("node").agg(F.sum("n").alias("owned"), F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("at"))


def may_link(a: str, b: str, common: str = "least(common{a}, common{b})") -> Column:
    """Whether two nodes' sizes, and a bound of the shingles in ``common``, allow the similarity: texts need to have
    ``SIMILARITY / (1 + SIMILARITY)`` of their sizes' sum in common. ``a`` and ``b`` are what columns' names end with."""
    least = f"{common} >= {SIMILARITY / (1 + SIMILARITY)} * (size{{a}} + size{{b}}) - 1e-9"
    return F.expr(f"least(size{{a}}, size{{b}}) >= {SIMILARITY} * greatest(size{{a}}, size{{b}}) - 1e-9 and {least}".format(a=a, b=b))


def grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows with equal keys, one at a time, of batches in which these stand together."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(rows):
            continue
        cuts = np.flatnonzero((rows[keys] != rows[keys].shift()).any(axis=1)).tolist()  # the last group may go on
        yield from (rows.iloc[lo:hi] for lo, hi in zip(cuts, cuts[1:], strict=False))
        rest = rows.iloc[cuts[-1] :]
    if rest is not None:
        yield rest


def possible(one: pd.DataFrame, other: pd.DataFrame, agreed: int | None = AGREED) -> np.ndarray:
    """Pairs of a node of ``one`` and one of ``other`` that aren't connected yet and that sizes, sketches (unless ``agreed`` is
    None) and shared shingles allow: in each part two nodes share at most the fewer of both."""
    values = [[x[c].to_numpy() for c in ("node", "label", "size", "common")] for x in (one, other)]
    (node_a, label_a, size_a, common_a), (node_b, label_b, size_b, common_b) = values
    bytes_a, bytes_b = (np.ascontiguousarray(x[SKETCH].to_numpy(np.int64)).view(np.uint8) for x in (one, other))
    parts_a, parts_b = (np.stack(x["parts"].to_numpy()) for x in (one, other))
    found = []
    for lo in range(0, len(node_a), 128):
        at = slice(lo, lo + 128)
        need = SIMILARITY / (1 + SIMILARITY) * np.add.outer(size_a[at], size_b) - 1e-9
        fit = np.not_equal.outer(label_a[at], label_b) & (np.minimum.outer(common_a[at], common_b) >= need)
        fit &= np.minimum.outer(size_a[at], size_b) >= SIMILARITY * np.maximum.outer(size_a[at], size_b) - 1e-9
        i, j = np.nonzero(fit)
        if agreed is not None:
            near = (bytes_a[i + lo] == bytes_b[j]).sum(axis=1) >= agreed
            i, j = i[near], j[near]
        near = np.minimum(parts_a[i + lo], parts_b[j]).sum(axis=1) >= need[i, j]
        i, j = node_a[i[near] + lo], node_b[j[near]]
        found.append(np.stack([np.minimum(i, j), np.maximum(i, j)], axis=1))
    return np.concatenate(found)


def in_blocks(rows: DataFrame, agreed: int | None = AGREED) -> DataFrame:
    """The distinct ``possible`` pairs ``a, b`` of each bucket's ``rows`` (``n``: how many it has). A bucket's rows are dealt to
    groups of about ``BLOCK``, and each two groups meet in a task of their own, which gives only those pairs."""

    def run(batches):
        for rows in grouped(batches, ["bucket", "lo", "hi"]):
            lo, hi = (rows[rows["mine"] == rows[at].iloc[0]] for at in ("lo", "hi"))
            if len(lo) and len(hi):
                found = np.unique(possible(lo, hi, agreed), axis=0)
                yield pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    count = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = rows.withColumn("mine", F.pmod(F.xxhash64("node"), count).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), count - 1)))
    dealt = dealt.withColumn("lo", F.least("mine", "with")).withColumn("hi", F.greatest("mine", "with")).drop("with", "n")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, as so few bytes would be put in one task
    return dealt.repartition(tasks, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInPandas(run, "a long, b long").distinct()


def proposed(texts: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of nodes of ``node, text`` that SimHash links: a spanning forest of each shard's BK-tree over distinct
    fingerprints, each of which its least node stands for, and that node with all others of its fingerprint."""
    spark = texts.sparkSession
    made = stored(spark, with_fingerprints(texts.select(F.col("node").alias("doc_id"), "text")).withColumnRenamed("doc_id", "node"), "fingerprints")
    firsts = stored(spark, made.groupBy("fp").agg(F.min("node").alias("first")), "nodes")
    a, b = (firsts.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")) for c in "ab")
    near = links(firsts, firsts.count()).join(a, "a").join(b, "b").select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    same = made.join(firsts, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return near.union(same)


def similar(texts: DataFrame, agreed: int | None = AGREED) -> DataFrame:
    """``node, label`` of the nodes with links among ``node, text`` (a row a node). Texts that SimHash links (``proposed``), and
    those that share a MinHash band, are compared exactly. A node is linked only if at least ``SIMILARITY`` of its shingles occur in other nodes, so all others
    go first. In each bucket the node with the least share of shingles of its own, likely the one that the others are edits
    of, is compared with all others; then those pairs of a bucket that aren't connected yet, and whose sketches and shared
    shingles, counted by part, allow it (``in_blocks``). With ``agreed=None`` sketches aren't asked, and no pair of a bucket is
    passed over that exact bounds allow."""
    spark = texts.sparkSession

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t) for t in batch["text"]]
            values = [band_values(x) for x in sets]
            sketches = np.array([sketch(x) for x in values], np.int64).reshape(-1, len(SKETCH))
            parts = [np.bincount((x & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS).astype(np.int32) for x in sets]
            yield pd.DataFrame({"node": batch["node"], "size": [len(x) for x in sets], "keys": [band_keys(x) for x in values], "parts": parts} | {c: sketches[:, k] for k, c in enumerate(SKETCH)})

    def with_bucket(rows: DataFrame, *found: Column) -> DataFrame:
        """Rows of buckets of two or more rows, with values gathered over their bucket."""
        of = rows.groupBy("bucket").agg(F.count("*").alias("n"), *found).filter("n > 1").select("bucket", F.struct("*").alias("of"))
        return looked_up(rows, "bucket", of, "bucket", "of").withColumnRenamed("__value", "of")

    sketched = stored(spark, texts.select("node", "text").mapInPandas(run, "node long, size int, keys array<long>, parts array<int>, " + ", ".join(f"{c} long" for c in SKETCH)), "sketches")
    banded = with_bucket(sketched.select(F.explode("keys").alias("bucket"), "node", "size"))
    shared = stored(spark, banded.select("bucket", "node", "size"), "buckets")
    hashed = stored(spark, proposed(texts), "proposed")
    asked = shared.select("node").union(hashed.select("a")).union(hashed.select("b")).distinct()
    held = stored(spark, texts.select("node", "text").join(asked, "node", "left_semi"), "candidates")
    nodes = sketched.drop("keys").join(shared.select("node").distinct(), "node", "left_semi").join(owned(held), "node", "left")
    nodes = nodes.withColumn("common", F.col("size") - F.coalesce("owned", F.lit(0))).filter(F.col("common") >= SIMILARITY * F.col("size") - 1e-9)
    nodes = stored(spark, nodes.withColumn("parts", F.expr("transform(parts, (n, k) -> n - coalesce(at[k], 0))")).drop("owned", "at"), "nodes")
    common = stored(spark, shared.join(nodes.select("node", "common"), "node"), "common")
    centre = F.min(F.struct((1 - F.col("common") / F.greatest("size", F.lit(1))).alias("own"), "node", "size", "common")).alias("centre")
    near = with_bucket(common, centre).select("node", "size", "common", *[F.col(f"of.centre.{c}").alias(f"{c}_c") for c in ("node", "size", "common")])
    stars = near.filter((F.col("node") != F.col("node_c")) & may_link("", "_c")).select(F.least("node", "node_c").alias("a"), F.greatest("node", "node_c").alias("b"))
    stars = stored(spark, stars.union(hashed).distinct(), "pairs")
    found = stored(spark, verified(stars, held), "links")
    labels = components(spark, found)
    apart = common.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = with_bucket(apart, F.min("label").alias("lo"), F.max("label").alias("hi")).filter("of.lo <> of.hi").withColumn("n", F.col("of.n")).drop("of")
    rest = in_blocks(apart.join(nodes.select("node", "parts", *SKETCH), "node"), agreed).join(stars, ["a", "b"], "left_anti")
    more = stored(spark, verified(stored(spark, rest, "pairs"), held), "links")
    return components(spark, found.union(more))


def first_of(rows: DataFrame, key: str) -> DataFrame:
    """Of the rows with the same key the one with the smallest ``doc_id``, null last, then by text and all columns."""
    order = Window.partitionBy(key).orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), tie_break())
    return rows.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: of each component of similar texts the document with the smallest id stays (one row, if it is repeated).

    Rows carry their text's hash, and then their component, so ids needn't tell them apart. Null and empty texts are one
    group; rows without id come after all others of their group; no documents give none; all columns come back as they were.
    """
    make_importable(spark)
    text = F.col("text").cast("string")
    rows = in_one(docs, doc_id=F.col("doc_id").cast("long"), text=text, node=F.xxhash64(F.coalesce(text, F.lit(""))))
    rows = stored(spark, first_of(rows, "node"), "distinct")
    found = similar(rows.select("node", "text")).select(F.col("node").alias("of"), "label")
    labelled = rows.join(found, F.col("node") == F.col("of"), "left").withColumn("label", F.coalesce("label", "node"))
    return as_they_were(first_of(labelled, "label"), docs)
