"""Approximate nearest neighbours: a forest of random-projection trees, then exact reranking.

Trees are grown on a bounded sample (``SAMPLE`` vectors at most, chosen by hash); every vector has its leaf in each tree. A
query walks all trees through one priority queue, ordered by the sum of squared distances to the splits it crossed, until
its leaves are expected to hold a share of the table; which leaves those are is a row of bits. The query rows, with their
bits, are written in blocks of ``QUERY_BLOCK``. A task holds a chunk of vectors, works out their leaves, and goes through the query blocks one
after the other: a vector is a query's candidate if any tree's bit of its leaf is set, and candidates are reranked by exact
Euclidean distance. So no vector is copied or shuffled for any tree, and what leaves a task is each query's nearest there.

Equal vectors are one node with the smallest ids that could be among a query's nearest, so a vector that
fills a third of the table is compared once. Nothing but the sample and the trees is on the driver.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, as do
those whose length differs from the commonest; rows without id take no part; a row repeated with its id
counts once; fewer candidates than ``k`` give fewer rows; no vectors give no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.llm.common import file_system, make_importable, shared_dir, stored, table, uniform

K = 10
EVERY = 100
SAMPLE = 20_000
TREES = 48
LEAF = 8
#: What a query's leaves should hold, as a share of the table, vectors that several trees reach counted as often: some 45 to
#: 49 % of the vectors. Vectors without any structure need as much for a recall of 0.9; real embeddings need less.
SEARCH_SHARE = 0.8
#: And so many, counted likewise, for each neighbour asked for, which matters below some 800 vectors.
LEAST = 60
QUERY_BLOCK = 4096
#: Vectors that a task compares with a query block at a time.
CHUNK = 65_536


class Tree:
    """Splits by hyperplanes midway between two sampled vectors; leaves are numbered in order."""

    def __init__(self, sample: np.ndarray, leaf: int, rng: np.random.Generator):
        self.normals: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.children: list[list[int]] = []  # >= 0: split, < 0: leaf -1 - number
        self.sizes: list[int] = []
        self.top = self._grow(sample, np.arange(len(sample)), leaf, rng, 0)
        # As compact as can be: the trees are held whole by the driver and by each worker.
        self.planes = np.array(self.normals, np.float32).reshape(-1, sample.shape[1])
        self.children, self.offsets, self.sizes = np.array(self.children, np.int32).reshape(-1, 2), np.array(self.offsets), np.array(self.sizes)
        del self.normals

    def _grow(self, sample: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator, depth: int) -> int:
        for _ in range(4 if len(rows) > leaf and depth < 40 else 0):
            a, b = sample[rng.choice(rows, 2, replace=False)]
            normal = a - b
            length = float(np.linalg.norm(normal))
            if length == 0:
                continue
            normal = normal / length
            sides = sample[rows] @ normal
            offset = float(np.median(sides))
            left = sides < offset
            if not 0 < left.sum() < len(rows):
                continue
            node = len(self.normals)
            self.normals.append(normal)
            self.offsets.append(offset)
            self.children.append([0, 0])
            self.children[node] = [self._grow(sample, rows[left], leaf, rng, depth + 1), self._grow(sample, rows[~left], leaf, rng, depth + 1)]
            return node
        self.sizes.append(len(rows))
        return -len(self.sizes)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        at = np.full(len(vectors), self.top)
        while (open_ := np.flatnonzero(at >= 0)).size:
            nodes = at[open_]
            right = np.einsum("ij,ij->i", vectors[open_], self.planes[nodes]) >= self.offsets[nodes]
            at[open_] = self.children[nodes, right.astype(int)]
        return -1 - at


class RandomProjectionForest:
    def __init__(self, sample: np.ndarray, scale: float, trees: int = TREES, leaf: int = LEAF, seed: int = 7):
        """scale: how many vectors of the table one of the sample stands for."""
        rng = np.random.default_rng(seed)
        self.scale = scale
        self.trees = [Tree(sample, max(8, int(leaf / scale)), rng) for _ in range(trees)]

    @property
    def most_leaves(self) -> int:
        return max(len(tree.sizes) for tree in self.trees)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """A row a vector, a column a tree."""
        return np.stack([tree.leaves(vectors) for tree in self.trees], axis=1)

    def search(self, vector: np.ndarray, search_k: float, least: int = 0) -> np.ndarray:
        """Which leaves to look in, as truth values by tree and leaf: the nearest first, until they hold ``search_k``.

        least: and until those of one tree hold so many, which are different ones.
        """
        queue = [(0.0, t, tree.top) for t, tree in enumerate(self.trees)]
        heapq.heapify(queue)
        sides = [tree.planes @ vector.astype(np.float32) - tree.offsets for tree in self.trees]
        found, held = np.zeros((len(self.trees), self.most_leaves), bool), np.zeros(len(self.trees))
        while queue and (held.sum() < search_k or held.max() < least):
            far, t, node = heapq.heappop(queue)
            if node < 0:
                found[t, -1 - node] = True
                held[t] += self.trees[t].sizes[-1 - node] * self.scale
                continue
            side, (left, right) = float(sides[t][node]), self.trees[t].children[node].tolist()
            heapq.heappush(queue, (far, t, right if side >= 0 else left))
            heapq.heappush(queue, (far + side * side, t, left if side >= 0 else right))
        return found


def distances(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean, in double precision."""
    gap = vectors.astype(np.float64) - query.astype(np.float64)
    return np.sqrt((gap * gap).sum(axis=1))


def chunks(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """``vectors, nodes, ids`` of ``most`` rows or a few more at a time."""
    held: list[pd.DataFrame] = []

    def joined():
        rows = pd.concat(held)
        held.clear()
        return np.array(rows["vector"].tolist()), rows["node"].to_numpy(), rows["ids"].tolist()

    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= most:
            yield joined()
    if held:
        yield joined()


def nearest_in_chunk(uri: str, vectors: np.ndarray, names: np.ndarray, ids: list, leaves: np.ndarray, shape: tuple[int, int], keep: int) -> pd.DataFrame:
    """Each query of a block with the ``keep`` nearest of its candidates in a chunk, ties to the smaller node."""
    import pyarrow.dataset as ds

    files, path = file_system(uri)
    block = ds.dataset(path, filesystem=files, format="parquet", partitioning=None).to_table(columns=["node", "vector", "visited"]).to_pydict()
    trees, out = np.arange(shape[0]), []
    for name, vector, visited in zip(block["node"], block["vector"], block["visited"], strict=True):
        bits = np.unpackbits(np.frombuffer(visited, np.uint8), count=shape[0] * shape[1]).reshape(shape).astype(bool)
        at = np.flatnonzero(bits[trees, leaves].any(axis=1))
        d = distances(np.asarray(vector), vectors[at])
        if len(at) > keep:
            least = np.flatnonzero(d <= np.partition(d, keep - 1)[keep - 1])
            at, d = at[least], d[least]
        near = np.lexsort((names[at], d))[:keep]
        out += [(name, float(d[x]), int(names[at[x]]), list(map(int, ids[at[x]]))) for x in near]
    return pd.DataFrame(out, columns=["query_node", "score", "near", "ids"])


def valid_vectors(table_: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, vector`` (double) of the rows that take part."""
    v = F.col("vector")
    rows = table_.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector")).filter("vec_id is not null and vector is not null")
    fine = rows.filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0.0))
    sizes = fine.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return fine.filter(F.size("vector") == (sizes[0]["d"] if sizes else 0))


def nearest(table_: DataFrame, every: int = EVERY, k: int = K, trees: int = TREES, leaf: int = LEAF, search_share: float = SEARCH_SHARE, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row whose id ``every`` divides."""
    spark = table_.sparkSession
    make_importable(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = stored(spark, valid_vectors(table_).distinct(), "vectors")
    keep = k + 1

    def smallest(batches):
        ids: dict[bytes, list[int]] = {}
        for batch in batches:
            for vec_id, vector in zip(batch["vec_id"].tolist(), batch["vector"], strict=True):
                held = ids.setdefault((np.asarray(vector, np.float64) + 0.0).tobytes(), [])
                held.append(vec_id)
                if len(held) > 64:
                    held[:] = sorted(set(held))[:keep]
        made = [(np.frombuffer(v).tolist(), sorted(set(x))[:keep]) for v, x in ids.items()]
        for lo in range(0, len(made), 5000):
            yield pd.DataFrame(made[lo : lo + 5000], columns=["vector", "ids"])

    # A partition gives at most k + 1 ids a vector, so a common vector's group stays small.
    part = rows.mapInPandas(smallest, "vector array<double>, ids array<long>")
    nodes = part.groupBy("vector").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))
    nodes = stored(spark, nodes.withColumn("node", F.col("ids")[0]), "nodes")
    count = nodes.count()
    if not count:
        return spark.createDataFrame([], schema)
    drawn = nodes.select("node", "vector").filter(uniform(F.col("node"), seed=seed) <= min(1.0, sample / count)).orderBy(uniform(F.col("node"), seed=seed)).limit(sample).toPandas()
    points = np.array(drawn.sort_values("node")["vector"].tolist()).reshape(len(drawn), -1)
    if not len(points):
        points = np.array(nodes.select("vector").limit(1).collect()[0]["vector"]).reshape(1, -1)
    forest = spark.sparkContext.broadcast(RandomProjectionForest(points, count / len(points), trees, leaf, seed))

    def visit(batches):
        for batch in batches:
            bits = [np.packbits(forest.value.search(np.asarray(v), max(search_share * count, LEAST * k), keep)).tobytes() for v in batch["vector"]]
            yield pd.DataFrame({"node": batch["node"], "vector": batch["vector"], "visited": bits})

    asked = rows.filter(F.col("vec_id") % every == 0)
    plain = F.transform("vector", lambda x: x + F.lit(0.0))
    of_node = asked.withColumn("vector", plain).join(nodes.select("vector", "node"), "vector").select(F.col("vec_id").alias("query_id"), "node")
    of_node = stored(spark, of_node, "queries")
    query_nodes = nodes.join(of_node.select("node").distinct(), "node", "left_semi").select("node", "vector")
    number = -(-query_nodes.count() // QUERY_BLOCK)
    where = shared_dir(spark, "query-blocks")
    block = F.pmod(F.xxhash64("node"), F.lit(max(1, number))).cast("int")
    query_nodes.mapInPandas(visit, "node long, vector array<double>, visited binary").withColumn("block", block).repartition(max(1, number), "block").write.partitionBy("block").parquet(where)
    uris = [f"{where}/block={r['block']}" for r in spark.read.parquet(where).select("block").distinct().collect()] if number else []  # a row a block

    def look(batches):
        for vectors, names, ids in chunks(batches, CHUNK):
            leaves = forest.value.leaves(vectors)
            for uri in uris:
                yield nearest_in_chunk(uri, vectors, names, ids, leaves, (len(forest.value.trees), forest.value.most_leaves), keep)

    found = nodes.select("node", "vector", "ids").mapInPandas(look, "query_node long, score double, near long, ids array<long>")
    top = found.withColumn("place", F.row_number().over(Window.partitionBy("query_node").orderBy("score", "near"))).filter(F.col("place") <= keep)
    spread = top.select("query_node", "score", F.explode("ids").alias("vec_id"))
    lists = spread.groupBy("query_node").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, 2 * keep).alias("near"))  # at most (k + 1)^2
    own = of_node.join(lists, of_node["node"] == lists["query_node"])
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    ranked = own.select("query_id", F.posexplode(others).alias("place", "x"))
    return ranked.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    make_importable(spark)
    return nearest(table(spark, sf_dir, "embeddings"))
