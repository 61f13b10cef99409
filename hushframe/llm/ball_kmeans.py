"""Ball k-means over whole numbers: exact Lloyd rounds that compare a vector only with the centroids that could win.

A cluster is a ball: its centroid, and a bound on the distance of its farthest member (what the last round
measured, plus how far the centroid has moved since). Centroid j is a neighbour of ball i only if half the distance
between the two centroids is within that radius. A member nearer to its own centroid than half the way to the
nearest neighbour lies in the stable core and stays without comparison; the others lie in annuli between
half-distances to successive neighbours, and those of the a-th annulus are compared exactly with the first a neighbours. The tests
are whole-number inequalities (4 d² >= D²), so no tie is lost to rounding; only the radii are rounded, and always up.

Vectors are dealt once into a table bucketed by block, a block being some ``BLOCK`` vectors as one binary row. A round reads
that table and the last round's table of cluster numbers, bucketed alike, so the two meet without
moving a vector; it writes the new numbers with sums over the clusters, which Spark adds up. The
driver holds centroids, radii and sums: numbers that depend on the count of clusters alone.

Defined cases: vectors that are null, of another length, or hold null or non-finite components are left out;
components beyond ±2^26 count as that, so that every distance fits a long, and inertias stop at the largest long; repeated rows
count as often as they occur; rows without id are clustered, but only become first centroids if others lack;
fewer vectors than clusters give fewer clusters; no vectors give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import make_importable, shared_dir, stored, table

SIZE = 64
SCALE = 1024
K = 8
ROUNDS = 10
SEED = 3
BLOCK = 128
#: Vectors in a bucket: one task reads a bucket of each table at a time.
PER_BUCKET = 200_000
MAX_BUCKETS = 100_000
LIMIT = 1 << 26
LONGEST = (1 << 63) - 1

_STATE = "block long, clusters binary, sums array<struct<cluster:int, n:long, farthest:long, total:array<long>>>"


def whole_vectors(table_: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """``vec_id, vector`` (array of int): floor(scale * x) of each component of the vectors that take part."""
    rows = table_.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    fine = rows.filter((F.size("vector") == size) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole = F.transform("vector", lambda x: F.least(F.greatest(F.floor(x * float(scale)), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))
    return fine.select("vec_id", whole.alias("vector"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors whose ``seed:id`` has the smallest SHA-256, in that order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = vectors.select(name.alias("name"), "vector").orderBy(F.asc_nulls_last("name"), "vector").limit(k).collect()
    return np.array([r["vector"] for r in found], np.int64)


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all pairs."""
    largest = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if vectors.shape[1] * 4 * largest * largest < 1 << 53:  # whole numbers that doubles hold exactly
        x, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((vectors.astype(np.int64) - c) ** 2).sum(axis=1) for c in centroids.astype(np.int64)], axis=1).reshape(len(vectors), len(centroids))


@dataclass
class Balls:
    """Centroids, and for each the neighbours that its members could move to, nearest first."""

    centroids: np.ndarray
    neighbours: list[np.ndarray] = field(default_factory=list)
    gaps: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def around(cls, centroids: np.ndarray, radii: list[float]) -> Balls:
        """radii: a bound on each ball's farthest member; infinite where none is known."""
        between, made = squared(centroids, centroids), cls(centroids)
        for i, radius in enumerate(radii):
            others = np.array([j for j in np.lexsort((np.arange(len(centroids)), between[i])) if j != i and between[i, j] <= 4.0 * radius * radius], np.int64)
            made.neighbours.append(others)
            made.gaps.append(between[i, others])
        return made

    def assign(self, vectors: np.ndarray, clusters: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each vector's nearest centroid (ties: the smaller number), its squared distance, and how many were compared."""
        best, least, compared = clusters.copy(), np.empty(len(vectors), np.int64), 0
        for i in np.unique(clusters):
            members = np.flatnonzero(clusters == i)
            own = squared(vectors[members], self.centroids[i : i + 1])[:, 0]
            least[members], compared = own, compared + len(members)
            # The annulus of a member: how many neighbours have half their distance within the member's own.
            ring = np.searchsorted(self.gaps[i], 4 * own, side="right")
            for a in range(int(ring.max(initial=0))):
                j, reached = int(self.neighbours[i][a]), np.flatnonzero(ring > a)
                at = members[reached]
                d = squared(vectors[at], self.centroids[j : j + 1])[:, 0]
                nearer = (d < least[at]) | ((d == least[at]) & (j < best[at]))
                best[at[nearer]], least[at[nearer]] = j, d[nearer]
                compared += len(at)
        return best, least, compared


def _blocks(vectors: DataFrame, block: int) -> DataFrame:
    """``block, ids, vectors``: vectors in binary rows of ``block`` each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype("<i4")
            width = len(flat) // max(1, batch.num_rows)
            starts = range(0, batch.num_rows, block)
            names = pa.array(range(number, number + len(starts)), pa.int64())
            ids = pa.array([batch.column("vec_id").slice(s, block).to_pylist() for s in starts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([names, ids, pa.array([flat[s * width : (s + block) * width].tobytes() for s in starts], pa.binary())], ["block", "ids", "vectors"])
            number += len(starts)

    return vectors.mapInArrow(cut, "block long, ids array<long>, vectors binary")


class _Buckets:
    """Tables below the shared folder, bucketed by block into as many files."""

    def __init__(self, spark: SparkSession, count: int):
        self.spark, self.count, self.made = spark, count, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        table_ = f"hushframe_{name}_{uuid.uuid4().hex}"
        where = shared_dir(self.spark, name)
        df.write.bucketBy(self.count, "block").option("path", where).option("compression", "zstd").saveAsTable(table_)
        self.made.append(table_)
        return self.spark.table(table_)

    def forget(self) -> None:
        """Takes the names out of the catalogue; files stay, as results may still be read from them."""
        for name in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list[int], list, np.ndarray, np.ndarray, list[int]]]:
    """``blocks, ids, vectors, clusters, sizes`` of each batch; vectors without a cluster stand in the first."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw = [x.as_py() for x in batch.column("vectors")]
        sizes = [len(x) // (4 * width) for x in raw]
        had = [x.as_py() or bytes(4 * n) for x, n in zip(batch.column("clusters"), sizes, strict=True)] if "clusters" in batch.schema.names else [bytes(4 * n) for n in sizes]
        yield batch.column("block").to_pylist(), batch.column("ids"), np.frombuffer(b"".join(raw), "<i4").reshape(-1, width).astype(np.int64), np.frombuffer(b"".join(had), "<i4").astype(np.int64), sizes


def _round(met: DataFrame, balls: Balls) -> DataFrame:
    """New cluster numbers of each block; a batch's first block carries the batch's sums."""
    shared = met.sparkSession.sparkContext.broadcast(balls)
    width = balls.centroids.shape[1]

    def work(batches):
        for names, _, vectors, clusters, sizes in _batches(batches, width):
            best, least, _ = shared.value.assign(vectors, clusters)
            sums = []
            for c in np.unique(best):
                mine = best == c
                sums.append({"cluster": int(c), "n": int(mine.sum()), "farthest": int(least[mine].max()), "total": vectors[mine].sum(axis=0).tolist()})
            edges = np.cumsum([0, *sizes])
            cut = [best[a:b].astype("<i4").tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            kind = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("farthest", pa.int64()), ("total", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(cut, pa.binary()), pa.array([sums] + [[]] * (len(names) - 1), kind)], ["block", "clusters", "sums"])

    return met.mapInArrow(work, _STATE)


def _totals(state: DataFrame, width: int) -> dict[int, tuple[int, int, list[int]]]:
    """Members, farthest member and sums of each cluster: ``width`` + 1 numbers for each."""
    each = state.select(F.explode("sums").alias("s")).select("s.*")
    parts = each.select("cluster", "n", "farthest", F.posexplode("total").alias("at", "x"))
    rows = parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.max("farthest").alias("farthest"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    found = {r["cluster"]: (r["n"], r["farthest"], [0] * width) for r in rows}
    for r in rows:
        found[r["cluster"]][2][r["at"]] = int(r["x"])
    return found


@dataclass
class Clustering:
    centroids: np.ndarray
    assigned: DataFrame  #: vec_id, cluster, distance
    rounds: int
    neighbours: list[int]  #: in each round, how many (ball, neighbour) pairs there were


def ball_kmeans(vectors: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS, block: int = BLOCK, per_bucket: int = PER_BUCKET) -> Clustering:
    """Lloyd's rounds over ``vec_id, vector`` from given centroids, means rounded down, then a last assignment.

    A round that changes no centroid ends the rounds, as all later ones would repeat it.
    """
    spark = vectors.sparkSession
    make_importable(spark)
    held = stored(spark, vectors, "vectors")
    width = centroids.shape[1]
    count = min(MAX_BUCKETS, max(1, -(-held.count() // per_bucket)))
    buckets = _Buckets(spark, count)
    blocks = buckets.write(_blocks(held, block).repartition(count, "block"), "blocks")
    state, radii, done, pairs = None, [float("inf")] * len(centroids), 0, []
    try:
        while True:
            balls = Balls.around(centroids, radii)
            pairs.append(sum(map(len, balls.neighbours)))
            met = blocks if state is None else blocks.join(state.select("block", "clusters").hint("shuffle_hash"), "block")
            if done == rounds:
                assigned = stored(spark, _assigned(met, balls), "assigned")
                return Clustering(centroids, assigned, done, pairs)
            state = buckets.write(_round(met, balls), f"round{done}")
            found, before = _totals(state, width), centroids
            centroids = np.array([[t // found[c][0] for t in found[c][2]] if c in found else before[c].tolist() for c in range(len(before))], np.int64)
            moved = np.sqrt(((centroids - before).astype(np.float64) ** 2).sum(axis=1))
            # Rounded up, so that the ball holds its members for certain; an empty ball has none.
            radii = [(np.sqrt(float(found[c][1])) + moved[c]) * (1 + 1e-9) + 1e-6 if c in found else 0.0 for c in range(len(before))]
            done = rounds if not moved.any() else done + 1
    finally:
        buckets.forget()


def _assigned(met: DataFrame, balls: Balls) -> DataFrame:
    shared = met.sparkSession.sparkContext.broadcast(balls)
    width = balls.centroids.shape[1]

    def work(batches):
        for _, ids, vectors, clusters, _ in _batches(batches, width):
            best, least, _ = shared.value.assign(vectors, clusters)
            yield pa.RecordBatch.from_arrays([ids.flatten(), pa.array(best.astype(np.int32)), pa.array(least)], ["vec_id", "cluster", "distance"])

    return met.mapInArrow(work, "vec_id long, cluster int, distance long")


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    centroids = first_centroids(vectors)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    done = ball_kmeans(vectors, centroids)
    sums = {r["cluster"]: int(r["s"]) for r in done.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = min(LONGEST, sum(sums.values()))
    facts = [(c, min(LONGEST, sums.get(c, 0)), whole, hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest()) for c, x in enumerate(done.centroids)]
    named = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.assigned.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(size: int = SIZE, scale: int = SCALE, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """DuckDB SQL of the query: every vector compared with every centroid in every round."""
    gap = "list_sum(list_transform(range(1, {n} + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))".format(n=size)
    exact = "[" + ", ".join(f"CAST((sum(x[{i}]) - ((sum(x[{i}]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)" for i in range(1, size + 1)) + "]"
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {size})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS c, x FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.r, c.c, {gap} AS d FROM v, c{n} c) GROUP BY r)")
        if n < rounds:
            steps.append(f"m{n} AS MATERIALIZED (SELECT c, {exact} AS x FROM a{n} JOIN v USING (r) GROUP BY c)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c, coalesce(m.x, o.x) AS x FROM c{n} o LEFT JOIN m{n} m USING (c))")
    return "WITH " + ",\n".join(steps) + f"""
        SELECT vec_id, a.c AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
               CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.c = a.c"""
