"""Centroid clustering of integer vectors by filtering centroids through ball trees.

Build: each partition's vectors, TREE at a time, become a ball tree (halves by the projection on two far vectors, down to LEAF vectors or equal
ones).  A ball has its count, its integer sum, a centre (the sum's floored mean) and the largest squared distance of a vector from it.  Trees are
stored once, a row a tree, and serve every round.

Round: the centroids (CENTROIDS at most, so their size is bounded) go through every tree from the root.  By the triangle inequality a centroid
that is further from a ball's centre than the nearest one by more than two radii is nearest to none of its vectors; a ball with one centroid left
adds its count and sum to it as a whole, any other is descended into, and leaves compare their vectors exactly.  A task gives one
row a centroid; these are summed by Spark, and a few rows a round reach the driver.

Numbers are whole: distances are exact (in doubles as long as every product is below 2^53, else in 64 bits), and a centroid is dropped only if
it is too far by more than any rounding of the roots, so ties always reach an exact comparison, which the smaller number wins.

Cases: vectors that are null, have another length, or a null or non-finite component are left out; null ids are kept, but start no
centroid while there are others; rows of one id count each, and their hashes tie by their components; fewer vectors than centroids give fewer clusters; an
empty table gives no rows; a component over MOST in size raises, as its squared distance may not fit a long, and so does a sum that does
not fit; texts play no part, and other columns are ignored.  A vector that very many rows share is a ball of radius 0 in each tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import materialise, release, table

#: Components of a vector; their scale; centroids; rounds; salt of the first centroids' order.
SIZE, SCALE, CENTROIDS, ROUNDS, SALT = 64, 64, 16, 3, "1"
#: Vectors of a tree, and of a leaf that isn't split further; largest component.
TREE, LEAF, MOST = 4096, 32, 1 << 27
#: Components up to which squared distances are exact in doubles: 64 * (2 * 2^22)^2 = 2^52.
EXACT = 1 << 22
#: Rounding of a difference of two roots of whole numbers, with room to spare, as a part of their sum.
ROUNDING = 1e-12

TREES = "ids array<bigint>, points binary, sums binary, nodes binary"


def whole_vectors(df: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id and vector (array<bigint>), the floors of the scaled components, of the rows whose embedding is whole."""
    whole = F.expr(f"size(embedding) = {size} and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    part = f"floor({scale} * cast(x as double))"
    known = f"if(abs({part}) > {MOST}, raise_error('a component is too large for exact distances'), {part})"
    return df.where(F.coalesce(whole, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(f"transform(embedding, x -> cast({known} as bigint))").alias("vector"))


def first_centroids(vectors: DataFrame, count: int = CENTROIDS, salt: str = SALT) -> np.ndarray:
    """The vectors of the least SHA-256 of `salt:id`, in that order."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), "vector").limit(count).collect()
    return np.array([r.vector for r in rows], np.int64)


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """[point, centroid]: exact squared distances."""
    small = max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT
    p, c = (points.astype(np.float64), centroids.astype(np.float64)) if small else (points, centroids)
    return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)).astype(np.int64)


class BallTree:
    """points in the order of the leaves, and of each ball first, last + 1, left and right ball (-1: none) and squared radius."""

    def __init__(self, points: np.ndarray, nodes: np.ndarray, sums: np.ndarray):
        self.points, self.nodes, self.sums = points, nodes, sums
        self.counts = nodes[:, 1] - nodes[:, 0]
        self.centres = sums // np.maximum(self.counts, 1)[:, None]

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> tuple[BallTree, np.ndarray]:
        """The tree of some points, and their order in it."""
        order, nodes, sums, todo = np.arange(len(points)), [], [], [(0, len(points), -1, 0)]
        while todo:
            first, last, parent, side = todo.pop()
            own = points[order[first:last]]
            total = own.sum(0)
            far = squared(own, (total // len(own))[None])[:, 0]
            if parent >= 0:
                nodes[parent][side] = len(nodes)
            nodes.append([first, last, -1, -1, int(far.max())])
            sums.append(total)
            if last - first > leaf and far.max():
                a = own[far.argmax()]
                b = own[squared(own, a[None])[:, 0].argmax()]
                along = own.astype(np.float64) @ (b - a).astype(np.float64)
                order[first:last] = order[first:last][np.argsort(along, kind="stable")]
                half = (first + last) // 2
                todo += [(half, last, len(nodes) - 1, 3), (first, half, len(nodes) - 1, 2)]
        return cls(points[order], np.array(nodes, np.int64), np.array(sums, np.int64)), order

    def filter(self, centroids: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], tuple[np.ndarray, np.ndarray]]:
        """((balls, centroid of each) by depth, (places of points that were compared, centroid of each)): every point is in one of them."""
        whole, places, chosen = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        balls, open_to = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        while len(balls):
            far = np.where(open_to, np.sqrt(squared(self.centres[balls], centroids).astype(np.float64)), np.inf)
            near, reach = far.min(1), 2 * np.sqrt(self.nodes[balls, 4].astype(np.float64))
            open_to &= ~(far - near[:, None] - reach[:, None] > ROUNDING * (far + near[:, None] + reach[:, None]))
            done = open_to.sum(1) == 1
            whole.append((balls[done], open_to[done].argmax(1)))
            balls, open_to = balls[~done], open_to[~done]
            leaf = self.nodes[balls, 2] < 0
            for ball, among in zip(balls[leaf], open_to[leaf], strict=True):
                first, last, rivals = self.nodes[ball, 0], self.nodes[ball, 1], np.flatnonzero(among)
                places.append(np.arange(first, last))
                chosen.append(rivals[squared(self.points[first:last], centroids[rivals]).argmin(1)])
            balls, open_to = np.concatenate([self.nodes[balls[~leaf], 2], self.nodes[balls[~leaf], 3]]), np.concatenate([open_to[~leaf]] * 2)
        return whole, (np.concatenate(places), np.concatenate(chosen))

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and sum of the points nearest to each centroid."""
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        whole, (places, chosen) = self.filter(centroids)
        for balls, nearest in whole:
            np.add.at(counts, nearest, self.counts[balls])
            np.add.at(sums, nearest, self.sums[balls])
        np.add.at(counts, chosen, 1)
        np.add.at(sums, chosen, self.points[places])
        return counts, sums

    def nearest(self, centroids: np.ndarray) -> np.ndarray:
        """The number of each point's nearest centroid."""
        out = np.full(len(self.points), -1)
        whole, (places, chosen) = self.filter(centroids)
        for balls, nearest in whole:
            for ball, k in zip(balls, nearest, strict=True):
                out[self.nodes[ball, 0] : self.nodes[ball, 1]] = k
        out[places] = chosen
        return out

    def pack(self) -> tuple[bytes, bytes, bytes]:
        return tuple(zstandard.compress(x.astype("<i8").tobytes(), 1) for x in (self.points, self.sums, self.nodes))

    @classmethod
    def unpack(cls, points: bytes, sums: bytes, nodes: bytes, size: int) -> BallTree:
        read = lambda data, width: np.frombuffer(zstandard.decompress(data), "<i8").reshape(-1, width)
        return cls(read(points, size), read(nodes, 5), read(sums, size))


def ball_trees(vectors: DataFrame, size: int = SIZE, most: int = TREE, leaf: int = LEAF) -> DataFrame:
    """Stored trees of vectors (vec_id, vector), a row a tree, each of vectors of one partition."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                b = batch.slice(start, most)
                points = b.column("vector").flatten().to_numpy().reshape(-1, size)
                tree, order = BallTree.build(points, leaf)
                ids = b.column("vec_id").take(pa.array(order))
                lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([lists, *(pa.array([x], pa.binary()) for x in tree.pack())], ["ids", "points", "sums", "nodes"])
        release()

    return materialise(vectors.select("vec_id", "vector").mapInArrow(build, TREES), "ball-trees")


def _trees(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.Array, BallTree]]:
    for k in range(batch.num_rows):
        yield batch.column("ids")[k].values, BallTree.unpack(*(batch.column(c)[k].as_py() for c in ("points", "sums", "nodes")), size)


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floored means of the vectors nearest to each centroid; one without any stays."""
    k, size = centroids.shape

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            for _, tree in _trees(batch, size):
                n, s = tree.totals(centroids)
                counts, sums = counts + n, sums + s
        used = np.flatnonzero(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * size), pa.array(sums[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), lists], ["cluster", "n", "sums"])
        release()

    each = trees.mapInArrow(total, "cluster int, n bigint, sums array<bigint>")
    rows = each.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(size)]).alias("sums")).collect()
    out = centroids.copy()
    for r in rows:
        out[r.cluster] = [x // r.n for x in r.sums]
    return out


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance (squared) of every vector."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in _trees(batch, size):
                nearest = tree.nearest(centroids)
                off = tree.points - centroids[nearest]
                yield pa.RecordBatch.from_arrays([ids, pa.array(nearest.astype(np.int32)), pa.array((off * off).sum(1))], ["vec_id", "cluster", "distance"])
        release()

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(df: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, salt: str = SALT, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every whole vector of df (vec_id, embedding)."""
    spark, vectors = df.sparkSession, whole_vectors(df, size, scale)
    centroids = first_centroids(vectors, count, salt)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    trees = ball_trees(vectors, size)
    for _ in range(rounds):
        centroids = moved(trees, centroids)
    rows = materialise(assigned(trees, centroids), "assigned")
    inertia = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = spark.createDataFrame([(k, s, sum(inertia.values()), digests[k]) for k, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _rounds() -> str:
    out = []
    for k in range(ROUNDS + 1):
        out.append(f"""far{k} as (select r, c, list_sum(list_transform(list_zip(kept.v, cent{k}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from kept, cent{k}),
near{k} as (select r, c, d from far{k} qualify row_number() over (partition by r order by d, c) = 1)""")
        if k < ROUNDS:
            out.append(f"""part{k} as (select c, i, sum(x) as s, count(*) as n from (select c, unnest(v) as x, generate_subscripts(v, 1) as i from near{k} join kept using (r)) group by c, i),
mean{k} as (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as v from part{k} group by c),
cent{k + 1} as (select m.c, coalesce(a.v, m.v) as v from cent{k} m left join mean{k} a using (c))""")
    return ",\n".join(out)


ORACLE = f"""with kept as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v
  from embeddings where len(embedding) = {SIZE} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {SIZE}),
cent0 as (select cast(row_number() over (order by sha256('{SALT}:' || vec_id) nulls last, v) - 1 as integer) as c, v from kept qualify c < {CENTROIDS}),
{_rounds()}
select vec_id, c as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
  sha256(array_to_string(m.v, ',')) as centroid_sha256 from near{ROUNDS} join kept using (r) join cent{ROUNDS} m using (c)"""
