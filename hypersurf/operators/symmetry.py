"""Masks, symmetry and canonical labels.

A complex of at most 63 squares is a mask in a BIGINT.  Labels of such masks are orbit minima; larger cubes are labelled by the
kernel of plans/enumerate.py.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cells, lanes, topology
from .incidence import incidence


def masks(c: DataFrame) -> DataFrame:
    """cid and mask of complexes in long form; a square that has no bit of a BIGINT below its sign raises."""
    return c.groupBy("cid").agg(F.bit_or(F.expr("if(sq < 0 or sq > 62, raise_error('square outside 0 to 62'), shiftleft(1L, sq))")).alias("mask"))


def squares_of(m: DataFrame, n: int) -> DataFrame:
    """Long form of (cid, mask)."""
    return m.select("cid", "mask", F.explode(F.expr(f"sequence(0, {cells.sizes(n)[2] - 1})")).alias("sq")).where("(shiftright(mask, sq) & 1) = 1").select("cid", "sq")


@lru_cache
def images(n: int) -> np.ndarray:
    """images(n)[g, s]: the square to which symmetry g sends square s."""
    rows = np.array([d for d in product(range(3), repeat=n) if d.count(2) == 2])
    place = 3 ** np.arange(n - 1, -1, -1)
    index = {c: i for i, c in enumerate((rows @ place).tolist())}
    out = []
    for p in permutations(range(n)):
        for f in range(2**n):
            flip = (f >> np.arange(n)) & 1
            out.append([index[c] for c in (np.where(rows == 2, 2, rows ^ flip)[:, p] @ place).tolist()])
    return np.array(out)


@lru_cache
def byte_images(n: int) -> np.ndarray:
    """[byte, g, value]: the image under g of the squares in one byte of a mask."""
    at = images(n)
    n2 = at.shape[1]
    bits = np.zeros((at.shape[0], -(-n2 // 8) * 8), np.int64)
    bits[:, :n2] = np.int64(1) << at
    value = np.arange(256)
    return np.stack([np.bitwise_or.reduce([np.where(value >> k & 1, bits[:, 8 * b + k, None], 0) for k in range(8)]) for b in range(bits.shape[1] // 8)])


def orbit(mask: np.ndarray, n: int) -> np.ndarray:
    """(symmetries, masks): every image of each mask."""
    return np.bitwise_or.reduce([t[:, (mask >> 8 * b) & 255] for b, t in enumerate(byte_images(n))])


def canonical_label(mask: Column, n: int) -> Column:
    """Orbit minimum of a mask, for cubes of up to 4 dimensions: a byte table walk in Arrow batches."""
    if n > 4:
        raise ValueError("masks of more than 63 squares have no BIGINT label")

    @F.pandas_udf("long")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            values = s.to_numpy()
            yield pd.Series(np.concatenate([np.zeros(0, np.int64), *(orbit(values[i : i + 2048], n).min(0) for i in range(0, len(values), 2048))]))

    return label(mask)


def orbit_sizes(m: DataFrame, n: int) -> DataFrame:
    """label and the number of masks of its orbit, for the distinct labels of (cid, mask)."""
    labels = m.select(canonical_label(F.col("mask"), n).alias("label")).distinct()
    group = F.broadcast(cells.group_action(m.sparkSession, n))
    moved = labels.withColumn("sq", F.explode(F.expr(f"sequence(0, {cells.sizes(n)[2] - 1})"))).where("(shiftright(label, sq) & 1) = 1").join(group, "sq")
    each = moved.groupBy("label", "g").agg(F.bit_or(F.expr("shiftleft(1L, sq_image)")).alias("image"))
    return each.groupBy("label").agg(F.countDistinct("image").cast("int").alias("orbit_size"))


def _moves(n: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(root, sq, at: after the flips that bring root to the origin), (perm, at, image), (pattern, perm: one that puts the pattern in order)."""
    at = incidence(n)
    index = at.square_index
    flips = [(v, s, index[tuple(d if d == 2 else d ^ b for d, b in zip(square, bits, strict=True))]) for v, bits in enumerate(at.vertices) for s, square in enumerate(at.squares)]
    perms = list(permutations(range(n)))
    moves = [(k, s, index[tuple(square[i] for i in perm)]) for k, perm in enumerate(perms) for s, square in enumerate(at.squares)]
    dense = [r for r in product(range(n), repeat=n) if set(r) == set(range(max(r) + 1))]
    keys = [(sum(x * n**i for i, x in enumerate(r)), k) for r in dense for k, perm in enumerate(perms) if all(r[a] <= r[b] for a, b in zip(perm, perm[1:], strict=False))]
    return flips, moves, keys


def restricted_labels_of(s: DataFrame, n: int, *carry: str, rounds: int | None = None) -> DataFrame:
    """carry, label limbs (l0, the lowest, l1, ...), roots and trials of complexes (carry, which tells them apart, and m limbs).

    The label is the least image under the symmetries that bring a vertex of least signature to the origin and put its neighbours' signatures in
    order.  rounds: signatures by so many rounds of refinement instead of the two of topology.signed.  The permutations come from a table keyed by the pattern of the neighbours'
    ranks, images from two tables of moves, all broadcast (for the 6-cube 23,040, 15,360 and 172,800 rows); cubes of up to 6 dimensions.
    """
    if n > 6:
        raise ValueError("the tables of moves of the 7-cube are too large to broadcast")
    spark, p = s.sparkSession, lanes.packing(n)
    flips, moves, keys = _moves(n)
    flips = F.broadcast(spark.createDataFrame(flips, "root int, sq int, at int"))
    moves = F.broadcast(spark.createDataFrame(moves, "perm int, at int, image int"))
    keys = F.broadcast(spark.createDataFrame(keys, "pattern long, perm int"))
    own = [x for x in carry if x not in p.m]
    # Null-safe, as the optimizer would infer a filter of ranks that are not null, and push that down with copies of all they are made of.
    ranks = lanes.exploded(topology.ranks_of(lanes.linked(s, n, *own, *p.m), n, *own, *p.m, rounds=rounds), n, "root", p.n0).where("rank[root] <=> 0")
    near = ranks.select(*own, *p.m, "root", F.array(*[F.expr(f"rank[root ^ {1 << (n - 1 - k)}]") for k in range(n)]).alias("_near")).withColumn("_order", F.expr("sort_array(array_distinct(_near))"))
    pattern = " + ".join(f"(array_position(_order, _near[{k}]) - 1) * {n**k}L" for k in range(n))
    roots = near.select(*own, *p.m, "root", F.expr(pattern).alias("pattern"))
    squares = lanes.exploded(roots.join(keys, "pattern"), n, "sq", p.n2).where(lanes.has("sq", n)).select(*own, "root", "perm", "sq")
    image = lanes.mask_limbs("image", n)
    images = squares.join(flips, ["root", "sq"]).join(moves, ["perm", "at"]).groupBy(*own, "root", "perm").agg(*[F.bit_or(F.expr(x)).alias(f"l{k}") for k, x in enumerate(image)])
    highest = [f"l{k}" for k in reversed(range(len(p.m)))]
    best = images.groupBy(*own).agg(F.min(F.struct(*highest)).alias("best"), F.count_distinct("root").cast("int").alias("roots"), F.count("*").cast("int").alias("trials"))
    return best.select(*own, *[F.col(f"best.l{k}").alias(f"l{k}") for k in range(len(p.m))], "roots", "trials")


def restricted_labels(c: DataFrame, n: int, rounds: int | None = None) -> DataFrame:
    """cid, label limbs, roots and trials (see restricted_labels_of) of complexes (cid, sq); equal complexes are labelled once."""
    p, g = lanes.packing(n), lanes.gathered(c, n)
    own = {x: f"of_{x}" for x in p.m}
    # By a number of parts of their own, as adaptive execution would put these few bytes, of which each makes thousands of rows, into one task.
    parts = 4 * int(c.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many as the shuffle before has would be left out
    each = lanes.alike(g, n).select(*p.m, *[F.col(x).alias(of) for x, of in own.items()]).repartition(parts, *own.values())
    found = restricted_labels_of(each, n, *own.values(), rounds=rounds).withColumnsRenamed({of: x for x, of in own.items()})
    return g.join(found, p.m).select("cid", *[f"l{k}" for k in range(len(p.m))], "roots", "trials")
