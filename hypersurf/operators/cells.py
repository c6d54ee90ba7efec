"""Cells of the n-cube and their incidence, as small DataFrames.

A cell is a row of n digits 0, 1 or 2, a 2 being a free coordinate; its code is the row read in base 3, its dimension the
number of 2s, its index its place among the cells of that dimension by code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIMENSIONS = range(3, 8)


def check_dimension(n: int) -> int:
    if n not in DIMENSIONS:
        raise ValueError(f"the cube's dimension must be from 3 to 7, not {n}")
    return n


def sizes(n: int) -> tuple[int, int, int]:
    """Vertices, edges and squares of the n-cube."""
    return 2**n, n * 2 ** (n - 1), n * (n - 1) * 2**n // 8


def cells(spark: SparkSession, n: int) -> DataFrame:
    """dim, idx, code and digits of every cell."""
    check_dimension(n)
    digits = F.expr(f"transform(sequence(0, {n - 1}), k -> cast(id div cast(power(3, {n - 1} - k) as bigint) as int) % 3)")
    every = spark.range(3**n).select(F.col("id").alias("code"), digits.alias("digits")).withColumn("dim", F.expr("size(filter(digits, d -> d = 2))"))
    return every.withColumn("idx", (F.row_number().over(W.partitionBy("dim").orderBy("code")) - 1).cast("int")).select("dim", "idx", "code", "digits")


def faces(spark: SparkSession, n: int) -> DataFrame:
    """dim, idx of each cell and face, the index of each face one dimension below."""
    every = cells(spark, n)
    cut = every.select("dim", "idx", "code", F.posexplode("digits").alias("at", "digit")).where("digit = 2")
    place = F.expr(f"cast(power(3, {n - 1} - at) as bigint)")
    cut = cut.withColumn("face_code", F.explode(F.array(F.col("code") - 2 * place, F.col("code") - place)))
    below = every.select(F.col("code").alias("face_code"), F.col("idx").alias("face"))
    return cut.join(F.broadcast(below), "face_code").select("dim", "idx", "face")


def square_edges(spark: SparkSession, n: int) -> DataFrame:
    return faces(spark, n).where("dim = 2").select(F.col("idx").alias("sq"), F.col("face").alias("edge"))


def edge_vertices(spark: SparkSession, n: int) -> DataFrame:
    return faces(spark, n).where("dim = 1").select(F.col("idx").alias("edge"), F.col("face").alias("vertex"))


def square_vertices(spark: SparkSession, n: int) -> DataFrame:
    return square_edges(spark, n).join(edge_vertices(spark, n), "edge").select("sq", "vertex").distinct()


def edge_squares(spark: SparkSession, n: int) -> DataFrame:
    return square_edges(spark, n).groupBy("edge").agg(F.count("*").cast("int").alias("squares"), F.min("sq").alias("first_sq"), F.max("sq").alias("last_sq"))


def vertex_neighbors(spark: SparkSession, n: int) -> DataFrame:
    """The neighbour of each vertex along each coordinate, counted from the left."""
    flip = F.expr(f"cast(shiftleft(1, {n - 1} - coord) as int)")
    every = spark.range(2**n).select(F.col("id").cast("int").alias("vertex"), F.explode(F.expr(f"sequence(0, {n - 1})")).alias("coord"))
    return every.select("vertex", "coord", F.col("vertex").bitwiseXOR(flip).alias("nbr"))


def square_directions(spark: SparkSession, n: int) -> DataFrame:
    """sq and dirs, the mask of its free coordinates."""
    dirs = F.expr("aggregate(transform(digits, (d, k) -> if(d = 2, shiftleft(1, k), 0)), 0, (a, x) -> a | x)")
    return cells(spark, n).where("dim = 2").select(F.col("idx").alias("sq"), dirs.alias("dirs"))


def link_cycles(spark: SparkSession, n: int) -> DataFrame:
    """Short cycles of vertex links: vertex, len, the cycle's squares as s1 < s2 < ... (-1 beyond len).

    Squares at a vertex form a cycle if each direction is met by none or two of them.
    """
    at = square_vertices(spark, n).join(square_directions(spark, n), "sq")
    pick = lambda k: at.select("vertex", F.col("sq").alias(f"s{k}"), F.col("dirs").alias(f"d{k}"))
    out, chain = None, pick(1)
    for k in range(2, 6 if n >= 7 else 5):
        chain = chain.join(pick(k), "vertex").where(f"s{k - 1} < s{k}")
        if k >= 3:
            closed = chain.where(" ^ ".join(f"d{i}" for i in range(1, k + 1)) + " = 0")
            each = closed.select("vertex", F.lit(k).alias("len"), *[F.col(f"s{i}") if i <= k else F.lit(-1).alias(f"s{i}") for i in range(1, 6)])
            out = each if out is None else out.unionByName(each)
    return out


def group_action(spark: SparkSession, n: int) -> DataFrame:
    """The square to which each symmetry g (a permutation of coordinates after flips) sends each square: 2^n n! rows a square, made from their numbers alone."""
    from itertools import permutations, product

    squares = [c for c in product(range(3), repeat=n) if c.count(2) == 2]
    index = {c: i for i, c in enumerate(squares)}
    perms = list(permutations(range(n)))
    sql = lambda rows: "array(" + ", ".join(sql(r) if isinstance(r, (list, tuple)) else str(r) for r in rows) + ")"
    places = [index.get(c, -1) for c in product(range(3), repeat=n)]
    of = spark.range(len(perms) * 2**n * len(squares)).select(F.expr(f"id div {len(squares)}").alias("g"), F.expr(f"cast(id % {len(squares)} as int)").alias("sq"))
    moved = f"transform({sql(perms)}[cast(g div {2**n} as int)], k -> if({sql(squares)}[sq][k] = 2, 2, {sql(squares)}[sq][k] ^ cast(shiftright(g % {2**n}, k) & 1 as int)))"
    image = f"{sql(places)}[aggregate({moved}, 0, (a, x) -> a * 3 + x)]"
    return of.select("g", "sq", F.expr(image).alias("sq_image"))
