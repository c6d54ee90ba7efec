"""Complexes as packed counters: whole states in a few BIGINT columns, updated by one addition a square.

m0, m1, ...: the squares as bits, 60 a limb.  e0, e1, ...: how many squares lie on each edge, LANES counters of LANE bits a limb.
v0, v1, ...: for each vertex the pairs of directions that its squares span, a bit a pair: the link of a vertex is a graph on directions, so its edges,
squares and cycles are bit counts and bit tests, the same at every vertex of the cube.

The cube is a table with one row a square, broadcast (672 rows at most), whose columns are what that square adds; a complex is gathered in one
aggregation by cid, the only shuffle, and its state is the sum of its squares' rows (of small cubes, of tables of four squares, without a join).  Plans
don't grow with wider cubes, but for the number of limbs, and hold no lambda: everything is compiled.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from itertools import combinations
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cells
from .incidence import incidence

#: Bits of a limb; of an edge's counter (an edge lies in n - 1 <= 6 squares); counters of a limb.
LIMB, LANE, LANES = 60, 3, 20
#: Cubes up to which a state is looked up from the squares' bits, four at a time; wider ones add up the rows of the squares.
TABLES = 5
ONES = sum(1 << LANE * k for k in range(LANES))


class Packing:
    """Names and places of the limbs for a cube."""

    def __init__(self, n: int):
        n0, n1, n2 = cells.sizes(cells.check_dimension(n))
        self.n, self.n0, self.n1, self.n2 = n, n0, n1, n2
        #: Bits of a vertex's link, and links of a limb.
        self.width = n * (n - 1) // 2
        self.links = LIMB // self.width
        self.m = [f"m{k}" for k in range(-(-n2 // LIMB))]
        self.e = [f"e{k}" for k in range(-(-n1 // LANES))]
        self.v = [f"v{k}" for k in range(-(-n0 // self.links))]
        self.pair = {p: k for k, p in enumerate(combinations(range(n), 2))}

    def limbs(self, parts: str) -> list[str]:
        return [x for p in parts for x in getattr(self, p)]

    def square(self, s: int) -> list[int]:
        """What a square adds to each limb of m, e and v."""
        at, out = incidence(self.n), dict.fromkeys(self.limbs("mev"), 0)
        out[f"m{s // LIMB}"] |= 1 << s % LIMB
        for e in at.edges_of[s]:
            out[f"e{e // LANES}"] += 1 << LANE * (e % LANES)
        bit = self.pair[tuple(k for k in range(self.n) if at.squares[s][k] == 2)]
        for v in at.vertices_of[s]:
            out[f"v{v // self.links}"] |= 1 << self.width * (v % self.links) + bit
        return list(out.values())

    def cycles(self) -> dict[int, list[int]]:
        """Pairs of directions of the short cycles of a link, by length."""
        at = incidence(self.n)
        pair = {s: self.pair[tuple(k for k in range(self.n) if at.squares[s][k] == 2)] for s in at.squares_at[0]}
        return {length: [sum(1 << pair[s] for s in c) for c in found] for length, found in at.cycles[0].items()}


@lru_cache
def packing(n: int) -> Packing:
    return Packing(n)


def pick(names: list[str], index: str) -> str:
    """SQL: the limb of a number."""
    return names[0] if len(names) == 1 else f"(case cast({index} as int) " + " ".join(f"when {k} then {x}" for k, x in enumerate(names)) + " end)"


def square_table(spark: SparkSession, n: int, parts: str = "mev", prefix: str = "") -> DataFrame:
    """sq and what each square adds, to be broadcast; prefix: of the limbs' names."""
    p = packing(n)
    all_names = p.limbs("mev")
    rows = [(s, *p.square(s)) for s in range(p.n2)]
    table = spark.createDataFrame(rows, "sq int, " + ", ".join(f"{x} long" for x in all_names))
    return F.broadcast(table.select("sq", *[F.col(x).alias(prefix + x) for x in p.limbs(parts)]))


def edge_table(spark: SparkSession, n: int) -> DataFrame:
    """edge and its ends a and b, to be broadcast."""
    return F.broadcast(spark.createDataFrame([(e, *ends) for e, ends in enumerate(incidence(n).ends)], "edge int, a int, b int"))


def edge_square_table(spark: SparkSession, n: int, prefix: str = "q") -> DataFrame:
    """edge and each square on it, with what that adds, to be broadcast."""
    on = spark.createDataFrame([(e, s) for e, squares in enumerate(incidence(n).squares_on) for s in squares], "edge int, sq int")
    return F.broadcast(on.join(square_table(spark, n, "mev", prefix), "sq"))


def gathered(c: DataFrame, n: int) -> DataFrame:
    """cid and m limbs of complexes in long form; a square outside the cube raises, a repeated one counts once."""
    p = packing(n)
    known = f"if(sq < 0 or sq >= {p.n2}, raise_error('square outside 0 to {p.n2 - 1}'), sq)"
    return c.groupBy("cid").agg(*[F.bit_or(F.expr(x)).alias(m) for x, m in zip(mask_limbs(known, n), p.m, strict=True)])


def mask_limbs(sq: str, n: int) -> list[str]:
    """SQL: the m limbs of one square."""
    return [f"if({sq} div {LIMB} = {k}, shiftleft(1L, cast({sq} % {LIMB} as int)), 0L)" for k in range(len(packing(n).m))]


def has(sq: str, n: int) -> str:
    """SQL: whether the complex holds a square."""
    return f"(shiftright({pick(packing(n).m, f'{sq} div {LIMB}')}, cast({sq} % {LIMB} as int)) & 1L) = 1L"


def exploded(g: DataFrame, n: int, what: str, count: int) -> DataFrame:
    """g with a row for each number below count in a column `what`."""
    return g.select("*", F.explode(F.expr(f"sequence(0, {count - 1})")).alias(what))


@lru_cache
def looked_up(limb: str, n: int) -> str:
    """SQL: a limb of e or v as the sum of what each four squares add, by a table of their 16 sets."""
    p = packing(n)
    at = p.limbs("mev").index(limb)
    add = [p.square(s)[at] for s in range(p.n2)]
    join = (lambda xs: sum(xs)) if limb[0] == "e" else (lambda xs: reduce(or_, xs, 0))
    terms = []
    for first in range(0, p.n2, 4):
        some = add[first : first + 4]
        table = ", ".join(f"{join([x for k, x in enumerate(some) if value >> k & 1])}L" for value in range(1 << len(some)))
        if any(some):
            terms.append(f"array({table})[cast(shiftright(m{first // LIMB}, {first % LIMB}) & {(1 << len(some)) - 1}L as int)]")
    return f"({(' + ' if limb[0] == 'e' else ' | ').join(terms)})"


def alike(g: DataFrame, n: int) -> DataFrame:
    """cid, the least one, m limbs and alike, the number of complexes, of each different complex of g (cid, m limbs): what is found of it holds for all of them."""
    m = packing(n).m
    return g.groupBy(*m).agg(F.min("cid").alias("cid"), F.count("*").alias("alike")).select("cid", *m, "alike")


def packed(c: DataFrame, n: int, parts: str = "mev") -> DataFrame:
    """cid and the limbs of parts of each complex of c (cid, sq)."""
    return packed_of(gathered(c, n), n, parts)


def packed_of(g: DataFrame, n: int, parts: str = "mev", *carry: str) -> DataFrame:
    """cid, carry and the limbs of parts of each complex of g (cid, carry, m limbs)."""
    p = packing(n)
    if parts == "m":
        return g
    if n <= TABLES:
        return g.select("cid", *carry, *[F.expr(x if x[0] == "m" else looked_up(x, n)).alias(x) for x in p.limbs(parts)])
    return summed(g, n, ["cid", *carry], p.limbs(parts))


def summed(g: DataFrame, n: int, keys: list[str], limbs: list[str]) -> DataFrame:
    """keys (which tell rows apart) and some limbs of the complexes of m limbs, as sums of their squares' rows; dealt as g is, if that is by keys."""
    kinds = "".join(dict.fromkeys(x[0] for x in limbs))
    rows = exploded(g, n, "sq", packing(n).n2).where(has("sq", n)).select(*keys, "sq").join(square_table(g.sparkSession, n, kinds, "q"), "sq")
    return rows.groupBy(*keys).agg(*[(F.sum(f"q{x}") if x[0] == "e" else F.bit_or(f"q{x}")).alias(x) for x in limbs])


def linked(g: DataFrame, n: int, *keys: str) -> DataFrame:
    """keys and the v limbs of the complexes of m limbs; keys tell rows apart."""
    p = packing(n)
    return g.select(*keys, *[F.expr(looked_up(x, n)).alias(x) for x in p.v]) if n <= TABLES else summed(g, n, list(keys), p.v)


def used(e: str) -> str:
    """SQL: a bit for each edge of a limb that lies in a square; free: in one; twice: in two; full: in two or more; over: in three or more."""
    return f"(({e} | shiftright({e}, 1) | shiftright({e}, 2)) & {ONES}L)"


def free(e: str) -> str:
    return f"({e} & ~shiftright({e}, 1) & ~shiftright({e}, 2) & {ONES}L)"


def twice(e: str) -> str:
    return f"(~{e} & shiftright({e}, 1) & ~shiftright({e}, 2) & {ONES}L)"


def full(e: str) -> str:
    return f"((shiftright({e}, 1) | shiftright({e}, 2)) & {ONES}L)"


def over(e: str) -> str:
    return f"((shiftright({e}, 2) | ({e} & shiftright({e}, 1))) & {ONES}L)"


def none(masks: list[str]) -> str:
    """SQL: whether all of these are 0."""
    return f"({' | '.join(masks)}) = 0L"


def bits(masks: list[str]) -> str:
    """SQL: how many bits these have."""
    return "cast(" + " + ".join(f"bit_count({x})" for x in masks) + " as int)"


def ok(n: int) -> str:
    return none([over(e) for e in packing(n).e])


def closed(n: int) -> str:
    return none([f"({free(e)} | {over(e)})" for e in packing(n).e])


def n_free(n: int) -> str:
    return bits([free(e) for e in packing(n).e])


def legal(n: int, prefix: str = "q") -> str:
    """SQL: a square that the complex lacks and that meets no edge in two squares or more; its limbs have a prefix."""
    p = packing(n)
    return f"{none([f'({m} & {prefix}{m})' for m in p.m])} and {none([f'({full(e)} & {prefix}{e})' for e in p.e])}"


def covers(n: int, prefix: str = "q") -> str:
    """SQL: how many free edges a square would cover."""
    return bits([f"({free(e)} & {prefix}{e})" for e in packing(n).e])


def first_edge(n: int, of=free) -> str:
    """SQL: the lowest free edge (null if there is none)."""
    low = lambda k, x: f"when {x} != 0L then {LANES * k} + cast(bit_count(({x} & -{x}) - 1L) div {LANE} as int)"
    return "(case " + " ".join(low(k, of(e)) for k, e in enumerate(packing(n).e)) + " end)"


def plus(n: int, prefix: str = "q") -> list:
    """Columns of the state with one more square."""
    p = packing(n)
    return [F.expr(f"{x} {'+' if x[0] == 'e' else '|'} {prefix}{x}").alias(x) for x in p.limbs("mev")]


def link_at(vertex: str, n: int) -> str:
    """SQL: the link of a vertex, as pairs of directions."""
    p = packing(n)
    return f"(shiftright({pick(p.v, f'{vertex} div {p.links}')}, cast({p.width} * ({vertex} % {p.links}) as int)) & {(1 << p.width) - 1}L)"


def directions(link: str, n: int) -> str:
    """SQL: how many edges meet at a vertex of that link."""
    around = [sum(1 << k for pair, k in packing(n).pair.items() if d in pair) for d in range(n)]
    return "(" + " + ".join(f"if(({link} & {x}L) != 0L, 1, 0)" for x in around) + ")"


def holds_cycle(link: str, n: int, length: int) -> str:
    """SQL: whether a link has a cycle of that length."""
    return "(" + (" or ".join(f"({link} & {c}L) = {c}L" for c in packing(n).cycles().get(length, ())) or "false") + ")"
