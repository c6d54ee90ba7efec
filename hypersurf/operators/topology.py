"""Tests of complexes in long form (cid, sq): one row a square.

A complex is gathered in one aggregation on cid, the only shuffle, into packed counters (lanes.py); tests, links, priorities and extensions
are compiled expressions on these.  Signatures and ranks are expressions on arrays by vertex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import lanes
from .incidence import incidence

LIMB = lanes.LIMB

#: Code of a vertex with (edges, squares) of the complex; from the 7-cube on also the second table.
CODES = {(2, 1): 1, (3, 2): 2, (3, 3): 3, (4, 2): 4, (4, 3): 5, (4, 4): 6, (5, 3): 7, (5, 4): 8, (5, 5): 9, (6, 3): 10, (6, 4): 11, (6, 5): 12, (6, 6): 13}
CODES_7 = {(7, 4): 14, (7, 5): 15, (7, 6): 16, (7, 7): 17}
#: Extension weight of a vertex code, 0 for any other.
WEIGHTS = {1: 9, 2: 8, 4: 7, 5: 6, 7: 5, 8: 4, 10: 3, 11: 2, 12: 1}
#: Codes whose link has several paths; codes that are hopeless if they hold a cycle of that length.
BAD, BAD_7 = (4, 7, 10, 11), (14, 15)
HOPELESS = {3: (8, 12, 13), 4: (12,), 5: ()}
HOPELESS_7 = {3: (8, 12, 13, 16, 17), 4: (12, 16, 17), 5: (16,)}


def codes(n: int) -> dict[tuple[int, int], int]:
    return CODES | CODES_7 if n >= 7 else CODES


def other(n: int) -> int:
    """The code of every other vertex that is used."""
    return 18 if n >= 7 else 14


def literal(x) -> str:
    """SQL of a number, or of a list of lists of numbers."""
    return f"array({', '.join(map(literal, x))})" if isinstance(x, (list, tuple)) else str(x)


def states(c: DataFrame, n: int) -> DataFrame:
    """cid and limbs of each complex, the lowest first."""
    return lanes.gathered(c, n).select("cid", F.array(*lanes.packing(n).m).alias("limbs"))


def edge_test(c: DataFrame, n: int) -> DataFrame:
    """ok: no edge in three squares; closed: every used edge in exactly two."""
    squares = F.expr(lanes.bits(lanes.packing(n).m)).alias("n_squares")
    return lanes.packed(c, n, "me").select("cid", squares, F.expr(lanes.ok(n)).alias("ok"), F.expr(lanes.closed(n)).alias("closed"))


def touched_edges(c: DataFrame, n: int) -> DataFrame:
    """cid, edge and m, the number of its squares, of every edge that is used."""
    p = lanes.packing(n)
    m = f"cast(shiftright({lanes.pick(p.e, f'edge div {lanes.LANES}')}, cast({lanes.LANE} * (edge % {lanes.LANES}) as int)) & {(1 << lanes.LANE) - 1}L as int)"
    return lanes.exploded(lanes.packed(c, n, "e"), n, "edge", p.n1).select("cid", "edge", F.expr(m).alias("m")).where("m > 0")


def _edges(s: DataFrame, n: int, of, *carry: str) -> DataFrame:
    """carry and edge of the edges for which a limb's bits are set."""
    p = lanes.packing(n)
    s = s.select(*carry, *[F.expr(of(e)).alias(f"_{e}") for e in p.e])
    at = f"(shiftright({lanes.pick([f'_{e}' for e in p.e], f'edge div {lanes.LANES}')}, cast({lanes.LANE} * (edge % {lanes.LANES}) as int)) & 1L) = 1L"
    return lanes.exploded(s, n, "edge", p.n1).where(at).select(*carry, "edge")


def free_edges(c: DataFrame, n: int) -> DataFrame:
    return _edges(lanes.packed(c, n, "e"), n, lanes.free, "cid")


def boundary(c: DataFrame, n: int) -> DataFrame:
    """cid, the sum mod 2 of the squares' boundaries as limbs of edges (b0, the lowest, b1, ...), and its number of edges.

    Where no edge lies in three squares these are the free edges.
    """
    n1, rows = lanes.packing(n).n1, []
    count = -(-n1 // LIMB)
    for s, edges in enumerate(incidence(n).edges_of):
        rows.append((s, *[sum(1 << e % LIMB for e in edges if e // LIMB == k) for k in range(count)]))
    table = F.broadcast(c.sparkSession.createDataFrame(rows, "sq int, " + ", ".join(f"b{k} long" for k in range(count))))
    squares = lanes.exploded(lanes.gathered(c, n), n, "sq", lanes.packing(n).n2).where(lanes.has("sq", n)).select("cid", "sq")
    sums = squares.join(table, "sq").groupBy("cid").agg(*[F.bit_xor(f"b{k}").alias(f"b{k}") for k in range(count)])
    return sums.withColumn("edges", F.expr(lanes.bits([f"b{k}" for k in range(count)])))


def saturated_edges(c: DataFrame, n: int) -> DataFrame:
    return _edges(lanes.packed(c, n, "e"), n, lanes.twice, "cid")


def every_square(s: DataFrame, n: int, parts: str = "me") -> DataFrame:
    """s with a row for each square of the cube and what it adds, as limbs of the prefix q."""
    return lanes.exploded(s, n, "sq", lanes.packing(n).n2).join(lanes.square_table(s.sparkSession, n, parts, "q"), "sq")


def legal_squares(c: DataFrame, n: int) -> DataFrame:
    """cid, sq, covers: absent squares that meet no edge in two or more squares, with the free edges they cover, 1 at least."""
    rows = every_square(lanes.packed(c, n, "me"), n).where(lanes.legal(n)).select("cid", F.col("sq"), F.expr(lanes.covers(n)).alias("covers"))
    return rows.where("covers > 0")


def with_histogram(s: DataFrame, n: int) -> DataFrame:
    """s (with m and e limbs) with b1 to b4, how many legal squares cover so many free edges."""
    keys = s.columns
    rows = every_square(s, n).select(*keys, F.expr(f"if({lanes.legal(n)}, {lanes.covers(n)}, 0)").alias("_covers"))
    return rows.groupBy(*keys).agg(*[F.count_if(F.col("_covers") == k).cast("int").alias(f"b{k}") for k in range(1, 5)])


def coverage_histogram(c: DataFrame, n: int) -> DataFrame:
    return with_histogram(lanes.packed(c, n, "me"), n).select("cid", "b1", "b2", "b3", "b4")


def cap(left) -> F.Column:
    """What the best `left` squares of a histogram b1 to b4 cover."""
    out, rest = F.lit(0), left
    for k in (4, 3, 2, 1):
        take = F.least(rest, F.col(f"b{k}"))
        out, rest = out + k * take, rest - take
    return out


def coverage_prune(c: DataFrame, n: int, max_squares: int) -> DataFrame:
    """Whether a complex can still be closed within max_squares, by what its best legal squares cover."""
    base = with_histogram(lanes.packed(c, n, "me"), n).select("cid", F.expr(lanes.bits(lanes.packing(n).m)).alias("n_squares"), F.expr(lanes.n_free(n)).alias("free"), "b1", "b2", "b3", "b4")
    left = F.greatest(F.lit(0), max_squares - F.col("n_squares"))
    base = base.withColumn("cap", cap(left))
    keep = (F.col("n_squares") < max_squares) & (F.col("free") <= 4 * left) & (F.col("cap") >= F.col("free"))
    return base.select("cid", "n_squares", "free", "cap", keep.alias("keep"))


def code_of(link: str, n: int) -> str:
    """SQL: the code of a vertex by its link, 0 where it is unused."""
    top = n * (n - 1) // 2 + 1
    table = [codes(n).get((e, q), other(n)) if e else 0 for e in range(n + 1) for q in range(top)]
    return f"{literal(table)}[{lanes.directions(link, n)} * {top} + bit_count({link})]"


def vertices(s: DataFrame, n: int, *carry: str) -> DataFrame:
    """carry, vertex, link, edges, squares and code of every used vertex of states with v limbs."""
    rows = lanes.exploded(s, n, "vertex", lanes.packing(n).n0).select(*carry, "vertex", F.expr(lanes.link_at("vertex", n)).alias("link")).where("link != 0L")
    rows = rows.select("*", F.expr(lanes.directions("link", n)).alias("edges"), F.expr("cast(bit_count(link) as int)").alias("squares"))
    return rows.withColumn("code", F.expr(code_of("link", n)))


def vertex_codes(c: DataFrame, n: int) -> DataFrame:
    """cid, vertex, edges, squares, code of every used vertex."""
    return vertices(lanes.packed(c, n, "v"), n, "cid").drop("link")


def link_flags(n: int) -> list:
    """Aggregates of vertices: bad and hopeless (see link_class)."""
    hopeless = [f"code = {other(n)}"]
    for length, of in (HOPELESS_7 if n >= 7 else HOPELESS).items():
        if of:
            hopeless.append(f"(code in ({', '.join(map(str, of))}) and {lanes.holds_cycle('link', n, length)})")
    bad = f"code in ({', '.join(map(str, BAD + BAD_7 if n >= 7 else BAD))})"
    return [F.bool_or(F.expr(bad)).alias("bad"), F.bool_or(F.expr(" or ".join(hopeless))).alias("hopeless")]


def link_class(c: DataFrame, n: int) -> DataFrame:
    """bad: a link has several paths; hopeless: a link can't become one path or one cycle any more."""
    return vertices(lanes.packed(c, n, "v"), n, "cid").groupBy("cid").agg(*link_flags(n))


#: (to the frontier, accepted) by mode: closed (connected or not) or with boundary; of complexes with ok, closed, bad and hopeless.
RULES = {
    "closed": ("ok and not hopeless and not closed", "ok and not hopeless and closed and not bad"),
    "closed_disconnected": ("ok and not hopeless", "ok and not hopeless and closed and not bad"),
    "boundary": ("ok and not hopeless", "ok and not hopeless and not bad"),
}


def keep_rules(c: DataFrame, n: int) -> DataFrame:
    """cid, mode, keep_labeled, keep_good for modes closed, closed_disconnected and boundary."""
    s = lanes.packed(c, n, "ev").withColumns({"ok": F.expr(lanes.ok(n)), "closed": F.expr(lanes.closed(n))})
    each = vertices(s, n, "cid", "ok", "closed").groupBy("cid", "ok", "closed").agg(*link_flags(n))
    rows = F.array(*[F.struct(F.lit(m).alias("mode"), F.expr(a).alias("keep_labeled"), F.expr(b).alias("keep_good")) for m, (a, b) in RULES.items()])
    return each.select("cid", F.inline(rows))


def _weighed(s: DataFrame, n: int, *carry: str) -> DataFrame:
    """carry, edge and weight of the free edges of states with e and v limbs; an edge weighs as its lighter end."""
    table = literal([WEIGHTS.get(k, 0) for k in range(other(n) + 1)])
    need = [*dict.fromkeys([*carry, *lanes.packing(n).v])]
    at = _edges(s, n, lanes.free, *need).join(lanes.edge_table(s.sparkSession, n), "edge")
    at = at.select(*carry, "edge", *[F.expr(lanes.link_at(x, n)).alias(f"_{x}") for x in ("a", "b")])
    return at.select(*carry, "edge", F.expr("least(" + ", ".join(f"{table}[{code_of(f'_{x}', n)}]" for x in ("a", "b")) + ")").alias("weight"))


def priority_edges(c: DataFrame, n: int) -> DataFrame:
    """Free edges of the least weight of their complex."""
    least = F.min("weight").over(W.partitionBy("cid"))
    return _weighed(lanes.packed(c, n, "ev"), n, "cid").withColumn("least", least).where("weight = least").select("cid", "edge", "weight")


def first_priority(s: DataFrame, n: int, *carry: str) -> DataFrame:
    """carry and edge, the first free edge of least weight, of states with e and v limbs that have a free edge; carry tells states apart."""
    return _weighed(s, n, *carry).groupBy(*carry).agg(F.min(F.expr("weight * 1024 + edge")).alias("_at")).select(*carry, F.expr("_at % 1024").alias("edge"))


def on_first(s: DataFrame, n: int, *carry: str) -> DataFrame:
    """carry, sq and q limbs of the squares on the first edge of priority; legal ones if carry has the m and e limbs."""
    return first_priority(s, n, *carry).join(lanes.edge_square_table(s.sparkSession, n), "edge").drop("edge")


def extend_closed(c: DataFrame, n: int) -> DataFrame:
    """cid, sq: legal squares on the first edge of priority."""
    p = lanes.packing(n)
    return on_first(lanes.packed(c, n), n, "cid", *p.m, *p.e).where(lanes.legal(n)).select("cid", "sq")


def extend_any(c: DataFrame, n: int) -> DataFrame:
    """cid, sq: every absent square."""
    return lanes.exploded(lanes.gathered(c, n), n, "sq", lanes.packing(n).n2).where(f"not {lanes.has('sq', n)}").select("cid", "sq")


def absent(n: int) -> str:
    """SQL: the complex lacks the square of the q limbs."""
    return lanes.none([f"({m} & q{m})" for m in lanes.packing(n).m])


def extend_boundary(c: DataFrame, n: int) -> DataFrame:
    """cid, sq: absent squares on any free edge."""
    return every_square(lanes.packed(c, n, "me"), n).where(f"{absent(n)} and {lanes.covers(n)} > 0").select("cid", "sq")


def on_edge(edge: str, n: int) -> str:
    """SQL: the square of the q limbs lies on an edge."""
    p = lanes.packing(n)
    return f"(shiftright({lanes.pick([f'q{e}' for e in p.e], f'{edge} div {lanes.LANES}')}, cast({lanes.LANE} * ({edge} % {lanes.LANES}) as int)) & 1L) = 1L"


def extend_disconnected(c: DataFrame, n: int) -> DataFrame:
    """cid, sq: absent squares on the first free edge; every absent square where no edge is free."""
    s = lanes.packed(c, n, "me").withColumn("first", F.expr(lanes.first_edge(n)))
    return every_square(s, n).where(f"{absent(n)} and (first is null or {on_edge('first', n)})").select("cid", "sq")


def lookahead(c: DataFrame, n: int) -> DataFrame:
    """Whether some legal square lies on the first edge of priority, of complexes with a free edge."""
    p = lanes.packing(n)
    rows = on_first(lanes.packed(c, n), n, "cid", *p.m, *p.e)
    return rows.groupBy("cid").agg(F.count_if(F.expr(lanes.legal(n))).cast("int").alias("moves")).withColumn("feasible", F.col("moves") > 0)


def let(value: str, name: str, body: str) -> str:
    """SQL of body with a name for a value that it uses several times."""
    return f"transform(array({value}), {name} -> {body})[0]"


def coded(s: DataFrame, n: int, *carry: str) -> DataFrame:
    """carry and code, an array by vertex (0 where it is unused), of states with v limbs; as one expression that isn't an array of parts: those the optimizer copies into every use."""
    p, top = lanes.packing(n), n * (n - 1) // 2 + 1
    table = [codes(n).get((e, q), other(n)) if e else 0 for e in range(n + 1) for q in range(top)]
    around = [sum(1 << k for pair, k in p.pair.items() if d in pair) for d in range(n)]
    links = s.select(*carry, F.array(*p.v).alias("v"))
    link = f"transform(sequence(0, {p.n0 - 1}), x -> shiftright(v[cast(x div {p.links} as int)], cast({p.width} * (x % {p.links}) as int)) & {(1 << p.width) - 1}L)"
    edges = " + ".join(f"if((y & {x}L) != 0L, 1, 0)" for x in around)
    return links.withColumn("code", F.expr(f"transform({link}, y -> {literal(table)}[({edges}) * {top} + bit_count(y)])")).select(*carry, "code")


def signed(s: DataFrame, n: int, *carry: str) -> DataFrame:
    """carry, sig1 and sig2 of every vertex of the cube, as arrays by vertex, of states with v limbs."""
    near = literal(incidence(n).near)
    s = coded(s, n, *carry).select(*carry, F.expr("transform(code, k -> lpad(cast(k as string), 2, '0'))").alias("sig"))
    for name, of, by in (("sig1", ":", ","), ("sig2", "|", ";")):
        before = "sig" if name == "sig1" else "sig1"
        s = s.withColumn(name, F.expr(f"transform({near}, (ws, v) -> concat({before}[v], '{of}', array_join(array_sort(transform(ws, w -> {before}[w])), '{by}')))"))
    return s.select(*carry, "sig1", "sig2")


def vertex_signatures(c: DataFrame, n: int) -> DataFrame:
    """cid, vertex, sig1 (code, then the neighbours' codes in order) and sig2 (the same of sig1) of every vertex of the cube."""
    return signed(lanes.packed(c, n, "v"), n, "cid").select("cid", F.posexplode(F.arrays_zip("sig1", "sig2")).alias("vertex", "s")).select("cid", "vertex", "s.sig1", "s.sig2")


def neighbor_ranks(c: DataFrame, n: int) -> DataFrame:
    """cid, vertex, coord, rank: place of a neighbour's signature among the distinct ones around the vertex."""
    ranks = f"transform({literal(incidence(n).near)}, ws -> transform(ws, w -> size(filter(array_distinct(transform(ws, x -> sig2[x])), y -> y < sig2[w]))))"
    rows = signed(lanes.packed(c, n, "v"), n, "cid").select("cid", F.posexplode(F.expr(ranks)).alias("vertex", "r"))
    return rows.select("cid", "vertex", F.posexplode("r").alias("coord", "rank"))


def ranks_of(s: DataFrame, n: int, *carry: str, rounds: int | None = None) -> DataFrame:
    """carry and rank, by vertex the place of its signature among those of the complex, of states with v limbs.

    The signature is sig2, or the rank after so many rounds, each of which ranks the vertices by their own rank and their neighbours' in order, starting from
    the codes.
    """
    dense = lambda x: let(x, "g", let("array_sort(array_distinct(g))", "o", "transform(g, x -> cast(array_position(o, x) as int) - 1)"))
    if rounds is None:
        return signed(s, n, *carry).select(*carry, F.expr(dense("sig2")).alias("rank"))
    near, rank = literal(incidence(n).near), "code"
    for _ in range(rounds):
        rank = let(rank, "r", dense(f"transform({near}, (ws, v) -> concat(array(r[v]), array_sort(transform(ws, w -> r[w]))))"))
    return coded(s, n, *carry).select(*carry, F.expr(rank).alias("rank"))


def refined_ranks(c: DataFrame, n: int, rounds: int = 3) -> DataFrame:
    """cid, vertex, rank after so many rounds (see ranks_of)."""
    return ranks_of(lanes.packed(c, n, "v"), n, "cid", rounds=rounds).select("cid", F.posexplode("rank").alias("vertex", "rank"))
