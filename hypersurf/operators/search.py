"""A level of the search, and the look-ahead, over given complexes: plans on packed states (lanes.py).

A child is its parent's state plus one square's row, so nothing is gathered again between extension, tests and label: a shuffle by parent, one each by equal
parents and by equal children, which are judged and labelled once, and one by label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import lanes, symmetry, topology
from .storage import stored

#: The rules of topology.RULES by mode: closed connected (""), closed with several parts ("d"), with boundary ("b"), both ("db").
MODES = {"": "closed", "d": "closed_disconnected", "b": "boundary", "db": "boundary"}


def children(s: DataFrame, n: int, mode: str = "", *carry: str) -> DataFrame:
    """cid, carry, sq and the child's state, of states (cid, carry, m, e and v limbs) and each square that the mode adds.

    "": legal squares on the first edge of priority; "d": absent squares on the first free edge, or every one where no edge is free;
    "b": absent squares on any free edge; "db": every absent square.
    """
    p = lanes.packing(n)
    state = ["cid", *carry, *p.limbs("mev")]
    if mode == "":
        rows = topology.on_first(s, n, *state).where(lanes.legal(n))
    else:
        where = {"d": f"first is null or {topology.on_edge('first', n)}", "b": f"{lanes.covers(n)} > 0", "db": "true"}[mode]
        s = s.withColumn("first", F.expr(lanes.first_edge(n))) if mode == "d" else s
        rows = topology.every_square(s, n, "mev").where(f"{topology.absent(n)} and ({where})")
    return rows.select("cid", *carry, "sq", *lanes.plus(n))


def judged(kids: DataFrame, n: int, mode: str = "", check_links: bool = True, *carry: str) -> DataFrame:
    """cid, carry, sq, m limbs, labeled (to the frontier) and good (accepted) of the children (see children) that are either."""
    p = lanes.packing(n)
    keys = ["cid", *carry, "sq", *p.m, "closed"]
    kids = kids.where(lanes.ok(n)).withColumns({"ok": F.lit(True), "closed": F.expr(lanes.closed(n))})
    if check_links:
        each = topology.vertices(kids, n, *keys).groupBy(*keys).agg(*topology.link_flags(n)).withColumn("ok", F.lit(True))
    else:
        each = kids.withColumns({"bad": F.lit(False), "hopeless": F.lit(False)})
    labeled, good = (F.expr(x) for x in topology.RULES[MODES[mode]])
    return each.select("cid", *carry, "sq", *p.m, labeled.alias("labeled"), good.alias("good")).where("labeled or good")


def level_step(c: DataFrame, n: int, mode: str = "", max_squares: int | None = None, check_links: bool = True) -> DataFrame:
    """label, squares, labeled, good, children and parent of the distinct children of complexes (cid, sq), the level after theirs.

    label: the least image as a BIGINT for cubes of up to 4 dimensions, the restricted label's limbs (l0, l1, ...) for wider ones.  children: how many
    children of all parents have it; parent: the least cid of these.  max_squares: closed modes extend no complex that has as many squares, or
    whose free edges are more than four for each square left.
    """
    p = lanes.packing(n)
    s = lanes.packed_of(lanes.alike(lanes.gathered(c, n), n), n, "mev", "alike")
    if max_squares and mode in ("", "d"):
        s = s.where(f"{lanes.bits(p.m)} < {max_squares} and {lanes.n_free(n)} <= 4 * ({max_squares} - {lanes.bits(p.m)})")
    kids = judged(children(s, n, mode, "alike"), n, mode, check_links, "alike")
    # Equal children of several parents have one label, and what is judged of them is equal too.
    kids = kids.groupBy(*p.m).agg(F.first("labeled").alias("labeled"), F.first("good").alias("good"), F.sum("alike").alias("alike"), F.min(F.struct("cid", "sq")).alias("of")).select("*", "of.cid", F.col("of.sq").alias("added")).withColumn("squares", F.expr(lanes.bits(p.m)))
    if n <= 4:
        kids, label = kids.withColumn("label", symmetry.canonical_label(F.col("m0"), n)), ["label"]
    else:
        kids, label = symmetry.restricted_labels_of(kids, n, "cid", "added", "alike", "squares", "labeled", "good"), [f"l{k}" for k in range(len(p.m))]
    return kids.groupBy(*label).agg(F.first("squares").alias("squares"), F.bool_or("labeled").alias("labeled"), F.bool_or("good").alias("good"), F.sum("alike").alias("children"), F.min("cid").alias("parent"))


class BudgetExceeded(RuntimeError):
    pass


def lookahead(c: DataFrame, n: int, max_squares: int, depth: int, budget: int | None = None) -> DataFrame:
    """cid, feasible and nodes of the complexes that have a free edge and fewer squares than max_squares.

    feasible: some `depth` legal squares, each on the then first edge of priority, leave at each step as much cover in the node's other legal squares as free edges are left, or
    close the complex on the way.  nodes: the different complexes that were extended; more than the budget for one cid are an error.

    Level by level: a node is a state; a level's rows are its nodes' moves, stored; a cid with a success is not followed further.  A level's nodes are dealt by cid
    once, which serves all of its steps.
    """
    p = lanes.packing(n)
    state = ["cid", "left", *p.limbs("mev")]
    nodes = lanes.packed(c, n).withColumn("left", max_squares - F.expr(lanes.bits(p.m))).where(f"left > 0 and {lanes.n_free(n)} > 0").select(*state)
    done = None
    for k in range(1, depth + 1):
        seen = topology.with_histogram(nodes, n)
        bound = ["b1", "b2", "b3", "b4"]
        moves = topology.on_first(seen, n, *state, *bound).withColumn("c", F.expr(lanes.covers(n)))
        rest = moves.withColumns({b: F.col(b) - (F.col("c") == i + 1).cast("int") for i, b in enumerate(bound)})
        fits = F.expr(lanes.legal(n)) & (F.expr(lanes.n_free(n)) - F.col("c") <= topology.cap(F.col("left") - 1))
        after = rest.select("cid", (F.col("left") - 1).alias("left"), F.struct(*p.m).alias("node"), fits.alias("fits"), *lanes.plus(n))
        success = F.col("fits") & (F.lit(k == depth) | (F.col("left") == 0) | F.expr(f"{lanes.n_free(n)} = 0"))
        level = after.withColumn("success", success).withColumn("met", F.max("success").over(W.partitionBy("cid")))
        level = stored(level, f"lookahead-{k}")
        found = level.groupBy("cid").agg(F.bool_or("success").alias("feasible"), F.count_distinct("node").alias("nodes"))
        done = found if done is None else done.unionByName(found).groupBy("cid").agg(F.bool_or("feasible").alias("feasible"), F.sum("nodes").alias("nodes"))
        if budget is not None and (most := done.agg(F.max("nodes")).first()[0] or 0) > budget:
            raise BudgetExceeded(f"the look-ahead extended {most} complexes of one cid, more than {budget}")
        nodes = level.where("fits and not met").select(*state).repartition("cid").distinct()
    return done
