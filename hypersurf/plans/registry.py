"""Registered queries over the driver's tables; plans/oracles.py says the same in SQL.

Complexes are made of line items: order o holds square l_partkey mod the number of squares of the cube.
"""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, wide
from ..operators import cells, dedup, lanes, numbering, search, symmetry, topology
from ..sources import good_store
from . import profile
from .enumerate import Options, enumerate_surfaces
from .oracles import ORACLES

#: Cube of the queries on complexes.
N = 4


def items(spark: SparkSession, sf_dir: str, n: int = N) -> DataFrame:
    """cid and sq of each line item; an order's may repeat a square."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(F.col("l_orderkey").cast("long").alias("cid"), (F.col("l_partkey") % cells.sizes(n)[2]).cast("int").alias("sq"))


def complexes(spark: SparkSession, sf_dir: str, n: int = N) -> DataFrame:
    return items(spark, sf_dir, n).distinct()


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.col("l_orderkey").cast("long")
    return items.select((F.col("l_partkey") % 1000).cast("long").alias("label"), (key * 1024 + F.col("l_linenumber")).alias("id"), (key * 31 + F.col("l_linenumber") * 7).alias("cplx"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run log in which every event is a line; a run is 500 of them."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("long").alias("e"), (F.col("user_id") % 48).cast("string").alias("level"))
    value = lambda name, mod: F.concat(F.lit(f" {name}="), (F.col("e") % mod).cast("string"))
    level = F.concat(F.lit("level="), F.col("level"))
    text = (
        F.when(F.expr("e % 500 = 0"), F.concat(F.lit("run_start run_label=r"), F.expr("cast(e div 500 % 3 as string)"), F.lit(" n=5 dbprefix= chunksize=1000 backend_limbs=1 backend_bits=128 run_mode=Safe")))
        .when(F.expr("e % 500 = 499"), F.lit("run_end"))
        .when(F.expr("e % 10 between 1 and 6"), F.concat(level, F.lit(" chunk=1/1"), value("read_ms", 17), value("analyze_ms", 101), value("reduce_ms", 13), value("proc_ms", 131), value("generated", 1009), value("labeled_ins", 503), value("good_ins", 7)))
        .when(F.expr("e % 10 = 7"), F.concat(level, value("commit_ms", 19), F.lit(" chunks_in_tx=16")))
        .when(F.expr("e % 10 = 8"), F.concat(level, value("prune_global_coverage", 23), value("prune_edge_neighborhood", 29)))
        .when(F.expr("e % 10 = 9"), F.concat(level, value("canon_calls", 37), value("canon_root_candidates", 41), value("canon_tau_trials", 43)))
        .otherwise(F.lit("some other line"))
    )
    return e.select(F.col("e").alias("line_no"), F.concat(F.lit("2024-01-01 00:00:00 "), text).alias("value"))


def storage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_lines with a record of the bytes in use for each line of no known kind."""
    e = F.col("line_no")
    sizes = F.format_string("2024-01-01 00:00:00 level=%d source_temp_db=1 est_live_before_finalize=%d est_live_after_finalize=%d est_live_peak=%d", e % 48, e % 97, e % 89, e % 83)
    return log_lines(spark, sf_dir).withColumn("value", F.when(F.col("value").endswith("some other line"), sizes).otherwise(F.col("value")))


def _surfaces(spark: SparkSession, sf_dir: str, n: int, mode: str) -> DataFrame:
    """Surfaces up to symmetry, and how many of the given complexes are each of them."""
    goods, _ = enumerate_surfaces(spark, Options(n, mode))
    mask = F.conv(F.hex("label"), 16, 10).cast("long")
    found = goods.select(F.col("squares").cast("int").alias("squares"), symmetry.canonical_label(mask, n).alias("label"))
    given = symmetry.masks(complexes(spark, sf_dir, n)).select(symmetry.canonical_label(F.col("mask"), n).alias("label")).groupBy("label").agg(F.count("*").alias("complexes"))
    return _counted(found, given, "label")


def _counted(df: DataFrame, use: DataFrame, *on: str) -> DataFrame:
    """df with complexes, 0 where use has no row."""
    return df.join(use, list(on), "left").withColumn("complexes", F.coalesce("complexes", F.lit(0).cast("long"))).select(*df.columns, "complexes")


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many complexes hold each square."""
    return complexes(spark, sf_dir).groupBy("sq").agg(F.count("*").alias("complexes"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    use = _uses(spark, sf_dir).select(F.lit(2).alias("dim"), F.col("sq").alias("idx"), "complexes")
    return _counted(cells.cells(spark, N).select("dim", "idx", "code"), use, "dim", "idx")


def _edge_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    use = cells.square_edges(spark, N).join(_uses(spark, sf_dir), "sq").groupBy("edge").agg(F.sum("complexes").alias("complexes"))
    return _counted(cells.edge_squares(spark, N), use, "edge")


def _vertex_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    use = cells.square_vertices(spark, N).join(_uses(spark, sf_dir), "sq").groupBy("vertex").agg(F.sum("complexes").alias("complexes"))
    return _counted(cells.vertex_neighbors(spark, N), use, "vertex")


def _link_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of links and how many complexes hold all squares of each: those whose masks have its bits.

    A row a complex, not one a square and cycle of it, is shuffled, and each distinct mask is held against the cycles once.
    """
    cycles = cells.link_cycles(spark, N)
    held = F.expr("aggregate(filter(array(s1, s2, s3, s4, s5), s -> s >= 0), 0L, (m, s) -> m | shiftleft(1L, s))")
    needs = F.broadcast(cycles.withColumn("need", held))
    masks = symmetry.masks(items(spark, sf_dir).where("sq >= 0")).groupBy("mask").agg(F.count("*").alias("n"))
    use = masks.join(needs, F.expr("mask & need = need")).groupBy(*cycles.columns).agg(F.sum("n").alias("complexes"))
    return _counted(cycles, use, *cycles.columns)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symmetry.masks(complexes(spark, sf_dir)).select("cid", symmetry.canonical_label(F.col("mask"), N).alias("label"))


def _good_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = symmetry.masks(complexes(spark, sf_dir))
    held = m.where("cid % 2 = 0").select("mask").distinct()
    return dedup.insert_if_absent(m.where("cid % 2 = 1").groupBy("mask").agg(F.min("cid").alias("cid")), held, "mask")


def _blobs(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    n2 = cells.sizes(N)[2]
    return symmetry.masks(complexes(spark, sf_dir)).select("cid", F.hex(codecs.encode_column(codecs.fixed_column(F.col("mask"), n2), n2, form)).alias("blob"))


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks read from the form of tables of accepted surfaces."""
    n2 = cells.sizes(N)[2]
    surfaces = symmetry.masks(complexes(spark, sf_dir)).select("cid", codecs.encode_column(codecs.fixed_column(F.col("mask"), n2), n2, "surface").alias("cplx"))
    return surfaces.select("cid", F.conv(F.hex(codecs.decode_column(F.col("cplx"), n2, "surface")), 16, 10).cast("long").alias("mask"))


def _lists(spark: SparkSession, sf_dir: str, f) -> DataFrame:
    """A function of the line quantities of each order, in order of line numbers, as text."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").cast("long").alias("cid"), "l_linenumber", "l_partkey", (F.col("l_partkey") % 5).cast("int").alias("v"))
    each = items.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "v"))).alias("x"))
    return each.select("cid", F.array_join(f(F.col("x.v")).cast("array<string>"), ",").alias("out"))


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours' ranks around each vertex as one octal number."""
    ranks = topology.neighbor_ranks(complexes(spark, sf_dir), N)
    digits = F.transform(F.array_sort(F.collect_list(F.struct("coord", "rank"))), lambda p: p["rank"].cast("long"))
    return ranks.groupBy("cid", "vertex").agg(digits.alias("d")).select("cid", "vertex", codecs.octal_pattern(F.col("d")).alias("pattern"))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a level, numbered in the order of their parents and squares."""
    return numbering.running_numbers(topology.extend_closed(complexes(spark, sf_dir), N), ["cid", "sq"])


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted complexes in buckets: two staged parts, of which the second is merged twice."""
    m = symmetry.masks(complexes(spark, sf_dir)).select(F.col("mask").alias("label"), F.col("cid").alias("id"))
    store = good_store.GoodStore(spark, f"goods_{uuid.uuid4().hex[:12]}")
    first, second = store.stage(m.where("id % 2 = 0")), store.stage(m.where("id % 3 = 0"))
    added = [store.merge(first), store.merge(second), store.merge(first, second)]
    return store.read().select("label", "id", *[F.lit(x).cast("long").alias(f"added_{k}") for k, x in enumerate(added)])


def _wide(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Masks as wide numbers: a, b = a shifted left by cid mod the width, their sum, difference and order, a shifted right, its trailing zeros."""
    p, width = lanes.packing(n), cells.sizes(n)[2]
    a, by = [F.col(x) for x in p.m], (F.col("cid") % width).cast("int")
    m = lanes.gathered(complexes(spark, sf_dir, n), n).select("cid", *p.m, *[x.alias(f"b{k}") for k, x in enumerate(wide.shift_left(a, by, width))])
    b = [F.col(f"b{k}") for k in range(len(a))]
    out = {"b": b, "right": wide.shift_right(a, by), "total": wide.add(a, b, width), "less": wide.subtract(a, b, width)}
    return m.select("cid", *[wide.digits(x).alias(c) for c, x in out.items()], wide.compare(a, b).alias("sign"), wide.trailing_zeros(a, width).alias("zeros"))


def _unranked(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Squares of the complexes, from their ranks."""
    n2 = cells.sizes(n)[2]
    return wide.combinadic_squares(wide.combinadic_ranks(complexes(spark, sf_dir, n), n2), n2)


def _ranks(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    n2 = cells.sizes(n)[2]
    limbs = [F.col(f"r{k}") for k in range(wide.rank_limbs(n2))]
    return wide.combinadic_ranks(complexes(spark, sf_dir, n), n2).select("cid", "k", wide.digits(limbs, wide.RANK_BITS).alias("rank"))


def _on(f, n: int = N):
    return lambda spark, sf_dir: f(complexes(spark, sf_dir, n), n)


QUERIES = {
    "cells": _cells,
    "square_edges": lambda s, d: _counted(cells.square_edges(s, N), _uses(s, d), "sq"),
    "square_vertices": lambda s, d: _counted(cells.square_vertices(s, N), _uses(s, d), "sq"),
    "edge_squares": _edge_squares,
    "vertex_neighbors": _vertex_neighbors,
    "link_cycles": _link_cycles,
    "group_action": lambda s, d: _counted(cells.group_action(s, N).groupBy("sq", "sq_image").agg(F.count("*").alias("symmetries")), _uses(s, d), "sq"),
    "keyset_page": lambda s, d: dedup.page(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_custkey").cast("long").alias("cplx")), "id", 1000, 500),
    "merge_shards": lambda s, d: dedup.merge_shards([complexes(s, d).where(dedup.shard_of("cid", 4) == k).groupBy("cid").agg(F.count("*").alias("squares")) for k in range(4)], "cid"),
    "complex_mask": lambda s, d: symmetry.masks(complexes(s, d)),
    "mask_explode": lambda s, d: symmetry.squares_of(symmetry.masks(complexes(s, d)), N),
    "popcount": lambda s, d: symmetry.masks(complexes(s, d)).select("cid", F.bit_count("mask").alias("squares")),
    "edge_test": _on(topology.edge_test, 3),
    "edge_test_n4": _on(topology.edge_test),
    "free_edges": _on(topology.free_edges),
    "saturated_edges": _on(topology.saturated_edges),
    "coverage_histogram": _on(topology.coverage_histogram),
    "coverage_prune": lambda s, d: topology.coverage_prune(complexes(s, d), N, 8),
    "lookahead_depth1": _on(topology.lookahead),
    "vertex_codes": _on(topology.vertex_codes),
    "link_class": _on(topology.link_class),
    "priority_edges": _on(topology.priority_edges),
    "extend_closed": _on(topology.extend_closed),
    "extend_any": _on(topology.extend_any),
    "extend_boundary": _on(topology.extend_boundary),
    "extend_disconnected": _on(topology.extend_disconnected, 3),
    "keep_rules": _on(topology.keep_rules, 3),
    "vertex_signature": _on(topology.vertex_signatures),
    "neighbor_ranks": _on(topology.neighbor_ranks),
    "refined_ranks": _on(topology.refined_ranks),
    "canonical_label": _labels,
    "orbit_sizes": lambda s, d: symmetry.orbit_sizes(symmetry.masks(complexes(s, d)), N),
    "keep_first": lambda s, d: dedup.keep_first(candidates(s, d), "label", "id"),
    "keep_first_self": lambda s, d: candidates(s, d).groupBy("cplx").agg(F.min("id").alias("id")),
    "insert_if_absent": _good_insert,
    "shard_counts": lambda s, d: complexes(s, d).select("cid").distinct().groupBy(dedup.shard_of("cid", 16).alias("shard")).agg(F.count("*").alias("rows")),
    "good_count": lambda s, d: symmetry.masks(complexes(s, d, 3)).where("mask = 63").agg(F.count("*").alias("goods")),
    "sparse_blob": lambda s, d: _blobs(s, d, "sparse"),
    "combinadic_blob": lambda s, d: _blobs(s, d, "combinadic"),
    "surface_decode": _decoded,
    "limb_popcount_n5": lambda s, d: topology.states(complexes(s, d, 5), 5).select("cid", F.expr("aggregate(limbs, 0, (a, x) -> a + bit_count(x))").alias("squares")),
    "extend_closed_n5": _on(topology.extend_closed, 5),
    "stable_order": lambda s, d: _lists(s, d, codecs.stable_order),
    "run_lengths": lambda s, d: _lists(s, d, codecs.run_lengths),
    "spread_octal": lambda s, d: complexes(s, d).select("sq").distinct().select("sq", codecs.spread_octal(F.col("sq")).alias("octal")),
    "octal_pattern": lambda s, d: _patterns(s, d),
    "combinadic_rank": lambda s, d: codecs.combinadic_rank(complexes(s, d)),
    "boundary_mod2": _on(topology.boundary),
    "boundary_mod2_n5": _on(topology.boundary, 5),
    "touched_edges": _on(topology.touched_edges),
    "link_class_n6": _on(topology.link_class, 6),
    "numbered_candidates": _numbered,
    "merged_goods": _merged,
    "wide_arithmetic_n5": lambda s, d: _wide(s, d, 5),
    "wide_arithmetic_n6": lambda s, d: _wide(s, d, 6),
    **{f"wide_rank_n{n}": partial(_ranks, n=n) for n in (4, 5, 6)},
    **{f"unrank_n{n}": partial(_unranked, n=n) for n in (4, 5, 6)},
    "restricted_label": _on(symmetry.restricted_labels),
    "restricted_label_n5": _on(symmetry.restricted_labels, 5),
    **{f"level_{name}{'_n3' * (n == 3)}": _on(partial(search.level_step, mode=mode), n) for name, mode in (("closed", ""), ("disconnected", "d"), ("boundary", "b"), ("any", "db")) for n in (3, 4)},
    "lookahead_depth2": _on(partial(search.lookahead, max_squares=8, depth=2)),
    "lookahead_depth4": _on(partial(search.lookahead, max_squares=8, depth=4)),
    "lookahead_depth2_n3": _on(partial(search.lookahead, max_squares=6, depth=2), 3),
    "lookahead_depth4_n3": _on(partial(search.lookahead, max_squares=6, depth=4), 3),
    "enumerate_closed_n3": lambda s, d: _surfaces(s, d, 3, ""),
    "enumerate_closed_n4": lambda s, d: _surfaces(s, d, 4, ""),
    "enumerate_disconnected_n4": lambda s, d: _surfaces(s, d, 4, "d"),
    "enumerate_boundary_n3": lambda s, d: _surfaces(s, d, 3, "b"),
    "log_runs": lambda s, d: profile.runs(log_lines(s, d)),
    "log_levels": lambda s, d: profile.levels(log_lines(s, d)),
    "log_compare": lambda s, d: profile.compare(log_lines(s, d), 1, 2),
    "log_canon": lambda s, d: profile.canon_levels(log_lines(s, d)),
    "log_compare_all": lambda s, d: profile.compare_all(log_lines(s, d), 1, 2),
    "log_previous": lambda s, d: profile.compare_previous(log_lines(s, d)),
    "log_storage": lambda s, d: profile.storage(storage_lines(s, d)),
    "pct_delta": lambda s, d: profile.compare(log_lines(s, d), 1, 2, 0).select("level", "delta"),
}
