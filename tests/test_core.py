import os

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hypersurf.functions import codecs
from hypersurf.operators import cells
from hypersurf.plans import enumerate as en
from hypersurf.plans import profile, registry
from hypersurf.sources import sqlite_store

DATA = "/root/testdata/sf0.001"
NAMES = sorted(registry.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        db.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = db.sql(f"select {', '.join(f'"{c}"' for c in columns)} from ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(map(tuple, want), key=str)


def test_every_query_has_sql():
    assert registry.QUERIES.keys() == registry.ORACLES.keys()


@pytest.mark.parametrize(("n", "mode", "count"), [(3, "", 1), (3, "d", 1), (3, "b", 8), (3, "db", 9)])
def test_golden_counts(spark, n, mode, count):
    goods, _ = en.enumerate_surfaces(spark, en.Options(n, mode))
    assert goods.count() == count


def _locally(o: en.Options) -> set[int]:
    frontier, goods = {1}, set()
    while frontier:
        made = {label: (a, b) for m in frontier for label, a, b in en.children(o, m)}
        frontier, goods = {k for k, (a, _) in made.items() if a}, goods | {k for k, (_, b) in made.items() if b}
    return goods


def test_prunes_lose_no_surface():
    full = _locally(en.Options(4))
    assert sorted(m.bit_count() for m in full) == [6, 10, 12, 12, 14, 14, 16]
    bare = en.Options(4, coverage_prune=False, edge_prune=False)
    assert full == _locally(bare) == _locally(en.Options(4, lookahead=1)) == _locally(en.Options(4, max_squares=16, lookahead=3))
    assert _locally(en.Options(4, max_squares=12)) == {m for m in full if m.bit_count() <= 12}
    seeds = _locally(en.Options(3, labels="none"))
    assert seeds == {63}


def test_five_dimensions_up_to_sixteen_squares():
    from collections import Counter

    found = _locally(en.Options(5, max_squares=16, lookahead=1))
    assert Counter(m.bit_count() for m in found) == {6: 1, 10: 1, 12: 2, 14: 4, 16: 5}


def test_look_ahead_beyond_its_budget_is_an_error():
    c = en.cube(4)
    parent = en.Complex(c, 1)
    with pytest.raises(RuntimeError, match="lookahead_nodes"):
        parent.extensions(en.Options(4, max_squares=6, lookahead=4, lookahead_nodes=2), dict.fromkeys(en.COUNTS, 0))
    assert parent.extensions(en.Options(4, max_squares=6, lookahead=3, lookahead_nodes=2), dict.fromkeys(en.COUNTS, 0))
    counts = dict.fromkeys(en.COUNTS, 0)
    assert parent.extensions(en.Options(4, max_squares=4), counts) == [] and counts["prune_global_coverage"] + counts["prune_edge_neighborhood"] == 1


def test_options_of_the_environment():
    o = en.Options.from_env(5, "d", {"MAX_SQUARES": " 42 ", "GLOBAL_COVERAGE_PRUNE": "off", "EDGE_NEIGHBORHOOD_LOOKAHEAD": "0", "CHECK_VERTEX_LINKS": "No", "TEST_UP_TO": "x"})
    assert (o.max_squares, o.coverage_prune, o.edge_prune, o.lookahead, o.check_links, o.stop_level, o.cap) == (42, False, True, 4, False, None, 42)
    old = en.Options.from_env(6, "", {"RUN35_COMPAT": "1", "MAX_SQUARES": "42"})
    assert (old.max_squares, old.lookahead, old.cap) == (36, 1, 36)
    assert en.Options(3, "b", max_squares=2).cap == 6 and en.env_flag("maybe", True)


def test_metrics_resume_and_log(spark, tmp_path):
    path, o = str(tmp_path / "levels"), en.Options(3, stop_level=4)
    _, first = en.enumerate_surfaces(spark, o, path)
    assert [m["level"] for m in first] == [2, 3, 4] and all(m["generated"] >= m["frontier"] >= 1 and m["canon_calls"] == m["generated"] for m in first)
    with pytest.raises(Exception, match="(?i)exists"):
        en.enumerate_surfaces(spark, o, path)
    goods, rest = en.enumerate_surfaces(spark, en.Options(3), path, resume=True)
    assert goods.count() == 1 and [m["frontier"] for m in rest[:3]] == [m["frontier"] for m in first]
    assert en.metrics_frame(spark, rest).count() == len(rest)
    assert [r.value for r in en.surface_cells(goods, 3).collect()] == ["022 122 202 212 220 221"]
    log = str(tmp_path / "run.log")
    for label in ("a", "b", "a"):
        en.append_log(log, en.log_lines(en.Options(3), rest, label))
    lines = profile.read_log(spark, log)
    assert [(r.run, r.label, r.n, r.ended) for r in profile.runs(lines).orderBy("run").collect()] == [(1, "a", 3, True), (2, "b", 3, True), (3, "a", 3, True)]
    made = {(r.run, r.level): r for r in profile.levels(lines).collect()}
    assert all(made[k, m["level"]].generated == m["generated"] and made[k, m["level"]].proc_ms == m["ms"] for k in (1, 2, 3) for m in rest)
    assert {r.level: r.canon_tau_trials for r in profile.canon_levels(lines).where("run = 2").collect()} == {m["level"]: m["canon_tau_trials"] for m in rest}
    assert {r.level: r.peak_bytes for r in profile.storage(lines).where("run = 2").collect()} == {m["level"]: m["held_bytes"] for m in rest}
    stored = {m["level"]: sum(f.stat().st_size for f in (tmp_path / "levels" / f"level={m['level']}").iterdir() if not f.name.endswith(".crc")) for m in rest}
    assert all(m["level_bytes"] >= stored[m["level"]] > 0 and m["held_bytes"] >= m["level_bytes"] + m["source_bytes"] and m["count_ms"] <= m["ms"] for m in rest)
    assert {(r.record, r["count"]) for r in profile.parse(lines).groupBy("record").count().collect()} >= {(x, 3 * len(rest)) for x in ("chunk", "commit", "finalize", "size", "peak", "prune", "canon")}


def test_last_level_stores_accepted_only(spark, tmp_path):
    rows = [(b"a", True, True, None), (b"b", True, False, None), (b"c", True, False, None), (b"d", False, True, None), (b"", False, False, [1] * len(en.COUNTS))]
    got = en.without_frontier(spark.createDataFrame(rows, en.SCHEMA))
    assert {(r.label if r.label is None else bytes(r.label), r.labeled, r.good, r.unstored) for r in got.collect()} == {(None, False, False, 2), (b"", False, False, None), (b"a", True, True, None), (b"d", False, True, None)}
    assert got.agg(F.max("counts")).first()[0] == [1] * len(en.COUNTS) and en.without_frontier(spark.createDataFrame([], en.SCHEMA)).count() == 0
    # A run to the cap, and the same run made of a stop before it and a resume, count the same frontiers.
    o = en.Options(4, "d", max_squares=7)
    _, whole = en.enumerate_surfaces(spark, o, str(tmp_path / "whole"))
    en.enumerate_surfaces(spark, en.Options(4, "d", max_squares=7, stop_level=6), str(tmp_path / "parts"))
    goods, parts = en.enumerate_surfaces(spark, o, str(tmp_path / "parts"), resume=True)
    again, kept = en.enumerate_surfaces(spark, o, str(tmp_path / "parts"), resume=True)
    assert [[(m["level"], m["frontier"], m["good"]) for m in run] for run in (whole, kept)] == [[(m["level"], m["frontier"], m["good"]) for m in parts]] * 2
    assert sorted(goods.collect()) == sorted(again.collect()) and whole[-1]["level"] == 7


def test_labels_are_invariant():
    from hypersurf.operators.symmetry import images

    c, at = en.cube(4), images(4)
    mask = sum(1 << s for s in (0, 3, 7, 11))
    label = lambda m: (x := en.Complex(c, m)).label(x.vertex_codes())
    for g in range(0, len(at), 29):
        assert label(sum(1 << int(at[g, s]) for s in (0, 3, 7, 11))) == label(mask)


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([24, 80, 240, 672]), st.data())
def test_codecs_round_trip(n2, data):
    value = sum(1 << i for i in data.draw(st.sets(st.integers(0, n2 - 1), min_size=1, max_size=60)))
    assert codecs.from_fixed(codecs.to_fixed(value, n2)) == value == codecs.from_fixed(codecs.to_plain(value, n2))
    assert codecs.from_combinadic(codecs.to_combinadic(value)) == value
    assert codecs.from_sparse(codecs.to_sparse(value, n2), n2) == value
    assert codecs.decode(codecs.to_adaptive(value, n2), n2) == value
    assert codecs.decode_surface(codecs.encode_surface(value, n2), n2) == value
    assert codecs.decode(codecs.encode_frontier(value, n2), n2) == value
    assert codecs.decode(bytes([codecs.FALLBACK]) + codecs.encode_surface(value, n2), n2) == value
    assert codecs.merge_limbs(codecs.split_limbs(value, 60, 12), 60) == value


def test_bytes_of_the_forms():
    v = 1 << 0 | 1 << 3 | 1 << 77  # bytes 0 and 9, of values 0x09 and 0x20
    assert codecs.to_sparse(v, 240).hex() == "a1" + "01020000" + "0920"
    assert codecs.to_gaps(v).hex() == "310a" + "00000201"  # set bits 0, 3 and 13 of the two bytes: distances 1, 3, 10
    assert codecs.to_combinadic(0b1011).hex() == "a30301" + "01"  # C(0, 1) + C(1, 2) + C(3, 3)
    assert codecs.to_combinadic(0b111).hex() == "a30300" and codecs.from_combinadic(bytes.fromhex("a30300")) == 0b111
    assert codecs.to_listed(v, 672).hex() == "0920" + "0102" + "00" * 9
    assert codecs.to_sparse(v, 672).hex() == "a1" + "0102" + "00" * 9 + "0920"
    assert codecs.to_adaptive((1 << 240) - 1, 240) == b"\xa2\0\0" + b"\xff" * 30 and len(codecs.to_adaptive((1 << 672) - 1, 672)) == 85
    assert codecs.from_gaps(b"\0\0\1") == codecs.from_gaps(bytes.fromhex("0100000001")) == 1 and codecs.decode(b"", 24) == 0
    with pytest.raises(ValueError):
        codecs.to_gaps((1 << 65) - 1)
    assert codecs.read_or_none(b"\xa3\1", 240, "any") is None and codecs.read_or_none(None, 24, "any") is None


def test_wide_complexes_in_columns(spark):
    import random

    from hypersurf.operators import topology

    r = random.Random(4)
    for n in (5, 6, 7):
        c, n2, rows = en.cube(n), cells.sizes(n)[2], {}
        for cid in range(25):
            mask = 1 << r.randrange(n2)
            for _ in range(r.randrange(12)):
                x = en.Complex(c, mask)
                mask |= 1 << r.choice([s for e in x.free for s in c.squares_on[e]] or [0])
            rows[cid] = mask
        df = spark.createDataFrame([(k, s) for k, m in rows.items() for s in codecs.positions(m)], "cid long, sq int")
        each = {k: en.Complex(c, m) for k, m in rows.items()}
        got = {x.cid: codecs.from_fixed(x.f) for x in topology.states(df, n).select("cid", codecs.limbs_fixed(F.col("limbs"), n2).alias("f")).collect()}
        assert got == rows
        back = topology.states(df, n).select("cid", "limbs", codecs.limb_array(codecs.limbs_fixed(F.col("limbs"), n2), n2).alias("b"))
        assert back.where("b <> limbs").count() == 0
        assert {(x.cid, x.edge) for x in topology.free_edges(df, n).collect()} == {(k, e) for k, x in each.items() for e in x.free}
        assert {(x.cid, x.vertex, x.code) for x in topology.vertex_codes(df, n).collect()} == {(k, v, code) for k, x in each.items() for v, code in x.vertex_codes().items()}
        assert {(x.cid, x.edge) for x in topology.priority_edges(df, n).collect()} == {(k, e) for k, x in each.items() for e in x.priority()}
        o = en.Options(n, coverage_prune=False, edge_prune=False)
        assert {(x.cid, x.sq) for x in topology.extend_closed(df, n).collect()} == {(k, s) for k, x in each.items() for s in x.extensions(o, {})}
        assert {x.cid: (x.bad, x.hopeless) for x in topology.link_class(df, n).collect()} == {k: x.links(x.vertex_codes()) for k, x in each.items()}


def test_five_cycles_at_a_vertex_of_the_7_cube(spark):
    from hypersurf.operators import topology

    c = en.cube(7)
    five = c.cycles[0][5][0]
    more = [s for s in c.squares_at[0] if not five >> s & 1]
    # A cycle of five and two arcs more: six or seven edges at the vertex.
    rows = {k: five | 1 << more[k] | 1 << more[-1 - k] for k in range(6)}
    df = spark.createDataFrame([(k, s) for k, m in rows.items() for s in codecs.positions(m)], "cid long, sq int")
    want = {k: en.Complex(c, m).links(en.Complex(c, m).vertex_codes()) for k, m in rows.items()}
    assert {x.cid: (x.bad, x.hopeless) for x in topology.link_class(df, 7).collect()} == want and any(h for _, h in want.values())


@pytest.mark.parametrize(("operator", "most"), [("rank", 24), ("mask", 63)])
def test_squares_outside_the_range_raise(spark, operator, most):
    from hypersurf.operators.symmetry import masks

    run = codecs.combinadic_rank if operator == "rank" else masks
    of = lambda *at: run(spark.createDataFrame([(1, s) for s in at], "cid long, sq int"))
    assert of(0, most - 1).first()[-1] == (most - 1) * (most - 2) // 2 if operator == "rank" else of(0, most - 1).first()[-1] == 1 | 1 << most - 1
    for bad in (most, -1):
        with pytest.raises(Exception, match="square outside"):
            of(0, bad).collect()


def test_change_in_percent(spark):
    rows = [(400, 449), (400, 335), (1000, 1001), (100_000, 99_999), (0, 5), (3, 3), (7, 100)]
    got = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a long, b long").select("k", profile.pct_delta(F.col("a"), F.col("b")).alias("x")).orderBy("k").collect()
    assert [r.x for r in got] == ["n/a" if a == 0 else f"{(b - a) * 100 / a:+.1f}%" for a, b in rows]


def test_bad_options():
    with pytest.raises(ValueError):
        en.Options(8)
    with pytest.raises(ValueError):
        en.Options(4, "x")
    assert cells.sizes(7) == (128, 448, 672)


def test_log_report(spark, tmp_path, capsys):
    lines = registry.log_lines(spark, DATA)
    assert profile.report(lines, min_level=0).count() > 0
    assert profile.runs(lines.limit(0)).count() == 0
    log = tmp_path / "x.log"
    log.write_bytes(b"before any run\n2024-01-01 00:00:00 level=30 commit_ms=5 chunks_in_tx=1\n" + b"".join(
        f"2024-01-01 00:00:0{k} run_start run_label=r{k % 2} n=5 dbprefix= chunksize=10 backend_bits=128 run_mode=Safe\n2024-01-01 00:00:09 level=30 chunk=1/2 read_ms=10 analyze_ms=20 reduce_ms=5 proc_ms={1000 * (k + 1)} generated=7 labeled_ins=3 good_ins=1\n"
        f"2024-01-01 00:00:09 level=30 commit_ms={500 * k} chunks_in_tx=1\n2024-01-01 00:00:09 level=30 prune_global_coverage=4 prune_edge_neighborhood=2\n2024-01-01 00:00:09 level=30 source_temp_db=1 est_live_before_finalize=70 est_live_after_finalize=90 est_live_peak=90\nbad \xff bytes\n".encode("latin-1") for k in range(3)))  # fmt: skip
    assert profile.main([str(log), "30"], spark) == 0
    out = capsys.readouterr().out
    assert "Run 3: 2024-01-01 00:00:02 label=r0 mode=Safe n=5" in out and "L30: chunks=1   total=   4.00s (proc=   3.00s, commit=   1.00s)" in out
    assert "Compare run 2 -> run 3 (levels >= 30)" in out and "total 2.50s -> 4.00s (+60.0%), commit 0.50s -> 1.00s (+100.0%)" in out
    assert profile.main([str(log), "31", "--label", "r0"], spark) == 0
    out = capsys.readouterr().out
    assert "no levels >= 31" in out and "Compare run 1 -> run 3" in out and "no overlapping levels in range" in out
    assert profile.main([str(log), "--label", "other"], spark) == 0 and capsys.readouterr().out == "no runs found\n"
    for bad in (["a", "b"], ["a", "1", "2"], ["--label"], [str(tmp_path / "none.log")]):
        assert profile.main(bad, spark) == 1 and capsys.readouterr().err
    assert [r.peak_bytes for r in profile.storage(profile.read_log(spark, str(log))).collect()] == [90] * 3
    (tmp_path / "logs").mkdir()
    for name in ("b", "a"):
        (tmp_path / "logs" / name).write_text(f"2024-01-01 00:00:00 run_start run_label={name}\n")
    assert [r.label for r in profile.runs(profile.read_log(spark, str(tmp_path / "logs"))).orderBy("run").collect()] == ["a", "b"]


def test_cell_store(spark, tmp_path):
    from hypersurf.sources import cell_store

    path = str(tmp_path / "cells")
    first = cell_store.read_cells(spark, 3, path)
    assert first["cells"].count() == 27 and first["square_edges"].count() == 24
    made = os.path.getmtime(f"{path}/about/_SUCCESS")
    cell_store.read_cells(spark, 3, path)
    assert os.path.getmtime(f"{path}/about/_SUCCESS") == made
    assert cell_store.read_cells(spark, 4, path)["cells"].count() == 81
    for f in os.listdir(f"{path}/about"):
        if f.endswith(".parquet"):
            with open(f"{path}/about/{f}", "wb") as out:
                out.write(b"broken")
            os.remove(f"{path}/about/.{f}.crc")
    assert cell_store.read_cells(spark, 4, path)["edge_vertices"].count() == 64


def test_sqlite_overwrite_replaces_all_files(spark, tmp_path):
    sqlite_store.register(spark)
    folder = str(tmp_path / "goods")
    write = lambda ids, parts: spark.createDataFrame([(i, bytes([0, i % 50 + 1, 7])) for i in ids], sqlite_store.SCHEMA).repartition(parts).write.format("sqlite_complexes").mode("overwrite").save(folder)
    write(range(20), 4)
    assert len(sqlite_store.files(folder)) == 4
    write([103, 53, 3], 1)
    read = lambda: [(r.id, bytes(r.cplx)) for r in spark.read.format("sqlite_complexes").option("path", folder).load().collect()]
    assert read() == [(3, bytes([0, 4, 7]))] and len(os.listdir(folder)) == 1
    with pytest.raises(Exception):  # noqa: B017
        spark.range(4).selectExpr("id", "if(id = 3, cast(raise_error('lost') as binary), cast(string(id) as binary)) as cplx").write.format("sqlite_complexes").mode("overwrite").save(folder)
    assert read() == [(3, bytes([0, 4, 7]))]


def test_resume_refuses_other_options(spark, tmp_path):
    path = str(tmp_path / "levels")
    en.enumerate_surfaces(spark, en.Options(3, "b"), path)
    with pytest.raises(ValueError, match="other options"):
        en.enumerate_surfaces(spark, en.Options(3), path, resume=True)
    with pytest.raises(ValueError, match="other options"):
        en.enumerate_surfaces(spark, en.Options(3, "b", check_links=False), path, resume=True)
    goods, metrics = en.enumerate_surfaces(spark, en.Options(3, "b", stop_level=3), path, resume=True)
    assert goods.agg(F.max("squares")).first()[0] == 3 and [m["level"] for m in metrics] == [2, 3]


def _random_complexes(n, count, most, seed=5):
    import random

    r, c, out = random.Random(seed), en.cube(n), {}
    for cid in range(count):
        mask = 1 << r.randrange(len(c.squares))
        for _ in range(r.randrange(most)):
            x = en.Complex(c, mask)
            near = x.near(x.free[:1]) or [s for s in range(len(c.squares)) if x.legal(s)]
            mask |= 1 << r.choice(near) if near else 0
        out[cid] = mask
    return out


def _long(spark, rows):
    return spark.createDataFrame([(k, s) for k, m in rows.items() for s in codecs.positions(m)], "cid long, sq int")


@pytest.mark.parametrize(("n", "most", "depth"), [(3, 6, 1), (3, 6, 3), (4, 9, 2), (4, 11, 4), (5, 14, 2)])
def test_look_ahead_equals_the_kernel(spark, n, most, depth):
    from hypersurf.operators import search

    rows = _random_complexes(n, 40, 8)
    each = {k: en.Complex(en.cube(n), m) for k, m in rows.items()}
    got = {r.cid: r.feasible for r in search.lookahead(_long(spark, rows), n, most, depth).collect()}
    assert got == {k: x.feasible(most - x.size, depth, None) for k, x in each.items() if x.free and x.size < most}
    if n == 4 and depth == 4:
        with pytest.raises(search.BudgetExceeded):
            search.lookahead(_long(spark, rows), n, most, depth, budget=1)


@pytest.mark.parametrize(("n", "mode"), [(3, "b"), (4, ""), (4, "d"), (5, ""), (6, "")])
def test_level_equals_the_kernel(spark, n, mode):
    from hypersurf.operators import lanes, search

    rows = _random_complexes(n, 25, 9)
    o = en.Options(n, mode, coverage_prune=False, edge_prune=False, labels="none")
    want = {k: sorted(en.children(o, m)) for k, m in rows.items()}
    s = lanes.packed(_long(spark, rows), n)
    kids = search.judged(search.children(s, n, mode), n, mode).collect()
    got = {k: sorted((sum(r[f"m{i}"] << 60 * i for i in range(len(lanes.packing(n).m))), r.labeled, r.good) for r in kids if r.cid == k) for k in rows}
    assert got == want
    if n <= 5:
        step = search.level_step(_long(spark, rows), n, mode).collect()
        labels = {en.Complex(en.cube(n), m).label(en.Complex(en.cube(n), m).vertex_codes()) for kids in want.values() for m, *_ in kids}
        assert len(step) == len(labels) and sum(r.children for r in step) == sum(map(len, want.values()))
        if n == 5:
            assert {r.l0 | r.l1 << 60 for r in step} == labels


def test_restricted_labels(spark):
    from hypersurf.operators import symmetry

    for n in (4, 5):
        rows = _random_complexes(n, 30, 9)
        each = {k: en.Complex(en.cube(n), m) for k, m in rows.items()}
        got = {r.cid: sum(r[f"l{i}"] << 60 * i for i in range(2 if n == 5 else 1)) for r in symmetry.restricted_labels(_long(spark, rows), n).collect()}
        assert got == {k: x.label(x.vertex_codes()) for k, x in each.items()}
    c = registry.complexes(spark, DATA)
    both = symmetry.restricted_labels(c, 4).join(symmetry.restricted_labels(c, 4, rounds=3).select("cid", F.col("l0").alias("by_rounds")), "cid")
    both = both.join(registry.QUERIES["canonical_label"](spark, DATA), "cid").select("label", "l0", "by_rounds").distinct()
    assert both.count() == both.select("label").distinct().count() == both.select("l0").distinct().count() == both.select("by_rounds").distinct().count()
    with pytest.raises(ValueError):
        symmetry.restricted_labels(c, 7)


def test_boundary_is_the_free_edges(spark):
    from hypersurf.operators import topology

    rows = _random_complexes(6, 20, 9)
    got = {r.cid: [i for k in range(4) for i in [60 * k + j for j in codecs.positions(r[f"b{k}"])]] for r in topology.boundary(_long(spark, rows), 6).collect()}
    assert got == {k: en.Complex(en.cube(6), m).free for k, m in rows.items()}


def test_plans_of_packed_counters(spark):
    from hypersurf.operators import lanes, topology

    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for n in (4, 5):
        for name in ("edge_test", "free_edges", "vertex_codes", "link_class", "extend_closed"):
            plan = text(getattr(topology, name)(registry.complexes(spark, DATA, n), n))
            assert "lambda" not in plan and plan.count("Exchange hashpartitioning") == 1
    size = {n: len(topology.link_class(registry.complexes(spark, DATA, n), n)._jdf.queryExecution().logical().toString()) / len(lanes.packing(n).limbs("v")) for n in (6, 7)}
    assert size[7] < 8 * size[6]  # by the cycles of one link, not by the cube's


def test_goods_in_buckets(spark):
    from hypersurf.sources.good_store import GoodStore

    store = GoodStore(spark, "goods_of_a_test", 4)
    try:
        df = lambda rows: spark.createDataFrame(rows, "label long, id long")
        first = store.stage(df([(5, 3), (5, 2), (7, 9)]))
        assert store.merge(first) == 2 and store.merge(first) == 0
        assert store.merge(first, store.stage(df([(7, 1), (8, 4), (8, 6)]))) == 1 and GoodStore(spark, "goods_of_a_test", 4).merge(first) == 0
        assert [tuple(r) for r in store.ordered().collect()] == [(5, 2), (8, 4), (7, 9)]
        plan = store.absent(spark.range(100).selectExpr("id as label", "id"))._jdf.queryExecution().executedPlan().toString()
        rows = plan.split("\n")
        target = rows[max(k for k, r in enumerate(rows) if r.strip().startswith(":")) + 1 :]
        assert any("Bucketed: true" in r for r in target) and not any("Exchange" in r for r in target)
    finally:
        store.drop()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, (1 << 130) - 1), st.integers(0, (1 << 130) - 1), st.integers(0, 200)), min_size=1, max_size=12))
def test_wide_arithmetic(spark, rows):
    from hypersurf.functions import wide

    width = 130
    limb = lambda x: [x >> 60 * k & (1 << 60) - 1 for k in range(3)]
    df = spark.createDataFrame([(k, *limb(a), *limb(b), by) for k, (a, b, by) in enumerate(rows)], "i int, a0 long, a1 long, a2 long, b0 long, b1 long, b2 long, s int")
    a, b, by = [F.col(f"a{k}") for k in range(3)], [F.col(f"b{k}") for k in range(3)], F.col("s")
    ops = {"add": wide.add(a, b, width), "sub": wide.subtract(a, b, width), "left": wide.shift_left(a, by, width), "right": wide.shift_right(a, by)}
    got = df.select("i", *[F.array(*x).alias(k) for k, x in ops.items()], wide.compare(a, b).alias("sign"), wide.trailing_zeros(a, width).alias("zeros"), wide.digits(a).alias("hex")).collect()
    wrap = (1 << width) - 1
    for r in got:
        x, y, n = rows[r.i]
        value = lambda c: sum(v << 60 * k for k, v in enumerate(r[c]))  # noqa: B023, E731
        assert (value("add"), value("sub"), value("left"), value("right")) == (x + y & wrap, x - y & wrap, x << n & wrap, x >> n)
        assert (r.sign, r.zeros, int(r.hex, 16)) == ((x > y) - (x < y), (x & -x).bit_length() - 1 if x else width, x)


def test_running_numbers(spark):
    from hypersurf.operators.numbering import running_numbers

    df = spark.range(1000).selectExpr("id % 7 as k", "id as v", "'x' as _at").repartition(5)
    got = running_numbers(df, [F.desc("k"), "v"], "nr", start=10).collect()
    assert [(r.nr, r.v) for r in sorted(got, key=lambda r: r.nr)] == list(enumerate((v for _, v in sorted(((i % 7, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))), 10))
    assert running_numbers(df.limit(0), ["v"]).count() == 0 and sorted(r.id for r in running_numbers(df.select(F.lit(1).alias("z")), ["z"]).collect()) == list(range(1, 1001))


def test_ranks_of_wide_sets(spark):
    from math import comb

    from hypersurf.functions import wide

    for n2 in (24, 80, 240):
        rows = {0: range(0, n2, 2), 1: range(n2 // 2, n2), 2: [n2 - 1], 3: [0], 4: range(n2)}
        df = spark.createDataFrame([(k, s) for k, xs in rows.items() for s in xs], "cid long, sq int")
        ranks = wide.combinadic_ranks(df, n2)
        got = {r.cid: sum(r[f"r{i}"] << wide.RANK_BITS * i for i in range(wide.rank_limbs(n2))) for r in ranks.collect()}
        assert got == {k: sum(comb(s, j) for j, s in enumerate(sorted(xs), 1)) for k, xs in rows.items()}
        assert sorted(map(tuple, wide.combinadic_squares(ranks, n2).collect())) == sorted((k, s) for k, xs in rows.items() for s in xs)


def test_sqlite_round_trip(spark, tmp_path):
    sqlite_store.register(spark)
    rows = [(1, b"\x00\x00\x09"), (2, b"\x80\x00\x01"), (3, b"\x00\x00\x09")]
    folder = str(tmp_path / "goods")
    df = spark.createDataFrame(rows, sqlite_store.SCHEMA).coalesce(1)
    df.write.format("sqlite_complexes").mode("append").save(folder)
    got = spark.read.format("sqlite_complexes").option("path", folder).load()
    assert sorted((r.id, bytes(r.cplx)) for r in got.collect()) == [(1, rows[0][1]), (2, rows[1][1])]
    formed = str(tmp_path / "formed")
    sqlite_store.split(df, 3).write.format("sqlite_complexes").option("squares", 24).mode("append").save(formed)
    assert len(sqlite_store.files(formed)) >= 2 and sqlite_store.files(f"{formed}/*.db") == sqlite_store.files(formed)
    read = spark.read.format("sqlite_complexes").option("path", formed)
    assert {bytes(r.cplx) for r in read.load().collect()} == {codecs.to_gaps(9), codecs.to_gaps(0x800001)}
    back = read.option("squares", 24).load()
    assert [(r.id, bytes(r.cplx)) for r in sqlite_store.merge(back).collect()] == [(1, rows[0][1]), (2, rows[1][1])]
    assert [r.id for r in sqlite_store.merge(back, spark.createDataFrame([(9, rows[0][1])], sqlite_store.SCHEMA)).collect()] == [2]
    with pytest.raises(Exception, match="none.db"):
        spark.read.format("sqlite_complexes").option("path", str(tmp_path / "none.db")).load().collect()


def test_unranking_joins_no_table_to_every_set(spark):
    import random

    from hypersurf.functions import wide

    r = random.Random(5)
    sets = {k: r.sample(range(240), n) for k, n in enumerate([1, 2, 7, 16, 17, 40, 120, 239, 240] + [3] * 500, 1)}
    ranks = wide.combinadic_ranks(spark.createDataFrame([(k, s) for k, xs in sets.items() for s in xs], "cid long, sq int"), 240)
    got = wide.combinadic_squares(ranks.localCheckpoint(), 240)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted((k, s) for k, xs in sets.items() for s in xs)


def test_link_cycles_shuffles_a_row_a_complex(spark):
    import re

    plan = registry.QUERIES["link_cycles"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    keys = re.findall(r"Aggregate \[([^]]*cid#[^]]*)\]", plan)
    assert keys and all(re.fullmatch(r"cid#\d+L", k) for k in keys)


@pytest.mark.parametrize("n2", [80, 240])
def test_ranks_of_more_squares_than_the_sql_holds(spark, n2):
    from math import comb

    from hypersurf.functions import wide

    xs = sorted({7 * k * k % n2 for k in range(200)} | set(range(1, n2, 9)))[:17]
    r = wide.combinadic_ranks(spark.createDataFrame([(1, s) for s in xs], "cid long, sq int"), n2).first()
    assert len(xs) == r.k == 17 and sum(r[f"r{i}"] << wide.RANK_BITS * i for i in range(wide.rank_limbs(n2))) == sum(comb(s, j) for j, s in enumerate(xs, 1))


def _counting(monkeypatch, module, name):
    """The numbers of rows of the frames that a function is called with."""
    plain, seen = getattr(module, name), []
    monkeypatch.setattr(module, name, lambda s, *a, **k: (seen.append(s.count()), plain(s, *a, **k))[1])
    return seen


def test_equal_complexes_are_labelled_once(spark, monkeypatch):
    from hypersurf.operators import symmetry

    seen = _counting(monkeypatch, symmetry, "restricted_labels_of")
    c = spark.createDataFrame([(k, s) for k in range(9) for s in ((0, 7), (3, 70), (5,))[k % 3]], "cid long, sq int")
    rows = {r.cid: tuple(r)[1:] for r in symmetry.restricted_labels(c, 5).collect()}
    assert seen == [3] and sorted(rows) == list(range(9)) and all(rows[k] == rows[k % 3] for k in range(9))


@pytest.mark.parametrize("n", [4, 5])
def test_equal_parents_are_extended_once(spark, monkeypatch, n):
    from hypersurf.operators import search

    seen = _counting(monkeypatch, search, "children")
    c = spark.createDataFrame([(k, s) for k in range(1, 7) for s in ((0, 7), (3, 11))[k % 2]], "cid long, sq int")
    mode = "db" if n == 4 else ""
    level = search.level_step(c, n, mode).collect()
    once = search.level_step(c.where("cid <= 2"), n, mode).collect()
    assert seen == [2, 2] and level and sorted((*r[:-2], r.children, r.parent) for r in level) == sorted((*r[:-2], 3 * r.children, r.parent) for r in once)
