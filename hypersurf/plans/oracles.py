"""SQL for DuckDB that states the registered queries independently of the DataFrame code."""

from __future__ import annotations

from itertools import permutations

from ..operators import topology


def _sizes(n: int) -> int:
    return n * (n - 1) * 2**n // 8


def dims(n: int) -> str:
    digits = ", ".join(f"(c // {3 ** (n - 1 - k)}) % 3 as d{k}" for k in range(n))
    dim = " + ".join(f"(d{k} = 2)::int" for k in range(n))
    cuts = " union all ".join(f"select c.dim, c.idx, f.idx as face from cel c join cel f on f.code = c.code - {(2 - b) * 3 ** (n - 1 - k)} where c.d{k} = 2" for k in range(n) for b in (0, 1))
    dirs = " + ".join(f"(d{k} = 2)::int * {1 << k}" for k in range(n))
    near = " union all ".join(f"select v.idx as vertex, {k} as coord, xor(v.idx, {1 << (n - 1 - k)}) as nbr from cel v where v.dim = 0" for k in range(n))
    return f"""dig as (select c as code, {digits} from range({3**n}) r(c)),
sized as (select *, {dim} as dim from dig),
cel as (select *, cast(row_number() over (partition by dim order by code) - 1 as integer) as idx from sized),
face as ({cuts}),
se as (select idx as sq, face as edge from face where dim = 2),
ev as (select idx as edge, face as vertex from face where dim = 1),
sv as (select distinct sq, vertex from se join ev using (edge)),
dirs as (select idx as sq, {dirs} as dirs from cel where dim = 2),
nb as ({near})"""


def cx(n: int, source: str = "") -> str:
    items = f"select distinct cast(l_orderkey as bigint) as cid, cast(l_partkey % {_sizes(n)} as integer) as sq from lineitem"
    return f"""cx as ({source or items}),
deg as (select cid, edge, count(*) as m from cx join se using (sq) group by cid, edge),
near_sq as (select cid, se.sq, max(m) as most, cast(count(*) filter (m = 1) as integer) as covers from deg join se on se.edge = deg.edge group by cid, se.sq),
legal as (select cid, sq, covers from near_sq where most = 1 and not exists (select 1 from cx where cx.cid = near_sq.cid and cx.sq = near_sq.sq)),
free as (select cid, edge from deg where m = 1),
every as (select cid, cast(s as integer) as sq from (select distinct cid from cx), range({_sizes(n)}) r(s)),
absent as (select * from every except select * from cx)"""


def _case(table: dict, key: str, default) -> str:
    return f"case {key} " + " ".join(f"when {k} then {v}" for k, v in table.items()) + f" else {default} end"


def verts(n: int) -> str:
    code = _case({e * 8 + s: k for (e, s), k in topology.codes(n).items()}, "edges * 8 + squares", topology.other(n))
    weight = _case(topology.WEIGHTS, "code", 0)
    return f"""used as (select distinct cid, edge from cx join se using (sq)),
ve as (select cid, vertex, cast(count(*) as integer) as edges from used join ev using (edge) group by cid, vertex),
vs as (select cid, vertex, cast(count(*) as integer) as squares from cx join sv using (sq) group by cid, vertex),
vc as (select cid, vertex, edges, squares, cast({code} as integer) as code from ve join vs using (cid, vertex)),
weighed as (select f.cid, f.edge, min({weight}) as w from free f join ev using (edge) join vc using (cid, vertex) group by f.cid, f.edge),
prio as (select cid, edge, cast(w as integer) as weight from (select *, min(w) over (partition by cid) as least from weighed) where w = least),
first_prio as (select cid, min(edge) as edge from prio group by cid)"""


def cycles(n: int) -> str:
    join = "select {cols} from ({tables}) where {order} and {parity}"
    out = []
    for k in range(3, 6 if n >= 7 else 5):
        tables = "select t1.vertex, " + ", ".join(f"t{i}.sq as s{i}, t{i}.dirs as x{i}" for i in range(1, k + 1)) + " from at_v t1 " + " ".join(f"join at_v t{i} on t{i}.vertex = t1.vertex and t{i}.sq > t{i - 1}.sq" for i in range(2, k + 1))
        parity = "x1"
        for i in range(2, k + 1):
            parity = f"xor({parity}, x{i})"
        out.append(join.format(cols=f"vertex, {k} as len, " + ", ".join(f"s{i}" if i <= k else f"-1 as s{i}" for i in range(1, 6)), tables=tables, order="true", parity=f"{parity} = 0"))
    return "at_v as (select * from sv join dirs using (sq)), cyc as (" + " union all ".join(out) + ")"


def links(n: int) -> str:
    has = lambda k: f"exists (select 1 from whole w where w.cid = vc.cid and w.vertex = vc.vertex and w.len = {k})"
    hopeless = f"code = {topology.other(n)} or (code in (8, 12, 13) and {has(3)}) or (code = 12 and {has(4)})"
    return f"""{cycles(n)},
whole as (select distinct cid, vertex, len from (
  select c.cid, y.vertex, y.len, y.s1, y.s2, y.s3, y.s4, count(*) as k from cx c join cyc y on c.sq in (y.s1, y.s2, y.s3, y.s4)
  group by all) where k = len),
lc as (select cid, bool_or(code in (4, 7, 10, 11)) as bad, bool_or({hopeless}) as hopeless from vc group by cid)"""


def group(n: int) -> str:
    place = lambda p, k: f"case when d{p[k]} = 2 then 2 else xor(d{p[k]}, (f >> {p[k]}) & 1) end * {3 ** (n - 1 - k)}"
    moved = " union all ".join(f"select {i} * {2**n} + f as g, idx as sq, " + " + ".join(place(p, k) for k in range(n)) + f" as code from cel, range({2**n}) r(f) where dim = 2" for i, p in enumerate(permutations(range(n))))
    return f"moved as ({moved}), ga as (select g, moved.sq, cel.idx as sq_image from moved join cel using (code))"


def label_of(source: str, n: int) -> str:
    """lab(mask, label, images) of the distinct masks of a relation."""
    return f"""ms as (select distinct mask from {source}),
img as (select mask, g, bit_or(1::bigint << sq_image) as image from ms join ga on (mask >> sq) & 1 = 1 group by mask, g),
lab as (select mask, min(image) as label, cast(count(distinct image) as integer) as images from img group by mask)"""


_EXTEND = {
    "": "select p.cid, l.sq from first_prio p join se using (edge) join legal l on l.cid = p.cid and l.sq = se.sq",
    "d": """select a.cid, a.sq from absent a join (select cid, min(edge) as edge from free group by cid) f using (cid) join se on se.edge = f.edge and se.sq = a.sq
  union all select cid, sq from absent where cid not in (select cid from free)""",
    "b": "select distinct a.cid, a.sq from absent a join se using (sq) join free f on f.cid = a.cid and f.edge = se.edge",
    "db": "select cid, sq from absent",
}
_KEPT = {"": ("ok and not hopeless and not closed", "ok and not hopeless and closed and not bad"), "d": ("ok and not hopeless", "ok and not hopeless and closed and not bad"), "b": ("ok and not hopeless", "ok and not hopeless and not bad")}


def level(n: int, mode: str) -> str:
    """The children of all complexes, tested and labelled as complexes of their own."""
    labeled, good = _KEPT["b" if "b" in mode else mode]
    return f"""with {dims(n)}, {cx(n)}, {verts(n)}, ext as ({_EXTEND[mode]}),
kid as (select row_number() over () as kid, cid, sq from ext),
kx as (select kid as cid, cx.sq from kid join cx using (cid) union all select kid, sq from kid),
tested as (with {cx(n, "select * from kx")}, {verts(n)}, {links(n)}, {TEST}, {MASKS} select cid as kid, mask, n_squares, {labeled} as labeled, {good} as good from et join lc using (cid) join mk using (cid)),
kept as (select * from tested where labeled or good), {group(n)}, {label_of("kept", n)}
select label, min(n_squares) as squares, bool_or(labeled) as labeled, bool_or(good) as good, count(*) as children, min(cid) as parent from kept join lab using (mask) join kid using (kid) group by label"""


def ahead(n: int, most: int, depth: int) -> str:
    """Look-ahead: level by level, the sets of squares reached from each complex."""
    n2, out = _sizes(n), []
    for k in range(1, depth + 1):
        done = f"{str(k == depth).lower()} or left0 = 1 or f + 4 - 2 * covers = 0"
        out.append(f"""l{k} as (with {cx(n, f"select node as cid, cast(q as integer) as sq from n{k}, range({n2}) r(q) where (mask >> q) & 1 = 1")}, {verts(n)},
  ranked as (select cid, sq, covers, row_number() over (partition by cid order by covers desc, sq) as j from legal),
  tops as (select cid, sq, covers, j, sum(covers) over (partition by cid order by j) as upto, max(j) over (partition by cid) as many from ranked),
  nf as (select cid, count(*) as f from free group by cid),
  mv as (select p.cid as node, t.sq, t.covers, t.j from first_prio p join se using (edge) join tops t on t.cid = p.cid and t.sq = se.sq),
  m0 as (select mv.*, o.cid, o.mask, o.left0, f from mv join n{k} o using (node) join nf on nf.cid = mv.node),
  m1 as (select m0.*, case when j > left0 - 1 then (select coalesce(max(upto), 0) from tops t where t.cid = m0.node and t.j <= m0.left0 - 1) else (select max(upto) from tops t where t.cid = m0.node and t.j <= m0.left0) - covers end as cap from m0)
  select cid, node, mask | (1::bigint << sq) as mask, left0 - 1 as left0, f - covers <= cap as fits, f - covers <= cap and ({done}) as success from m1),
f{k} as (select o.cid, coalesce(bool_or(success), false) as feasible, count(distinct o.node) as nodes from n{k} o left join l{k} using (cid) group by o.cid)""")
        if k < depth:
            out.append(f"n{k + 1} as (select row_number() over () as node, * from (select distinct cid, mask, left0 from l{k} where fits and cid not in (select cid from f{k} where feasible)))")
    found = " union all ".join(f"select * from f{k}" for k in range(1, depth + 1))
    return f"""with {dims(n)}, {cx(n)},
n1 as (select cid as node, cid, bit_or(1::bigint << sq) as mask, {most} - count(*) as left0 from cx where cid in (select cid from free) group by cid having count(*) < {most}),
{", ".join(out)}
select cid, bool_or(feasible) as feasible, cast(sum(nodes) as bigint) as nodes from ({found}) group by cid"""


def boundary_sum(n: int) -> str:
    limbs = -(-(n * 2 ** (n - 1)) // 60)
    parts = ", ".join(f"cast(coalesce(sum(1::bigint << cast(edge % 60 as integer)) filter (edge // 60 = {k}), 0) as bigint) as b{k}" for k in range(limbs))
    return f"with {dims(n)}, {cx(n)}, odd as (select cid, edge from deg where m % 2 = 1) select cid, {parts}, cast(count(edge) as integer) as edges from (select distinct cid from cx) left join odd using (cid) group by cid"


def wide_numbers(n: int) -> str:
    """Wide numbers as strings of bits, sums as columns of bits with a carry in 8 limbs of 30 bits a HUGEINT each."""
    n2 = _sizes(n)
    limbs = -(-n2 // 30)
    piece = lambda x, k: f"(('0b' || lpad(substring({x}, greatest({n2} - {30 * (k + 1)}, 0) + 1, least(30, {n2} - {30 * k})), 30, '0'))::bigint)"
    out, total, less = [], "0", "0"
    steps = []
    for k in range(limbs):
        top = (1 << min(30, n2 - 30 * k)) - 1
        before = f"step{k - 1}" if k else "bits2"
        steps.append(f"step{k} as (select *, a{k} + b{k} + {total} as t{k}, a{k} - b{k} + {less} as d{k} from {before})")
        total, less = f"(t{k} >> 30)", f"(case when d{k} < 0 then -1 else 0 end)"
        out.append((f"lpad(bin(t{k} & {top}), 30, '0')", f"lpad(bin((d{k} + {(1 << 30)}) & {top}), 30, '0')"))
    width = 60 * -(-n2 // 60)
    text = lambda x: f"(select string_agg(lower(hex(('0b' || substring(z, i * 60 + 1, 60))::bigint)).lpad(15, '0'), '' order by i) from (select lpad({x}, {width}, '0') as z), range({width // 60}) r(i))"
    joined = lambda j: " || ".join(x[j] for x in reversed(out))
    return f"""with {cx(n)[: cx(n).index(",\ndeg")]},
ones as (select q.cid, string_agg(case when sq is null then '0' else '1' end, '' order by p desc) as a, min(p) filter (sq is not null) as zeros from (select cid, cast(p as integer) as p from (select distinct cid from cx), range({n2}) r(p)) q left join cx on cx.cid = q.cid and cx.sq = q.p group by q.cid),
shifted as (select *, rpad(substring(a, cast(cid % {n2} as integer) + 1), {n2}, '0') as b, lpad(substring(a, 1, {n2} - cast(cid % {n2} as integer)), {n2}, '0') as r from ones),
bits2 as (select *, {", ".join(f"{piece(x, k)} as {x}{k}" for x in "ab" for k in range(limbs))} from shifted),
{", ".join(steps)}
select cid, {text("b")} as b, {text("r")} as "right", {text(joined(0))} as total, {text(joined(1))} as less, case when a < b then -1 when a > b then 1 else 0 end as sign, cast(zeros as integer) as zeros from step{limbs - 1}"""


def ranks(n: int) -> str:
    """Ranks as HUGEINT products, in hexadecimal."""
    n2 = _sizes(n)
    from math import comb

    size = 12 * -(-comb(n2, n2 // 2).bit_length() // 48)
    base = cx(n)[: cx(n).index(",\ndeg")]
    return f"""with recursive {base}, binom(s, j, c) as (select s, 0, 1::hugeint from range({n2}) r(s) union all select s, j + 1, c * (s - j) // (j + 1) from binom where j < 16),
nth as (select cid, sq, row_number() over (partition by cid order by sq) as j from cx),
total as (select cid, cast(count(*) as integer) as k, cast(sum(c) as hugeint) as r from nth join binom on s = sq and binom.j = nth.j group by cid)
select cid, k, right(repeat('0', {size}) || lower(printf('%x', cast(r >> 60 as bigint))) || lpad(lower(printf('%x', cast(r & {(1 << 60) - 1} as bigint))), 15, '0'), {size}) as rank from total"""


def counted(n: int, select: str, on: str, use: str) -> str:
    """A relation with the number of complexes that use each of its rows."""
    return f"with {dims(n)}, {cx(n)}, us as (select sq, count(*) as complexes from cx group by sq), rel as ({select}), use as ({use}) select rel.*, cast(coalesce(complexes, 0) as bigint) as complexes from rel left join use using ({on})"


def given(sql: str, n: int) -> str:
    """Surfaces (squares, label) with the number of complexes of each label."""
    return f"with own as (with {dims(n)}, {cx(n)}, {MASKS}, {group(n)}, {label_of('mk', n)} select label, count(*) as complexes from mk join lab using (mask) group by label), s as ({sql}) select s.*, coalesce(complexes, 0) as complexes from s left join own using (label)"


MASKS = "mk as (select cid, bit_or(1::bigint << sq) as mask from cx group by cid)"
TEST = "et as (select cid, cast(sum(m) / 4 as integer) as n_squares, max(m) <= 2 as ok, max(m) <= 2 and min(m) = 2 as closed from deg group by cid)"


def span(n: int) -> str:
    """cyc_masks: sums mod 2 of the boundaries of the 3-cells, other than 0."""
    return f"""cube3 as (select c.idx as cell, cast(c.idx as integer) as nth, bit_or(1::bigint << f.face) as b from cel c join face f on f.dim = 3 and f.idx = c.idx where c.dim = 3 group by c.idx),
sums as (select t, bit_xor(b) as mask from range(1, (1::bigint << (select count(*) from cube3))::bigint) r(t) join cube3 on (t >> nth) & 1 = 1 group by t),
cyc_masks as (select distinct mask from sums where mask <> 0)"""


def closed(n: int, connected: bool) -> str:
    whole = "where not exists (select 1 from cyc_masks y where y.mask <> x.mask and y.mask & x.mask = y.mask)" if connected else ""
    return f"with {dims(n)}, {span(n)}, kept as (select x.mask from cyc_masks x {whole}), {group(n)}, {label_of('kept', n)} select distinct cast(bit_count(label) as integer) as squares, label from lab"


def _log(e: str = "e") -> str:
    return f"""ev0 as (select cast(event_id as bigint) as e, cast(user_id % 48 as integer) as level from events),
starts as (select e as s, row_number() over (order by e) as run, lead(e, 1, 4611686018427387904) over (order by e) as after from ev0 where e % 500 = 0),
lines as (select ev0.*, run, s // 500 % 3 as lbl, case when e % 500 = 0 then 'run_start' when e % 500 = 499 then 'run_end' when e % 10 between 1 and 6 then 'chunk'
  when e % 10 = 7 then 'commit' when e % 10 = 8 then 'prune' when e % 10 = 9 then 'canon' end as record from ev0 join starts on e >= s and e < after),
lv as (select run, level, count(*) filter (record = 'chunk') as chunks,
  {", ".join(f"cast(coalesce(sum(e % {m}) filter (record = '{r}'), 0) as bigint) as {f}" for r, f, m in (("chunk", "read_ms", 17), ("chunk", "analyze_ms", 101), ("chunk", "reduce_ms", 13), ("chunk", "proc_ms", 131), ("chunk", "generated", 1009), ("chunk", "labeled_ins", 503), ("chunk", "good_ins", 7), ("commit", "commit_ms", 19), ("prune", "prune_global_coverage", 23), ("prune", "prune_edge_neighborhood", 29)))}
  from lines where record in ('chunk', 'commit', 'prune') group by run, level),
lvt as (select *, proc_ms + commit_ms as total_ms from lv)"""


_CMP = """cmp as (select a.level, a.total_ms as old_ms, b.total_ms as new_ms,
  case when a.total_ms = 0 then 'n/a' else printf('%+.1f%%', (b.total_ms - a.total_ms) * 100.0::double / a.total_ms) end as delta,
  a.generated as old_generated, b.generated as new_generated from lvt a join lvt b on a.level = b.level and a.run = 1 and b.run = 2)"""

_CMP_ALL = ", ".join(f"a.{c} as old_{x}, b.{c} as new_{x}" for c, x in (("total_ms", "ms"), ("commit_ms", "commit_ms"), ("read_ms", "read_ms"), ("reduce_ms", "reduce_ms"), ("prune_global_coverage", "prune_coverage"), ("prune_edge_neighborhood", "prune_edge"), ("generated", "generated")))
_DELTAS = ", ".join(f"case when a.{c} = 0 then 'n/a' else printf('%+.1f%%', (b.{c} - a.{c}) * 100.0::double / a.{c}) end as {x}" for c, x in (("total_ms", "delta"), ("commit_ms", "commit_delta"), ("read_ms", "read_delta"), ("reduce_ms", "reduce_delta")))
_LISTS = "ls as (select cast(l_orderkey as bigint) as cid, list(cast(l_partkey % 5 as integer) order by l_linenumber, l_partkey) as x from lineitem group by 1)"
_BYTES = [f"(mask >> {8 * k}) & 255" for k in range(3)]
_RANK = """(select cid, cast(count(*) as integer) as k, cast(sum(case when j > sq then 0 else (select round(exp(sum(ln(sq - i) - ln(i + 1)))) from range(j) r(i)) end) as bigint) as rank
 from (select cid, sq, row_number() over (partition by cid order by sq) as j from cx) group by cid)"""

_D4, _C4 = dims(4), f"{dims(4)}, {cx(4)}"
_C3 = f"{dims(3)}, {cx(3)}"
_V4 = f"{_C4}, {verts(4)}"
_AROUND = lambda x, v, n=4: "[" + ", ".join(f"{x}[xor({v}, {1 << (n - 1 - k)}) + 1]" for k in range(n)) + "]"
#: Lists by vertex, as neighbours of a vertex differ from it in one bit.
def _signatures(n: int) -> str:
    return f"""{dims(n)}, {cx(n)}, {verts(n)},
zero as (select p.cid, list(lpad(cast(coalesce(code, 0) as varchar), 2, '0') order by v) as z from (select cid, cast(v as integer) as v from (select distinct cid from cx), range({2**n}) r(v)) p left join vc on vc.cid = p.cid and vc.vertex = p.v group by p.cid),
one as (select cid, list_transform(range({2**n}), lambda v: z[v + 1] || ':' || array_to_string(list_sort({_AROUND("z", "v", n)}), ',')) as a from zero),
two as (select cid, a, list_transform(range({2**n}), lambda v: a[v + 1] || '|' || array_to_string(list_sort({_AROUND("a", "v", n)}), ';')) as b from one)"""


def restricted(n: int) -> str:
    """Least image under the symmetries that bring a vertex of least signature to the origin and order its neighbours' signatures."""
    perms = ", ".join(str((i, *p)) for i, p in enumerate(permutations(range(n))))
    at = lambda k: f"b[xor(v, 1 << ({n - 1} - p{k})) + 1]"
    flip = " + ".join(f"((v >> {n - 1 - k}) & 1) * {1 << k}" for k in range(n))
    limbs = ", ".join(f"cast((label >> {60 * k}) & {(1 << 60) - 1}::hugeint as bigint) as l{k}" for k in range(-(-_sizes(n) // 60)))
    return f"""with {_signatures(n)}, {group(n)}, perms(i, {", ".join(f"p{k}" for k in range(n))}) as (values {perms}),
adm as (select cid, v, i, i * {2**n} + {flip} as g from two, range({2**n}) r(v), perms where b[v + 1] = list_min(b) and {" and ".join(f"{at(k)} <= {at(k + 1)}" for k in range(n - 1))}),
img as (select cid, v, i, bit_or(1::hugeint << sq_image) as image from adm join cx using (cid) join ga using (g, sq) group by cid, v, i),
best as (select cid, min(image) as label, cast(count(distinct v) as integer) as roots, cast(count(*) as integer) as trials from img group by cid)
select cid, {limbs}, roots, trials from best"""


_SIG = _signatures(4)
_ROUNDS = "".join(f""",
sig{k} as (select cid, r, list_transform(range(16), lambda v: list_prepend(r[v + 1], list_sort({_AROUND("r", "v")}))) as s from rank{k - 1}),
rank{k} as (select cid, list_transform(s, lambda x: len(list_filter(list_distinct(s), lambda y: y < x))) as r from sig{k})""" for k in (1, 2, 3))
_CAND = "cand as (select cast(l_partkey % 1000 as bigint) as label, cast(l_orderkey as bigint) * 1024 + l_linenumber as id, cast(l_orderkey as bigint) * 31 + l_linenumber * 7 as cplx from lineitem)"

ORACLES = {
    "cells": counted(4, "select cast(dim as integer) as dim, idx, cast(code as bigint) as code from cel", "dim, idx", "select 2 as dim, sq as idx, complexes from us"),
    "square_edges": counted(4, "select sq, edge from se", "sq", "select * from us"),
    "square_vertices": counted(4, "select sq, vertex from sv", "sq", "select * from us"),
    "edge_squares": counted(4, "select edge, cast(count(*) as integer) as squares, min(sq) as first_sq, max(sq) as last_sq from se group by edge", "edge", "select edge, sum(complexes) as complexes from se join us using (sq) group by edge"),
    "vertex_neighbors": counted(4, "select vertex, coord, nbr from nb", "vertex", "select vertex, sum(complexes) as complexes from sv join us using (sq) group by vertex"),
    "link_cycles": f"""with {_D4}, {cx(4)}, {cycles(4)}, held as (select y.vertex, y.len, y.s1, y.s2, y.s3, y.s4, y.s5, c.cid, count(*) as k from cx c join cyc y on c.sq in (y.s1, y.s2, y.s3, y.s4, y.s5) group by all),
n as (select vertex, s1, s2, s3, s4, s5, count(*) as complexes from held where k = len group by all) select cyc.*, coalesce(complexes, 0) as complexes from cyc left join n using (vertex, s1, s2, s3, s4, s5)""",
    "group_action": counted(4, f"with {group(4)} select sq, sq_image, count(*) as symmetries from ga group by sq, sq_image", "sq", "select * from us"),
    "keyset_page": "select cast(o_orderkey as bigint) as id, cast(o_custkey as bigint) as cplx from orders where o_orderkey > 1000 order by o_orderkey limit 500",
    "merge_shards": f"with {_C4} select cid, count(*) as squares from cx group by cid",
    "complex_mask": f"with {_C4}, {MASKS} select cid, mask from mk",
    "mask_explode": f"with {_C4} select cid, sq from cx",
    "popcount": f"with {_C4} select cid, cast(count(*) as integer) as squares from cx group by cid",
    "edge_test": f"with {_C3}, {TEST} select * from et",
    "edge_test_n4": f"with {_C4}, {TEST} select * from et",
    "free_edges": f"with {_C4} select cid, edge from free",
    "saturated_edges": f"with {_C4} select cid, edge from deg where m = 2",
    "coverage_histogram": f"with {_C4} select cid, " + ", ".join(f"cast(count(*) filter (covers = {k}) as integer) as b{k}" for k in range(1, 5)) + " from (select distinct cid from cx) left join legal using (cid) group by cid",
    "coverage_prune": f"""with {_C4}, ranked as (select cid, covers, row_number() over (partition by cid order by covers desc) as nth from legal),
ns as (select cid, cast(count(*) as integer) as n_squares from cx group by cid), nf as (select cid, cast(count(*) as integer) as free from free group by cid),
best as (select ns.cid, n_squares, coalesce(free, 0) as free, cast(coalesce((select sum(covers) from ranked r where r.cid = ns.cid and r.nth <= 8 - n_squares), 0) as integer) as cap from ns left join nf using (cid))
select cid, n_squares, free, cap, n_squares < 8 and free <= 4 * greatest(0, 8 - n_squares) and cap >= free as keep from best""",
    "lookahead_depth1": f"with {_V4} select p.cid, cast(count(l.sq) as integer) as moves, count(l.sq) > 0 as feasible from first_prio p join se using (edge) left join legal l on l.cid = p.cid and l.sq = se.sq group by p.cid",
    "vertex_codes": f"with {_V4} select * from vc",
    "link_class": f"with {_V4}, {links(4)} select * from lc",
    "priority_edges": f"with {_V4} select cid, edge, weight from prio",
    "extend_closed": f"with {_V4} select p.cid, l.sq from first_prio p join se using (edge) join legal l on l.cid = p.cid and l.sq = se.sq",
    "extend_any": f"with {_C4} select cid, sq from absent",
    "extend_boundary": f"with {_C4} select distinct a.cid, a.sq from absent a join se using (sq) join free f on f.cid = a.cid and f.edge = se.edge",
    "extend_disconnected": f"""with {_C3}, ff as (select cid, min(edge) as edge from free group by cid)
select a.cid, a.sq from absent a join ff using (cid) join se on se.edge = ff.edge and se.sq = a.sq
union all select cid, sq from absent where cid not in (select cid from ff)""",
    "keep_rules": f"""with {_C3}, {verts(3)}, {links(3)}, {TEST}, b as (select *, ok and not hopeless as alive from et join lc using (cid))
select cid, 'closed' as mode, alive and not closed as keep_labeled, alive and closed and not bad as keep_good from b
union all select cid, 'closed_disconnected', alive, alive and closed and not bad from b union all select cid, 'boundary', alive, alive and not bad from b""",
    "vertex_signature": f"with {_SIG} select cid, cast(v as integer) as vertex, a[v + 1] as sig1, b[v + 1] as sig2 from two, range(16) r(v)",
    "neighbor_ranks": f"with {_SIG} select cid, vertex, coord, cast(len(list_filter(list_distinct({_AROUND("b", "vertex")}), lambda y: y < b[nbr + 1])) as integer) as rank from two, nb",
    "refined_ranks": f"""with {_V4}, rank0 as (select p.cid, list(coalesce(code, 0) order by v) as r from (select cid, cast(v as integer) as v from (select distinct cid from cx), range(16) x(v)) p left join vc on vc.cid = p.cid and vc.vertex = p.v group by p.cid){_ROUNDS}
select cid, cast(v as integer) as vertex, cast(r[v + 1] as integer) as rank from rank3, range(16) x(v)""",
    "canonical_label": f"with {_C4}, {MASKS}, {group(4)}, {label_of('mk', 4)} select cid, label from mk join lab using (mask)",
    "orbit_sizes": f"with {_C4}, {MASKS}, {group(4)}, {label_of('mk', 4)} select distinct label, images as orbit_size from lab",
    "keep_first": f"with {_CAND} select label, min(id) as id, arg_min(cplx, id) as cplx from cand group by label",
    "keep_first_self": f"with {_CAND} select cplx, min(id) as id from cand group by cplx",
    "insert_if_absent": f"with {_C4}, {MASKS} select mask, min(cid) as cid from mk where cid % 2 = 1 and mask not in (select mask from mk where cid % 2 = 0) group by mask",
    "shard_counts": "select cast(cid % 16 as integer) as shard, count(*) as rows from (select distinct l_orderkey as cid from lineitem) group by 1",
    "good_count": f"with {_C3}, {MASKS} select count(*) as goods from mk where mask = 63",
    "sparse_blob": f"with {_C4}, {MASKS} select cid, 'A1' || printf('%02X', " + " + ".join(f"case when {b} <> 0 then {1 << k} else 0 end" for k, b in enumerate(_BYTES)) + ") || '000000' || " + " || ".join(f"case when {b} <> 0 then printf('%02X', {b}) else '' end" for b in _BYTES) + " as blob from mk",
    "combinadic_blob": f"with {_C4}, rk as {_RANK}, hx as (select cid, k, case when rank = 0 then '' else printf('%X', rank) end as h from rk), even as (select cid, k, case when len(h) % 2 = 1 then '0' || h else h end as h from hx) select cid, 'A3' || printf('%02X', k) || printf('%02X', len(h) // 2) || h as blob from even",
    "surface_decode": f"with {_C4}, {MASKS} select cid, mask from mk",
    "limb_popcount_n5": f"with {dims(5)}, {cx(5)} select cid, cast(count(*) as integer) as squares from cx group by cid",
    "extend_closed_n5": f"with {dims(5)}, {cx(5)}, {verts(5)} select p.cid, l.sq from first_prio p join se using (edge) join legal l on l.cid = p.cid and l.sq = se.sq",
    "stable_order": f"with {_LISTS}, e as (select cid, unnest(x) as v, unnest(range(len(x))) as i from ls) select cid, string_agg(i, ',' order by v, i) as out from e group by cid",
    "run_lengths": f"with {_LISTS}, e as (select cid, unnest(x) as v from ls), k as (select cid, v, count(*) as n from e group by cid, v) select cid, string_agg(n, ',' order by v) as out from k group by cid",
    "spread_octal": "select sq, cast(sum(((sq >> b) & 1) << (3 * b)) as bigint) as octal from (select distinct cast(l_partkey % 24 as integer) as sq from lineitem), range(5) r(b) group by sq",
    "octal_pattern": f"with {_SIG}, rk as (select cid, vertex, coord, len(list_filter(list_distinct({_AROUND('b', 'vertex')}), lambda y: y < b[nbr + 1])) as rank from two, nb) select cid, vertex, cast(sum(rank << (3 * (3 - coord))) as bigint) as pattern from rk group by cid, vertex",
    "combinadic_rank": f"""with {_C4}, nth as (select cid, sq, row_number() over (partition by cid order by sq) as j from cx)
select cid, cast(count(*) as integer) as k, cast(sum(case when j > sq then 0 else (select round(exp(sum(ln(sq - i) - ln(i + 1)))) from range(j) r(i)) end) as bigint) as rank from nth group by cid""",
    "boundary_mod2": boundary_sum(4),
    "boundary_mod2_n5": boundary_sum(5),
    "touched_edges": f"with {_C4} select cid, edge, cast(m as integer) as m from deg",
    "link_class_n6": f"with {dims(6)}, {cx(6)}, {verts(6)}, {links(6)} select * from lc",
    "numbered_candidates": f"with {_V4} select p.cid, l.sq, row_number() over (order by p.cid, l.sq) as id from first_prio p join se using (edge) join legal l on l.cid = p.cid and l.sq = se.sq",
    "merged_goods": f"""with {_C4}, {MASKS}, one as (select mask as label, min(cid) as id from mk where cid % 2 = 0 group by mask), two as (select mask as label, min(cid) as id from mk where cid % 3 = 0 and mask not in (select label from one) group by mask)
select label, id, (select count(*) from one) as added_0, (select count(*) from two) as added_1, 0::bigint as added_2 from (select * from one union all select * from two)""",
    "wide_arithmetic_n5": wide_numbers(5),
    "wide_arithmetic_n6": wide_numbers(6),
    **{f"wide_rank_n{n}": ranks(n) for n in (4, 5, 6)},
    **{f"unrank_n{n}": f"select distinct cast(l_orderkey as bigint) as cid, cast(l_partkey % {_sizes(n)} as integer) as sq from lineitem" for n in (4, 5, 6)},
    "restricted_label": restricted(4),
    "restricted_label_n5": restricted(5),
    **{f"level_{name}{'_n3' * (n == 3)}": level(n, mode) for name, mode in (("closed", ""), ("disconnected", "d"), ("boundary", "b"), ("any", "db")) for n in (3, 4)},
    "lookahead_depth2": ahead(4, 8, 2),
    "lookahead_depth4": ahead(4, 8, 4),
    "lookahead_depth2_n3": ahead(3, 6, 2),
    "lookahead_depth4_n3": ahead(3, 6, 4),
    "enumerate_closed_n3": given(closed(3, True), 3),
    "enumerate_closed_n4": given(closed(4, True), 4),
    "enumerate_disconnected_n4": given(closed(4, False), 4),
    "enumerate_boundary_n3": given(f"""with {dims(3)}, pairs as (select bit_or(1::bigint << a.sq) | (1::bigint << b.sq) as mask from range(6) a(sq), range(6) b(sq) where a.sq < b.sq and not exists (select 1 from se x join se y using (edge) where x.sq = a.sq and y.sq = b.sq) group by a.sq, b.sq),
kept as (select cast(m as bigint) as mask from range(1, 64) r(m) where m not in (select mask from pairs)), {group(3)}, {label_of('kept', 3)} select distinct cast(bit_count(label) as integer) as squares, label from lab""", 3),
    "log_runs": f"with {_log()} select cast(run as integer) as run, 'r' || lbl as label, 5 as n, count(*) as lines, bool_or(record = 'run_end') as ended from lines where record is not null group by run, lbl",
    "log_levels": f"with {_log()} select * replace (cast(run as integer) as run) from lvt",
    "log_compare": f"with {_log()}, {_CMP} select * from cmp where level >= 24",
    "log_canon": f"with {_log()} select cast(run as integer) as run, level, " + ", ".join(f"cast(sum(e % {m}) as bigint) as {f}" for f, m in (("canon_calls", 37), ("canon_root_candidates", 41), ("canon_tau_trials", 43))) + " from lines where record = 'canon' group by run, level",
    "log_compare_all": f"with {_log()} select a.level, {_CMP_ALL}, {_DELTAS} from lvt a join lvt b on a.level = b.level and a.run = 1 and b.run = 2 where a.level >= 24",
    "log_previous": f"with {_log()}, p as (select cast(run as integer) as run, level, total_ms, lag(cast(run as integer)) over w as old_run, lag(total_ms) over w as old_ms from lvt where level >= 24 window w as (partition by level order by run)) select *, case when old_run is null then null when old_ms = 0 then 'n/a' else printf('%+.1f%%', (total_ms - old_ms) * 100.0::double / old_ms) end as delta from p",
    "log_storage": f"with {_log()}, more as (select ev0.*, run from ev0 join starts on e >= s and e < after where e % 10 = 0 and e % 500 <> 0) select cast(run as integer) as run, cast(e % 48 as integer) as level, max(greatest(e % 97, e % 89, e % 83)) as peak_bytes from more group by 1, 2",
    "pct_delta": f"with {_log()}, {_CMP} select level, delta from cmp",
}
