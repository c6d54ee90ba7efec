"""Level by level enumeration of cubical surfaces up to symmetry.

One level is one job: every complex of the frontier is extended by a square, children are tested and labelled in Arrow batches,
and one shuffle by label removes copies.  The label itself is the representative, so no order or id matters.  Levels are
Parquet folders; the driver loop reads counts only.  What a level's tasks count (children, prunes, labels) is a row of the level
with an empty label, so that it is right when tasks run again.  A run that ended early goes on from its last complete level.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from datetime import datetime
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells, storage, topology
from ..operators.incidence import Incidence

MODES = ("", "d", "b", "db")
#: What tasks count, in the order of the counts of a level.
COUNTS = ("generated", "prune_global_coverage", "prune_edge_neighborhood", "canon_calls", "canon_root_candidates", "canon_tau_trials")
#: Depth from which the look-ahead has a budget.
BUDGET_DEPTH = 4


def env_flag(value: str | None, default: bool) -> bool:
    """1, true, yes, on (y, t) are true, 0, false, no, off (n, f) false, in any case; else the default."""
    word = (value or "").strip().lower()
    return True if word in ("1", "true", "yes", "on", "y", "t") else False if word in ("0", "false", "no", "off", "n", "f") else default


def env_number(value: str | None, default: int | None) -> int | None:
    """A positive number, else the default."""
    word = (value or "").strip()
    return int(word) if word.isdigit() and int(word) > 0 else default


@dataclass(frozen=True)
class Options:
    """mode: closed connected (""), closed with several parts ("d"), with boundary ("b"), both ("db").

    max_squares bounds closed modes only.  lookahead: moves that the look-ahead tries (0: none); from BUDGET_DEPTH on it may visit lookahead_nodes
    complexes, and more are an error.  labels: "canonical", or "none" to keep complexes as they are, without reduction by symmetry.
    seed: "first" square, or "all" of them.
    """

    n: int
    mode: str = ""
    max_squares: int | None = None
    stop_level: int | None = None
    check_links: bool = True
    coverage_prune: bool = True
    edge_prune: bool = True
    lookahead: int = 4
    lookahead_nodes: int = 200_000
    labels: str = "canonical"
    seed: str = "first"

    def __post_init__(self):
        cells.check_dimension(self.n)
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, not {self.mode!r}")
        if self.labels not in ("canonical", "none") or self.seed not in ("first", "all"):
            raise ValueError("labels must be canonical or none, seed first or all")

    @classmethod
    def historical(cls, n: int, mode: str = "", **more) -> Options:
        """The settings of the first long runs."""
        return cls(n, mode, **({"max_squares": 36, "lookahead": 1} | more))

    @classmethod
    def from_env(cls, n: int, mode: str = "", env: dict[str, str] | None = None) -> Options:
        """Settings by the names of environment variables."""
        env = dict(os.environ) if env is None else env
        if env_flag(env.get("RUN35_COMPAT"), False):
            return cls.historical(n, mode, stop_level=env_number(env.get("TEST_UP_TO"), None), check_links=env_flag(env.get("CHECK_VERTEX_LINKS"), True))
        return cls(
            n, mode, max_squares=env_number(env.get("MAX_SQUARES"), None), stop_level=env_number(env.get("TEST_UP_TO"), None), check_links=env_flag(env.get("CHECK_VERTEX_LINKS"), True),
            coverage_prune=env_flag(env.get("GLOBAL_COVERAGE_PRUNE"), True), edge_prune=env_flag(env.get("EDGE_NEIGHBORHOOD_PRUNE"), True),
            lookahead=env_number(env.get("EDGE_NEIGHBORHOOD_LOOKAHEAD"), 4), lookahead_nodes=env_number(env.get("EDGE_NEIGHBORHOOD_LOOKAHEAD_NODE_BUDGET"), 200_000),
        )

    @property
    def cap(self) -> int:
        """Squares that a surface can have."""
        every = cells.sizes(self.n)[2]
        return min(every, self.max_squares or every) if self.mode in ("", "d") else every


class Cube(Incidence):
    """Incidence as masks of Python integers, and symmetries as tables, for the kernel."""

    def __init__(self, n: int):
        super().__init__(n)
        mask = lambda xs: sum(1 << x for x in xs)
        self.codes, self.other = topology.codes(n), topology.other(n)
        self.cycles = [{k: [mask(x) for x in cycles] for k, cycles in at.items()} for at in self.cycles]
        self.edge_mask, self.edge_squares = [mask(x) for x in self.edges_of], [mask(x) for x in self.squares_on]
        self.vertex_edges, self.vertex_squares = [mask(x) for x in self.edges_at], [mask(x) for x in self.squares_at]
        digits = np.array(self.squares)
        place = 3 ** np.arange(n - 1, -1, -1)
        index = np.full(3**n, -1, np.int16)
        index[digits @ place] = np.arange(len(digits))
        self.near_vertices = self.near
        self.perms = np.array(list(permutations(range(n))))
        #: flips[v, s]: square s after the coordinates in which vertex v is 1 are flipped; moves[p, s]: after permutation p.
        self.flips = np.stack([index[np.where(digits == 2, 2, digits ^ np.array(v)) @ place] for v in self.vertices])
        self.moves = np.stack([index[digits[:, p] @ place] for p in self.perms])

    @lru_cache(maxsize=4096)  # noqa: B019
    def sorting(self, ranks: tuple[int, ...]) -> np.ndarray:
        """moves of the permutations that put ranks in order."""
        return self.moves[(np.diff(np.array(ranks)[self.perms], axis=1) >= 0).all(1)]


@lru_cache
def cube(n: int) -> Cube:
    return Cube(n)


def _bits(mask: int) -> list[int]:
    out = []
    while mask:
        low = mask & -mask
        out.append(low.bit_length() - 1)
        mask ^= low
    return out


def covered(counts: list[int], left: int) -> int:
    """What the best `left` squares of a histogram cover."""
    out = 0
    for k in (4, 3, 2, 1):
        take = min(left, counts[k])
        out, left = out + k * take, left - take
    return out


class Complex:
    """A set of squares: mask; edges in one square or more, two or more, three or more, as masks."""

    __slots__ = ("c", "mask", "one", "two", "three")

    def __init__(self, c: Cube, mask: int):
        self.c, self.mask, self.one, self.two, self.three = c, mask, 0, 0, 0
        for s in _bits(mask):
            self._add(c.edge_mask[s])

    def _add(self, edges: int) -> None:
        self.three |= self.two & edges
        self.two |= self.one & edges
        self.one |= edges

    def plus(self, s: int) -> Complex:
        """With one more square."""
        out = Complex.__new__(Complex)
        out.c, out.mask, out.one, out.two, out.three = self.c, self.mask | 1 << s, self.one, self.two, self.three
        out._add(self.c.edge_mask[s])
        return out

    @property
    def size(self) -> int:
        return self.mask.bit_count()

    @property
    def free_mask(self) -> int:
        return self.one & ~self.two

    @property
    def free(self) -> list[int]:
        return _bits(self.free_mask)

    def vertex_codes(self) -> dict[int, int]:
        """Code of every used vertex."""
        c, out = self.c, {}
        for v, (es, qs) in enumerate(zip(c.vertex_edges, c.vertex_squares, strict=True)):
            k = (self.one & es).bit_count()
            if k:
                out[v] = c.codes.get((k, (self.mask & qs).bit_count()), c.other)
        return out

    def legal(self, s: int) -> bool:
        return not self.mask >> s & 1 and not self.two & self.c.edge_mask[s]

    def links(self, codes: dict[int, int]) -> tuple[bool, bool]:
        """(some link has several paths, some link is beyond repair)."""
        seven = self.c.n >= 7
        bad = any(k in (topology.BAD + topology.BAD_7 if seven else topology.BAD) for k in codes.values())
        for v, k in codes.items():
            if k == self.c.other:
                return bad, True
            for length, of in (topology.HOPELESS_7 if seven else topology.HOPELESS).items():
                if k in of and any(m & self.mask == m for m in self.c.cycles[v].get(length, ())):
                    return bad, True
        return bad, False

    def priority(self) -> list[int]:
        free = self.free
        if not free:
            return []
        codes = self.vertex_codes()
        weight = {v: topology.WEIGHTS.get(k, 0) for v, k in codes.items()}
        each = [min(weight[v] for v in self.c.ends[e]) for e in free]
        least = min(each)
        return [e for e, w in zip(free, each, strict=True) if w == least]

    def near(self, edges: list[int]) -> list[int]:
        """Legal squares on any of these edges."""
        on = 0
        for e in edges:
            on |= self.c.edge_squares[e]
        return [s for s in _bits(on & ~self.mask) if not self.two & self.c.edge_mask[s]]

    def histogram(self) -> list[int]:
        """How many legal squares cover 0 (none is counted), 1, 2, 3, 4 free edges."""
        free, counts = self.free_mask, [0] * 5
        for s in self.near(_bits(free)):
            counts[(free & self.c.edge_mask[s]).bit_count()] += 1
        return counts

    def feasible(self, left: int, depth: int, budget: list[int] | None) -> bool:
        """Whether some `depth` legal moves, each on the then first edge of priority, always leave enough cover among the node's other legal squares.

        A budget is of nodes; an exhausted one is an error.
        """
        if budget is not None:
            budget[0] -= 1
            if budget[0] < 0:
                raise RuntimeError("the look-ahead visited more complexes than lookahead_nodes allows")
        free = self.free_mask
        if left <= 0 or not free:
            return not free
        counts = self.histogram()
        for s in self.near(self.priority()[:1]):
            c = (free & self.c.edge_mask[s]).bit_count()
            counts[c] -= 1
            fits = free.bit_count() - c <= covered(counts, left - 1)
            counts[c] += 1
            if fits:
                if depth <= 1 or left == 1:
                    return True
                child = self.plus(s)
                if not child.free_mask or child.feasible(left - 1, depth - 1, budget):
                    return True
        return False

    def extensions(self, o: Options, counts: dict[str, int]) -> list[int]:
        """Squares that may be added in this mode."""
        c = self.c
        if o.mode != "":
            every = (1 << len(c.squares)) - 1
            if o.mode == "db":
                return _bits(every & ~self.mask)
            free, on = self.free, 0
            for e in free if o.mode == "b" else free[:1]:
                on |= c.edge_squares[e]
            return _bits((on if free or o.mode == "b" else every) & ~self.mask)
        left, n_free = o.cap - self.size, self.free_mask.bit_count()
        if left <= 0 or not 0 < n_free <= 4 * left:  # a bound, not a prune that can be turned off or is counted
            return []
        if o.coverage_prune and n_free > covered(self.histogram(), left):
            counts["prune_global_coverage"] += 1
            return []
        if o.edge_prune and o.lookahead and not self.feasible(left, o.lookahead, [o.lookahead_nodes] if o.lookahead >= BUDGET_DEPTH else None):
            counts["prune_edge_neighborhood"] += 1
            return []
        return self.near(self.priority()[:1])

    def label(self, codes: dict[int, int], counts: dict[str, int] | None = None) -> int:
        """Least image under the symmetries that send a vertex of least signature to the origin and sort its neighbours."""
        c = self.c
        counts = counts if counts is not None else dict.fromkeys(COUNTS, 0)
        counts["canon_calls"] += 1
        sig: list = [codes.get(v, 0) for v in range(len(c.vertices))]
        for _ in range(2):
            sig = [(sig[v], tuple(sorted([sig[w] for w in c.near_vertices[v]]))) for v in range(len(sig))]
        least, squares, best = min(sig), np.array(_bits(self.mask)), None
        for root in (v for v in range(len(sig)) if sig[v] == least):
            around = [sig[w] for w in c.near_vertices[root]]
            ranks = {x: i for i, x in enumerate(sorted(set(around)))}
            moves = c.sorting(tuple(ranks[x] for x in around))
            counts["canon_root_candidates"] += 1
            counts["canon_tau_trials"] += len(moves)
            # Images have as many squares, so the least number is the least list of squares from the highest down.
            images = np.sort(moves[:, c.flips[root][squares]], axis=1)[:, ::-1]
            for k in range(images.shape[1]):
                if len(images) == 1:
                    break
                images = images[images[:, k] == images[:, k].min()]
            found = images[0].tolist()
            if best is None or found < best:
                best = found
        return sum(1 << s for s in best)


def children(o: Options, mask: int, counts: dict[str, int] | None = None) -> Iterator[tuple[int, bool, bool]]:
    """(label, to the frontier, accepted) of every child that is kept."""
    c, counts = cube(o.n), counts if counts is not None else dict.fromkeys(COUNTS, 0)
    parent = Complex(c, mask)
    for s in parent.extensions(o, counts):
        counts["generated"] += 1
        child = parent.plus(s)
        if child.three:
            continue
        closed = not child.free_mask
        codes = child.vertex_codes()
        bad, hopeless = child.links(codes) if o.check_links else (False, False)
        if hopeless:
            continue
        if o.mode == "":
            labeled, good = not closed, closed and not bad
        else:
            labeled, good = True, not bad and (closed or "b" in o.mode)
        if labeled or good:
            yield child.label(codes, counts) if o.labels == "canonical" else child.mask, labeled, good


SCHEMA = "label binary, labeled boolean, good boolean, counts array<bigint>"
METRICS = "level int, frontier long, good long, ms long, count_ms long, source_bytes long, level_bytes long, held_bytes long, " + ", ".join(f"{c} long" for c in COUNTS)
#: A stored level: unstored is the number of complexes of the last possible level that its one row without a label stands for.
STORED = SCHEMA + ", unstored long"


def step(frontier: DataFrame, o: Options) -> DataFrame:
    """label, labeled, good of the distinct children of a frontier (label); a row with an empty label has the counts of the tasks."""
    size = -(-cells.sizes(o.n)[2] // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = dict.fromkeys(COUNTS, 0)

        def batch(found: dict[bytes, tuple[bool, bool]], counted: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([x for x, _ in found.values()], pa.bool_()), pa.array([x for _, x in found.values()], pa.bool_()), pa.array(counted, pa.list_(pa.int64()))], ["label", "labeled", "good", "counts"])

        for b in batches:
            found: dict[bytes, tuple[bool, bool]] = {}
            for parent in b.column("label").to_pylist():
                for label, labeled, good in children(o, int.from_bytes(parent, "big"), counts):
                    found[label.to_bytes(size, "big")] = (labeled, good)
            yield batch(found, [None] * len(found))
        yield batch({b"": (False, False)}, [list(counts.values())])

    sums = F.when(F.length("label") == 0, F.array(*[F.sum(F.get("counts", F.lit(k))) for k in range(len(COUNTS))]))
    return frontier.mapInArrow(run, SCHEMA).groupBy("label").agg(F.bool_or("labeled").alias("labeled"), F.bool_or("good").alias("good"), sums.alias("counts"))


def without_frontier(made: DataFrame) -> DataFrame:
    """A level after which none can follow, as STORED: accepted complexes, the counts, and the number of the others in one row."""
    label = F.when(F.col("good") | (F.length("label") == 0), F.col("label")).alias("label")
    others = F.when(F.col("label").isNull(), F.count_if("labeled")).alias("unstored")
    flags = [(F.bool_or(c) & F.col("label").isNotNull()).alias(c) for c in ("labeled", "good")]
    return made.select(label, "labeled", "good", "counts").groupBy("label").agg(*flags, F.max("counts").alias("counts"), others)


def _complete(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def enumerate_surfaces(spark: SparkSession, options: Options, path: str | None = None, resume: bool = False) -> tuple[DataFrame, list[dict]]:
    """Accepted surfaces (squares, label) and, for each level, its metrics (METRICS).

    path: folder of the levels; an existing one is an error unless resume, which goes on after its last complete level.  A folder that was
    made with other options than the last level's number is an error, and levels beyond the last one are not read.  Of the level of the most
    squares only accepted complexes are stored; that of a smaller stop_level is stored whole, as a later run may go on from it.
    """
    o, path = options, path or storage.folder(spark, "levels")
    size = -(-cells.sizes(o.n)[2] // 8)
    about = json.dumps(asdict(o) | {"stop_level": None}, sort_keys=True)
    if resume and _complete(spark, f"{path}/_options"):
        if (held := spark.read.text(f"{path}/_options", wholetext=True).first()[0].strip()) != about:
            raise ValueError(f"{path} holds levels of other options: {held}")
    else:
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite" if resume else "errorifexists").text(f"{path}/_options")
    seeds = [(1 << s).to_bytes(size, "big") for s in range(cells.sizes(o.n)[2] if o.seed == "all" else 1)]
    if not (resume and _complete(spark, f"{path}/level=1")):
        spark.createDataFrame([(x, True, "b" in o.mode, None) for x in seeds], SCHEMA).write.mode("overwrite" if resume else "errorifexists").parquet(f"{path}/level=1")
    last, metrics, level, count = min(o.stop_level or o.cap, o.cap), [], 1, len(seeds)
    held = storage.size(spark, f"{path}/level=1")
    while level < last and count:
        done = spark.read.schema(SCHEMA).parquet(f"{path}/level={level}").where("labeled").select("label")
        level, began = level + 1, time.time()
        if not (resume and _complete(spark, f"{path}/level={level}")):
            # A complex takes milliseconds, so small levels are spread by count, not by bytes.
            wide = done.repartition(min(count, max(spark.sparkContext.defaultParallelism, -(-count // 2000))))
            made = step(wide, o)
            (without_frontier(made) if level == o.cap else made).write.mode("overwrite" if resume else "errorifexists").parquet(f"{path}/level={level}")
        counted = time.time()
        frontier = F.count_if("labeled") + F.coalesce(F.sum("unstored"), F.lit(0))
        made = spark.read.schema(STORED).parquet(f"{path}/level={level}").agg(frontier, F.count_if("good"), F.max("counts")).first()
        count, ended = made[0], time.time()
        sizes = [storage.size(spark, f"{path}/level={k}") for k in (level - 1, level)]
        held += sizes[1]
        times = {"ms": int(1000 * (ended - began)), "count_ms": int(1000 * (ended - counted))}
        bytes_ = dict(zip(("source_bytes", "level_bytes", "held_bytes"), (*sizes, held), strict=True))
        metrics.append({"level": level, "frontier": count, "good": made[1]} | times | bytes_ | dict(zip(COUNTS, made[2] or [0] * len(COUNTS), strict=True)))
    goods = spark.read.schema(SCHEMA + ", level int").parquet(path).where(F.col("good") & (F.col("level") <= level))
    return goods.select(F.col("level").alias("squares"), "label"), metrics


def metrics_frame(spark: SparkSession, metrics: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(m[x.split()[0]] for x in METRICS.split(", ")) for m in metrics], METRICS)


def log_lines(o: Options, metrics: list[dict], label: str = "-", when: datetime | None = None) -> list[str]:
    """The run's records as lines of a log, in the form that plans/profile.py reads.

    A level is complete once it is counted, which is its finalize time; the bytes in use before that are those of the levels before it and its own, and as
    no level is dropped they are so afterwards too.
    """
    ts = f"{when or datetime.now():%Y-%m-%d %H:%M:%S}"
    out = [
        f"{ts} run_start run_label={label} n={o.n} dbprefix={o.mode} max_squares={o.max_squares} global_coverage_prune={str(o.coverage_prune).lower()} edge_neighborhood_prune={str(o.edge_prune).lower()} "
        f"edge_neighborhood_lookahead={o.lookahead} edge_neighborhood_lookahead_node_budget={o.lookahead_nodes} check_vertex_links={str(o.check_links).lower()}"
    ]
    for m in metrics:
        at = f"{ts} level={m['level']}"
        out += [
            f"{at} chunk=1/1 read_ms=0 analyze_ms={m['ms']} reduce_ms=0 proc_ms={m['ms']} generated={m['generated']} labeled_ins={m['frontier']} good_ins={m['good']}",
            f"{at} commit_ms=0 chunks_in_tx=1",
            f"{at} finalize_total_ms={m['count_ms']} good_count_ms={m['count_ms']}",
            f"{at} size_main_db={m['held_bytes']} size_temp_db={m['level_bytes']}",
            f"{at} source_temp_db={m['source_bytes']} next_temp_db={m['level_bytes']} est_live_before_finalize={m['held_bytes']} est_live_after_finalize={m['held_bytes']} est_live_peak={m['held_bytes']}",
            f"{at} prune_global_coverage={m['prune_global_coverage']} prune_edge_neighborhood={m['prune_edge_neighborhood']} global_coverage_prune={str(o.coverage_prune).lower()} edge_neighborhood_prune={str(o.edge_prune).lower()}",
            f"{at} canon_calls={m['canon_calls']} canon_root_candidates={m['canon_root_candidates']} canon_tau_trials={m['canon_tau_trials']}",
        ]
    return [*out, f"{ts} run_end"]


def append_log(path: str, lines: list[str]) -> None:
    with open(path, "a", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def surface_cells(goods: DataFrame, n: int) -> DataFrame:
    """One line a surface (label): its squares as lists of digits, for text files."""
    squares = cube(n).squares
    names = F.array(*[F.lit("".join(map(str, s))) for s in squares])
    bits = F.reverse(_binary(F.hex("label")))
    held = F.filter(F.transform(names, lambda x, i: F.when(F.substring(bits, i + 1, F.lit(1)) == "1", x)), lambda x: x.isNotNull())
    return goods.select(F.concat_ws(" ", held).alias("value"))


def _binary(digits) -> object:
    """Binary digits of hex ones."""
    table = {f"{k:X}": f"{k:04b}" for k in range(16)}
    return F.array_join(F.transform(F.split(digits, "(?!^)"), lambda d: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), d)), "")
