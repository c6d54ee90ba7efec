"""Analytics of run logs: lines of `timestamp key=value ...` to runs, levels, comparisons of runs and a text report.

python -m hypersurf.plans.profile [log] [min_level] [--label LABEL] prints the report of a log file.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The smallest level of a report, the log's name, and the sums of a level by record.
MIN_LEVEL, LOG = 24, "run_profile.log"
SUMS = {
    "chunk": ("read_ms", "analyze_ms", "reduce_ms", "proc_ms", "generated", "labeled_ins", "good_ins"),
    "commit": ("commit_ms",),
    "prune": ("prune_global_coverage", "prune_edge_neighborhood"),
}
#: A field that only lines of a record have.
MARKS = {"chunk": "chunk", "commit": "commit_ms", "prune": "prune_global_coverage", "finalize": "finalize_total_ms", "canon": "canon_calls", "size": "size_main_db", "peak": "est_live_peak"}
#: Settings of a run that its heading states, by field.
SETTINGS = {
    "run_mode": "mode", "n": "n", "chunksize": "chunksize", "temp_encoding_mode": "encoding", "commit_every_chunks": "commit_every", "benchmark_max_level": "bench_max", "test_up_to": "test_up_to",
    "run35_compat": "run35_compat", "max_squares": "max_squares", "global_coverage_prune": "global_prune", "edge_neighborhood_prune": "edge_prune", "edge_neighborhood_lookahead": "edge_neighborhood_lookahead",
    "check_vertex_links": "check_links", "frontier_sharding": "frontier_sharding", "frontier_shards": "frontier_shards",
}
_TIME = r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d "
#: Lines of a stretch, in which run starts are counted by itself.
STRETCH = 1 << 16


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """line_no and value of the lines of log files in the order of their names and places; line_no ascends, with gaps; bad bytes are replaced.

    A line's number is that of its split among all (one row a split) and its place in there.
    """
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), place.alias("at"))
    splits = rows.select("path", "start").distinct().withColumn("nth", F.row_number().over(W.orderBy("path", "start")).cast("long"))
    return rows.join(splits, ["path", "start"]).select((F.col("nth") * (1 << 33) + F.col("at")).alias("line_no"), F.make_valid_utf8("value").alias("value"))


def field(name: str) -> Column:
    return F.nullif(F.regexp_extract("value", rf"(?:^| ){name}=(\S*)", 1), F.lit(""))


def records(lines: DataFrame) -> DataFrame:
    """line_no, value, record, ts of the lines of a known kind: run_start and run_end by name, the others by the field that marks them."""
    kind = F.regexp_extract("value", _TIME + r"(run_start|run_end)\b", 1)
    for record, mark in reversed(MARKS.items()):
        kind = F.when(F.col("value").rlike(rf"{_TIME}.*\b{mark}="), record).otherwise(kind) if record != "chunk" else F.when(F.col("value").rlike(rf"{_TIME}.*\bchunk=.*\bproc_ms="), record).otherwise(kind)
    start = F.regexp_extract("value", _TIME + r"(run_start|run_end)\b", 1)
    return lines.withColumn("record", F.when(start != "", start).otherwise(kind)).where("record <> ''").withColumn("ts", F.to_timestamp(F.substring("value", 1, 19)))


def parse(lines: DataFrame) -> DataFrame:
    """line_no, value, record, ts, run, label and n of the lines of a known kind from the first run start on.

    The run of a line is the number of starts up to it: counted in each stretch of lines by a window, and over the stretches, of which there
    is one for STRETCH lines, by another; no line is compared with the starts of other runs.
    """
    known = records(lines).withColumn("stretch", F.floor(F.col("line_no") / STRETCH)).withColumn("start", (F.col("record") == "run_start").cast("int"))
    sums = known.groupBy("stretch").agg(F.sum("start").alias("starts"))
    before = sums.select("stretch", (F.sum("starts").over(W.orderBy("stretch").rowsBetween(W.unboundedPreceding, -1))).alias("before"))
    here = F.sum("start").over(W.partitionBy("stretch").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    numbered = known.withColumn("here", here).join(before, "stretch").withColumn("run", (F.coalesce("before", F.lit(0)) + F.col("here")).cast("int")).where("run > 0")
    starts = numbered.where("start = 1").select("run", field("run_label").alias("label"), field("n").cast("int").alias("n"))
    return numbered.join(starts, "run").select("line_no", "value", "record", "ts", "run", "label", "n")


def runs(lines: DataFrame) -> DataFrame:
    """run, label, n, lines, ended."""
    return parse(lines).groupBy("run", "label", "n").agg(F.count("*").alias("lines"), F.bool_or(F.col("record") == "run_end").alias("ended"))


def settings(lines: DataFrame) -> DataFrame:
    """run, ts, label, ended and, as text, the settings that its start line states (null where it doesn't)."""
    rows = parse(lines)
    fields = [F.max(F.when(F.col("record") == "run_start", field(f))).alias(f) for f in SETTINGS]
    return rows.groupBy("run", "label").agg(F.min("ts").alias("ts"), F.bool_or(F.col("record") == "run_end").alias("ended"), *fields)


def levels(lines: DataFrame) -> DataFrame:
    """run, level and the sums of its chunks, commits and prunes; total_ms is proc_ms + commit_ms."""
    rows = parse(lines).where(F.col("record").isin(*SUMS)).withColumn("level", field("level").cast("int"))
    sums = [F.coalesce(F.sum(F.when(F.col("record") == r, field(f).cast("long"))), F.lit(0)).alias(f) for r, fields in SUMS.items() for f in fields]
    out = rows.groupBy("run", "level").agg(F.count_if(F.col("record") == "chunk").alias("chunks"), *sums)
    return out.withColumn("total_ms", F.col("proc_ms") + F.col("commit_ms"))


def canon_levels(lines: DataFrame) -> DataFrame:
    """run, level and its counts of labels made, of roots and of permutations tried."""
    rows = parse(lines).where("record = 'canon'").withColumn("level", field("level").cast("int"))
    return rows.groupBy("run", "level").agg(*[F.coalesce(F.sum(field(f).cast("long")), F.lit(0)).alias(f) for f in ("canon_calls", "canon_root_candidates", "canon_tau_trials")])


def storage(lines: DataFrame) -> DataFrame:
    """run, level and the larger of the bytes in use before and after a level is completed."""
    rows = parse(lines).where("record = 'peak'").withColumn("level", field("level").cast("int"))
    before, after = (field(f"est_live_{x}_finalize").cast("long") for x in ("before", "after"))
    return rows.groupBy("run", "level").agg(F.max(F.greatest(before, after, field("est_live_peak").cast("long"))).alias("peak_bytes"))


def pct_delta(old: Column, new: Column) -> Column:
    """Signed change in percent with one decimal, halves to the even one, n/a from 0."""
    change = (new - old) * 100.0 / old
    tenths = F.bround(change, 1)
    return F.when(old == 0, F.lit("n/a")).when((change < 0) & (tenths == 0), F.lit("-0.0%")).otherwise(F.format_string("%+.1f%%", tenths))


def seconds(ms: Column) -> Column:
    return F.format_string("%.2fs", ms / 1000.0)


def compare(lines: DataFrame, old: int, new: int, min_level: int = MIN_LEVEL) -> DataFrame:
    """level, total_ms of both runs and its change, for the levels that both have from min_level on."""
    return compare_all(lines, old, new, min_level).select("level", "old_ms", "new_ms", "delta", "old_generated", "new_generated")


def compare_all(lines: DataFrame, old: int, new: int, min_level: int = MIN_LEVEL) -> DataFrame:
    """level and, of both runs, total_ms (as old_ms, new_ms, delta), commit, read and reduce times with their changes, prunes and generated complexes."""
    every = levels(lines).where(F.col("level") >= min_level)
    names = {"total_ms": "ms", "commit_ms": "commit_ms", "read_ms": "read_ms", "reduce_ms": "reduce_ms", "prune_global_coverage": "prune_coverage", "prune_edge_neighborhood": "prune_edge", "generated": "generated"}
    a, b = (every.where(F.col("run") == run).select("level", *[F.col(c).alias(f"{side}_{x}") for c, x in names.items()]) for side, run in (("old", old), ("new", new)))
    both = a.join(b, "level")
    changes = [pct_delta(F.col(f"old_{x}"), F.col(f"new_{x}")).alias("delta" if x == "ms" else f"{x[:-3]}_delta") for x in names.values() if x.endswith("ms")]
    return both.select("level", *[f"{side}_{x}" for x in names.values() for side in ("old", "new")], *changes)


def compare_previous(lines: DataFrame, min_level: int = MIN_LEVEL) -> DataFrame:
    """run, level, total_ms, the run before it that has the level (old_run, old_ms) and the change; null for a level's first run."""
    order = W.partitionBy("level").orderBy("run")
    rows = levels(lines).where(F.col("level") >= min_level).withColumns({"old_run": F.lag("run").over(order), "old_ms": F.lag("total_ms").over(order)})
    return rows.select("run", "level", "total_ms", "old_run", "old_ms", F.when(F.col("old_run").isNotNull(), pct_delta(F.col("old_ms"), F.col("total_ms"))).alias("delta"))


def last_runs(lines: DataFrame, label: str | None = None, most: int = 2) -> list:
    """Rows of settings() of the last runs, of one label if given, the last one first."""
    found = settings(lines)
    return (found.where(F.col("label") == label) if label is not None else found).orderBy(F.desc("run")).limit(most).collect()


def report(lines: DataFrame, label: str | None = None, min_level: int = MIN_LEVEL) -> DataFrame:
    """Levels of the last run and the one before it, of one label if given, as text columns."""
    found = runs(lines)
    found = found.where(F.col("label") == label) if label is not None else found
    last = found.orderBy(F.desc("run")).limit(2).select("run", "label")
    rows = levels(lines).where(F.col("level") >= min_level).join(F.broadcast(last), "run")
    times = [seconds(F.col(f"{x}_ms")).alias(x) for x in ("proc", "commit", "total", "read", "analyze", "reduce")]
    return rows.select("run", "label", "level", "chunks", *times, "generated", "labeled_ins", "prune_global_coverage", "prune_edge_neighborhood").orderBy(F.desc("run"), "level")


def report_text(lines: DataFrame, label: str | None = None, min_level: int = MIN_LEVEL) -> list[str]:
    """The report as lines: the last run, the one before it, and both compared; 'no runs found' without any."""
    lines = lines.cache()
    try:
        return _report_text(lines, label, min_level)
    finally:
        lines.unpersist()


def _report_text(lines: DataFrame, label: str | None, min_level: int) -> list[str]:
    picked = last_runs(lines, label)
    if not picked:
        return ["no runs found"]
    out, rows = [], report(lines, label, min_level).collect()
    for k, run in enumerate(picked):
        stated = " ".join(f"{name}={run[f] or 'Unknown'}" for f, name in SETTINGS.items())
        out += [""] * (k > 0) + [f"Run {run['run']}: {run['ts']:%Y-%m-%d %H:%M:%S} label={run['label'] or 'Unknown'} {stated} ended={run['ended']}"]
        own = [r for r in rows if r["run"] == run["run"]]
        out += [
            f"  L{r['level']:>2}: chunks={r['chunks']:<3} total={r['total']:>8} (proc={r['proc']:>8}, commit={r['commit']:>8}) read={r['read']:>8} analyze={r['analyze']:>8} "
            f"reduce={r['reduce']:>8} labeled={r['labeled_ins']} prune_cov={r['prune_global_coverage']} prune_edge={r['prune_edge_neighborhood']}"
            for r in own
        ] or [f"  no levels >= {min_level}"]
    if len(picked) == 2:
        new, old = picked
        out += ["", f"Compare run {old['run']} -> run {new['run']} (levels >= {min_level})"]
        show = lambda r, x, change: f"{r[f'old_{x}'] / 1000:.2f}s -> {r[f'new_{x}'] / 1000:.2f}s ({r[change]})"
        out += [
            f"  L{r['level']:>2}: total {show(r, 'ms', 'delta')}, commit {show(r, 'commit_ms', 'commit_delta')}, read {show(r, 'read_ms', 'read_delta')}, reduce {show(r, 'reduce_ms', 'reduce_delta')}, "
            f"prune_cov {r['old_prune_coverage']} -> {r['new_prune_coverage']}, prune_edge {r['old_prune_edge']} -> {r['new_prune_edge']}"
            for r in compare_all(lines, old["run"], new["run"], min_level).orderBy("level").collect()
        ] or ["  no overlapping levels in range"]
    return out


def arguments(argv: list[str]) -> tuple[str, int, str | None]:
    """Log, least level and label of a command line; ValueError says what is wrong with it."""
    rest, label, words = [], None, iter(argv)
    for word in words:
        if word != "--label":
            rest.append(word)
        elif (label := next(words, None)) is None:
            raise ValueError("missing value after --label")
    if len(rest) > 2:
        raise ValueError("too many arguments; usage: [log] [min_level] [--label LABEL]")
    if len(rest) == 2 and not rest[1].lstrip("+-").isdigit():
        raise ValueError(f"invalid min_level: {rest[1]}")
    return rest[0] if rest else LOG, int(rest[1]) if len(rest) == 2 else MIN_LEVEL, label


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    try:
        path, least, label = arguments(argv)
        if "://" not in path and not os.path.exists(path):
            raise ValueError(f"missing log file: {path}")
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    session = spark or SparkSession.builder.getOrCreate()
    print("\n".join(report_text(read_log(session, path), label, least)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
