"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A document is the set of its word 5-grams (a shorter one is a single shingle), each of weight 1 however often it
occurs.  Every shingle sends arrivals of an exponential process whose rate is its weight to random registers; a register
keeps its earliest arrival's shingle, and a shingle ends as soon as its next arrival is later than every register's.  The
share of equal registers estimates the probability Jaccard similarity of two sets, which for equal weights is the Jaccard
similarity that defines a link (THRESHOLD or more).  Bands of ROWS registers give candidates; those whose estimate is far
below the threshold wait for the exact last round, and the rest is verified on the whole texts.

Scale: equal texts are one node, so copies cost one row each.  Bands are shuffled as pairs of longs.  A bucket never
emits all its pairs: its members are compared with one pivot, a few rounds of pivots follow for the members that
are still in other components.  What is left is dealt anew by its rarest shingles
(see rare_shingles), and only there pairs of different components are formed and all verified on their texts, so that no
link is lost.  Tables of one row a key (copies, sizes, pivots) are stored before the join with the rows of that key, so that a key with a third
of all rows is split over tasks by adaptive execution and not held in the task that counted it.
Components are found by star contraction in shared storage.  Texts are shuffled once, for documents
with candidates.

Misses: a pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8^6)^32 = 0.99994.

Cases: null and empty texts are classes of their own; texts without words are joined with equal texts only; a null id has
a null class; of rows with one id but different texts each is in its own text's class, and equal rows are in one; class_id is the smallest id of a
class; an empty table gives no rows; other columns are ignored, and the stage keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .words import gram_hashes, mixed, split_words, word_hashes
from .work import materialise, own_names, plain_names, release, slices, table

SHINGLE, THRESHOLD, REGISTERS, ROWS, PIVOTS = 5, 0.8, 192, 6, 2
#: An estimate this far below the threshold is over four standard errors off: sqrt(0.8 * 0.2 / 192) = 0.029.
MARGIN = 0.12
#: Text bytes whose shingles are held together: a byte of text takes some 30 in arrays of shingles and arrivals.
SHINGLE_BYTES = 1 << 20


def shingles(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct word n-grams of each text, in order of text and hash."""
    flat, ends, distinct = split_words(texts)
    hashes = word_hashes(distinct)[flat] if len(flat) else np.zeros(0, np.uint64)
    sizes = np.diff(ends, prepend=0)
    starts = ends - sizes
    grams = gram_hashes(hashes, n)
    doc = np.repeat(np.arange(len(ends)), np.maximum(0, sizes - n + 1))
    at = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(0, sizes - n + 1)) - np.maximum(0, sizes - n + 1), np.maximum(0, sizes - n + 1)) + starts[doc]
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    whole = np.array([gram_hashes(hashes[starts[i] : ends[i]], int(sizes[i]))[0] for i in short], np.uint64)
    doc, value = np.concatenate([doc, short]), np.concatenate([grams[at], whole])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    places = np.flatnonzero(first)
    return doc[places], value[places], np.diff(places, append=len(doc))


def prob_minhash(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """(n_docs, registers): the shingle of the earliest arrival in each register; zeros for a set without shingles."""
    time, won = np.full(n_docs * registers, np.inf), np.zeros(n_docs * registers, np.uint64)
    at, doc_now, value_now, weight_now, nth = np.zeros(len(doc)), doc, value, weight.astype(float), 0
    while len(doc_now):
        nth += 1
        h = mixed(value_now + np.uint64(nth * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        at = at - np.log(((h >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / weight_now
        slot = doc_now * registers + (mixed(h) % np.uint64(registers)).astype(np.int64)
        better = np.flatnonzero(at < time[slot])
        better = better[np.argsort(-at[better], kind="stable")]  # of equal slots the earliest is written last
        time[slot[better]], won[slot[better]] = at[better], value_now[better]
        on = at < time.reshape(n_docs, registers).max(1)[doc_now]
        at, doc_now, value_now, weight_now = at[on], doc_now[on], value_now[on], weight_now[on]
    return won.reshape(n_docs, registers)


def sketch_batches(batches: Iterator[pa.RecordBatch], registers: int = REGISTERS, rows: int = ROWS, n: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    """Adds bands and registers to doc_id, copy and digest of batches with text, SHINGLE_BYTES of text or one longer text at a time."""
    names = ["doc_id", "copy", "digest", "bands", "registers"]
    for batch in batches:
        for b in slices(batch, "text", SHINGLE_BYTES):
            doc, value, _ = shingles(b.column("text"), n)
            won = prob_minhash(doc, value, np.ones(len(doc)), b.num_rows, registers)
            full = np.bincount(doc, minlength=b.num_rows) > 0
            bands = [gram_hashes(won[:, k : k + rows].T.reshape(rows, -1).T.ravel(), rows)[::rows] + np.uint64(k) for k in range(0, registers, rows)]
            bands = mixed(np.stack(bands, 1)).view(np.int64)
            kept = mixed(won).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("copy"), b.column("digest"), pa.array([x if f else [] for x, f in zip(bands.tolist(), full, strict=True)], pa.list_(pa.int64())), pa.array([x.tobytes() for x in kept], pa.binary())], names)
    release()


def sketch(docs: DataFrame, registers: int = REGISTERS, rows: int = ROWS, n: int = SHINGLE) -> DataFrame:
    """doc_id, copy and digest (hashes of the text; digest null for an empty one), bands (array of long) and registers (binary, a byte each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return sketch_batches(batches, registers, rows, n)

    rows_in = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), F.when(F.length("text") > 0, F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "text")
    return rows_in.mapInArrow(run, "doc_id long, copy long, digest string, bands array<long>, registers binary")


def similar_pairs(batches: Iterator[pa.RecordBatch], threshold: float = THRESHOLD, n: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    """Those of the pairs (a, b, ta, tb) whose texts are similar, SHINGLE_BYTES of both texts or one longer pair at a time."""
    for batch in batches:
        for b in slices(batch, "ta", SHINGLE_BYTES, "tb"):
            sides = []
            for c in ("ta", "tb"):
                doc, value, _ = shingles(b.column(c), n)
                sides.append(np.split(value, np.searchsorted(doc, np.arange(1, b.num_rows))))
            good = []
            for x, y in zip(*sides, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= threshold * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))
    release()


def verify(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, screen: bool = True) -> DataFrame:
    """Of pairs (a, b) of ids of texts (doc_id, text, registers) those with Jaccard similarity of at least threshold.

    With screen, pairs whose estimate is MARGIN below it are dropped unread.
    """

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("ra", "rb"))
                yield b.select(["a", "b"]).filter(pa.array((x == y).mean(1) >= threshold - MARGIN))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return similar_pairs(batches, threshold, n)

    def both(pairs: DataFrame, column: str) -> DataFrame:
        a, b = (texts.select(F.col("doc_id").alias(k), F.col(column).alias(f"{column[0]}{k}")) for k in "ab")
        return pairs.join(a, "a").join(b, "b")

    near = materialise(both(pairs, "registers").select("a", "b", "ra", "rb").mapInArrow(estimate, "a long, b long"), "estimated") if screen else pairs
    return both(near, "text").select("a", "b", "ta", "tb").mapInArrow(exact, "a long, b long")


def rare_shingles(nodes: DataFrame, texts: DataFrame, threshold: float, n: int) -> DataFrame:
    """key, node, root, size, left: of each of nodes (node, root) so many of its rarest shingles that similar sets share one of them.

    Sets of similarity t share all but (1 - t) of either's shingles, so one of the first (1 - t) * size + 1 of either in
    any common order; in order of rarity these are hardly ever of a passage that many documents share.  Only shingles
    with nodes of different roots are returned.  left counts the node's shingles from this one on: the first shared
    shingle of two sets bounds what they share by the smaller left of the two.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", SHINGLE_BYTES):
                doc, value, _ = shingles(b.column("text"), n)
                yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(doc)), b.column("root").take(pa.array(doc)), pa.array(value.view(np.int64))], ["node", "root", "key"])
        release()

    of = texts.select(F.col("doc_id").alias("node"), "text").join(nodes, "node").select("node", "root", "text")
    each = materialise(of.mapInArrow(explode, "node long, root long, key long"), "shingles")
    often = materialise(each.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"), "shingle-counts")
    ranked = each.join(often, "key")
    sizes = each.groupBy("node").agg(F.count("*").alias("size"))
    rare = ranked.groupBy("node", "root").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("held")).join(sizes, "node")
    # Shingles of one document only are the rarest of all and take the first places, though they link nothing.
    rest = F.floor((1 - threshold) * F.col("size") + 1e-9) + 1 - (F.col("size") - F.size("held"))
    rare = rare.where(rest > 0).select("node", "root", "size", F.size("held").alias("n_held"), F.posexplode(F.slice("held", F.lit(1), rest.cast("int"))).alias("at", "x")).select("node", "root", "size", (F.col("n_held") - F.col("at")).alias("left"), F.col("x.key").alias("key"))
    shared = rare.groupBy("key").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p <> q").select("key")
    return rare.join(shared, "key").select("key", "node", "root", "size", "left")


def classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, registers: int = REGISTERS, rows: int = ROWS) -> DataFrame:
    """doc_id, copy (hash of the text), root (number of its class) and class_id (smallest id of the class) of each row of docs (doc_id, text) with an id."""
    # Numbers of rows are drawn once, as they are stored with the sketches: a node is the number of one of the rows of a text.
    found = materialise(sketch(docs, registers, rows, n).withColumn("row", F.monotonically_increasing_id()), "sketches")
    copies = materialise(found.where("digest is not null").groupBy("digest").agg(F.min("row").alias("node"), F.count("*").alias("n")).where("n > 1").select("digest", "node"), "copies")
    members = materialise(found.select("row", "doc_id", "copy", "digest").join(copies, "digest", "left").select("row", "doc_id", "copy", F.coalesce("node", "row").alias("node")), "members")
    heads = members.where("row = node").select("node", "doc_id", "copy")
    nodes = found.where("size(bands) > 0").withColumnRenamed("row", "node").join(heads.select("node"), "node", "left_semi")
    buckets = materialise(nodes.select(F.explode("bands").alias("key"), "node"), "buckets")
    shared = materialise(buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared-keys")
    buckets = materialise(buckets.join(shared, "key"), "shared-buckets")
    involved = heads.join(buckets.select("node").distinct(), "node").join(found.select(F.col("row").alias("node"), "registers"), "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text").join(involved, ["doc_id", "copy"])
    texts = materialise(texts.dropDuplicates(["doc_id", "copy"]).select(F.col("node").alias("doc_id"), "text", "registers"), "candidate-texts")
    links, roots, whole = None, None, True
    for turn in range(PIVOTS + 1):
        if roots is None:
            at = buckets.withColumn("root", F.col("node"))
        else:
            at = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            mixed_keys = materialise(at.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key"), "mixed-keys")
            at = materialise(at.join(mixed_keys, "key").select("key", "node", "root", "n"), "mixed-buckets")
        if turn < PIVOTS:
            # First whoever shares most buckets with others: the original of a family of copies, if it is there.
            if turn == 0:
                weight = materialise(at.groupBy("node").agg((-F.sum("n")).alias("h")), "weights")
                at = at.join(weight, "node")
            else:
                at = at.withColumn("h", F.xxhash64("node", F.lit(turn)))
            pivots = materialise(at.groupBy("key").agg(F.min(F.struct("h", "node", "root")).alias("p")).select("key", F.col("p.node").alias("pivot"), F.col("p.root").alias("proot")), "pivots")
            pairs = at.join(pivots, "key").where("root <> proot")
            pairs = pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
        else:
            at = materialise(rare_shingles(at.select("node", "root").distinct(), texts, threshold, n), "rare-shingles")
            one, two = (at.select("key", F.col("node").alias(k), F.col("root").alias(f"r{k}"), F.col("size").alias(f"s{k}"), F.col("left").alias(f"l{k}")) for k in "ab")
            # Similarity t needs t / (1 + t) of both sizes together in common; of a link at least the first shared shingle has as much left.
            enough = F.least("la", "lb") * (1 + threshold) + 1e-6 >= threshold * (F.col("sa") + F.col("sb"))
            pairs = one.join(two, "key").where("a < b and ra <> rb").where(enough).select("a", "b")
        pairs = materialise(pairs.distinct(), "pairs")
        if pairs.isEmpty():
            break
        new = materialise(verify(pairs, texts, threshold, n, turn < PIVOTS), "links")
        if new.isEmpty():
            continue
        links = new if links is None else links.unionByName(new)
        # Between the pivots labels that join only what is joined will do; the last labels are whole components.
        whole = turn + 1 >= PIVOTS
        roots = materialise(components(links) if whole else near_labels(links), "roots")
    if not whole:
        roots = materialise(components(links), "roots")
    rooted = members.select("doc_id", "copy", F.col("node").alias("root"))
    if roots is not None:
        rooted = materialise(members.join(roots, "node", "left").select("doc_id", "copy", F.coalesce("root", "node").alias("root")), "rooted")
    return rooted.join(_least(rooted), "root").select("doc_id", "copy", "root", "class_id")


def _least(members: DataFrame) -> DataFrame:
    """The smallest id of each class, stored: a class can hold many rows."""
    return materialise(members.groupBy("root").agg(F.min("doc_id").alias("class_id")), "class-ids")


def near_labels(links: DataFrame, hops: int = 2) -> DataFrame:
    """(node, root): the smallest node within some steps; nodes of one root are connected, connected nodes may have several roots."""
    both = materialise(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))), "both-ways")
    label = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    for _ in range(hops - 1):
        label = materialise(label, "labels")
        seen = both.join(label.select(F.col("u").alias("v"), "m"), "v").groupBy("u").agg(F.min("m").alias("m2"))
        label = label.join(seen, "u").select("u", F.least("m", "m2").alias("m"))
    return label.select(F.col("u").alias("node"), F.col("m").alias("root"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, registers: int = REGISTERS, rows: int = ROWS) -> DataFrame:
    """doc_id and class_id of each row of docs (doc_id, text) with an id."""
    return classes(docs, threshold, n, registers, rows).select("doc_id", "class_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).unionByName(docs.where("doc_id is null").select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("class_id")))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class one row stays, that of the smallest id (of rows of that id the smallest text hash, of equal ones the
    smallest in all columns); rows without an id stay."""
    found = materialise(classes(docs.select("doc_id", "text")), "classes")
    first = found.where("doc_id = class_id").groupBy("root").agg(F.min("copy").alias("kept"))
    each = found.groupBy("doc_id", "copy", "root", "class_id").agg(F.count("*").alias("n"))
    each = each.join(materialise(first, "kept"), "root", "left")
    each = materialise(each.select("doc_id", "copy", "n", ((F.col("doc_id") == F.col("class_id")) & (F.col("copy") == F.col("kept"))).alias("stays")).where("not stays or n > 1"), "touched")
    held = plain_names(docs).withColumn("id", F.col(f"_{docs.columns.index('doc_id')}").cast("long")).withColumn("copy", F.xxhash64("text"))
    several = each.where("stays").select(F.col("doc_id").alias("id"), "copy")
    alone = held.join(each.select(F.col("doc_id").alias("id"), "copy"), ["id", "copy"], "left_anti")
    rows = plain_names(docs).columns
    one = held.join(several, ["id", "copy"], "left_semi").groupBy("id", "copy").agg(F.min(F.struct(*rows)).alias("r")).select("r.*")
    return own_names(alone.select(*rows).unionByName(one), docs)
