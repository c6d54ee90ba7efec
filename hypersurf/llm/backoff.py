"""LM scoring: stupid-backoff scores from n-gram counts of the whole corpus.

Documents are exploded into n-grams of one to ORDER words.  Count tables are partitioned by hash; each partition sums the counts of its
n-grams and they are joined back to the n-grams of the documents, whose log scores are summed per document.  For the words w1 w2 w3 the score
of w3 is count(w1 w2 w3) / count(w1 w2) if the trigram occurs at least CUTOFF times, else ALPHA times that of w2 w3 by the
same rule, and at the end ALPHA * count(w3) / words of the corpus.  n-grams don't reach over documents.

There are two forms with the same results.  stupid_backoff_rows says it in DataFrame operations, a row an n-gram: its shuffles are over ten
times the input.  stupid_backoff, which the query uses, packs what travels: blocks of BLOCK_WORDS words count their equal n-grams first and send
a row a (block, partition) that holds sorted columns of 64-bit hashes and counts, compressed; the sums come back in the same order.  Rows without
n-grams aren't sent, so there are at most as many rows as n-grams of blocks, whatever the number of blocks and partitions.  The number of
partitions grows with the input, so that one holds about PART_GRAMS n-grams; frequent n-grams are one entry a block, so none is
hot.  The blocks are made in two passes over the documents, one for n-grams and one for their words, and carry a check sum in both, so that nothing
is stored before its shuffle and an input that changes between the passes is an error.  n-grams are told apart by their hash: of g
different ones g^2 / 2^65 pairs are taken for one another, so 0.003 pairs at 3 * 10^8 and 10^-7 of all at 10^13.

Cases: a text without words, or null, scores 0 with 0 words; null ids and repeated rows keep their rows (copies count as
often as they occur); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import gram_hashes, split_words, word_hashes
from .work import materialise, partitions, release, slices, table

ORDER, ALPHA, CUTOFF, BLOCK_WORDS, PART_GRAMS = 3, 0.4, 2, 3 << 19, 2 << 20
#: Text bytes of a word, at least, for the number of partitions.
WORD_BYTES = 6
PACKED = "block long, part int, data binary, docs binary, sequence binary, vocabulary binary, sum long"
NAMES = [x.split()[0] for x in PACKED.split(", ")]


def _planes(x: np.ndarray) -> bytes:
    """Bytes of an array, those of equal weight together."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _array(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _zip(x: np.ndarray) -> bytes:
    return zstandard.compress(_planes(x), 1)


def _unzip(data: bytes, kind) -> np.ndarray:
    return _array(zstandard.decompress(data), kind)


def _blocks(batches: Iterator[pa.RecordBatch], block_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, documents as rows of (null id, id, end), word hashes) of doc_id, text."""
    from pyspark import TaskContext

    block, ids, ends, parts, total = TaskContext.get().partitionId() << 32, [], [], [], 0
    for batch in batches:
        for b in slices(batch, "text"):
            flat, text_ends, distinct = split_words(b.column("text"))
            parts.append(word_hashes(distinct)[flat] if len(flat) else np.zeros(0, np.uint64))
            ids += b.column("doc_id").to_pylist()
            ends += (text_ends + total).tolist()
            total += len(flat)
            if total >= block_words:
                yield block, np.array([(d is None, d or 0, e) for d, e in zip(ids, ends, strict=True)], "<i8"), np.concatenate(parts)
                block, ids, ends, parts, total = block + 1, [], [], [], 0
    if ids:
        yield block, np.array([(d is None, d or 0, e) for d, e in zip(ids, ends, strict=True)], "<i8"), np.concatenate(parts)


def _grams(docs: np.ndarray, words: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n from 1 to order: (places at which an n-gram ends, its hash)."""
    ends = docs[:, 2]
    sizes = np.diff(ends, prepend=0)
    nth = np.arange(len(words), dtype=np.int32) - np.repeat(ends - sizes, sizes).astype(np.int32)
    for n in range(1, order + 1):
        places = np.flatnonzero(nth >= n - 1)
        hashes = gram_hashes(words, n)
        yield places, hashes[places - n + 1] if len(hashes) else hashes


def _parts(hashes: np.ndarray, parts: int) -> np.ndarray:
    """First place of each partition in sorted hashes; the last entry is their number."""
    return np.searchsorted(((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))


def _sum(hashes: np.ndarray) -> int:
    return int(np.add.reduce(hashes, dtype=np.uint64).astype(np.int64)) if len(hashes) else 0


def _pack(hashes: list[np.ndarray], counts: list[np.ndarray]) -> bytes:
    """Sorted hashes and counts of each order."""
    sizes = np.array([len(h) for h in hashes], "<u4").tobytes()
    deltas = np.concatenate([np.diff(h, prepend=np.uint64(0)) for h in hashes])
    return sizes + zstandard.compress(_planes(deltas) + _planes(np.concatenate(counts).astype(np.uint32)), 1)


def _unpack(data: bytes, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    sizes = np.frombuffer(data, "<u4", order)
    raw, n, cuts = zstandard.decompress(data[4 * order :]), int(sizes.sum()), np.cumsum(sizes)[:-1]
    return [np.cumsum(d, dtype=np.uint64) for d in np.split(_array(raw[: 8 * n], np.uint64), cuts)], np.split(_array(raw[8 * n :], np.uint32), cuts)


def stupid_backoff(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, cutoff: int = CUTOFF, block_words: int = BLOCK_WORDS, part_grams: int = PART_GRAMS, stable: bool = False) -> DataFrame:
    """doc_id, n_words and log_score (sum of natural logs) of docs (doc_id, text).

    docs is read twice: one that isn't read from files as it is (stable) is stored first.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs if stable else materialise(docs, "texts")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(partitions(spark), -(-size // WORD_BYTES * order // part_grams))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int32(), *[pa.binary()] * 4, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], NAMES)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, docs_, words in _blocks(batches, block_words):
            found = [np.unique(hashes, return_counts=True) for _, hashes in _grams(docs_, words, order)]
            starts = [_parts(hashes, parts) for hashes, _ in found]
            rows, held = [], 0
            for p in np.flatnonzero(sum(np.diff(x) for x in starts)).tolist():
                own = [slice(x[p], x[p + 1]) for x in starts]
                mine = [h[k] for (h, _), k in zip(found, own, strict=True)]
                rows.append((block, p, _pack(mine, [c[k] for (_, c), k in zip(found, own, strict=True)]), None, None, None, sum(map(_sum, mine)) & 0x7FFFFFFF))
                held += len(rows[-1][2])
                if held > 4 << 20:
                    yield batch(rows)
                    rows, held = [], 0
            yield batch(rows)
        release()

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, docs_, words in _blocks(batches, block_words):
            vocabulary, sequence = np.unique(words, return_inverse=True)
            yield batch([(block, -1, None, docs_.tobytes(), zstandard.compress(_planes(sequence.astype(np.uint32)), 3), _zip(np.diff(vocabulary, prepend=np.uint64(0))), 0)])
        release()

    def count(group: pa.Table) -> pa.Table:
        rows = [_unpack(x, order) for x in group.column("data").to_pylist()]
        sums: list[list[np.ndarray]] = [[] for _ in rows]
        for n in range(order):
            sizes = [len(h[n]) for h, _ in rows]
            _, index = np.unique(np.concatenate([h[n] for h, _ in rows]), return_inverse=True)
            total = np.bincount(index, np.concatenate([c[n] for _, c in rows])).astype(np.int64)[index]
            for k, own in enumerate(np.split(total, np.cumsum(sizes)[:-1])):
                sums[k].append(own)
        none = pa.nulls(len(rows), pa.binary())
        out = pa.table([group.column("block"), group.column("part"), pa.array([np.array([len(x) for x in own], "<u4").tobytes() + _zip(np.concatenate(own)) for own in sums], pa.binary()), none, none, none, group.column("sum")], names=NAMES)
        release()
        return out

    def score(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in NAMES[1:]), strict=True), key=lambda r: r[0])
        changed = RuntimeError("the documents changed between two passes; store them first")
        if rows[0][0] != -1:
            raise changed
        head, tables = rows[0], [(np.frombuffer(r[1], "<u4", order), _unzip(r[1][4 * order :], np.int64)) for r in rows[1:]]
        docs_, words = np.frombuffer(head[2], "<i8").reshape(-1, 3), np.cumsum(_unzip(head[4], np.uint64), dtype=np.uint64)
        words = words[_unzip(head[3], np.uint32)] if len(words) else words
        logs, backed, below, check = np.zeros(len(words)), np.ones(len(words), bool), None, np.zeros(len(rows) - 1, np.int64)
        for n, (places, hashes) in enumerate(_grams(docs_, words, order)):
            distinct, index = np.unique(hashes, return_inverse=True)
            starts = _parts(distinct, parts)
            sizes = np.array([s[n] for s, _ in tables], np.int64)
            if len(tables) and (np.diff(starts)[[r[0] for r in rows[1:]]] != sizes).any() or sizes.sum() != len(distinct):
                raise changed
            check += np.array([_sum(distinct[starts[r[0]] : starts[r[0] + 1]]) & 0x7FFFFFFF for r in rows[1:]], np.int64)
            known = np.zeros(len(words), np.int64)
            if len(places):
                known[places] = np.concatenate([t[int(s[:n].sum()) : int(s[: n + 1].sum())] for s, t in tables])[index]
            if n == 0:
                logs = np.log(np.maximum(known, 1))
            else:
                seen = known[places] >= cutoff
                logs[places] += np.log(alpha)
                good = places[seen]
                logs[good] = np.log(known[good] / below[good - 1])
                backed[good] = False
            below = known
        if ((check & 0x7FFFFFFF) != np.array([r[5] for r in rows[1:]], np.int64)).any():
            raise changed
        sizes = np.diff(docs_[:, 2], prepend=0)
        starts = np.minimum(docs_[:, 2] - sizes, max(0, len(logs) - 1))
        each, least = ((np.where(sizes > 0, np.add.reduceat(x, starts), 0) if len(logs) else np.zeros(len(docs_))) for x in (logs, backed.astype(np.int64)))
        out = pa.table({"doc_id": pa.array([None if z else d for z, d, _ in docs_.tolist()], pa.int64()), "n_words": pa.array(sizes), "part_score": pa.array(each, pa.float64()), "unigrams": pa.array(least.astype(np.int64))})
        release()
        return out

    counted = docs.mapInArrow(explode, PACKED).groupBy("part").applyInArrow(count, PACKED)
    scored = docs.mapInArrow(heads, PACKED).unionByName(counted).groupBy("block").applyInArrow(score, "doc_id long, n_words long, part_score double, unigrams long")
    scored = materialise(scored, "scores")
    # Words scored by their own count alone lack the words of the corpus, known only now.
    n_words = scored.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    return scored.select("doc_id", "n_words", (F.col("part_score") - F.col("unigrams") * F.log(F.lit(float(max(1, n_words))))).alias("log_score"))


def stupid_backoff_rows(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, cutoff: int = CUTOFF) -> DataFrame:
    """The same in DataFrame operations: count tables shuffled by n-gram and joined to the exploded n-grams of the documents."""
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), found.alias("words")), "words")
    at = rows.select("row", "words", F.explode(F.expr("if(size(words) = 0, cast(array() as array<int>), sequence(1, size(words)))")).alias("at"))
    grams = {n: F.when(F.col("at") >= n, F.concat_ws(" ", F.slice("words", F.col("at") - n + 1, F.lit(n)))) for n in range(1, order + 1)}
    before = {n: F.when(F.col("at") > n, F.concat_ws(" ", F.slice("words", F.col("at") - n, F.lit(n)))) for n in range(1, order)}
    at = materialise(at.select("row", *[g.alias(f"g{n}") for n, g in grams.items()], *[g.alias(f"b{n}") for n, g in before.items()]), "grams")
    joined = at
    for n in range(1, order + 1):
        counts = materialise(at.where(F.col(f"g{n}").isNotNull()).groupBy(F.col(f"g{n}").alias("gram")).agg(F.count("*").alias("c")), f"counts-{n}")
        for side in ("g", "b") if n < order else ("g",):
            joined = joined.join(counts.select(F.col("gram").alias(f"{side}{n}"), F.col("c").alias(f"c{side}{n}")), f"{side}{n}", "left")
    n_words = at.count()
    score = F.log(F.col("cg1") / F.lit(float(max(1, n_words))))
    for n in range(2, order + 1):
        score = F.when(F.col(f"g{n}").isNull(), score).when(F.col(f"cg{n}") >= cutoff, F.log(F.col(f"cg{n}") / F.col(f"cb{n - 1}"))).otherwise(score + float(np.log(alpha)))
    sums = joined.select("row", score.alias("s")).groupBy("row").agg(F.sum("s").alias("s"))
    return rows.select("doc_id", "row", F.size("words").cast("long").alias("n_words")).join(sums, "row", "left").select("doc_id", "n_words", F.coalesce("s", F.lit(0.0)).alias("log_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stupid_backoff(table(spark, sf_dir, "documents").select("doc_id", "text"), stable=True)
    return out.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"))


_SQL_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"

ORACLE = f"""
with d as (select doc_id, {_SQL_WORDS} as words from documents),
w as (select doc_id, words[spot] as c, case when spot > 1 then words[spot - 1] end as b, case when spot > 2 then words[spot - 2] end as a
      from (select doc_id, words, unnest(range(1, len(words) + 1)) as spot from d)),
c1 as (select c, count(*) as n1 from w group by c), total as (select count(*) as n from w),
c2 as (select b, c, count(*) as n2 from w where b is not null group by b, c),
c3 as (select a, b, c, count(*) as n3 from w where a is not null group by a, b, c),
s as (
  select w.doc_id, case
    when n3 >= {CUTOFF} then ln(n3 / x2.n2)
    when c2.n2 >= {CUTOFF} then ln(c2.n2 / x1.n1) + case when w.a is not null then ln({ALPHA}) else 0 end
    else ln(c1.n1 / total.n) + case when w.a is not null then 2 * ln({ALPHA}) when w.b is not null then ln({ALPHA}) else 0 end end as s
  from w join c1 on c1.c = w.c cross join total
  left join c2 on c2.b = w.b and c2.c = w.c left join c1 x1 on x1.c = w.b
  left join c3 on c3.a = w.a and c3.b = w.b and c3.c = w.c left join c2 x2 on x2.b = w.a and x2.c = w.b)
select d.doc_id, cast(len(d.words) as bigint) as n_words, round(coalesce(t.s, 0.0), 3) as log_score
from d left join (select doc_id, sum(s) as s from s group by doc_id) t on t.doc_id = d.doc_id
"""
