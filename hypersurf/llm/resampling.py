"""Importance resampling of documents towards a target by hashed n-gram features.

Features: texts, BLOCK_BYTES together (or one longer text), get an integer dictionary of their distinct words.  An n-gram is a tuple of ids (the
number of its first n - 1 words' tuple, the id of its last word); each distinct tuple's bytes are put together and hashed once, and the
tuples' places bring the bucket back to every occurrence, and so to every document.  The features of a document are stored as buckets, once.

The dictionary is a block's and not the corpus's, as the buckets, and so all results, are the same with either: a global one would shuffle each block's
words and tuples both ways, several times the input.  Nothing here is shuffled by word: what leaves a task is a document's buckets, and
counts a bucket, of which there are `buckets` in all.  Only these reach the driver and are broadcast.

Scores are native expressions on documents' totals, ranks are running numbers by ranges of scores (operators/numbering.py).

Cases: null and empty texts, and texts without words, have no features and weight 0; very long texts are read whole, as a block of their own; a null
id is hashed as the text `null` and ranks after others of its score; rows of one id are scored each by its own text, equal rows get different ranks; an empty
table gives no rows; an empty target draws by gains that only discount frequent features; other columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import running_numbers
from .work import materialise, release, slices, table

#: Longest run of words, buckets, scale of logarithms, salt, words of a document that can be drawn, per cent drawn.
GRAMS, BUCKETS, SCALE, SALT, LEAST_WORDS, PERCENT = 2, 10_000, 1000, "7", 20, 25
#: Text bytes that share a dictionary.
BLOCK_BYTES = 8 << 20

#: Bytes as words see them: A-Z lowered, what is neither a letter, a digit nor part of a longer character a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

FEATURES = "doc_id long, n_words long, n_features long, buckets binary"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def block_buckets(texts: list[bytes], grams: int = GRAMS, buckets: int = BUCKETS) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Words of each text, and for each length of n-gram the buckets of each text's n-grams."""
    ids_of: dict[bytes, int] = {}
    ids, ends = array("I"), []
    for text in texts:
        ids.extend([ids_of.setdefault(w, len(ids_of)) for w in words_of(text)])
        ends.append(len(ids))
    word, ends = np.frombuffer(ids, np.uint32).astype(np.int64) if len(ids) else np.zeros(0, np.int64), np.array(ends, np.int64)
    sizes = np.diff(ends, prepend=0)
    hashes, spaced = [crc32(w) for w in ids_of], [b" " + w for w in ids_of]
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    tuples, out = word, []
    for n in range(1, grams + 1):
        if n > 1:
            # tuples[i]: number of the distinct tuple of the n - 1 words from place i on, of whatever text.
            pairs, tuples = np.unique(tuples[: len(word) - n + 1] * len(spaced) + word[n - 1 :], return_inverse=True)
            hashes = [crc32(spaced[j], hashes[i]) for i, j in zip((pairs // len(spaced)).tolist(), (pairs % len(spaced)).tolist(), strict=True)] if len(pairs) else []
        at = (np.array(hashes, np.int64) % buckets).astype(kind)[tuples]
        out.append([at[e - s : max(e - s, e - n + 1)] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)])
    return sizes, out


def features(docs: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """Stored doc_id, n_words, n_features and buckets (numbers of 2 or 4 bytes) of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", BLOCK_BYTES):
                sizes, by_length = block_buckets([t or b"" for t in b.column("text").to_pylist()], grams, buckets)
                rows = [np.concatenate(x) for x in zip(*by_length, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes), pa.array([len(r) for r in rows], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], [x.split()[0] for x in FEATURES.split(", ")])
        release()

    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, FEATURES), "features")


def _flat(batch: pa.RecordBatch, buckets: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Some rows, and their buckets one after another."""
    for b in slices(batch, "buckets"):
        yield b, np.frombuffer(b"".join(b.column("buckets").to_pylist()), "<u2" if buckets <= 1 << 16 else "<u4")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, flat in _flat(batch, buckets):
                counts += np.bincount(flat, minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["bucket", "n"])
        release()

    out = np.zeros(buckets, np.int64)
    for r in found.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Scaled logarithm of each bucket's smoothed share in the target over that in the source, floored."""
    every, wanted, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(scale * math.log(float(t + 1) * float(every + n) / (float(s + 1) * float(wanted + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """found (see features) with weight, the floored mean of its features' gains, instead of the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, flat in _flat(batch, len(gain)):
                counts = b.column("n_features").to_numpy()
                sums = np.diff(np.concatenate([[0], np.cumsum(gain[flat])])[np.concatenate([[0], np.cumsum(counts)])])
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(sums // np.maximum(counts, 1))], ["doc_id", "n_words", "n_features", "weight"])
        release()

    return found.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, scale: int = SCALE, salt: str = SALT, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of docs (doc_id, text): the per cent of highest scores is drawn."""
    found, wanted = features(docs, grams, buckets), features(target, grams, buckets)
    gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets), scale)
    share = f"(conv(substring(sha2(concat('{salt}:', coalesce(cast(doc_id as string), 'null')), 256), 1, 8), 16, 10) + 0.5D) / 4294967296D"
    scored = weighed(found, gain).withColumn("score", F.expr(f"weight + cast(floor(-{scale}D * ln(-ln({share}))) as bigint)"))
    enough = F.col("n_words") >= least_words
    drawn = percent * found.where(enough).count() // 100
    numbered = running_numbers(scored.where(enough), [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight"], "rank")
    ranked = numbered.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))


def _grams(name: str, columns: str) -> str:
    return f"""{name}w as (select {columns}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from {name}),
{name}f as (select r, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) as f from {name}w),
{name}n as (select r, f, count(*) as n from {name}f group by r, f)"""


_TABLE = "c0 as (select i, i as c from range(256) x(i)), " + ", ".join(f"c{k + 1} as (select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end as c from c{k})" for k in range(8)) + ", crc as (select list(c order by i) as t from c8)"
ORACLE = f"""with d as (select row_number() over () as r, doc_id, text from documents), b as (select row_number() over () as r, text from benchmark),
{_grams("d", "r, doc_id")},
{_grams("b", "r")},
{_TABLE},
each as (select distinct f from (select f from dn union all select f from bn)),
bytes as (select f, hex(encode(f)) as h from each),
code as (select f, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda k: cast('0x' || substring(h, 2 * k + 1, 2) as bigint))),
  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % {BUCKETS} as bucket from bytes, crc),
s as (select bucket, cast(sum(n) as double) as s from dn join code using (f) group by bucket), t as (select bucket, cast(sum(n) as double) as t from bn join code using (f) group by bucket),
total as (select (select coalesce(sum(s), 0) from s) as a, (select coalesce(sum(t), 0) from t) as z),
gain as (select bucket, cast(floor({SCALE} * ln((coalesce(t, 0) + 1) * (a + {BUCKETS}) / ((s + 1) * (z + {BUCKETS})))) as bigint) as g from s left join t using (bucket), total),
w as (select r, cast(sum(n) as bigint) as n_features, cast(sum(n * g) as bigint) as g from dn join code using (f) join gain using (bucket) group by r),
scored as (select r, doc_id, len(dw.w) as n_words, coalesce(n_features, 0) as n_features, coalesce((g - ((g % n_features) + n_features) % n_features) // n_features, 0) as weight,
  cast('0x' || substring(sha256('{SALT}:' || coalesce(cast(doc_id as varchar), 'null')), 1, 8) as bigint) as h from dw left join w using (r)),
final as (select *, weight + cast(floor(-{SCALE} * ln(-ln((h + 0.5::double) / 4294967296))) as bigint) as score from scored),
placed as (select *, row_number() over (partition by n_words >= {LEAST_WORDS} order by score desc, doc_id nulls last, n_features, weight) as place, count(*) filter (n_words >= {LEAST_WORDS}) over () as n from final)
select doc_id, cast(n_features as bigint) as n_features, cast(weight as bigint) as weight, cast(score as bigint) as score, case when n_words >= {LEAST_WORDS} and place <= {PERCENT} * n // 100 then place end as rank from placed"""
