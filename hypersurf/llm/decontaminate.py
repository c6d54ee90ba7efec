"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A mask is a row of 1 and 0; its seed at a place of a text is the hash of the words under the 1s, so words under a 0
may differ.  An item that is shorter than the shortest mask has one seed, of all its words.  Seeds of the documents are joined with those of the
benchmark; around each hit the document is laid beside the item at that offset, and the best stretch scores +1 a equal word and
MISS a differing one.  A stretch of MIN_OVERLAP (or the whole of a shorter item) is an overlap; so is an item of fewer than SHORT words of which SHARE per cent
are the same words at their places, as edits would leave such an item no long stretch.

Scale: seeds are made and probed in one pass over the documents; a seed's row holds its hash, its place and the document's key, never the
words.  The benchmark's seeds (40 bytes each) are stored and counted first, and sent to every executor if there are at most BROADCAST_SEEDS;
more are joined by shuffle.  Only distinct (document, item, offset) are left after that, and are stored and counted too: the words
of their documents come from a second pass, to which they are sent if there are at most BROADCAST_HITS, else by shuffle.

Cases: null or empty texts and items have no overlap; very long texts are read whole, a row a place; repeated items or documents give one row a pair of ids, the best of the texts
of an id; rows with null ids give no pair; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import materialise, table

#: The masks' rows of words that count (1) and that may differ (0).
MASKS = ("1110111", "11011011", "101111")
MIN_OVERLAP, MISS, BROADCAST_SEEDS, BROADCAST_HITS = 10, -2, 500_000, 200_000
#: Words up to which (exclusive) an item is judged by its share of equal words too, and that share in per cent.
SHORT, SHARE = 20, 80
#: Equal words that an overlap needs to make the pipeline reject a document: fewer are no evidence, as the one word of an item may be in any clean text.
REJECT_OVERLAP = 5


def words(text: str) -> Column:
    """Lower case runs of letters and digits; a text without any has the single word ''."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def short_masks(sizes: list[int], masks: tuple[str, ...] = MASKS) -> tuple[str, ...]:
    """Masks of 1s for items of these sizes, of those that no mask fits in."""
    return tuple("1" * n for n in sorted(set(sizes)) if 0 < n < min(map(len, masks)))


def seeds(df: DataFrame, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """df (with the array `words`) with a row a seed: `at`, its place, and `seed`, its hash."""
    least = min(map(len, masks))
    places = df.withColumn("at", F.explode(F.expr(f"if(size(words) >= {least} and words[0] <> '', sequence(0, size(words) - {least}), cast(array() as array<int>))")))
    each = []
    for mask in masks:
        under = [F.get("words", F.col("at") + i) for i, m in enumerate(mask) if m == "1"]
        each.append(F.when(F.col("at") + len(mask) <= F.size("words"), F.xxhash64(F.lit(mask), *under)))
    return places.withColumn("seed", F.explode(F.array(*each))).where("seed is not null")


def item_seeds(items: DataFrame, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """seed, item, place of the items (item, words): by the masks, or one of all words for an item that none fits in."""
    least, every = min(map(len, masks)), []
    for part, own in ((f"size(words) >= {least}", masks), *((f"size(words) = {n}", ("1" * n,)) for n in range(1, least))):
        every.append(seeds(items.where(part), own).select("seed", "item", F.col("at").alias("place")))
    out = every[0]
    for x in every[1:]:
        out = out.unionByName(x)
    return out.distinct()


def laid_out(document: str, item: str, start: str, miss: int = MISS) -> Column:
    """best: highest sum over a stretch of the item's words, 1 where the document has the same word at `start` plus its place, else miss; same: how many are the same."""
    same = f"coalesce(get({document}, {start} + k) = {item}[k], false)"
    return F.expr(f"""aggregate(sequence(0, size({item}) - 1), named_struct('run', 0, 'best', 0, 'same', 0),
        (a, k) -> named_struct(
            'run', greatest(0, a.run + if({same}, 1, {miss})),
            'best', greatest(a.best, a.run + if({same}, 1, {miss})),
            'same', a.same + if({same}, 1, 0)))""")


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_overlap: int = MIN_OVERLAP, broadcast_seeds: int = BROADCAST_SEEDS, broadcast_hits: int = BROADCAST_HITS) -> DataFrame:
    """doc_id, item_id, overlap (score of the best stretch) and same (most equal words) of docs (doc_id, text) against benchmark (item_id, text)."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), words("text").alias("words")).where("words[0] <> ''")
    items = materialise(items.distinct().withColumn("item", F.xxhash64("item_id", "words")), "items")
    least = min(map(len, masks))
    short = short_masks([r[0] for r in items.where(F.size("words") < least).select(F.size("words")).distinct().collect()], masks)
    known = materialise(item_seeds(items, masks), "benchmark-seeds")
    if known.count() <= broadcast_seeds:
        known = F.broadcast(known)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text")
    cut = texts.select("doc_id", "copy", words("text").alias("words"))
    hits = seeds(cut, (*masks, *short)).select("doc_id", "copy", "at", "seed").join(known, "seed")
    hits = materialise(hits.select("doc_id", "copy", "item", (F.col("at") - F.col("place")).alias("start")).distinct(), "hits")
    n_hits = hits.count()
    pairs = hits.join(items.select("item", "item_id", F.col("words").alias("item_words")), "item")
    hit = hits.select("doc_id", "copy").distinct()
    found = texts.join(F.broadcast(hit) if n_hits <= broadcast_hits else hit, ["doc_id", "copy"], "left_semi").dropDuplicates(["doc_id", "copy"]).select("doc_id", "copy", words("text").alias("words"))
    scored = pairs.join(found, ["doc_id", "copy"]).select("doc_id", "item_id", F.size("item_words").alias("size"), laid_out("words", "item_words", "start").alias("laid"))
    # The threshold is on a row, not on the best of an id: texts of an id may differ in size.
    scored = scored.select("doc_id", "item_id", "size", "laid.best", "laid.same")
    kept = scored.where((F.col("best") >= F.least(F.lit(min_overlap), F.col("size"))) | ((F.col("size") < SHORT) & (100 * F.col("same") >= SHARE * F.col("size"))))
    return kept.groupBy("doc_id", "item_id").agg(F.max("best").cast("int").alias("overlap"), F.max("same").cast("int").alias("same"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "overlap")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejects documents that overlap with a benchmark item by REJECT_OVERLAP equal words or more; a shorter item, however often it occurs, is no leak."""
    gone = overlaps(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).where(F.col("same") >= REJECT_OVERLAP).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def _sql_seeds(source: str, masks: tuple[str, ...], where: str = "true") -> str:
    parts = []
    for mask in masks:
        under = " || ' ' || ".join(f"words[spot + {i + 1}]" for i, m in enumerate(mask) if m == "1")
        parts.append(f"select id, spot, '{mask} ' || {under} as seed from (select id, words, unnest(range(0, len(words) - {len(mask) - 1})) as spot from {source} where len(words) >= {len(mask)} and {where})")
    return " union all ".join(parts)


_SQL_WORDS = r"str_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')"

_LEAST = min(map(len, MASKS))
_SHORT = tuple("1" * n for n in range(1, _LEAST))

ORACLE = f"""
with d as (select distinct doc_id as id, {_SQL_WORDS} as words from documents where doc_id is not null),
b as (select * from (select distinct item_id as id, {_SQL_WORDS} as words from benchmark where item_id is not null) where words[1] <> ''),
bseed as (select distinct * from ({_sql_seeds("b", MASKS)} union all {" union all ".join(_sql_seeds("b", (m,), f"len(words) = {len(m)}") for m in _SHORT)})),
dseed as ({_sql_seeds("d", MASKS)} union all {" union all ".join(_sql_seeds("d", (m,), f"exists (select 1 from b where len(b.words) = {len(m)})") for m in _SHORT)}),
laid as (select distinct x.id as doc_id, y.id as item_id, x.spot - y.spot as start from dseed x join bseed y on x.seed = y.seed),
cells as (
  select doc_id, item_id, start, len(b.words) as size, k,
    case when start + k >= 0 and start + k < len(d.words) and d.words[start + k + 1] = b.words[k + 1] then 1 else {MISS} end as s
  from laid join d on d.id = doc_id join b on b.id = item_id, unnest(range(0, len(b.words))) as t(k)),
sums as (select *, sum(s) over (partition by doc_id, item_id, start order by k) as total from cells),
runs as (select *, total - least(0, coalesce(min(total) over (partition by doc_id, item_id, start order by k rows between unbounded preceding and 1 preceding), 0)) as run from sums),
best as (select doc_id, item_id, start, any_value(size) as size, max(run) as overlap, count(*) filter (s = 1) as same from runs group by all)
select doc_id, item_id, cast(max(overlap) as integer) as overlap from best
where overlap >= least({MIN_OVERLAP}, size) or (size < {SHORT} and 100 * same >= {SHARE} * size) group by doc_id, item_id
"""
