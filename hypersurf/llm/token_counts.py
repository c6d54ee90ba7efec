"""Token counts of whole texts by a cache of digests.

A text's key is the SHA-256 of its normal form, a tokenizer's version the SHA-256 of its library's name and version and its file's bytes.
The cache is a table (version, digest, n_tokens) in files below a shared folder; it is joined to the texts' keys, only distinct texts
that it lacks are encoded, and their counts are appended to it before all keys are joined to it.

Normal form: null is empty; where a tokenizer has a normalizer of its own, what that leaves of a text around its special strings; else the text itself.

Scale: keys (32 bytes a row) are all that is shuffled of texts that the cache has.  Texts that it lacks are reduced to one a key within each task
before they are shuffled by key, so copies don't meet as rows; up to BROADCAST missing keys are broadcast, so that other texts
stay where they are, and more are found by a join after that reduction.  Keys and the counts of their version are stored, without texts, and
joined as they are read, so that Spark can split a hot key's rows.

Lost executors: counts are appended by Spark's committer, as a folder of its own a run, so the cache never holds half a run; two runs that encode
the same text both append the same count, and readers take one.

Cases: null and empty texts count 0 tokens; very long texts are encoded whole; null ids and repeated rows keep their rows; an empty table gives no rows and
appends nothing; strings of special tokens count as the library takes them by default; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import MOST_CHUNKS, ChunkEncoder, loaded
from .work import materialise, open_fs, release, slices, table, work_dir

#: Tokens over which a text is over the limit; missing keys (of 32 bytes) that may be broadcast.
LIMIT, BROADCAST = 1024, 100_000
#: Setting that names the folder of a cache to keep; without it a query begins one of its own.
SETTING = "hypersurf.token.cache"

CACHE = "version string, digest binary, n_tokens long"


class Counter:
    """Counts tokens as the tokenizers (.json) or the sentencepiece library (.model) does, without added or special tokens."""

    def __init__(self, path: str):
        self.normal: Callable[[str], bytes] | None = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count = lambda text: len(model.encode(text))
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        if tokenizer.normalizer is not None:
            self.normal = _normal_form(tokenizer, path)
        try:
            one = ChunkEncoder(path, MOST_CHUNKS)
            self.count = lambda text: len(one(text)) // 4
        except ValueError:  # not byte-level
            self.count = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def _normal_form(tokenizer, path: str) -> Callable[[str], bytes]:
    """What the normalizer leaves of a text between its added tokens, each of which stands for itself."""
    with open(path, encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f)["added_tokens"]]
    split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else lambda text: [text]

    def normal(text: str) -> bytes:
        parts = [p.encode() if k % 2 else tokenizer.normalizer.normalize_str(p).encode() for k, p in enumerate(split(text))]
        return b"".join(len(p).to_bytes(8, "little") + p for p in parts)

    return normal


def counter(path: str) -> tuple:
    return ("counts", path), lambda: Counter(path)


def version_of(path: str) -> str:
    """Digest of a tokenizer: its library, that one's version, its file."""
    import sentencepiece
    import tokenizers

    library = sentencepiece if path.endswith(".model") else tokenizers
    digest = hashlib.sha256(f"{library.__name__} {library.__version__}\0".encode())
    with open(path, "rb") as f:
        digest.update(f.read())
    return digest.hexdigest()


def keyed(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text (null: empty), n_bytes and digest of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    plain = docs.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    if Counter(path).normal is None:
        return plain.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal = loaded(counter(path)).normal
        for batch in batches:
            for b in slices(batch, "text"):
                yield b.append_column("digest", pa.array([hashlib.sha256(normal(t)).digest() for t in b.column("text").to_pylist()], pa.binary()))
        release()

    return plain.mapInArrow(run, "doc_id long, text string, n_bytes long, digest binary")


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """digest and n_tokens that the cache has for a tokenizer, once each."""
    store, base = open_fs(cache)
    if store.get_file_info(base).type.name == "NotFound":
        return spark.createDataFrame([], "digest binary, n_tokens long")
    found = spark.read.schema(CACHE).option("recursiveFileLookup", "true").parquet(cache)
    return found.where(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def append_missing(texts: DataFrame, keys: DataFrame, path: str, cache: str, broadcast: int = BROADCAST) -> None:
    """Encodes the distinct texts (text, digest) of keys (digest) that the cache lacks and appends their counts."""
    version = version_of(path)
    held = read_cache(keys.sparkSession, cache, version)
    texts, missing = texts.select("digest", "text"), None
    if not held.isEmpty():
        missing = keys.select("digest").distinct().join(held, "digest", "left_anti")
        few = missing.limit(broadcast + 1).count()
        if not few:
            return
        if few <= broadcast:
            texts, missing = texts.join(F.broadcast(missing), "digest", "left_semi"), None
    elif keys.isEmpty():
        return
    each = texts.groupBy("digest").agg(F.first("text").alias("text"))
    if missing is not None:
        each = each.join(held, "digest", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = loaded(counter(path)).count
        for batch in batches:
            for b in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array([version] * b.num_rows, pa.string()), b.column("digest"), pa.array([count(t) if t else 0 for t in b.column("text").to_pylist()], pa.int64())], ["version", "digest", "n_tokens"])
        release()

    each.mapInArrow(run, CACHE).write.parquet(f"{cache.rstrip('/')}/run-{uuid.uuid4().hex[:12]}")


def token_counts(docs: DataFrame, path: str, cache: str, limit: int = LIMIT, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of docs (doc_id, text) by a tokenizer's file; cache: a folder that all machines share."""
    texts = keyed(docs, path)
    keys = materialise(texts.drop("text"), "keys")
    append_missing(texts, keys, path, cache, broadcast)
    counts = materialise(read_cache(docs.sparkSession, cache, version_of(path)), "counts")
    return keys.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cache = spark.conf.get(SETTING, None) or work_dir(spark, "token-cache")
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)
