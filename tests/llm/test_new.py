"""Clusters, resampling and token counts: their parts against plain code."""

import hashlib
import math
import os
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hypersurf.llm import clusters, resampling, token_counts


def _nearest(points, centroids):
    return [min(range(len(centroids)), key=lambda k: (sum((a - b) ** 2 for a, b in zip(p, centroids[k], strict=True)), k)) for p in points]


@settings(max_examples=80, deadline=None)
@given(st.data())
def test_ball_tree_assigns_as_a_scan_does(data):
    size, most = data.draw(st.integers(1, 4)), data.draw(st.sampled_from([2, 40, 1 << 27]))
    vector = st.lists(st.integers(-most, most), min_size=size, max_size=size)
    points = data.draw(st.lists(vector, min_size=1, max_size=60))
    points += points[: data.draw(st.integers(0, 40))]
    centroids = data.draw(st.lists(vector, min_size=1, max_size=6))
    tree, order = clusters.BallTree.build(np.array(points, np.int64), leaf=3)
    again = clusters.BallTree.unpack(*tree.pack(), size)
    want = [_nearest(points, centroids)[i] for i in order]
    assert again.nearest(np.array(centroids, np.int64)).tolist() == want
    counts, sums = tree.totals(np.array(centroids, np.int64))
    assert counts.tolist() == [want.count(k) for k in range(len(centroids))]
    assert sums.tolist() == [[sum(points[i][c] for i, w in zip(order, want, strict=True) if w == k) for c in range(size)] for k in range(len(centroids))]


def test_whole_balls_are_assigned_without_their_leaves():
    r = np.random.default_rng(3)
    points = np.concatenate([r.integers(-9, 9, (500, 8)) + 1000 * k for k in range(4)])
    centroids = np.arange(4)[:, None] * 1000 + np.zeros((4, 8), np.int64)
    tree, _ = clusters.BallTree.build(points)
    whole, (places, _) = tree.filter(centroids)
    assert not len(places) and sum(len(b) for b, _ in whole) == 4 and len(tree.nodes) > 30


def test_bad_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 3e9])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        clusters.whole_vectors(df, 2).collect()
    assert clusters.cluster(df.withColumn("embedding", F.expr("array(1D, 2D)")), size=2, count=5).first()[1:5] == (0, 0, 0, 0)


def _plain_buckets(text, grams, buckets):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return len(words), [[crc32(" ".join(words[i : i + n]).encode()) % buckets for i in range(len(words) - n + 1)] for n in range(1, grams + 1)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(["a", "B1", "é", "漢字", "x-y", " "]), max_size=30).map(" ".join)), max_size=6), st.integers(1, 4), st.sampled_from([7, 10_000, 100_003]))
def test_buckets_equal_plain_hashes(texts, grams, buckets):
    sizes, by_length = resampling.block_buckets([t.encode() for t in texts], grams, buckets)
    plain = [_plain_buckets(t, grams, buckets) for t in texts]
    assert sizes.tolist() == [n for n, _ in plain]
    assert [[x.tolist() for x in column] for column in by_length] == [[p[k] for _, p in plain] for k in range(grams)]


def test_resampling_prefers_the_target(spark):
    docs = [(k, " ".join(["apple pie" if k % 4 == 0 else "steel rod"] * 15 + [f"w{k}"])) for k in range(400)]
    target = spark.createDataFrame([(1, "apple pie " * 50)], "doc_id long, text string")
    rows = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), target).collect()
    drawn = sorted((r.rank, r.doc_id) for r in rows if r.rank)
    assert drawn == list(enumerate((r.doc_id for r in sorted(rows, key=lambda r: (-r.score, r.doc_id))[:100]), 1))
    assert Counter(i % 4 for _, i in drawn)[0] > 85  # the noise lets a few others in
    h = int(hashlib.sha256(b"7:8").hexdigest()[:8], 16)
    one = next(r for r in rows if r.doc_id == 8)
    assert one.score == one.weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]
TEXTS = [None, "", " ", "A quick test.", "a quick test.", "a  quick test.", "<|endoftext|>", "<|ENDOFTEXT|>", "x<|endoftext|> y", "e\u0301 é", "word " * 5000, "漢字", "a quick test."]


def _encode(path):
    if path.endswith("model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).encode
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda t: tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
def test_counts_come_from_the_cache(spark, tmp_path, name, monkeypatch):
    import public_tokenizers

    path, cache = public_tokenizers.path(name), str(tmp_path / "cache")
    docs = spark.createDataFrame([(k if k else None, t) for k, t in enumerate(TEXTS)], "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    encode, held = _encode(path), lambda: spark.read.schema(token_counts.CACHE).option("recursiveFileLookup", "true").parquet(cache)
    want = sorted(((k if k else None, len((t or "").encode()), len(encode(t or "")), len(encode(t or "")) > 1024) for k, t in enumerate(TEXTS)), key=str)
    run = lambda d, **more: sorted(map(tuple, token_counts.token_counts(d, path, cache, **more).collect()), key=str)
    assert run(docs.where("doc_id < 8")) == [r for r in want if r[0] and r[0] < 8]
    first = held().count()
    runs = len(os.listdir(cache))
    for most in (0, 100):  # misses found by a join, then none left
        assert run(docs, broadcast=most) == want
    assert len(os.listdir(cache)) == runs + 1 and first < held().count() == held().select("digest").distinct().count() <= len(set(map(str, TEXTS)))
    more = docs.unionByName(docs.limit(1).withColumn("text", F.lit("new words")).withColumn("doc_id", F.lit(99).cast("long")))
    before = held().count()
    assert run(more)[-1] == (99, 9, len(encode("new words")), False) or len(run(more)) == len(want) + 1
    assert held().count() == before + 1  # a miss that was broadcast
    # Stored counts are believed; those of another version aren't.
    held().withColumn("n_tokens", F.lit(7).cast("long")).write.parquet(str(tmp_path / "other/run-1"))
    cache = str(tmp_path / "other")
    assert {r[2] for r in run(docs)} == {7}
    monkeypatch.setattr(token_counts, "version_of", lambda p: "another")
    assert run(docs) == want


def test_empty_documents_append_nothing(spark, tmp_path):
    import public_tokenizers

    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(docs, public_tokenizers.path(NAMES[0]), str(tmp_path / "none")).count() == 0 and not (tmp_path / "none").exists()


def test_numbers_of_tokens_are_of_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path(NAMES[0])
    one, encode = token_counts.Counter(path).count, _encode(path)
    long = "some words, and\n\nlines 12345 " * 20_000
    assert one(long) == len(encode(long)) and pa.array([one("a")]).to_pylist() == [1]
