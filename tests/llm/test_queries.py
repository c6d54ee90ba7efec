"""The registered queries and the pipeline on a small corpus with odd rows, against brute force."""

import hashlib
import math
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from hypersurf.llm import decontaminate, language, pieces, queries, toxicity, warc
from hypersurf.llm.work import table

from .test_llm import _classes

SMALL = "/root/testdata/sf0.001"
ODD = [
    (9000, None), (9001, ""), (9002, " \n\t "), (9003, "!!! ..."), (9004, "one two"), (9005, "one two"), (None, "no id at all"), (9006, "é ñ 漢字 \x00 \x85x  y"), (9007, "long words here " * 60_000),
    (9008, "a <|endoftext|> b"), (9009, "same row"), (9009, "same row"), (9010, "one id"), (9010, "and two texts of it"), (9011, "α" * 300), (9012, "ta"),
]
PAGES = [(9000, "http://x.org/a", None), (9001, None, "<p>same"), (9002, "bad:[", "<p>same"), (None, "http://x.org/", "<p>same"), (9003, "http://x.org/b", "y" * 3_000_000), (9003, "http://x.org/b", "y" * 3_000_000), (9004, "http://x.org/c", "")]
#: Names that the operators use themselves.
CLASHES = ("size", "score", "predicted", "cost", "lang_pred", "key", "node", "root", "copy", "digest", "bands", "part", "block", "ids", "body", "image", "at", "words", "seed", "row")


def _write(folder, rows, pages, labels, benchmark):
    docs = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array([r[2] for r in rows], pa.string()), "source": pa.array(["s"] * len(rows), pa.string()), "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())}
    pq.write_table(pa.table(docs | {c: pa.array([k] * len(rows), pa.int32()) for k, c in enumerate(CLASHES)}), f"{folder}/documents.parquet")
    pq.write_table(pa.table({"page_id": pa.array([r[0] for r in pages], pa.int64()), "url": pa.array([r[1] for r in pages], pa.string()), "html": pa.array([r[2] for r in pages], pa.string()), "offset": pa.array([1] * len(pages), pa.int32())}), f"{folder}/pages.parquet")
    pq.write_table(labels, f"{folder}/labels.parquet")
    pq.write_table(benchmark, f"{folder}/benchmark.parquet")
    vectors = [(k % 300, [((k * 31 + i * 17) % 97 - 48) / 64 for i in range(64)]) for k in range(360)] if rows else []
    odd = [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 63 + [None]), (904, [0.5] * 63 + [math.nan]), (905, [math.inf] + [0.5] * 63), (None, [0.25] * 64), (None, [-0.25] * 64), *[(906, [-0.001] * 64)] * 50]
    vectors += odd if rows else []
    pq.write_table(pa.table({"vec_id": pa.array([v[0] for v in vectors], pa.int64()), "embedding": pa.array([v[1] for v in vectors], pa.list_(pa.float32())), "cluster": pa.array(["x"] * len(vectors))}), f"{folder}/embeddings.parquet")


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    read = lambda name: pq.read_table(f"{SMALL}/{name}.parquet")
    rows = [tuple(r.values()) for r in read("documents").select(["doc_id", "text", "lang"]).to_pylist()] + [(i, t, None) for i, t in ODD]
    pages = [tuple(r.values()) for r in read("pages").select(["page_id", "url", "html"]).to_pylist()] + PAGES
    _write(folder, rows, pages, read("labels"), read("benchmark"))
    return folder, rows, pages


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    _write(folder, [], [], pq.read_table(f"{SMALL}/labels.parquet").slice(0, 0), pq.read_table(f"{SMALL}/benchmark.parquet").slice(0, 0))
    return folder


def _remainder(i, m):
    return None if i is None else zlib.crc32(str(i).encode()) % m


def _sorted(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", ["op11_clusters", "op12_resampling"])
def test_query_equals_its_sql_on_odd_rows(spark, corpus, empty, name):
    for folder in (corpus[0], empty):
        db = duckdb.connect()
        for t in ("documents", "benchmark", "embeddings"):
            db.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
        got = queries.QUERIES[name](spark, folder)
        want = db.sql(f"select {', '.join(got.columns)} from ({queries.ORACLES[name]})").fetchall()
        assert _sorted(map(tuple, got.collect())) == _sorted(want) and bool(want) == (folder == corpus[0])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_every_query_is_registered():
    assert {f"op{n}_" for n in range(1, 14)} == {f"{q.split('_')[0]}_" for q in queries.QUERIES} and entry.queries()["pipeline"] is corpus_pipeline.run
    assert queries.QUERIES.keys() <= entry.queries().keys() and queries.ORACLES.keys() <= entry.oracle_sql().keys()


def test_op1(spark, corpus):
    folder, rows, _ = corpus
    got = queries.QUERIES["op1_toxicity"](spark, folder).collect()
    assert _sorted((r.doc_id, r.held_out) for r in got) == _sorted((i, _remainder(i, 3) == 1) for i, *_ in rows)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    model = toxicity.fit(table(spark, folder, "documents"), table(spark, folder, "labels"))
    want = model.score(pa.array([t for _, t, _ in rows], pa.large_string()))
    assert np.allclose(sorted(r.score for r in got), sorted(want), atol=1e-5)


def test_op2(spark, corpus):
    folder, rows, _ = corpus
    known = [(i, t) for i, t, _ in rows if i is not None]
    got = queries.QUERIES["op2_minhash"](spark, folder).collect()
    assert _sorted(map(tuple, got)) == _sorted([*((i, c) for (i, _), c in zip(known, _classes(known), strict=True)), (None, None)])


@pytest.mark.parametrize("name", ["op3_decontaminate", "op4_backoff"])
def test_op3_and_op4_equal_their_sql(spark, corpus, name):
    folder, rows, _ = corpus
    ids = [i for i, *_ in rows]
    db = duckdb.connect()
    # The SQL tells documents apart by their ids.
    db.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet') where doc_id is not null and doc_id not in (9009, 9010)")
    db.execute(f"create view benchmark as select * from read_parquet('{folder}/benchmark.parquet')")
    got = queries.QUERIES[name](spark, folder)
    if name == "op3_decontaminate":
        want = db.sql(f"select {', '.join(got.columns)} from ({queries.ORACLES[name]})").fetchall()
        assert want and _sorted(map(tuple, got.collect())) == _sorted(want)
        return
    docs = table(spark, folder, "documents")
    from hypersurf.llm import backoff

    assert got.count() == len(ids)
    scored = {r.doc_id: r for r in backoff.stupid_backoff(docs.where("doc_id is not null and doc_id not in (9009, 9010)")).collect()}
    for i, n, s in db.sql(f"select doc_id, n_words, log_score from ({queries.ORACLES[name]})").fetchall():
        assert scored[i].n_words == n and math.isclose(scored[i].log_score, s, abs_tol=0.01)


def test_op5(spark, corpus):
    folder, _, pages = corpus
    got = queries.QUERIES["op5_warc"](spark, folder).collect()
    ids = {}
    for i, _, html in pages:
        ids.setdefault(html or "", []).append(i)
    want = []
    for i, _, html in pages:
        own = ids[html or ""]
        first = min((x for x in own if x is not None), default=None)
        revisit = first is not None and i != first
        want.append((i, len((html or "").encode()), warc.base32_sha1((html or "").encode()), "revisit" if revisit else "response", first if revisit else None))
    assert _sorted(map(tuple, got)) == _sorted(want)


def test_op6(spark, corpus):
    folder, rows, _ = corpus
    got = queries.QUERIES["op6_media"](spark, folder).collect()
    assert _sorted(r.doc_id for r in got) == _sorted(i for i, *_ in rows)
    texts, seen = {}, {}
    for i, t, _ in rows:
        texts.setdefault(i, set()).add(t or "")
    for r in got:
        body = [t.encode() for t in texts[r.doc_id] if len(t.encode()) == r.n_bytes]
        padded = [b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b)) for b in body]
        own = next(p for p in padded if hashlib.sha256(p).hexdigest() == r.payload_sha256)
        assert (r.payload_bytes, r.tail_crc32) == (len(own), zlib.crc32(own[-64:])) and r.media_bytes > len(own)
        assert r.tiles == -(-len(own) // 64 // 4096) or -(-(len(own) // 64) // 4096) == r.tiles
        # The feature of the whole image at once, by plain means over the boxes.
        image = np.frombuffer(own, np.uint8).reshape(-1, 64).astype(float)
        y, x = np.linspace(0, image.shape[0], 9), np.linspace(0, 64, 10)
        cover = lambda edges, n: np.clip(np.minimum(edges[1:, None], np.arange(1, n + 1)) - np.maximum(edges[:-1, None], np.arange(n)), 0, 1)
        small = np.round(cover(y, image.shape[0]) @ image @ cover(x, 64).T / ((y[1] - y[0]) * (x[1] - x[0])), 6)
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(r.feature), np.uint8)).reshape(8, 8).astype(bool)
        clear = np.abs(np.diff(small, axis=1)) > 1e-5
        assert ((small[:, 1:] > small[:, :-1]) == bits)[clear].all()
        seen.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.feature, r.media_bytes))
    assert all(len(x) == 1 for x in seen.values()) and max(r.tiles for r in got) > 3


def test_op7(spark, corpus):
    folder, rows, _ = corpus
    got = queries.QUERIES["op7_language"](spark, folder).collect()
    assert _sorted((r.doc_id, r.held_out) for r in got) == _sorted((i, _remainder(i, 5) == 0) for i, *_ in rows)
    model = language.fit(table(spark, folder, "documents"))
    langs, scores, _ = model.predict([t for _, t, _ in rows], model.code_table())
    assert _sorted((r.doc_id, r.lang_pred, round(r.score, 6)) for r in got) == _sorted((i, k, round(float(s), 6)) for (i, *_), k, s in zip(rows, langs, scores, strict=True))
    for (_, t, _), k, s in zip(rows, langs, scores, strict=True):
        letters = any(c.isalpha() for c in t or "")
        assert (k == "und") == (not letters) and (letters or s == 0) and 0 <= s <= 1
    known = [(k, lang) for (_, t, lang), k in zip(rows, langs, strict=True) if lang and len(t or "") > 40]
    assert sum(a == b for a, b in known) > 0.97 * len(known)


def test_op8(spark, corpus):
    import public_tokenizers
    import tiktoken

    folder, rows, _ = corpus
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pieces.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = []
    for i, t, _ in rows:
        ids = plain.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = queries.QUERIES["op8_pieces"](spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert _sorted(map(tuple, got)) == _sorted(want)


def test_op9(spark, corpus):
    folder, rows, _ = corpus
    got = queries.QUERIES["op9_shards"](spark, folder).collect()
    assert _sorted((r.doc_id, r.size, r.text_crc32) for r in got) == _sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)} and {r.shard for r in got} <= set(range(8))
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    groups = {}
    for r in got:
        groups.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(x) == 1 for x in groups.values())


def test_op10(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    folder, rows, _ = corpus
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 0]) for i, x, _ in rows]
    got = sorted(queries.QUERIES["op10_token_file"](spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in ids), key=lambda i: (i is not None, i))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert _sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == _sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)


def test_pipeline_against_brute_force(spark, corpus):
    import public_tokenizers
    import tiktoken

    folder, rows, _ = corpus
    got = corpus_pipeline.run(spark, folder)
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    left = [r for r, s in zip(rows, model.score(pa.array([t for _, t, _ in rows], pa.large_string())), strict=True) if s < toxicity.THRESHOLD]
    assert 0 < len(left) < len(rows)
    stored = spark.createDataFrame(left, "doc_id long, text string, lang string")
    parser = language.fit(stored)
    langs, _, costs = parser.predict([t for _, t, _ in left], parser.code_table())
    left = [r for r, k, c in zip(left, langs, costs, strict=True) if k != "und" and c <= parser.bounds[k]]
    known = [(i, t) for i, t, _ in left if i is not None]
    first, kept = {}, [(i, t) for i, t, _ in left if i is None]
    for (i, t), c in sorted(zip(known, _classes(known), strict=True), key=lambda x: x[0][0]):
        if i != 9010 or t != "one id":  # two classes of one id
            first.setdefault((c, t if i == 9010 else None), (i, t))
    kept += [*first.values(), (9010, "one id")]
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", [r for r in kept if r[0] is not None])
    db.execute(f"create view benchmark as select * from read_parquet('{folder}/benchmark.parquet')")
    leaked = {r[0] for r in db.sql(f"select doc_id from ({decontaminate.ORACLE}) where overlap >= {decontaminate.REJECT_OVERLAP}").fetchall()}
    assert leaked
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pieces.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = []
    for i, t in kept:
        if i is None or i not in leaked:
            ids = plain.encode_ordinary(t)
            want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert _sorted(map(tuple, got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == _sorted(want)


def test_pipeline_keeps_columns_and_takes_empty_tables(spark, corpus, empty):
    folder, _, _ = corpus
    docs = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name != "near_duplicates":
            assert stage(spark, docs, folder).schema == docs.schema, name
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_op13(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    folder, rows, _ = corpus
    got = queries.QUERIES["op13_token_counts"](spark, folder).collect()
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    counts = {t: len(encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows}
    assert _sorted(map(tuple, got)) == _sorted((i, len((t or "").encode()), counts[t], counts[t] > 1024) for i, t, _ in rows)
