import hashlib
import io
import random
import re
import struct
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hypersurf.llm import backoff, components, decontaminate, language, media, minhash, pieces, sharding, token_file, toxicity, warc, words

DOCS = "doc_id long, text string, lang string, source string, n_chars int, size int, score int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2) for i, t in rows], DOCS)


def _texts(seed=5, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.randint(8, 60))) for _ in range(n)]


ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "!!! ..."), (904, "one two"), (905, "one two"), (None, "no id at all"), (906, "é ñ 漢字 \x00 \x85x  y"), (907, "long " * 5000)]


@pytest.fixture(scope="module")
def docs(spark):
    return _docs(spark, [*enumerate(_texts()), *ODD]).repartition(3).cache()


def test_sharding(spark, docs):
    rows = sharding.shard(docs, 5).collect()
    texts = {i: t or "" for i, t in [*enumerate(_texts()), *ODD]}
    assert len(rows) == len(texts)
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 1
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    assert len({r.shard for r in rows if r.doc_id in (904, 905)}) == 1
    for s in range(5):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    groups = {}
    for i, t in texts.items():
        first, size = groups.get(t, (1 << 60, 0))
        groups[t] = min(first, -(1 << 62) if i is None else i), size + len(t.encode()) + 1
    order = [s for _, s in sorted(groups.values())]

    def fits(capacity):
        used, held = 1, 0
        for s in order:
            if s > capacity:
                return False
            if held + s > capacity:
                used, held = used + 1, 0
            held += s
        return used <= 5

    assert max(sum(r.size for r in rows if r.shard == s) for s in range(5)) == next(c for c in range(sum(order) + 1) if fits(c))
    assert sharding.shard(docs.limit(0), 5).count() == 0


def test_token_file_random_access():
    out, ids = io.BytesIO(), [np.random.default_rng(3).integers(0, 1 << b, n) for b, n in ((8, 700), (16, 1300), (31, 40), (4, 0), (9, 1))]
    writer = token_file.TokenFileWriter(out, 512)
    for k, x in enumerate(ids):
        writer.add(k, x)
    writer.close()
    f, flat = token_file.TokenFile(out), np.concatenate(ids)
    assert [f[i] for i in range(0, len(flat), 7)] == flat[::7].tolist()
    assert all((x == y).all() for (_, _, x), y in zip(f.documents(), ids, strict=True))
    with pytest.raises(IndexError):
        f[len(flat)]


SPECIAL = [(920, "<|endoftext|>"), (921, "a  <|endoftext|> b<|endoftext|><|endoftext|>c"), (922, "  <|endoftext|>  \n x "), (923, "ends <|endoftext|>")]
PIECES = [*ODD, *SPECIAL, (904, "one two"), (904, "other text, same id"), (930, "\u2003a \u00a0 b\u200b \x1c c\x85 d  "), (931, "it's don't  WE'LL 12three\u00b2 \u0301x"), (932, " "), (933, "tab\t end ")]


def test_pieces(spark):
    import public_tokenizers
    import tiktoken

    rows = [*enumerate(_texts()), *PIECES]
    docs = _docs(spark, rows).repartition(3)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pieces.read_ranks(ranks), special_tokens={})
    want = sorted(((i, tuple(plain.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows), key=str)
    got = pieces.decode(pieces.encode(docs, pieces.rank_encoder(ranks, public_tokenizers.PATTERN), public_tokenizers.PATTERN, 2000), ranks).collect()
    assert sorted(((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got), key=str) == want
    hashed = sorted((str(i), len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t).hexdigest()) for i, x, t in want)
    stored = docs.cache()
    assert sorted((str(r.doc_id), *r[1:]) for r in pieces.digests(stored, stable=True).collect()) == hashed
    assert pieces.digests(docs.limit(0)).count() == 0
    with pytest.raises(Exception, match="changed between two passes"):
        unstable = docs.withColumn("text", F.udf(lambda: f"x{random.random()}")())
        pieces.digests(unstable, stable=True).collect()


def test_windows_of_long_documents():
    old, pieces.WINDOW = pieces.WINDOW, 4
    try:
        got = list(pieces._windows(np.array([0, 0, 3, 4, 15, 15, 16])))
    finally:
        pieces.WINDOW = old
    assert got == [(0, 4, 0, 4), (4, 5, 4, 8), (4, 5, 8, 12), (4, 5, 12, 15), (5, 7, 15, 16)]


def test_long_documents_are_hashed_in_stretches(spark, monkeypatch):
    texts = ["word " * 700_000 + "end", "x" * 3, "", "many words here " * 100_000]
    got = {r.doc_id: r for r in pieces.digests(_docs(spark, [*enumerate(texts)]).coalesce(1)).collect()}
    for i, t in enumerate(texts):
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert got[0].n_tokens > pieces.WINDOW


def test_token_files(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [*enumerate(_texts()), *PIECES]
    docs = _docs(spark, rows).repartition(3)
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    encoded = [(i, t.encode(x or "", add_special_tokens=False).ids) for i, x in rows]
    assert any(50256 in ids for _, ids in encoded)
    for most in (0, 400_000):
        got = pieces.encode_in_place(docs, pieces.tokenizer_encoder(path, most)).collect()
        assert sorted(((r.doc_id, list(r.ids)) for r in got), key=str) == sorted(encoded, key=str)
    files = token_file.token_files(docs, path, str(tmp_path / "f"), range_bytes=3000, segment=500, file_ids=1500)
    assert len(files) > 8
    got = sorted(token_file.read_token_files(spark, files).collect(), key=lambda r: r.start)
    start, flat = 0, []
    for r, (i, ids) in zip(got, sorted(encoded, key=lambda x: (x[0] is not None, x[0])), strict=True):
        if i != 904:
            assert tuple(r) == (i, start, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes()))
        start += r.n_tokens
    assert sorted(r.ids_crc32 for r in got if r.doc_id == 904) == sorted(zlib.crc32(np.array([*ids, 0], "<u4").tobytes()) for i, ids in encoded if i == 904)
    ends = {r.id for r in token_file.tokens_at(spark.createDataFrame([(r.start + r.n_tokens - 1,) for r in got], "place long"), files).collect()}
    assert ends == {0}
    by_start = {r.start: encoded_ids for r in got for i, encoded_ids in encoded if i == r.doc_id and i != 904 and encoded_ids}
    heads = token_file.tokens_at(spark.createDataFrame([*((k,) for k in by_start), (-1,), (start,), (None,)], "place long"), files).collect()
    assert {r.place: r.id for r in heads if r.id is not None} == {k: v[0] for k, v in by_start.items()}
    assert sum(r.id is None for r in heads) == 3
    assert token_file.read_token_files(spark, token_file.token_files(docs.limit(0), path, str(tmp_path / "none"))).count() == 0
    assert all((pieces.unpack_ids(pieces.pack_ids(np.array(x, np.uint32))) == x).all() for x in ([], [1, 65535], [65536, 0]))


def test_loser_tree_and_urls():
    r = random.Random(1)
    for k in (0, 1, 2, 3, 7, 8):
        runs = [sorted(r.randint(0, 30) for _ in range(r.randint(0, 20))) for _ in range(k)]
        assert list(warc.loser_tree_merge(runs)) == sorted(x for run in runs for x in run)
    assert warc.url_key("HTTPS://www.Example.org:443/A?b=1#c") == "org,example)/a?b=1"


def test_warc(spark, tmp_path):
    rows = [(3, "http://a.com/x", "same", 1), (1, "http://b.com/y", "same", 1), (2, None, None, 1), (5, "http://a.com/x", "", 1), (None, "bad:[", "same", 1), (4, "http://a.com/a b", "other", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, offset int")
    folder = str(tmp_path / "w")
    merged = warc.merge_index(warc.write_archives(pages, folder, roll_bytes=300), folder)
    got = warc.read_archives(merged).collect()
    by_id = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert (by_id[3].record_type, by_id[3].refers_to, by_id[1].record_type, by_id[5].refers_to) == ("revisit", 1, "response", 2)
    for i, _, html, _ in rows:
        assert by_id[i].payload_bytes == len(html or "") and by_id[i].payload_digest == warc.base32_sha1((html or "").encode())
    keys = [(r.urlkey, r.ts) for r in got]
    assert keys == sorted(keys)
    assert warc.read_archives(warc.merge_index(warc.write_archives(pages.limit(0), str(tmp_path / "e")), folder)).count() == 0


def test_external_merge_of_many_runs(spark, tmp_path):
    r, folder = random.Random(3), str(tmp_path / "w")
    rows = [(k if k % 97 else None, f"http://h{r.randrange(40)}.org/{r.randrange(30)}", r.choice(["same", "twice", f"own {k}", "x" * 3000]), 1) for k in range(900)] + [(5, "http://h1.org/", "same", 1)] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rows int").repartition(7)
    payloads = {}
    for k, _, html, _ in rows:
        payloads.setdefault(html, []).append(k)
    want = []
    for k, _, html, _ in rows:
        known = [x for x in payloads[html] if x is not None]
        first = min(known) if known else None
        revisit = k is not None and len(payloads[html]) > 1 and k != first
        want.append((k, len(html), warc.base32_sha1(html.encode()), "revisit" if revisit else "response", first if revisit else None))
    for most, fan_in in ((1000, 128), (0, 4)):
        runs = warc.write_archives(pages, f"{folder}{most}", roll_bytes=5000, run_rows=40, broadcast_digests=most)
        assert runs.select("path").distinct().count() > 20
        index = warc.merge_index(runs, f"{folder}{most}", fan_in=fan_in, range_rows=100)
        assert index.rdd.getNumPartitions() > 5
        keys = [warc._capture(x) for x in index.collect()]
        assert len(keys) == len(rows) and keys == sorted(keys)
        got = warc.read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_media(spark, docs):
    pixels = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert (media.decode_image(b"P6\n# c\n4 2\n255\n" + pixels.tobytes()) == pixels).all()
    assert (media.decode_image(b"P3 4 2 255 " + " ".join(map(str, pixels.ravel())).encode()) == pixels).all()
    assert media.decode_image(b"P1 3 1 101").tolist() == [[1, 0, 1]] == media.decode_image(b"P4 3 1\n\xa0").tolist()
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + 24, 0, 54, 40, 4, -2, 1, 24, 0, 24, 0, 0, 0, 0) + pixels[:, :, ::-1].tobytes()
    assert (media.decode_image(bmp) == pixels).all()
    image = np.random.default_rng(0).integers(0, 256, (16, 18)).astype(np.uint8)
    assert np.allclose(media.resize(image, 8, 9), image.reshape(8, 2, 9, 2).mean((1, 3)))
    assert (media.from_npy(media.to_npy(pixels)) == pixels).all()
    tiles = media.decode_images(media.payload_image(docs).select("doc_id", "image"), "doc_id", "image", 64).collect()
    assert {r.key for r in tiles} == set(range(60)) | {i for i, _ in ODD}
    whole = b"".join(media.from_npy(r.npy).tobytes() for r in sorted((r for r in tiles if r.key == 907), key=lambda r: r.tile_y))
    assert whole.rstrip(b"\0") == ODD[-1][1].encode() and len(whole) % 64 == 0
    assert media.decode_images(spark.createDataFrame([(1, b"junk"), (2, None)], "k int, i binary"), "k", "i").where("npy is null").count() == 2


def test_language(spark):
    a, b = " ".join(_texts(1, 40)), " ".join(t.translate(str.maketrans("abcdefgh", "stuvwxyz")) for t in _texts(2, 40))
    rows = [(i, x[i * 40 : i * 40 + 300], k, 0) for k, x in (("aa", a), ("zz", b)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, cost int")
    model = language.fit(docs)
    assert language.predict(docs.drop("cost"), model).where("lang_pred <> lang").count() == 0
    odd = {r.doc_id: r for r in language.predict(_docs(spark, ODD).select("doc_id", "text"), model).collect()}
    assert odd[900].lang_pred == odd[901].lang_pred == odd[903].lang_pred == "und" and odd[904].lang_pred in ("aa", "zz")
    none = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.predict(docs.select("doc_id", "text"), none).collect()} == {"und"}


def test_language_of_large_alphabets():
    r = random.Random(8)
    many = ["".join(chr(0x4E00 + r.randrange(900)) for _ in range(r.randint(1, 3))) for _ in range(1500)]
    texts = {"han": " ".join(r.choice(many) for _ in range(4000)), "aa": " ".join(_texts(1, 40)), "zz": " ".join(_texts(2, 40)).translate(str.maketrans("abcdefgh", "stuvwxyz"))}
    model = language.Model(texts)
    asked = [" ".join(r.choice(many) for _ in range(60)), " ".join(_texts(1, 2)), "".join(chr(0x3B1 + r.randrange(17)) for _ in range(200)), "".join(chr(0xAC00 + r.randrange(900)) for _ in range(200))]
    langs, _, costs = model.predict(asked, model.code_table())
    assert langs[:2] == ["han", "aa"] and costs[0] <= model.bounds["han"] and costs[1] <= model.bounds["aa"] == language.STRANGE
    assert all(costs[i] > model.bounds[langs[i]] for i in (2, 3))
    small = language.Model({k: texts[k] for k in ("aa", "zz")})
    phrases = model.costs(asked, model.code_table())[1][:, [0, 2]] / model.bits
    assert np.allclose(small.costs(asked, small.code_table())[1] / small.bits, phrases)


def test_language_learns_of_every_part_of_a_text(spark):
    r = random.Random(2)
    long = " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(6000))
    few = spark.createDataFrame([(1, long[:9000], "aa", 1), (2, "end of it", "aa", 1)], "doc_id long, text string, lang string, at int")
    model = language.fit(few)
    whole = model.costs([long[:9000], long[4000:4500]], model.code_table())[1][:, 0] / model.bits
    assert whole[0] < 40 and whole[1] < 3
    docs = spark.createDataFrame([(1, long, "aa", 1), *((k, "same words " * 5, "aa", 1) for k in range(2, 400))], "doc_id long, text string, lang string, at int")
    assert 15_000 < 2 ** language.fit(docs, pieces=300).bits < 60_000  # the long text has 36 of 434 pieces, from anywhere in it
    assert language.fit(docs, pieces=300).bits == language.fit(docs.repartition(5), pieces=300).bits


def test_a_language_with_little_text_wins_nothing(spark):
    a, b = _texts(1, 40), [t.translate(str.maketrans("abcdefgh", "stuvwxyz")) for t in _texts(2, 40)]
    rows = [*((k, t, "aa") for k, t in enumerate(a)), *((100 + k, t, "zz") for k, t in enumerate(b)), (501, "quite other words", "xx"), (502, "quite other words", "xx"), (503, "quite", "xx")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.names == ["aa", "xx", "zz"]
    codes = model.code_table()
    asked = [*a[:5], *b[:5], "same text here", "word " * 200_000, "hgfedc babab", "quite other words"]
    langs, scores, _ = model.predict(asked, codes)
    assert langs[:10] == ["aa"] * 5 + ["zz"] * 5 and langs[12:] == ["aa", "xx"]
    assert model.predict(["1234 !"], codes)[0] == ["und"] and all(0 <= x <= 1 for x in scores)
    # Letters of no language cost all of them alike: the first by name, far above the bound of strange texts.
    assert model.predict(["\u03b1\u03b2\u03b3" * 20], codes)[0] == ["aa"] and model.predict(["\u03b1\u03b2\u03b3" * 20], codes)[2][0] > language.STRANGE


def test_language_stage_keeps_columns_and_short_texts(spark):
    a = _texts(1, 60)
    docs = spark.createDataFrame([*((k, t, "aa", "s", 1.5, k) for k, t in enumerate(a)), (900, a[3], "aa", "s", 1.5, 3), (900, a[3], "aa", "s", 1.5, 3), (901, None, None, "s", 1.5, 3), (902, "12", None, "s", 1.5, 3), (903, "\u03b1" * 500, None, "s", 1.5, 3), (904, a[5].split()[0], "aa", "s", 1.5, 3), (None, a[7], "aa", "s", 1.5, 3)], "doc_id long, text string, lang string, source string, score double, cost int")
    left = language.keep_known(spark, docs, "")
    assert left.schema == docs.schema
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([*range(60), 900, 900, 904, None], key=str)
    assert language.keep_known(spark, docs.limit(0), "").count() == 0


def test_automaton_counts_phrases():
    classes = np.random.default_rng(2).integers(0, 4, 300)
    table, text = language.Automaton(classes).parser(), np.random.default_rng(3).integers(0, 5, 200).tolist()
    state = phrases = 0
    for c in text:
        got = table[state, c]
        state, phrases = got >> 1, phrases + (got & 1)
    known, want, held = "".join(map(str, classes)), 0, ""
    for c in map(str, text):
        if held + c in known:
            held += c
        else:
            want, held = want + 1, c if c in known else ""
    assert phrases == want


def test_toxicity(spark):
    r = random.Random(4)
    texts = _texts(6, 240)
    toxic = [i % 3 == 0 for i in range(240)]
    texts = [t + " zzvile" + r.choice("abc") + " tail word" if bad else t for t, bad in zip(texts, toxic, strict=True)]
    docs = _docs(spark, [*enumerate(texts), *ODD])
    labels = spark.createDataFrame([(i, int(x)) for i, x in enumerate(toxic)] + [(None, 1), (7, None), (5000, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels)).collect()}
    assert sum(got[i].predicted == int(toxic[i]) for i in range(240)) > 225
    assert got[900].score == got[901].score == 0 and all(0 <= r.score <= 1 for r in got.values())
    flat = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r.score for r in toxicity.score(docs.select("doc_id", "text"), flat).collect()} == {0.0}


def _plain_network(net, x, words):
    """Logits by loops over windows and words, from the published equations of gated recurrent units."""
    p, h, out = {k: v.astype(float) for k, v in net.p.items()}, toxicity.HIDDEN, []
    for row in words:
        own = [w for w in row if w < len(x) - 1]
        states = {}
        for k in "fb":
            state, held = np.zeros(h), {}
            for t, w in list(enumerate(own)) if k == "f" else list(reversed(list(enumerate(own)))):
                g, hu = x[w].astype(float) @ p[f"W{k}"] + p[f"c{k}"], state @ p[f"U{k}"]
                z, r = (1 / (1 + np.exp(-(g[i * h : (i + 1) * h] + hu[i * h : (i + 1) * h]))) for i in (0, 1))
                state = (1 - z) * np.tanh(g[2 * h :] + r * hu[2 * h :]) + z * state
                held[t] = state
            states[k] = held
        all_of = [np.concatenate([states["f"][t], states["b"][t], x[w].astype(float)]) for t, w in enumerate(own)]
        weight = np.exp([v @ p["q"] for v in all_of])
        out.append(sum(a * (v @ p["w"]) for a, v in zip(weight / weight.sum(), all_of, strict=True)) + p["b"][0])
    return np.array(out)


def test_network_equals_plain_equations_and_its_gradients_finite_differences():
    r = np.random.default_rng(3)
    corpus = toxicity.Corpus(pa.array(["some words make a window of text and one more word here " * 2, "short text", "others say other things in this third text, too"]))
    words_, _ = corpus.windows()
    odds = tuple(r.standard_normal(toxicity.SLOTS).astype(np.float32) for _ in range(2))
    net = toxicity.Network(5)
    for k in net.p:
        net.p[k] = (net.p[k] + 0.2 * r.standard_normal(net.p[k].shape)).astype(np.float32)
    inputs = lambda: corpus.inputs(np.arange(corpus.n), odds, (net.p["Ew"], net.p["Ec"]))
    assert np.allclose(net.forward(inputs(), words_), _plain_network(net, inputs(), words_), atol=1e-4)
    target = np.arange(len(words_)) % 2

    def loss():
        p = 1 / (1 + np.exp(-_plain_network(net, inputs(), words_)))
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).mean()

    grads = net.gradients(corpus, odds, words_, target)
    for name, g in grads.items():
        for at in np.argsort(-np.abs(g).ravel())[:3]:
            kept, old = net.p[name], float(net.p[name].ravel()[at])
            sides = []
            for step in (2e-3, -2e-3):
                kept.ravel()[at] = old + step
                sides.append(loss())
            kept.ravel()[at] = old
            assert abs((sides[0] - sides[1]) / 4e-3 - g.ravel()[at]) < 2e-3 + 0.03 * abs(g.ravel()[at]), name


def test_recurrent_states_matter_beside_the_log_odds():
    """Word order decides: the log odds of every word are the same in both classes, so only the states can tell them apart."""
    r = random.Random(8)
    fill = [f"w{k}" for k in range(40)]

    def text(toxic):
        own = [r.choice(fill) for _ in range(12)]
        at = r.randrange(9)
        own[at : at + 2] = ["alpha", "omega"] if toxic else ["omega", "alpha"]
        return " ".join(own)

    labels = np.arange(1200) % 2
    corpus = toxicity.Corpus(pa.array([text(x) for x in labels]))
    words_, _ = corpus.windows()
    odds = tuple(np.zeros(toxicity.SLOTS, np.float32) for _ in range(2))
    net, pick = toxicity.Network(3), np.random.default_rng(4)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    for step in range(1, 501):
        own = pick.integers(0, 800, 64)
        for k, g in net.gradients(corpus, odds, words_[own], labels[own]).items():
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            net.p[k] -= (0.03 * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    right = lambda: ((net.forward(corpus.inputs(np.arange(corpus.n), odds, (net.p["Ew"], net.p["Ec"])), words_[800:]) > 0) == labels[800:]).mean()
    learned = right()
    for k in "fb":
        net.p[f"W{k}"][:] = net.p[f"U{k}"][:] = net.p[f"c{k}"][:] = 0
    assert learned > 0.9 and right() < 0.65


def test_toxicity_of_odd_rows_and_all_windows(spark):
    r = random.Random(4)
    texts = _texts(6, 240)
    texts = [t + (" zzvile" + r.choice("abc") if i % 3 == 0 else "") for i, t in enumerate(texts)]
    docs = _docs(spark, [*enumerate(texts)])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    long = " ".join(_texts(7, 200))
    rows = [(1, long), (2, f"{long} zzvilea zzvileb {long}"), (3, f"{long} {long} zzvilec zzvilea"), (4, None), (4, None), (5, "zzvilea zzvileb"), (5, "zzvilea zzvileb"), (None, "zzvilea zzvilec")]
    got = toxicity.score(_docs(spark, rows).select("doc_id", "text"), model).collect()
    assert sorted(((x.doc_id, x.predicted) for x in got), key=str) == sorted([(1, 0), (2, 1), (3, 1), (4, 0), (4, 0), (5, 1), (5, 1), (None, 1)], key=str)
    assert toxicity.score(docs.select("doc_id", "text").limit(0), model).count() == 0
    empty = toxicity.fit(docs.limit(0), labels)
    assert {x.score for x in toxicity.score(docs.select("doc_id", "text"), empty).collect()} == {0.0}


def _edit(text, at):
    parts = text.split()
    parts[at] = "changed"
    return " ".join(parts)


def test_near_duplicates(spark):
    base = " ".join(_texts(9, 4))
    rows = [*enumerate(_texts()), (100, base), (101, _edit(base, 3)), (102, _edit(base, 40)), (103, base), (104, _edit(_edit(base, 3), 60)), *ODD]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(_docs(spark, rows).select("doc_id", "text")).collect()}
    sets = {i: set(zip(*(w[k:] for k in range(5)), strict=False)) or {tuple(w)} for i, t in rows if i is not None and (w := words.split_words(pa.array([t]))[0].tolist() and " ".join((t or "").lower().split()).split())}
    root = {i: i for i in got}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert got == root
    assert minhash.near_duplicates(_docs(spark, rows[:0]).select("doc_id", "text")).count() == 0


def test_near_duplicates_that_repeat_a_line(spark):
    rows = []
    for k in range(12):
        own = [f"w{k}x{i}" for i in range(60)]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own + own[50:] * 20))]
    got = minhash.near_duplicates(_docs(spark, rows).select("doc_id", "text")).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: i - i % 2 for i, _ in rows}


def _shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return set(zip(*(w[k:] for k in range(5)), strict=False)) or ({tuple(w)} if w else set())


def _classes(rows, least=0.8):
    """Class of each row by brute force."""
    sets, root = [_shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            same = rows[a][1] == rows[b][1] and rows[a][1]
            if root[a] != root[b] and (same or sets[a] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])):
                x, y = root[a], root[b]
                root = [y if r == x else r for r in root]
    return [min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in root]


def test_near_duplicates_lose_no_link_at_any_similarity(spark):
    r, rows, bins = random.Random(21), [], {}
    vocabulary = [f"v{k}" for k in range(4000)]
    footer = " ".join(r.choice(vocabulary) for _ in range(30))
    for k in range(150):
        base = [r.choice(vocabulary) for _ in range(r.randint(60, 160))]
        copy = list(base)
        for _ in range(r.randint(0, 5)):
            copy[r.randrange(len(copy))] = r.choice(vocabulary)
        x, y = (" ".join(t) + (f" {footer}" if k % 3 == 0 else "") for t in (base, copy))
        rows += [(2 * k, x), (2 * k + 1, y)]
        a, b = _shingles(x), _shingles(y)
        bins.setdefault(min(19, int(20 * len(a & b) / len(a | b))), []).append(2 * k)
    want = _classes(rows)
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(_docs(spark, rows).select("doc_id", "text")).collect()}
    for share in (16, 17, 18, 19):  # each bin of a twentieth from 0.8 on has pairs, and all of them are found
        assert bins[share] and all(got[k] == got[k + 1] for k in bins[share])
    assert [got[k] for k, _ in rows] == want


def test_rows_that_share_an_id(spark):
    base = " ".join(_texts(9, 4))
    rows = [(1, base), (2, base), (2, "quite another text with more than five words"), (3, _edit(base, 9)), (4, _edit(base, 30)), (4, _edit(base, 30)), (5, None), (5, ""), (6, ""), (None, base), (None, base), (7, "!!!"), (8, "!!!"), (9, "?")]
    docs = _docs(spark, rows).withColumn("bands", F.lit(1)).withColumn("node", F.lit("x")).withColumn("_3", F.lit(2)).withColumn("copy", F.rand(3)).cache()
    got = sorted(map(tuple, minhash.near_duplicates(docs).collect()))
    assert got == [(1, 1), (2, 1), (2, 2), (3, 1), (4, 1), (4, 1), (5, 5), (5, 5), (6, 6), (7, 7), (8, 7), (9, 9)]
    left = minhash.keep_one(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(1, base), (2, rows[2][1]), (5, None), (5, ""), (6, ""), (None, base), (None, base), (7, "!!!"), (9, "?")], key=str)
    same = minhash.keep_one(spark, _docs(spark, [(4, base)] * 5 + [(4, _edit(base, 3)), (6, base)]), "").collect()
    assert len(same) == 1 and same[0].doc_id == 4
    assert minhash.keep_one(spark, docs.limit(0), "").count() == 0


def test_hot_copies_and_chains(spark):
    r = random.Random(5)
    words_ = [f"w{k}" for k in range(400)]
    chain = [r.choice(words_) for _ in range(100)]
    rows = []
    for k in range(60):  # each is near the one before it, the first and the last are not
        rows.append((k, " ".join(chain)))
        chain[r.randrange(100)] = f"new{k}"
    rows += [(1000 + k, "one and the same text for a third of all rows here") for k in range(80)]
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(_docs(spark, rows).select("doc_id", "text")).collect()}
    assert [got[k] for k, _ in rows] == _classes(rows)


def test_shingles_are_held_a_few_texts_at_a_time():
    r = random.Random(11)
    words_of = [f"w{k}" for k in range(5000)]
    long, short = [" ".join(r.choices(words_of, k=3000)) for _ in range(250)], ["one two three four five six"] * 250
    n, peaks = pa.array(range(250)), []
    for run, batch in (
        (minhash.sketch_batches, pa.record_batch({"doc_id": n, "copy": n, "digest": pa.array(long), "text": pa.array(long)})),
        (minhash.similar_pairs, pa.record_batch({"a": n, "b": n, "ta": pa.array(short), "tb": pa.array(long)})),
        (minhash.similar_pairs, pa.record_batch({"a": n, "b": n, "ta": pa.array(long), "tb": pa.array(long)})),
    ):
        tracemalloc.start()
        got = [b.num_rows for b in run(iter([batch]))]
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
        assert len(got) > 3
    assert sum(got) == 250 and max(peaks) < 60, peaks


def test_prob_minhash_estimates():
    x, y = {1: 3.0, 2: 1.0, 3: 2.0, 9: 1.0}, {1: 1.0, 2: 1.0, 3: 2.0, 8: 4.0}
    won = minhash.prob_minhash(np.array([0] * 4 + [1] * 4), words.mixed(np.array([*x, *y], np.uint64)), np.array([*x.values(), *y.values()]), 2, 20_000)
    want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())
    assert abs((won[0] == won[1]).mean() - want) < 0.02


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200), (300, 301), (301, 302)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 300: 300, 301: 300, 302: 300}


def test_decontaminate(spark):
    import duckdb

    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    changed = _edit(_edit(item, 4), 10)
    rows = [(1, "before " + item + " after"), (2, changed), (3, "quite other words here"), (4, "alpha beta gamma delta epsilon"), (5, "Alpha, BETA; gamma delta epsilon zeta eta theta iota kappa"), (5, item), *ODD]
    bench = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "", 1), (10, "too short", 1), (None, item, 1)], "item_id long, text string, overlap int")
    for most in (0, 1000):
        got = {(r.doc_id, r.item_id): r.overlap for r in decontaminate.overlaps(_docs(spark, rows), bench, broadcast_seeds=most, broadcast_hits=most).collect()}
        assert got.keys() == {(1, 7), (2, 7), (5, 7)} and got[1, 7] == 14
    # A short item is found by its share of equal words, whatever stretch they leave; half of it isn't.
    apart = _edit(_edit(changed, 6), 8)
    assert decontaminate.overlaps(_docs(spark, [(2, changed)]), bench, min_overlap=100).first()[2:] == (8, 12)
    assert decontaminate.overlaps(_docs(spark, [(2, apart)]), bench).count() == 0
    assert decontaminate.overlaps(_docs(spark, []), bench).count() == decontaminate.overlaps(_docs(spark, rows), bench.limit(0)).count() == 0
    # Short items, repeated words, long texts, repeated rows and items, against the SQL.
    r = random.Random(12)
    rows = [(k, " ".join(r.choice("abc") for _ in range(r.randint(0, 40)))) for k in range(40)] + [(100, "x " * 3000 + item + " y" * 3000), (101, "so five words are enough"), (101, "so five words are enough"), (102, "One!"), (103, None), (104, ""), (105, "b a b c a b c"), (106, "a a b b c c a a b b c c a"), (107, "c c a a b b c c a x b b c c a a b b c c")]
    items = [(1, "a b c a b"), (2, "five words are enough"), (3, "one"), (4, item), (4, item), (5, "a a b b c c a a b b c c a"), (6, next(t for _, t in rows if len(t.split()) > 25)), (7, "nowhere at all"), (8, ""), (9, None)]
    db = duckdb.connect()
    for name, data, columns in (("documents", rows, "doc_id bigint, text varchar"), ("benchmark", items, "item_id bigint, text varchar")):
        db.execute(f"create table {name} ({columns})")
        db.executemany(f"insert into {name} values (?, ?)", data)
    want = sorted(set(db.sql(f"select doc_id, item_id, overlap from ({decontaminate.ORACLE})").fetchall()))
    assert {1, 2, 3, 4, 5, 6} == {x[1] for x in want} and (101, 2, 4) in want
    for most in (0, 100_000):
        got = decontaminate.overlaps(_docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), broadcast_seeds=most, broadcast_hits=most)
        assert sorted(tuple(x) for x in got.select("doc_id", "item_id", "overlap").collect()) == want


def test_leaks_of_short_items_are_rejected(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = _docs(spark, [(1, "x one two three four five six other eight nine ten eleven twelve y"), (2, "one two three other five six seven eight nine other eleven twelve"), (3, "one two x x x three four x x five six x seven"), (4, None)])
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(spark, docs, str(tmp_path)).collect()) == [3, 4]


def test_one_word_items_reject_no_document(spark, tmp_path):
    spark.createDataFrame([(1, "the"), (2, "five words make a leak")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = _docs(spark, [(1, "the words"), (2, "here five words make a leak"), (2, "the same id"), (None, "five words make a leak")])
    left = decontaminate.drop_contaminated(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "five words make a leak"), (1, "the words")]


def test_backoff(spark):
    import math
    import re
    from collections import Counter

    rows = [*enumerate(_texts()), *ODD, (7, _texts()[7]), (7, "same id, other words"), *((2000 + k, "a b a b a a c " * k) for k in range(6))]
    docs = _docs(spark, rows).repartition(3)
    lists = [(i, re.findall(r"[^\W_]+", (t or "").lower())) for i, t in rows]
    counts = Counter(tuple(w[k : k + n]) for _, w in lists for n in (1, 2, 3) for k in range(len(w) - n + 1))
    total = sum(len(w) for _, w in lists)

    def part(gram):
        if len(gram) == 1:
            return counts[gram] / total
        return counts[gram] / counts[gram[:-1]] if counts[gram] >= 2 else 0.4 * part(gram[1:])

    want = sorted((str(i), len(w), round(sum(math.log(part(tuple(w[max(0, k - 2) : k + 1]))) for k in range(len(w))), 6)) for i, w in lists)
    for got in (backoff.stupid_backoff(docs, block_words=200, part_grams=500), backoff.stupid_backoff_rows(docs)):
        found = sorted((str(r.doc_id), r.n_words, round(r.log_score, 6)) for r in got.collect())
        assert [x[:2] for x in found] == [x[:2] for x in want] and [x[2] for x in found] == pytest.approx([x[2] for x in want], abs=1e-5)
    assert backoff.stupid_backoff(docs.limit(0)).count() == backoff.stupid_backoff_rows(docs.limit(0)).count() == 0
    with pytest.raises(Exception, match="changed between two passes"):
        backoff.stupid_backoff(docs.withColumn("text", F.udf(lambda: f"x{random.random()} y")()), stable=True).collect()


def test_hash_of_whole_texts(spark, docs):
    key = hashlib.sha256(ODD[-1][1].encode()).hexdigest()
    assert minhash.sketch(docs).where(f"digest = '{key}'").count() == 1


def test_toxicity_without_words_to_learn_from(spark):
    for texts in (["", "!!", "", ".."], ["", ""]):
        model = toxicity.Model(texts, [k % 2 for k in range(len(texts))], 0.5)
        got = model.score(pa.array(["hello world", "", None], pa.string()))
        assert got.tolist() == [0.0, 0.0, 0.0]


def test_toxicity_learns_one_bounded_text_of_an_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "Model", lambda texts, toxic, share: seen.append((texts, toxic.tolist(), share)))
    ids = [k for k in range(30) if zlib.crc32(str(k).encode()) % 3 != 1][:4]
    docs = _docs(spark, [*[(ids[0], "a b")] * 50, (ids[0], "a a"), (ids[1], "x" * (toxicity.TEXT_BYTES + 1)), (ids[2], None), (ids[3], "c")])
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
    toxicity.fit(docs, labels)
    assert sorted(zip(*seen[0][:2], strict=True)) == [("", 0), ("a a", 0), ("c", 1)] and seen[0][2] == 0.5


def test_chunks_are_cut_at_once():
    import time

    from hypersurf.llm import pieces

    for text in ("", " ", "a", "a b", " a  b \n c ", "\n x", "x  y  ", "a  b 　c"):
        first, rest = pieces.tails(text)
        assert [first, *(f" {x}" for x in rest)] == pieces.chunks(text)
    text = "some words of a text " * 20_000 + "end"

    def seconds(f) -> float:
        start = time.process_time()
        f(text)
        return time.process_time() - start

    assert min(seconds(pieces.tails) for _ in range(9)) < min(seconds(pieces.chunks) for _ in range(9))
