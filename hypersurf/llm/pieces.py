"""Byte-level BPE by a global shuffle of distinct words.

Split: each block of documents (BLOCK_BYTES of text, or one longer document) is cut into pre-tokens with positions; of each block the
distinct pre-tokens, dealt into buckets by hash, are one stream, the sequence of their places another.  Encode: buckets are
shuffled, so that each distinct word of the corpus meets in one task, which encodes it once.  Join back: each block
gets its words' ids and puts them in its sequence's order.  Decoding joins each id with the token-byte table.

Rows travel packed: a row a (block, bucket) with all its words, not a row a pre-token, which would shuffle several
times the input.  A word that is everywhere is one entry a block, so no bucket is hot.  The two streams come from two passes
over the documents, so that neither is stored before its shuffle; each bucket of a block carries a check sum in both, and an input that
changes between the passes is an error.  Buckets grow with the input up to BUCKETS; a task that meets more than MOST_KNOWN
words encodes some again.  Tasks hold one block, or the words of one bucket, and work on WINDOW pre-tokens at a time.
The token-byte table is bounded by the vocabulary.

Cases: null and empty texts have no ids and decode to no bytes; null ids and repeated rows keep their rows; an empty
table gives no rows; strings of special tokens are ordinary text to rank_encoder, and to tokenizer_encoder what they are to the
tokenizers library (their own ids); other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import materialise, partitions, release, slices, table

BLOCK_BYTES, BUCKET_BYTES, BUCKETS, WINDOW, MOST_KNOWN, MOST_CHUNKS = 6 << 20, 16 << 20, 16_384, 1 << 18, 400_000, 1_000_000
PACKED = "block long, bucket int, data binary, docs binary, ends binary, sums binary"
_loaded: dict = {}


def chunks(text: str) -> list[str]:
    """Cuts a text at spaces before characters that are no white space: byte-level pre-tokenizers always begin a piece there."""
    parts = text.split(" ")
    out, held = [], parts[0]
    for part in parts[1:]:
        if part and not part[0].isspace():
            out.append(held)
            held = " " + part
        else:
            held = f"{held} {part}"
    out.append(held)
    return out


def tails(text: str) -> tuple[str, list[str]]:
    """The first of a text's chunks, and the others without the space that each of them begins with."""
    if _ODD(text):
        first, *rest = chunks(text)
        return first, [c[1:] for c in rest]
    first, *rest = text.split(" ")
    return first, rest


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_encoder(path: str, pattern: str):
    """Encodes pre-tokens of the tiktoken library's kind, each by itself."""

    def load():
        import tiktoken

        one = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})._encode_single_piece
        return lambda words: [one(w) for w in words]

    return path, load


def byte_alphabet() -> dict[int, str]:
    """Character of each byte in byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ChunkEncoder:
    """Ids of texts by the tokenizers library, which encodes each distinct chunk once; as bytes of 32-bit ids.

    Byte-level models without a normalizer only.  Strings of added tokens get their own ids, as in the library.
    """

    def __init__(self, path: str, most_known: int):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        kind = form["pre_tokenizer"] or {}
        if form.get("normalizer") or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True):
            raise ValueError("only byte-level tokenizers without a normalizer or a prefix space")
        if any(t[k] for t in form["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("an added token takes in its neighbourhood")
        self.tokenize, self.pre_tokenize, self.most_known = tokenizer.model.tokenize, tokenizer.pre_tokenizer.pre_tokenize_str, most_known
        letters = byte_alphabet()
        self.table, self.space = str.maketrans({chr(b): c for b, c in letters.items()}), letters[32]
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in form["added_tokens"]}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else lambda text: [text]
        outer = self

        class Tails(dict):
            """By chunk without the space before it."""

            def __missing__(self, part: str) -> bytes:
                if part.isalpha():
                    piece = outer.space + (part if part.isascii() else part.encode().decode("latin-1").translate(outer.table))
                    got = outer._ids([piece])
                elif part[-1:] in _MARKS and part[:-1].isalpha():
                    got = self[part[:-1]] + outer._ids([part[-1]])
                else:
                    got = outer._ids([p for p, _ in outer.pre_tokenize(f" {part}")])
                self[part] = got
                return got

        self.tails = Tails()

    def _ids(self, pieces: list[str]) -> bytes:
        return array("I", [t.id for p in pieces for t in self.tokenize(p)]).tobytes()

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        first, rest = tails(text)
        return self._ids([p for p, _ in self.pre_tokenize(first)]) + b"".join(map(self.tails.__getitem__, rest))

    def __call__(self, text: str) -> bytes:
        if len(self.tails) > self.most_known:
            self.tails.clear()
        parts = self.split_added(text)
        return self._plain(text) if len(parts) == 1 else b"".join(self.added.get(p) if k % 2 else self._plain(p) for k, p in enumerate(parts))


#: Marks that are a pre-token of their own after letters.
_MARKS = (".", ",", ";", ":", "!", "?")
#: A space before white space or the end: only then a part between spaces is not a chunk of its own.
_ODD = re.compile(r" (?=\s|\Z)").search


def loaded(encoder: tuple):
    name, load = encoder
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def tokenizer_encoder(path: str, most_known: int = MOST_CHUNKS) -> tuple:
    """Encodes texts by the tokenizers library, add_special_tokens=False."""
    return (path, most_known), lambda: ChunkEncoder(path, most_known)


def pack(values: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, values), np.uint32, len(values))
    return zstandard.compress(len(values).to_bytes(4, "little") + sizes.tobytes() + b"".join(values), 3)


def unpack(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    n = int.from_bytes(raw[:4], "little")
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64)).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends], ends)]  # noqa: B905


def pack_ids(ids: np.ndarray) -> bytes:
    """Ids of 0 to 2^32 - 1 in the fewest of 2 or 4 bytes each, compressed."""
    small = not len(ids) or int(ids.max()) < 1 << 16
    return (b"2" if small else b"4") + zstandard.compress(ids.astype("<u2" if small else "<u4").tobytes(), 1)


def unpack_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data[1:]), "<u2" if data[:1] == b"2" else "<u4").astype(np.uint32)


def split_blocks(docs: DataFrame, pattern: str, buckets: int, block_bytes: int, words_only: bool) -> DataFrame:
    """Packed rows of docs (doc_id, text), for each block: with words_only its words by bucket, else its sequence with bucket -1."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import xxhash
        from pyspark import TaskContext

        find, block = regex.compile(pattern).findall, TaskContext.get().partitionId() << 32
        schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("data", "docs", "ends", "sums"))])
        words: dict[str, int] = {}

        def numbers(chunk: str) -> bytes:
            return array("I", [words.setdefault(w, len(words)) for w in find(chunk)]).tobytes()

        class Memo(dict):
            """Numbers of the words of a chunk, by the chunk without the space before it."""

            def __missing__(self, tail: str) -> bytes:
                got = self[tail] = numbers(f" {tail}")
                return got

        memo = Memo()
        ids, ends, sequence, held = [], [], bytearray(), 0

        def flush() -> pa.RecordBatch:
            names = [w.encode("utf-8", "surrogatepass") for w in words]
            bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in names), np.int64, len(names))
            order = np.argsort(bucket, kind="stable")
            used, starts = np.unique(bucket[order], return_index=True)
            parts = [[names[i] for i in own] for own in np.split(order, starts[1:])] if len(names) else []
            sums = [xxhash.xxh3_64_intdigest(b"\0".join(p)) for p in parts]
            if words_only:
                rows = [(block, b, pack(p), None, None, np.array([c], "<u8").tobytes()) for b, p, c in zip(used.tolist(), parts, sums, strict=True)]
            else:
                place = np.empty(len(order), np.uint32)
                place[order] = np.arange(len(order), dtype=np.uint32)
                at = place[np.frombuffer(sequence, np.uint32)] if len(order) else np.zeros(0, np.uint32)
                rows = [(block, -1, zstandard.compress(at.tobytes(), 3), np.array([x for d in ids for x in (d is None, d or 0)], "<i8").tobytes(), np.array(ends, "<i8").tobytes(), np.array(sums, "<u8").tobytes())]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, schema, strict=True)], schema=schema)

        for batch in batches:
            for b in slices(batch, "text"):
                for doc_id, text in zip(b.column(0).to_pylist(), b.column("text").to_pylist(), strict=True):
                    if text:
                        first, rest = tails(text)
                        got = numbers(first) + b"".join(map(memo.__getitem__, rest))
                        if not words_only:
                            sequence += got
                        del got, rest
                    held += len(text or "")
                    ids.append(doc_id)
                    ends.append(len(sequence) // 4)
                    if held >= block_bytes:
                        yield flush()
                        block, held, words, memo, ids, ends, sequence = block + 1, 0, {}, Memo(), [], [], bytearray()
        if ids:
            yield flush()
        words, memo = {}, {}
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(split, PACKED)


def _windows(ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first text, last + 1, first place, last + 1) of runs of texts of at most WINDOW places, or of stretches of a longer text."""
    k, at = 0, 0
    while k < len(ends):
        stop = max(k + 1, int(np.searchsorted(ends, at + WINDOW, side="right")))
        for low in range(at, max(int(ends[stop - 1]), at + 1), WINDOW) if stop == k + 1 else (at,):
            yield k, stop, low, min(int(ends[stop - 1]), low + WINDOW) if stop == k + 1 else int(ends[stop - 1])
        k, at = stop, int(ends[stop - 1])


def encode(docs: DataFrame, encoder: tuple, pattern: str, block_bytes: int = BLOCK_BYTES, stable: bool = False, finish: Callable | None = None, schema: str = "doc_id long, ids array<int>") -> DataFrame:
    """doc_id and ids (array of int) of docs (doc_id, text); encoder: of rank_encoder.

    docs is read twice: one that isn't read from files as it is (stable) is stored first.  finish: makes other columns (schema) of the
    runs (ids of documents, first document, last + 1, offsets, ids) of a block, instead of the ids.
    """
    docs = docs.select("doc_id", "text") if stable else materialise(docs.select("doc_id", "text"), "texts")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = min(max(partitions(docs.sparkSession), -(-size // BUCKET_BYTES)), BUCKETS)
    finish = finish or _lists

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, known = loaded(encoder), {}
        for b in batches:
            out = []
            for data in b.column("data").to_pylist():
                words = unpack(data)
                if len(known) > MOST_KNOWN:
                    known = {}
                new = [w for w in words if w not in known]
                for w, ids in zip(new, many(new), strict=True):
                    known[w] = array("I", ids).tobytes()
                out.append(pack([known[w] for w in words]))
            none = pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("bucket"), pa.array(out, pa.binary()), none, none, b.column("sums")], [x.split()[0] for x in PACKED.split(", ")])
        known = {}
        release()

    def reassemble(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("bucket", "data", "docs", "ends", "sums")), strict=True), key=lambda r: r[0])
        if rows[0][0] != -1 or b"".join(r[4] for r in rows[1:]) != rows[0][4]:
            raise RuntimeError("the documents changed between two passes; store them first")
        sequence = np.frombuffer(zstandard.decompress(rows[0][1]), np.uint32)
        ids = [None if z else d for z, d in np.frombuffer(rows[0][2], "<i8").reshape(-1, 2).tolist()]
        ends = np.frombuffer(rows[0][3], "<i8")
        words = [w for r in rows[1:] for w in unpack(r[1])]
        sizes = np.fromiter((len(w) // 4 for w in words), np.int32, len(words))
        flat, starts = np.frombuffer(b"".join(words), "<u4"), np.cumsum(sizes, dtype=np.int64) - sizes

        def runs() -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
            for first, last, low, high in _windows(ends):
                own = sequence[low:high]
                each = sizes[own]
                after = np.cumsum(each, dtype=np.int64)
                offsets = np.concatenate([[0], np.concatenate([[0], after])[np.minimum(ends[first:last], high) - low]])
                yield first, last, offsets, flat[np.repeat(starts[own] - after + each, each) + np.arange(after[-1] if len(after) else 0)]

        out = finish(ids, runs())
        release()
        return out

    encoded = split_blocks(docs, pattern, buckets, block_bytes, True).repartitionById(buckets, F.col("bucket")).mapInArrow(encode_words, PACKED)
    return split_blocks(docs, pattern, buckets, block_bytes, False).unionByName(encoded).groupBy("block").applyInArrow(reassemble, schema)


def _lists(ids: list, runs: Iterator) -> pa.Table:
    """doc_id and ids of a block, put together from its runs."""
    values, ends, held = [], np.zeros(len(ids) + 1, np.int64), 0
    for first, last, offsets, own in runs:
        ends[first + 1 : last + 1] = held + offsets[1:]
        values.append(own.astype(np.int32))
        held += len(own)
    flat = pa.array(np.concatenate([np.zeros(0, np.int32), *values]))
    lists = pa.LargeListArray.from_arrays(pa.array(ends), flat) if held >= 1 << 31 else pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "ids": lists})


def encode_in_place(docs: DataFrame, encoder: tuple, bounds: list[int] | None = None) -> DataFrame:
    """doc_id and ids (array of int) of docs (doc_id, text), without a shuffle; encoder: of tokenizer_encoder.

    With bounds: ids packed (see pack_ids), and `part`, the number of bounds that are at most doc_id.
    """
    schema = "doc_id long, ids array<int>" if bounds is None else "part int, doc_id long, ids binary"
    limits = np.array(bounds or [], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = loaded(encoder)
        for batch in batches:
            for b in slices(batch, "text"):
                got = [one(t) if t else b"" for t in b.column("text").to_pylist()]
                if bounds is None:
                    ends = np.cumsum([0, *(len(x) // 4 for x in got)])
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(got), np.int32)))], ["doc_id", "ids"])
                else:
                    part = np.searchsorted(limits, pc.fill_null(b.column("doc_id"), -(1 << 63)).to_numpy(), side="right").astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(part), b.column("doc_id"), pa.array([pack_ids(np.frombuffer(x, "<u4")) for x in got], pa.binary())], ["part", "doc_id", "ids"])
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, schema)


class TokenBytes:
    """The token-byte table of a file of ranks, to be joined with ids."""

    def __init__(self, ranks: str):
        by_id = sorted((i, t) for t, i in read_ranks(ranks).items())
        ids = np.array([i for i, _ in by_id])
        self.place = np.full(by_id[-1][0] + 1, -1, np.int32)
        self.place[ids] = np.arange(len(ids))
        self.tokens = pa.array([t for _, t in by_id], pa.binary())

    def join(self, flat: np.ndarray) -> pa.Array:
        """Bytes of each id."""
        if len(flat) and int(flat.max()) >= len(self.place) or (self.place[flat] < 0).any():
            raise ValueError("an id is not in the token table")
        return self.tokens.take(pa.array(self.place[flat]))


def token_bytes(ranks: str) -> tuple:
    return ("bytes", ranks), lambda: TokenBytes(ranks)


def _texts_of(values: pa.Array, offsets: np.ndarray, by: bytes) -> pa.Array:
    """The values between offsets joined."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), values), pa.scalar(by, values.type))


def decode(tokens: DataFrame, ranks: str) -> DataFrame:
    """tokens (doc_id, ids) with `decoded`, the bytes of the ids in order, joined from the token-byte table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = loaded(token_bytes(ranks))
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                b = batch.slice(start, 256)
                lists = b.column("ids")
                offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, _texts_of(tokens_of.join(lists.flatten().to_numpy()), offsets, b"").cast(pa.binary())], ["doc_id", "ids", "decoded"])
        release()

    return tokens.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, stable: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 by the public multi-language vocabulary; the ids don't leave the step that puts them together."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def digest(ids: list, runs: Iterator) -> pa.Table:
        tokens_of = loaded(token_bytes(ranks))
        if "names" not in vars(tokens_of):
            tokens_of.names = pa.array(np.arange(len(tokens_of.place))).cast(pa.string()).cast(pa.binary())
        sizes, done = np.zeros(len(ids), np.int64), [[], []]
        open_at, hashes = -1, None
        for first, last, offsets, flat in runs:
            sizes[first:last] += np.diff(offsets)
            texts = _texts_of(tokens_of.names.take(pa.array(flat)), offsets, b","), _texts_of(tokens_of.join(flat), offsets, b"")
            if first == open_at:  # a further stretch of a long document
                for k, text in enumerate(texts):
                    hashes[k].update(b"," if k == 0 and len(flat) else b"")
                    hashes[k].update(text[0].as_buffer())
            else:
                hashes = [None, None]
                for k, column in enumerate(texts):
                    for text in column:
                        hashes[k] = hashlib.sha256(text.as_buffer())
                        done[k].append(hashes[k])
                open_at = first if last == first + 1 else -1
        names = [pa.array([h.hexdigest() for h in x], pa.string()) for x in done]
        return pa.table([pa.array(ids, pa.int64()), pa.array(sizes), *names], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(docs, rank_encoder(ranks, public_tokenizers.PATTERN), public_tokenizers.PATTERN, stable=stable, finish=digest, schema="doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), stable=True)


def encode_kept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the token digests of every document that is left; docs is stored by the stage before."""
    return digests(docs.select("doc_id", "text"), stable=True)
