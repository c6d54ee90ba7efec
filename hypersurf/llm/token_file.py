"""Token-id files of directly addressable codes.

An id is split into 8-bit chunks, lowest first.  Level 0 has a chunk of every id, level k + 1 a chunk of each id of
level k that has bits left; a continuation bitmap of each level marks those, and a rank directory (set bits before
every 512th one) finds an id's place in the next level.  Any single id is thus read with a few seeks and no block is
ever decoded.

File: magic, then segments of SEGMENT ids (the last one shorter), then the footer and its length.  Segment: for each
level the chunks, the bitmap and the directory.  Footer (JSON line, then int64 arrays): places of the levels, the number
of ids, and of every document its id, first token and token count.

Scale: bounds of ranges come from the ids of the documents alone; texts are encoded where they are read, each distinct chunk of a worker once
(see pieces.py), and shuffled once, as packed ids, to their range.  Each task writes files of its own in segments and begins a new file
after FILE_IDS ids or FILE_DOCS documents, so memory holds a batch of ids, a segment and a bounded footer.  The driver gets one manifest row a file.
A file's name holds its attempt, and the manifest names files of committed attempts only, so a lost or speculative task does no harm.

Cases: null text is empty (only the end id); null ids come first; repeated rows stay repeated, rows of one id ordered by their ids; an empty
table gives no rows; strings of special tokens in a text get the ids that the library gives them; other columns are ignored.
"""

from __future__ import annotations

import io
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import encode_in_place, tokenizer_encoder, unpack_ids
from .work import open_fs, partitions, publish, release, table, work_dir

MAGIC, SEGMENT, STRIDE = b"DACIDS1\n", 1 << 18, 512
#: Text bytes of a range; ids and documents after which a file ends.
RANGE_BYTES, FILE_IDS, FILE_DOCS = 256 << 20, 1 << 27, 1 << 20


def split_levels(ids: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
    """(chunks, continuation bitmap, rank directory) of each level."""
    out, left = [], ids.astype(np.uint32)
    while len(left):
        more = left > 255
        marks = np.packbits(more, bitorder="little").tobytes()
        ranks = np.concatenate([[0], np.add.reduceat(more, np.arange(0, len(more), STRIDE), dtype=np.uint32)[:-1]]).cumsum().astype("<u4")
        out.append(((left & 255).astype(np.uint8).tobytes(), marks, ranks.tobytes()))
        left = left[more] >> 8
    return out


class TokenFileWriter:
    """Writes documents of ids one after another; close() ends the file."""

    def __init__(self, out, segment: int = SEGMENT):
        self.out, self.segment, self.at = out, segment, 0
        self.held: list[np.ndarray] = []
        self.n_held = self.n = 0
        self.segments: list = []
        self.docs: list[tuple[int, int, int]] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.n, len(ids)))
        self.n += len(ids)
        self.held.append(np.asarray(ids, np.uint32))
        self.n_held += len(ids)
        if self.n_held >= self.segment:
            all_ids = np.concatenate(self.held)
            full = len(all_ids) // self.segment * self.segment
            for i in range(0, full, self.segment):
                self._flush(all_ids[i : i + self.segment])
            self.held, self.n_held = [all_ids[full:]], len(all_ids) - full

    def _flush(self, ids: np.ndarray) -> None:
        self.segments.append([len(ids), [[self._put(x) for x in level] for level in split_levels(ids)]])

    def close(self) -> None:
        if self.n_held:
            self._flush(np.concatenate(self.held))
        head = json.dumps({"n": self.n, "segment": self.segment, "docs": len(self.docs), "segments": self.segments}).encode() + b"\n"
        body = head + np.array(self.docs, "<i8").tobytes()
        self._put(body)
        self._put(len(body).to_bytes(8, "little"))


class TokenFile:
    """Reads a file of TokenFileWriter: file is seekable."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, io.SEEK_END) or file.tell()
        length = int.from_bytes(self._get(size - 8, 8), "little")
        body = self._get(size - 8 - length, length)
        head, _, rest = body.partition(b"\n")
        head = json.loads(head)
        self.n, self.segment, self.segments = head["n"], head["segment"], head["segments"]
        self.docs = np.frombuffer(rest, "<i8").reshape(-1, 3)

    def _get(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def __getitem__(self, i: int) -> int:
        """The i-th id, from one chunk, one bitmap stretch and one directory entry of each of its levels."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        (_, levels), i, value = self.segments[i // self.segment], i % self.segment, 0
        for k, (chunks, marks, ranks) in enumerate(levels):
            value |= self._get(chunks[0] + i, 1)[0] << 8 * k
            block = i // STRIDE
            bits = np.unpackbits(np.frombuffer(self._get(marks[0] + block * STRIDE // 8, min(STRIDE // 8, marks[1] - block * STRIDE // 8)), np.uint8), bitorder="little")
            if not bits[i % STRIDE]:
                return value
            i = int.from_bytes(self._get(ranks[0] + 4 * block, 4), "little") + int(bits[: i % STRIDE].sum())
        return value

    def segment_ids(self, k: int) -> np.ndarray:
        n, levels = self.segments[k]
        out, place = np.zeros(n, np.uint32), np.arange(n)
        for j, (chunks, marks, _) in enumerate(levels):
            out[place] |= np.frombuffer(self._get(*chunks), np.uint8).astype(np.uint32) << np.uint32(8 * j)
            place = place[np.unpackbits(np.frombuffer(self._get(*marks), np.uint8), bitorder="little")[: len(place)].astype(bool)]
        return out

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, first token, ids) of each document, with a segment in memory at a time besides the document."""
        k, low, ids = 0, 0, self.segment_ids(0) if self.segments else np.zeros(0, np.uint32)
        for doc_id, start, n in self.docs.tolist():
            got = []
            while n > sum(map(len, got)):
                at = start + sum(map(len, got))
                if at >= low + len(ids):
                    low, k = low + len(ids), k + 1
                    ids = self.segment_ids(k)
                got.append(ids[at - low : start + n - low])
            yield doc_id, start, got[0] if len(got) == 1 else np.concatenate([*got, np.zeros(0, np.uint32)])


def id_bounds(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> list[int]:
    """Ids at which ranges of docs (doc_id, text) begin: about as many rows in each, and as many ranges as shuffle partitions or more."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(partitions(docs.sparkSession), -(-size // range_bytes))
    at = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [k / n for k in range(1, n)], max(10_000, 20 * n))).first()[0] if n > 1 else None
    return sorted(set(at or []))


def write_token_files(tokens: DataFrame, ranges: int, folder: str, end_id: int = 0, segment: int = SEGMENT, file_ids: int = FILE_IDS) -> list[tuple[str, int, int]]:
    """Writes tokens (part, doc_id, packed ids) in id order, each document with an end id, into files below folder; (path, first token, tokens) of each file, in order.

    part: range of the ids, from 0 to ranges - 1, ascending with doc_id.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt, end, made = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), np.array([end_id], np.uint32), []
        rows = ((d, unpack_ids(x.as_py())) for b in batches for d, x in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True))
        ahead = next(rows, None)
        while ahead:

            def put(out) -> None:
                nonlocal ahead
                writer = TokenFileWriter(out, segment)
                while ahead and writer.n < file_ids and len(writer.docs) < FILE_DOCS:
                    writer.add(-(1 << 63) if ahead[0] is None else ahead[0], np.append(ahead[1], end))
                    ahead = next(rows, None)
                writer.close()
                made.append(writer.n)

            path = publish(folder, f"ids-{part:06d}-{len(made):04d}-{attempt}.dac", put)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(made)], pa.int32()), pa.array([path]), pa.array(made[-1:], pa.int64())], ["part", "nth", "path", "n"])
        release()

    ranged = tokens.repartitionById(ranges, F.col("part")).sortWithinPartitions("doc_id", "ids").select("doc_id", "ids")
    out, start = [], 0
    for r in sorted(ranged.mapInArrow(write, "part int, nth int, path string, n long").collect()):
        out.append((r["path"], start, r["n"]))
        start += r["n"]
    return out


def read_token_files(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start (over all files), n_tokens, ids_crc32 of each document, one task a file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

        for b in batches:
            for path, first in zip(b.column("path").to_pylist(), b.column("first").to_pylist(), strict=True):
                store, at = open_fs(path)
                with store.open_input_file(at) as f:
                    for d, s, ids in TokenFile(f).documents():
                        rows.append((None if d == -(1 << 63) else d, first + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == 4096:
                            yield flush()
                            rows = []
        if rows:
            yield flush()
        release()

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(k, p, s) for k, (p, s, _) in enumerate(files)], "k int, path string, first long")
    return listed.repartitionById(len(files), F.col("k")).mapInArrow(read, schema)


def tokens_at(places: DataFrame, files: list[tuple[str, int, int]]) -> DataFrame:
    """places (place, over all files) with the id there, null outside; each is read by itself, without decoding a block."""
    firsts, last = np.array([s for _, s, _ in files], np.int64), files[-1][1] + files[-1][2] if files else 0

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, at = -1, None
        for b in batches:
            out = []
            for place in b.column("place").to_pylist():
                if place is None or not 0 <= place < last:
                    out.append(None)
                    continue
                k = int(np.searchsorted(firsts, place, side="right")) - 1
                if k != of:
                    store, path = open_fs(files[k][0])
                    of, at = k, TokenFile(store.open_input_file(path))
                out.append(at[place - files[k][1]])
            yield pa.RecordBatch.from_arrays([b.column("place"), pa.array(out, pa.int64())], ["place", "id"])

    return places.select(F.col("place").cast("long").alias("place")).mapInArrow(look, "place long, id long")


def token_files(docs: DataFrame, path: str, folder: str, range_bytes: int = RANGE_BYTES, segment: int = SEGMENT, file_ids: int = FILE_IDS) -> list[tuple[str, int, int]]:
    """Files of the ids of docs (doc_id, text) by the tokenizer of a path."""
    bounds = id_bounds(docs, range_bytes)
    return write_token_files(encode_in_place(docs, tokenizer_encoder(path), bounds), len(bounds) + 1, folder, segment=segment, file_ids=file_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_token_files(spark, token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), work_dir(spark, "token-files")))
