"""Media columns: Netpbm and BMP images to numpy arrays, integral-image resizing, NPY tiles and difference hashes.

An image column (binary) is decoded, cut into NPY tiles of at most `tile` rows and columns, and stored through Spark's
writer, which commits whole tasks only; features are computed from what is read back.  The feature is the
difference hash of the whole image's area-resized grey image: every tile adds its part, from its own integral image, to the boxes that it meets.
Tiles are kept in one row, in order, so that no shuffle brings them together again.

The query makes an image of each text: of an odd number of rows a binary grey map (Netpbm), of an even number a BMP whose palette
is grey; both decode to the samples.  Tiles are TILE rows high, so the integral image is as small for a long text as for a short one.

Scale: one pass each way and no shuffle; a task holds one Arrow slice, or one longer image.  Stored tiles are zstd compressed.

Cases: null or undecodable images give no tile and a row with null features in decode_images; a sample deeper than 8 bits
becomes uint16; images of zero area are refused as undecodable; repeated rows give repeated rows; an empty table gives no rows; columns other than
key and image are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .work import materialise, release, slices, table, text_bytes

#: Samples a row of the image that carries a payload; rows of a tile of the query.
ROW, TILE = 64, 4096


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width) or (height, width, 3); bitmaps as 0 (white) and 1."""
    fields, at = [], 2
    kind = data[:2]
    want = 2 if kind in (b"P1", b"P4") else 3
    if not re.fullmatch(rb"P[1-6]", kind):
        raise ValueError("no Netpbm image")
    while len(fields) < want:
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(data, at)
        if not m:
            raise ValueError("broken header")
        fields.append(int(m[1]))
        at = m.end()
    width, height, top = [*fields, 1][:3]
    planes = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * planes
    if not n or not 0 < top < 65536:
        raise ValueError("empty image")
    if kind == b"P1":
        flat = np.frombuffer(re.sub(rb"#[^\n]*\n|\s", b"", data[at:])[:n], np.uint8) - 48
    elif kind in (b"P2", b"P3"):
        flat = np.array(re.sub(rb"#[^\n]*\n", b"", data[at:]).split()[:n], np.uint16 if top > 255 else np.uint8)
    elif kind == b"P4":
        line = (width + 7) // 8
        flat = np.unpackbits(np.frombuffer(data, np.uint8, line * height, at + 1).reshape(height, line), axis=1)[:, :width].ravel()
    else:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at + 1)
        flat = flat.astype(np.uint16) if top > 255 else flat
    return flat.reshape((height, width, 3) if planes == 3 else (height, width))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits as (height, width, 3), or (height, width) where its palette is grey."""
    if data[:2] != b"BM":
        raise ValueError("no BMP image")
    start, head, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    used = struct.unpack_from("<I", data, 46)[0]
    if packed or bits not in (1, 4, 8, 24, 32) or width <= 0 or not height:
        raise ValueError("BMP form that isn't supported")
    rows, line = abs(height), (width * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, rows * line, start).reshape(rows, line)
    if bits >= 24:
        out = raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    else:
        if bits == 8:
            index = raw[:, :width]
        else:
            each = np.unpackbits(raw, axis=1).reshape(rows, -1, bits)
            index = (each << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)[:, :width]
        colours = np.frombuffer(data, np.uint8, 4 * (used or 1 << bits), 14 + head).reshape(-1, 4)[:, 2::-1]
        out = colours[index] if (colours != colours[:, :1]).any() else colours[:, 0][index]
    return np.ascontiguousarray(out if height < 0 else out[::-1])


def decode_image(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def box_sums(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums over the boxes between the edges y and x of an image's samples, from its integral image; edges may cut samples or lie outside."""
    grey = image.mean(2) if image.ndim == 3 else image.astype(np.float64)
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    total[1:, 1:] = grey.cumsum(0).cumsum(1)

    def at(axis: int, places: np.ndarray, table: np.ndarray) -> np.ndarray:
        places = np.clip(places, 0, table.shape[axis] - 1)
        low = np.minimum(places.astype(int), table.shape[axis] - 2)
        part = (places - low).reshape((-1, 1) if axis == 0 else (1, -1))
        return np.take(table, low, axis) * (1 - part) + np.take(table, low + 1, axis) * part

    return np.diff(np.diff(at(1, x, at(0, y, total)), axis=0), axis=1)


def resize_tiles(tiles: Iterable[tuple[int, int, np.ndarray]], shape: tuple[int, int], height: int, width: int) -> np.ndarray:
    """Exact area means over height x width boxes of an image of that shape; tiles: (first row, first column, samples)."""
    y, x = np.linspace(0, shape[0], height + 1), np.linspace(0, shape[1], width + 1)
    sums = np.zeros((height, width))
    for top, left, part in tiles:
        sums += box_sums(part, y - top, x - left)
    return sums / ((y[1] - y[0]) * (x[1] - x[0]))


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    return resize_tiles([(0, 0, image)], image.shape[:2], height, width)


def hash_bits(small: np.ndarray) -> str:
    """64 bits in hex: of 8 rows of 9 area means, whether each is larger than the one to its left."""
    small = np.round(small, 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def difference_hash(image: np.ndarray) -> str:
    return hash_bits(resize(image, 8, 9))


def to_npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def from_npy(data: bytes) -> np.ndarray:
    """The array of NPY bytes or of a buffer of them."""
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def tile_images(df: DataFrame, key: str, image: str, tile: int | None = None) -> DataFrame:
    """key, height, width and tiles (in order of tile_y, tile_x) of every image; nulls where an image can't be decoded."""
    kind = df.schema[key].dataType
    schema = StructType([StructField("key", kind), *StructType.fromDDL("height int, width int, tiles array<struct<tile_y int, tile_x int, npy binary>>").fields])
    tiles_type = pa.list_(pa.struct([("tile_y", pa.int32()), ("tile_x", pa.int32()), ("npy", pa.binary())]))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "image"):
                sizes, tiles = [], []
                for data in b.column("image").to_pylist():
                    try:
                        array = decode_image(data or b"")
                    except (ValueError, struct.error, IndexError):
                        sizes.append((None, None))
                        tiles.append(None)
                        continue
                    h, w = tile or array.shape[0], tile or array.shape[1]
                    sizes.append(array.shape[:2])
                    tiles.append([{"tile_y": y // h, "tile_x": x // w, "npy": to_npy(array[y : y + h, x : x + w])} for y in range(0, array.shape[0], h) for x in range(0, array.shape[1], w)])
                yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array([s[k] for s in sizes], pa.int32()) for k in (0, 1)), pa.array(tiles, tiles_type)], ["key", "height", "width", "tiles"])
        release()

    return df.select(F.col(key).alias("key"), F.col(image).alias("image")).mapInArrow(decode, schema)


def decode_images(df: DataFrame, key: str, image: str, tile: int | None = None) -> DataFrame:
    """key, tile_y, tile_x, npy of every tile of every image; a null tile where an image can't be decoded."""
    return tile_images(df, key, image, tile).select("key", F.explode_outer("tiles").alias("t")).select("key", "t.*")


def store_tiles(tiles: DataFrame, name: str = "tiles") -> DataFrame:
    """Writes tiles to the shared folder; the table that reads them back."""
    return materialise(tiles, name)


def _little(n, size: int = 4):
    """Bytes of a number, the lowest first."""
    digits = F.lpad(F.hex(n), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in range(size - 1, -1, -1)]))


def payload_image(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds `n_bytes` and `image`: the text's UTF-8 bytes, padded by 0 to rows of ROW samples, as a binary grey map or a grey BMP."""
    n = F.octet_length(text_bytes(text_col))
    height = F.greatest(F.lit(1), F.ceil(n / ROW).cast("int"))
    pad = F.expr(f"unhex(repeat('00', {ROW}))")
    padded = F.substring(F.concat(F.col("body"), pad), F.lit(1), F.col("height") * ROW)
    start = 14 + 40 + 4 * 256
    grey = F.unhex(F.lit("".join(f"{k:02x}{k:02x}{k:02x}00" for k in range(256))))
    netpbm = F.concat(F.lit(f"P5 {ROW} "), F.col("height").cast("string"), F.lit(" 255\n")).cast("binary")
    # A negative height means that the first row comes first.
    bmp = F.concat(
        F.lit("BM").cast("binary"), _little(F.lit(start) + F.col("height") * ROW), F.unhex(F.lit("00000000")), _little(F.lit(start)),
        _little(F.lit(40)), _little(F.lit(ROW)), _little((F.lit(1 << 32) - F.col("height")).cast("long")), F.unhex(F.lit("01000800" + "00" * 24)), grey,
    )
    return (
        df.withColumn("body", text_bytes(text_col)).withColumn("n_bytes", n.cast("long")).withColumn("height", height)
        .withColumn("image", F.concat(F.when(F.col("height") % 2 == 0, bmp).otherwise(netpbm), padded))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tiles int"
    docs = payload_image(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    images = docs.select(F.struct("doc_id", "n_bytes").alias("key"), "image")
    stored = store_tiles(tile_images(images, "key", "image", TILE))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                b, rows = batch.slice(start, 256), []
                for key, height, width, tiles in zip(*(b.column(c) for c in ("key", "height", "width", "tiles")), strict=True):
                    payload, media, n, n_media, tail = hashlib.sha256(), hashlib.sha256(), 0, 0, b""

                    def parts() -> Iterator[tuple[int, int, np.ndarray]]:
                        nonlocal n, n_media, tail
                        for t in tiles.values:  # noqa: B023
                            npy = t["npy"].as_buffer()
                            array = from_npy(npy)
                            media.update(npy)  # noqa: B023
                            payload.update(array)  # noqa: B023
                            n, n_media, tail = n + array.nbytes, n_media + npy.size, array[-1].tobytes()
                            yield t["tile_y"].as_py() * TILE, t["tile_x"].as_py() * TILE, array

                    small = resize_tiles(parts(), (height.as_py(), width.as_py()), 8, 9)
                    rows.append((key["doc_id"].as_py(), key["n_bytes"].as_py(), n, payload.hexdigest(), zlib.crc32(tail), n_media, media.hexdigest(), hash_bits(small), len(tiles.values)))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [x.split()[0] for x in schema.split(", ")])
        release()

    return stored.mapInArrow(features, schema)
