"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images, written as
NPY tiles with difference hashes.

Images are binary columns. Everything is row-wise, so an operator is one map over Arrow batches with no
shuffle, and a task holds one image at a time.

Defined results: a null or empty image decodes to nothing (null features); bytes that are no image raise
ValueError in ``decode`` and give null features in ``image_features``; equal bytes give equal features.
Extra columns pass through ``store_payloads`` untouched unless named like its outputs, which replace them.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import map_arrow, stored, text_or_empty

PAYLOAD_WIDTH = 64


def _pnm_header(data: bytes, fields: int) -> tuple[list[int], int]:
    """Numbers after the magic, with comments skipped, and where the raster starts."""
    at, found = 2, []
    token = re.compile(rb"(?:\s+|#[^\n]*\n)*(\d+)")
    while len(found) < fields:
        m = token.match(data, at)
        if not m:
            raise ValueError("truncated Netpbm header")
        found.append(int(m[1]))
        at = m.end()
    return found, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width) or (height, width, 3); uint8, or uint16 for a maximum above 255."""
    kind = data[1:2]
    plain, bitmap, channels = kind in b"123", kind in b"14", 3 if kind in b"36" else 1
    (width, height, *rest), start = _pnm_header(data, 2 if bitmap else 3)
    top = rest[0] if rest else 1
    count = width * height * channels
    if plain:
        body = re.sub(rb"#[^\n]*", b"", data[start - 1 :])
        digits = [b[0] - 48 for b in re.findall(rb"[01]", body)] if bitmap else body.split()
        flat = np.array(digits[:count], np.int64)
    elif bitmap:
        stride = (width + 7) // 8
        rows = np.frombuffer(data, np.uint8, stride * height, start).reshape(height, stride)
        flat = np.unpackbits(rows, axis=1)[:, :width].reshape(-1)
    else:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, count, start)
    if len(flat) < count:
        raise ValueError("truncated Netpbm raster")
    if bitmap:
        flat = (1 - flat) * 255
    out = flat.astype(np.uint16 if top > 255 else np.uint8)
    return out.reshape((height, width, 3) if channels == 3 else (height, width))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits; grey palettes give (height, width)."""
    start, = struct.unpack_from("<I", data, 10)
    head, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if bits not in (8, 24, 32) or packed not in (0, 3):
        raise ValueError(f"BMP of {bits} bits, compression {packed}, is not supported")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    rows = rows if height < 0 else rows[::-1]
    if bits == 8:
        used, = struct.unpack_from("<I", data, 46)
        table = np.frombuffer(data, np.uint8, 4 * (used or 256), 14 + head).reshape(-1, 4)[:, 2::-1]
        picked = table[rows[:, :width]]
        return picked[..., 0].copy() if (table == table[:, :1]).all() else picked
    return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[..., 2::-1].copy()


def decode(data: bytes) -> np.ndarray:
    if re.match(rb"P[1-6]\s", data[:3]):
        return decode_netpbm(data)
    if data[:2] == b"BM":
        return decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.astype(np.uint8).tobytes()


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([299, 587, 114], np.int64) // 1000


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area below each target pixel, fractional edges included, as float64.

    The integral image is interpolated bilinearly at the target's grid lines, which is exact for areas.
    """
    src_h, src_w = image.shape
    total = np.zeros((src_h + 1, src_w + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def lines(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(parts + 1) * size / parts
        low = np.minimum(at.astype(np.int64), size - 1)
        return low, at - low

    (y, fy), (x, fx) = lines(src_h, height), lines(src_w, width)
    rows = total[y] * (1 - fy)[:, None] + total[y + 1] * fy[:, None]
    grid = rows[:, x] * (1 - fx) + rows[:, x + 1] * fx
    sums = np.diff(np.diff(grid, axis=0), axis=1)
    return sums / (src_h / height * src_w / width)


def difference_hash(image: np.ndarray, side: int = 8) -> str:
    """side*side bits, row by row: is a pixel of the (side, side+1) thumbnail darker than its right neighbour."""
    small = np.round(area_resize(grey(image), side, side + 1), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = 32) -> bytes:
    """The thumbnail of side*side as the bytes of an NPY file (uint8)."""
    out = io.BytesIO()
    np.save(out, np.rint(area_resize(grey(image), side, side)).astype(np.uint8))
    return out.getvalue()


def image_features(df: DataFrame, image: str = "image", tile: int = 32) -> DataFrame:
    """Adds height, width, dhash and tile_npy for a binary column of Netpbm or BMP files; null where it cannot be decoded."""
    kept = [c for c in df.columns if c not in ("height", "width", "dhash", "tile_npy")]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + ", height int, width int, dhash string, tile_npy binary"

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(batch.schema.get_field_index(image)).to_pylist():
                try:
                    pixels = decode(data) if data else None
                except (ValueError, struct.error, IndexError):
                    pixels = None
                if pixels is None or not pixels.size:
                    rows.append((None, None, None, None))
                else:
                    rows.append((*pixels.shape[:2], difference_hash(pixels), npy_tile(pixels, tile)))
            h, w, d, t = zip(*rows, strict=True) if rows else ((), (), (), ())
            more = [pa.array(h, pa.int32()), pa.array(w, pa.int32()), pa.array(d, pa.string()), pa.array(t, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), *more], [*kept, "height", "width", "dhash", "tile_npy"])

    return map_arrow(df.select(*kept), run, schema)


def store_payloads(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_bytes and image: the text's UTF-8 bytes, zero-padded to a positive multiple of 64, as a PGM of 64 columns."""
    kept = [c for c in df.columns if c not in ("n_bytes", "image", text)]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + ", n_bytes bigint, image binary"

    def run(batches):
        for batch in batches:
            sizes, images = [], []
            for value in batch.column(batch.num_columns - 1):
                raw = value.as_buffer().to_pybytes()
                padded = raw.ljust(max(1, -(-len(raw) // PAYLOAD_WIDTH)) * PAYLOAD_WIDTH, b"\0")
                sizes.append(len(raw))
                images.append(encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, PAYLOAD_WIDTH)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(sizes, pa.int64()), pa.array(images, pa.binary())], [*kept, "n_bytes", "image"])

    return map_arrow(df.select(*kept, text_or_empty(text).alias(text)), run, schema)


def stored_media(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, image, height, width, dhash and tile_npy of each text, written to the shared folder and read back."""
    return stored(image_features(store_payloads(df.select("doc_id", "text"))), "media")


def payload_digests(df: DataFrame) -> DataFrame:
    """Reads the images of ``store_payloads`` back: doc_id, n_bytes and the digests of the decoded samples and of the stored file."""

    def run(batches):
        for batch in batches:
            ids, sizes, images = (batch.column(i) for i in range(3))
            rows = []
            for value in images:
                data = value.as_buffer().to_pybytes()
                pixels = decode(data)
                payload = pixels.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(pixels)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([ids, sizes, *map(pa.array, columns, kinds)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return map_arrow(
        df.select("doc_id", "n_bytes", F.col("image")), run,
        "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    )
