"""Media columns: Netpbm and BMP decoded to numpy, area-resized by integral images, kept as NPY tiles.

Defined results: a null image is absent (all results null); an empty, cut off or otherwise bad one,
and one with a sample above its maximum, sets `error` and nothing else, and never fails the job; a null
text is an empty one, a block of padding; a long text is one tall image, resized a thousand rows at a
time; repeated rows stay repeated, equal images and texts give equal values; an empty table gives an
empty result; other columns of the table are left out, so their names cannot clash. There are no ties:
equal neighbours of a difference hash give the bit 0.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, text_bytes

BLOCK = 576
PAD = 255
TILE = 16


# ---------------------------------------------------------------- Netpbm
def _header(data: bytes, n: int) -> tuple[list[int], int]:
    """n integers of a Netpbm header after the magic number, and where the raster begins."""
    out, i = [], 2
    while len(out) < n:
        while i < len(data) and (data[i : i + 1].isspace() or data[i : i + 1] == b"#"):
            if data[i : i + 1] == b"#":
                end = data.find(b"\n", i)
                i = len(data) if end < 0 else end
            else:
                i += 1
        j = i
        while j < len(data) and 48 <= data[j] <= 57:
            j += 1
        if j == i:
            raise ValueError("bad Netpbm header")
        out.append(int(data[i:j]))
        i = j
    return out, i + 1


def _scaled(samples: np.ndarray, top: int) -> np.ndarray:
    """Samples of 0 to top as uint8 or, above 255, uint16 of the full range."""
    if len(samples) and samples.max() > top:
        raise ValueError("sample above the maximum")
    kind, full = (np.uint8, 255) if top < 256 else (np.uint16, 65535)
    if top == full:
        return samples.astype(kind, copy=False)
    return ((samples.astype(np.int64) * full + top // 2) // top).astype(kind)


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width) or (height, width, 3); uint8, or uint16 for a maximum above 255.

    Samples are scaled from their maximum to that of the type; one above its maximum is an error. Bitmaps
    (P1, P4) come back as 0 for black and 255 for white.
    """
    magic = data[:2]
    if magic not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    bitmap, colour = magic in (b"P1", b"P4"), magic in (b"P3", b"P6")
    head, at = _header(data, 2 if bitmap else 3)
    w, h, top = head[0], head[1], 1 if bitmap else head[2]
    if w <= 0 or h <= 0 or not 0 < top < 65536:
        raise ValueError("bad Netpbm size")
    shape, n = ((h, w, 3) if colour else (h, w)), h * w * (3 if colour else 1)
    if magic == b"P4":
        row = (w + 7) // 8
        if len(data) - at < row * h:
            raise ValueError("short Netpbm raster")
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at).reshape(h, row), axis=1)[:, :w]
        return np.where(bits == 1, 0, 255).astype(np.uint8)
    if magic == b"P1":
        digits = np.frombuffer(data, np.uint8, offset=at - 1)
        digits = digits[(digits == 48) | (digits == 49)][:n]
        if len(digits) < n:
            raise ValueError("short Netpbm raster")
        return np.where(digits == 49, 0, 255).astype(np.uint8).reshape(shape)
    if magic in (b"P2", b"P3"):
        words = data[at - 1 :].split(maxsplit=n)[:n]
        if len(words) < n:
            raise ValueError("short Netpbm raster")
        if not all(w.isdigit() and len(w.lstrip(b"0")) <= 5 for w in words):
            raise ValueError("bad Netpbm sample")
        return _scaled(np.array([int(w) for w in words]), top).reshape(shape)
    kind = np.dtype(np.uint8 if top < 256 else ">u2")
    if len(data) - at < n * kind.itemsize:
        raise ValueError("short Netpbm raster")
    return _scaled(np.frombuffer(data, kind, n, at), top).reshape(shape)


def encode_netpbm(image: np.ndarray) -> bytes:
    """P5 or P6 by the number of channels; 8 or 16 bits by the type."""
    magic = b"P6" if image.ndim == 3 else b"P5"
    top, raw = (255, image.astype(np.uint8)) if image.dtype != np.uint16 else (65535, image.astype(">u2"))
    return b"%s\n%d %d\n%d\n" % (magic, image.shape[1], image.shape[0], top) + raw.tobytes()


# ---------------------------------------------------------------- BMP
def decode_bmp(data: bytes) -> np.ndarray:
    """BMP of 1, 4, 8, 16, 24 or 32 bits, packed at most by colour masks, as (height, width[, 3]); a grey palette gives two axes."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not BMP")
    at, head, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or w <= 0 or h == 0 or bits not in (1, 4, 8, 16, 24, 32) or (packed == 3 and bits not in (16, 32)):
        raise ValueError("BMP kind not supported")
    rows, stride = abs(h), (w * bits + 31) // 32 * 4
    if len(data) - at < rows * stride:
        raise ValueError("short BMP raster")
    raster = np.frombuffer(data, np.uint8, rows * stride, at).reshape(rows, stride)
    if h > 0:
        raster = raster[::-1]
    if packed == 3 or bits == 16:
        masks = struct.unpack_from("<III", data, 54) if packed == 3 else (0x7C00, 0x3E0, 0x1F)
        if any(m == 0 or (m // (m & -m)) & (m // (m & -m) + 1) for m in masks):
            raise ValueError("bad BMP masks")
        pixels = np.ascontiguousarray(raster[:, : w * bits // 8]).view("<u2" if bits == 16 else "<u4")
        channel = lambda m: (pixels & m) // (m & -m) * 255.0 / (m // (m & -m))
        return np.rint(np.stack([channel(m) for m in masks], axis=2)).astype(np.uint8)
    if bits >= 24:
        return np.ascontiguousarray(raster[:, : w * bits // 8].reshape(rows, w, bits // 8)[:, :, 2::-1])
    n = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    if n > 1 << bits:
        raise ValueError("BMP palette too large")
    palette = np.frombuffer(data, np.uint8, n * 4, 14 + head).reshape(n, 4)[:, 2::-1]
    if bits == 8:
        index = raster[:, :w]
    elif bits == 4:
        index = np.stack([raster >> 4, raster & 15], axis=2).reshape(rows, -1)[:, :w]
    else:
        index = np.unpackbits(raster, axis=1)[:, :w]
    if (palette[:, 0] == palette[:, 1]).all() and (palette[:, 0] == palette[:, 2]).all():
        return np.ascontiguousarray(palette[:, 0][index])
    return palette[index]


def encode_bmp(image: np.ndarray) -> bytes:
    """8 bits with a grey palette for two axes, 24 bits for three; bottom row first."""
    h, w = image.shape[:2]
    bits = 24 if image.ndim == 3 else 8
    palette = b"" if bits == 24 else np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    if bits == 8:
        palette[:, 3] = 0
        palette = palette.tobytes()
    rows = (image[::-1, :, ::-1] if bits == 24 else image[::-1]).reshape(h, -1)
    pad = -rows.shape[1] % 4
    raster = (np.pad(rows, ((0, 0), (0, pad))) if pad else rows).astype(np.uint8).tobytes()
    at = 54 + len(palette)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", at + len(raster), 0, 0, at, 40, w, h, 1, bits, 0, len(raster), 2835, 2835, 0, 0) + palette + raster


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


# ---------------------------------------------------------------- features
def _edges(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(m + 1) * (n / m)
    low = np.minimum(at.astype(np.int64), n - 1)
    return low, at - low


def area_resize(image: np.ndarray, height: int, width: int, rows: int = 1024) -> np.ndarray:
    """Mean over each target cell's exact area, from the integral image read between its grid points.

    The integral image is built over `rows` rows at a time and read only at the cells' edges, so a
    tall image needs no more memory than a flat one.
    """
    h, w = image.shape[:2]
    if image.ndim == 3:
        return np.stack([area_resize(image[:, :, c], height, width, rows) for c in range(image.shape[2])], axis=2)
    xl, xf = _edges(w, width)
    yl, yf = _edges(h, height)
    total, sums = np.zeros(width + 1), np.zeros((height + 1, width + 1))
    for top in range(0, h, rows):
        part = image[top : top + rows]
        integral = np.zeros((len(part) + 1, w + 1), np.int64)
        np.cumsum(part, axis=1, dtype=np.int64, out=integral[1:, 1:])
        np.cumsum(integral[1:], axis=0, out=integral[1:])
        across = integral[:, xl] * (1 - xf) + integral[:, xl + 1] * xf + total
        here = np.flatnonzero((yl >= top) & (yl < top + len(part)))
        sums[here] = across[yl[here] - top] * (1 - yf[here])[:, None] + across[yl[here] - top + 1] * yf[here][:, None]
        total = across[-1]
    cell = (h / height) * (w / width)
    return (sums[1:, 1:] - sums[:-1, 1:] - sums[1:, :-1] + sums[:-1, :-1]) / cell


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray, side: int = 8) -> str:
    """Signs of the differences between neighbours of a side x (side + 1) tile, as hex; equal neighbours give 0."""
    tile = np.round(grey(area_resize(image, side, side + 1)), 6)
    return np.packbits(tile[:, 1:] > tile[:, :-1]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = TILE) -> bytes:
    """The image resized to side x side, as the bytes of an NPY file of uint8; 16-bit samples are brought to 8 bits."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, side, side) / (257 if image.dtype == np.uint16 else 1)), 0, 255).astype(np.uint8))
    return out.getvalue()


def media_features(df: DataFrame, image: str, key: str, side: int = TILE) -> DataFrame:
    """key, width, height, channels, dhash, tile (NPY bytes) and error of each encoded image of df."""
    bounded_batches(df.sparkSession)
    kind = df.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                if data is None:
                    rows.append((None,) * 6)
                    continue
                try:
                    x = decode(data)
                    rows.append((x.shape[1], x.shape[0], 1 if x.ndim == 2 else x.shape[2], difference_hash(x), npy_tile(x, side), None))
                except (ValueError, OverflowError, struct.error, IndexError) as e:
                    rows.append((None, None, None, None, None, str(e)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string())
            names = [key, "width", "height", "channels", "dhash", "tile", "error"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    schema = f"`{key}` {kind}, width int, height int, channels int, dhash string, tile binary, error string"
    return df.select(key, image).mapInArrow(run, schema)


# ---------------------------------------------------------------- texts as media
def store(payload: bytes) -> bytes:
    """The payload losslessly as 8-bit samples: by its number of blocks a PGM, PPM or BMP file."""
    samples = np.frombuffer(payload, np.uint8)
    kind = len(payload) // BLOCK % 3
    if kind == 1:
        return encode_netpbm(samples.reshape(-1, 24))
    image = samples.reshape(-1, 24, 3)
    return encode_netpbm(image) if kind == 2 else encode_bmp(image)


def text_media(df: DataFrame, key: str = "doc_id", text: str = "text", side: int = TILE) -> DataFrame:
    """Each whole text stored as an image, read back from the stored bytes, hashed and described.

    Null and empty texts make one block of padding. Equal texts give equal values; rows repeat as in df.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in text_bytes(batch.column(1)):
                stored = store(data + bytes([PAD]) * (-len(data) % BLOCK or (0 if data else BLOCK)))
                image = decode(stored)
                back = image.tobytes()
                tile = npy_tile(image, side)
                rows.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(image), stored[:2].decode(), tile))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_kind", "tile"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_kind string, tile binary"
    return df.select(df[key].cast("long").alias("doc_id"), df[text].cast("string").alias("text")).mapInArrow(run, schema)
