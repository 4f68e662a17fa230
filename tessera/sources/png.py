"""PNG files as arrays and back, with zlib and NumPy only: 8 bits a channel, not interlaced."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.masks import resize, sliced

#: Fixed values of the format: its signature, and channels by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Weights of red, green and blue in a grey value, in thousandths.
GREY = (299, 587, 114)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(values: np.ndarray) -> bytes:
    """A PNG of a grey (height, width), RGB or RGBA (height, width, 3 or 4) array of bytes."""
    values = np.ascontiguousarray(values, np.uint8)
    height, width = values.shape[:2]
    colour = {1: 0, 3: 2, 4: 6}[1 if values.ndim == 2 else values.shape[2]]
    rows = values.reshape(height, -1)
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rows], 1)  # 0: lines as they are
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes())) + _chunk(b"IEND", b"")


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        if at + 12 + size > len(data):
            raise ValueError("cut off")
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += 12 + size


def _unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Lines (height, 1 + bytes) with their filters undone; ``step`` bytes make a pixel."""
    out = np.zeros((lines.shape[0], lines.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for y, (kind, line) in enumerate(zip(lines[:, 0].tolist(), lines[:, 1:], strict=True)):
        if kind == 0:
            out[y] = line
        elif kind == 1:
            out[y] = np.cumsum(line.reshape(-1, step), 0, dtype=np.uint8).ravel()
        elif kind == 2:
            out[y] = line + above
        elif kind in (3, 4):
            now, up = line.astype(int).tolist(), above.astype(int).tolist()
            for x in range(len(now)):
                left = now[x - step] if x >= step else 0
                if kind == 3:
                    guess = (left + up[x]) // 2
                else:
                    corner = up[x - step] if x >= step else 0
                    far = [abs(up[x] - corner), abs(left - corner), abs(left + up[x] - 2 * corner)]
                    guess = (left, up[x], corner)[far.index(min(far))]
                now[x] = (now[x] + guess) & 255
            out[y] = now
        else:
            raise ValueError("unknown filter")
        above = out[y]
    return out


def _lines(data: bytes) -> tuple[np.ndarray, int, int, bytes]:
    """Filtered lines (height, 1 + bytes), width, colour type and palette; ValueError if the file is none of the kind."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    head, palette, packed = b"", b"", []
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = body
        elif kind == b"PLTE":
            palette = body
        elif kind == b"IDAT":
            packed.append(body)
    if len(head) != 13:
        raise ValueError("no header")
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    if depth != 8 or interlaced or colour not in CHANNELS:
        raise ValueError("unsupported PNG")
    channels = CHANNELS[colour]
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise ValueError("broken data") from e
    if len(raw) < height * (1 + width * channels):
        raise ValueError("cut off")
    return np.frombuffer(raw, np.uint8, height * (1 + width * channels)).reshape(height, -1), width, colour, palette


def decode(data: bytes) -> np.ndarray:
    """(height, width) of a grey PNG, (height, width, 3 or 4) of a coloured one; ValueError if it is none of the kind."""
    lines, width, colour, palette = _lines(data)
    channels = CHANNELS[colour]
    values = _unfiltered(lines, channels).reshape(len(lines), width, channels)
    if colour == 3:
        table = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        return table[np.minimum(values[..., 0], len(table) - 1)]
    if colour == 4:
        return np.concatenate([values[..., :1]] * 3 + [values[..., 1:]], 2)
    return values[..., 0] if channels == 1 else values


def plain(data: bytes) -> np.ndarray | None:
    """``decode`` of a whole grey, RGB or RGBA file that holds nothing but pixels, in lines that NumPy undoes at once; None for any other."""
    at, kinds = len(SIGNATURE), []
    while at + 12 <= len(data):
        end = at + 12 + int.from_bytes(data[at : at + 4], "big")
        if end > len(data) or zlib.crc32(data[at + 4 : end - 4]) != int.from_bytes(data[end - 4 : end], "big"):
            return None
        kinds.append(data[at + 4 : at + 8])
        at = end
    if at != len(data) or kinds[:1] != [b"IHDR"] or kinds[-1] != b"IEND" or set(kinds[1:-1]) != {b"IDAT"} or data[26:28] != bytes(2):
        return None
    try:
        lines, width, colour, _ = _lines(data)
    except ValueError:
        return None
    channels = CHANNELS[colour]
    if colour not in (0, 2, 6) or not lines.size or not width or lines[:, 0].max() > 2:
        return None
    values = (_unfiltered(lines, channels) if lines[:, 0].any() else lines[:, 1:]).reshape(len(lines), width, channels)
    return values[..., 0] if channels == 1 else values


def grey(values: np.ndarray) -> np.ndarray:
    """The grey values of an image, alpha left out."""
    if values.ndim == 2:
        return values
    return ((values[..., :3].astype(np.int64) @ np.array(GREY) + 500) // 1000).astype(np.uint8)


def read_masks(files: DataFrame) -> DataFrame:
    """(mask_id, width, height, raster, error) of PNG files (file, content); what is no such file has an error and no raster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for content in batch.column(1).to_pylist():
                try:
                    v = grey(decode(content or b""))
                    rows.append((v.shape[1], v.shape[0], v.tobytes(), None))
                except ValueError as e:
                    rows.append((None, None, None, str(e)))
            width, height, raster, error = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(width, pa.int32()), pa.array(height, pa.int32()), pa.array(raster, pa.binary()), pa.array(error, pa.string())],
                ["mask_id", "width", "height", "raster", "error"],
            )

    kind = dict(files.dtypes)["file"]
    return files.select("file", "content").mapInArrow(run, f"mask_id {kind}, width int, height int, raster binary, error string")


def written_masks(rasters: DataFrame) -> DataFrame:
    """(mask_id, content) of rasters (mask_id, width, height, raster) as PNG files: grey, or RGB(A) of three or four bytes a pixel; null rasters stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            _, width, height, raster = [c.to_pylist() for c in batch.columns]
            made = []
            for w, h, r in zip(width, height, raster, strict=True):
                shape = (h, w) if r is None or len(r) == w * h else (h, w, len(r) // (w * h))
                made.append(None if r is None else encode(np.frombuffer(r, np.uint8).reshape(shape)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["mask_id", "content"])

    kind = dict(rasters.dtypes)["mask_id"]
    return rasters.select("mask_id", "width", "height", "raster").mapInArrow(run, f"mask_id {kind}, content binary")



def grey_values(files: DataFrame, width: int = 9, height: int = 8) -> DataFrame:
    """(file, values) of PNG files (file, content): grey values at another size by rows; null for what is no such file.

    With 9 x 8 values, ``difference_hash(values, row=9)`` is the hash of the image.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for content in batch.column(1).to_pylist():
                try:
                    v = grey(decode(content or b""))
                    v = v if v.shape == (height, width) else np.rint(resize(v, width, height))
                    rows.append(v.astype(np.int32).ravel().tolist())
                except ValueError:
                    rows.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["file", "values"])

    kind = dict(files.dtypes)["file"]
    return files.select("file", "content").mapInArrow(run, f"file {kind}, values array<int>")
