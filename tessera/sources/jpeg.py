"""JPEG files from arrays: baseline, 8 bits, without subsampling."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the format: red, green and blue in luminance and in the two colour differences.
COLOURS = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
#: Places of an 8 x 8 block by rising diagonal, their direction changing.
ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))
#: Symbols of codes of one length each, 4 and 8 bits: sizes of first values; zeros before a value and its size.
FIRST = list(range(12))
LATER = [0x00, 0xF0, *[run << 4 | size for run in range(16) for size in range(1, 11)]]
_WAVES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) / (2 if u else np.sqrt(8)) for x in range(8)] for u in range(8)])


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def _blocks(plane: np.ndarray, step: int) -> np.ndarray:
    """Quantised coefficients (blocks, 64) in zigzag order; a plane is continued to whole blocks by its edge."""
    h, w = plane.shape
    wide = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128.0
    cut = wide.reshape(wide.shape[0] // 8, 8, wide.shape[1] // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8)
    return np.rint((_WAVES @ cut @ _WAVES.T / step).reshape(-1, 64)).astype(int)[:, ZIGZAG]


def _number(value: int) -> tuple[int, str]:
    """Size of a value and its bits; negative ones are counted from below."""
    size = abs(value).bit_length()
    return size, format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else ""


def encode(values: np.ndarray, step: int = 1) -> bytes:
    """A JPEG of a grey (height, width) or RGB (height, width, 3) array of bytes; a larger ``step`` is coarser."""
    values = np.asarray(values, np.uint8)
    height, width = values.shape[:2]
    planes = [values.astype(float)] if values.ndim == 2 else list(np.moveaxis(values @ COLOURS.T + [0, 128, 128], 2, 0))
    n, code = len(planes), {symbol: format(k, "08b") for k, symbol in enumerate(LATER)}
    bits, before = [], [0] * n
    for group in zip(*[_blocks(p, step) for p in planes], strict=True):
        for c, block in enumerate(group):
            size, number = _number(int(block[0]) - before[c])
            before[c] = int(block[0])
            bits.append(format(size, "04b") + number)
            last = 0
            for k in np.flatnonzero(block[1:]) + 1:
                zeros, last = int(k) - last - 1, int(k)
                size, number = _number(int(block[k]))
                bits.append(code[0xF0] * (zeros // 16) + code[zeros % 16 << 4 | size] + number)
            if last < 63:
                bits.append(code[0x00])
    stream = "".join(bits)
    stream += "1" * (-len(stream) % 8)
    packed = int(stream, 2).to_bytes(len(stream) // 8, "big").replace(b"\xff", b"\xff\x00")
    parts = b"".join(bytes([c + 1, 0x11, 0]) for c in range(n))
    table = lambda kind, length, symbols: bytes([kind]) + bytes(len(symbols) if k + 1 == length else 0 for k in range(16)) + bytes(symbols)
    return (
        b"\xff\xd8"
        + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
        + _segment(0xDB, bytes([0, *[step] * 64]))
        + _segment(0xC0, struct.pack(">BHHB", 8, height, width, n) + parts)
        + _segment(0xC4, table(0x00, 4, FIRST) + table(0x10, 8, LATER))
        + _segment(0xDA, bytes([n]) + b"".join(bytes([c + 1, 0]) for c in range(n)) + bytes([0, 63, 0]))
        + packed
        + b"\xff\xd9"
    )


def written_jpegs(rasters: DataFrame) -> DataFrame:
    """(mask_id, content) of rasters (mask_id, width, height, raster) as JPEG files: grey, or RGB where a raster has three bytes a pixel; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, width, height, raster = [c.to_pylist() for c in batch.columns]
            made = []
            for w, h, r in zip(width, height, raster, strict=True):
                shape = (h, w) if r is not None and len(r) == w * h else (h, w, 3)
                made.append(None if r is None else encode(np.frombuffer(r, np.uint8).reshape(shape)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["mask_id", "content"])

    kind = dict(rasters.dtypes)["mask_id"]
    return rasters.select("mask_id", "width", "height", "raster").mapInArrow(run, f"mask_id {kind}, content binary")
