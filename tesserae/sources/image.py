"""Page images: PNG files written and read with zlib alone, pages drawn as their elements' boxes, boxes laid over an image."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DPI, BASE = 150.0, 72.0
LINE, FILL = (220, 30, 30), (120, 120, 120)


def encode(pixels: np.ndarray) -> bytes:
    """A PNG file of an array [row, column, red-green-blue] of bytes."""
    high, wide, _ = pixels.shape
    rows = np.concatenate([np.zeros((high, 1), np.uint8), pixels.reshape(high, wide * 3)], axis=1)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes(), 6)) + part(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """The pixels of a PNG file of eight bits a channel, grey or coloured, with or without opacity, not interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG file")
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 8 + size])
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + size]
        at += 12 + size
    wide, high, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlaced:
        raise ValueError("an unsupported PNG file")
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(high, 1 + wide * channels)
    out, above = np.zeros((high, wide * channels), np.uint8), np.zeros(wide * channels, np.uint8)
    for k in range(high):
        kind, row = raw[k, 0], raw[k, 1:].copy()
        if kind == 1:
            row = np.cumsum(row.reshape(wide, channels), axis=0, dtype=np.uint64).astype(np.uint8).ravel()
        elif kind == 2:
            row = row + above
        elif kind in (3, 4):
            for j in range(len(row)):
                left, up = int(row[j - channels]) if j >= channels else 0, int(above[j])
                corner = int(above[j - channels]) if j >= channels else 0
                guess = left + up - corner
                near = min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]
                row[j] = (int(row[j]) + ((left + up) // 2 if kind == 3 else near)) & 255
        out[k] = above = row
    pixels = out.reshape(high, wide, channels)
    return np.repeat(pixels[:, :, :1], 3, axis=2) if channels < 3 else pixels[:, :, :3]


def framed(pixels: np.ndarray, boxes: list, scale: float, line: tuple = LINE, thick: int = 3) -> np.ndarray:
    """A copy with a frame for each box of four numbers in points; others are left out, and what lies outside is cut off."""
    out = pixels.copy()
    high, wide, _ = out.shape
    for box in boxes:
        if box is None or len(box) != 4:
            continue
        x0, y0, x1, y1 = (int(round(v * scale)) for v in box)
        x0, x1 = sorted((min(max(x0, 0), wide), min(max(x1, 0), wide)))
        y0, y1 = sorted((min(max(y0, 0), high), min(max(y1, 0), high)))
        for rows, columns in ((slice(y0, y0 + thick), slice(x0, x1)), (slice(max(y1 - thick, y0), y1), slice(x0, x1)), (slice(y0, y1), slice(x0, x0 + thick)), (slice(y0, y1), slice(max(x1 - thick, x0), x1))):
            out[rows, columns] = line
    return out


def overlaid(image: bytes | None, boxes: list, dpi: float = DPI) -> bytes | None:
    """A page image with boxes in points framed; None if there is no image."""
    return None if image is None else encode(framed(decode(image), boxes, dpi / BASE))


def drawn(pages: DataFrame, width: float = 595.0, height: float = 842.0, dpi: float = DPI) -> DataFrame:
    """(doc_id, page_number, image_path, png) of pages (doc_id, page_number, image_path, elements): white pages with their elements' boxes.

    Images are rows of a table, which any executor can write and read; image_path is unique to the document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = np.full((int(height * dpi / BASE), int(width * dpi / BASE), 3), 255, np.uint8)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                png = encode(framed(blank, row.column(3)[0].as_py() or [], dpi / BASE, FILL, 2))
                yield pa.RecordBatch.from_arrays([*row.columns[:3], pa.array([png], pa.binary())], ["doc_id", "page_number", "image_path", "png"])

    kind = pages.schema["doc_id"].dataType.simpleString()
    return pages.select("doc_id", F.col("page_number").cast("int"), "image_path", F.col("elements.bbox").alias("boxes")).mapInArrow(run, f"doc_id {kind}, page_number int, image_path string, png binary")


def overlays(images: DataFrame, boxes: DataFrame, dpi: float = DPI) -> DataFrame:
    """(doc_id, page_number, png): the images (doc_id, page_number, png) with the boxes (doc_id, page_number, bboxes) framed; pages without boxes stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                made = overlaid(row.column(2)[0].as_py(), row.column(3)[0].as_py() or [], dpi)
                yield pa.RecordBatch.from_arrays([*row.columns[:2], pa.array([made], pa.binary())], ["doc_id", "page_number", "png"])

    met = images.select("doc_id", F.col("page_number").cast("int").alias("page_number"), "png").join(boxes.select("doc_id", F.col("page_number").cast("int").alias("page_number"), "bboxes"), ["doc_id", "page_number"], "left")
    return met.mapInArrow(run, f"doc_id {images.schema['doc_id'].dataType.simpleString()}, page_number int, png binary")
