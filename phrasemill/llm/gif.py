"""Media columns: animated GIF to timed frames with colour histograms.

The decoder reads the LZW code streams, applies global and local palettes, interlacing, transparency and
disposal, and gives each frame as the canvas looks while it is shown.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: two bits a channel
BINS = 64
#: pixels of a canvas or a frame beyond which it is an error: as many bytes of RGBA as an executor can hold a few times
MOST_PIXELS = 1 << 26
#: bytes of frames that a task holds before it hands them on
HELD = 32_000_000


class Frame(NamedTuple):
    """A frame as it is stored: indices into its palette and where it lies."""

    left: int
    top: int
    indices: np.ndarray  # height x width
    palette: np.ndarray | None = None  # n x 3; None: the global one
    delay: int = 10  # hundredths of a second
    disposal: int = 0
    transparent: int | None = None
    interlaced: bool = False


class Shown(NamedTuple):
    start_ms: int
    delay_ms: int
    disposal: int
    rgba: np.ndarray  # height x width x 4


def lzw_decode(data: bytes, least: int, most: int) -> bytes:
    """Up to ``most`` indices of a code stream whose codes start at least + 1 bits."""
    clear, end = 1 << least, (1 << least) + 1
    first = [bytes([i]) for i in range(clear)] + [b"", b""]
    table_, width, before = list(first), least + 1, None
    out, size, bits, held = [], 0, 0, 0
    for byte in data:
        bits |= byte << held
        held += 8
        while held >= width:
            code = bits & ((1 << width) - 1)
            bits >>= width
            held -= width
            if code == clear:
                table_, width, before = list(first), least + 1, None
                continue
            if code == end:
                return b"".join(out)[:most]
            if before is None:
                if code >= clear:
                    raise ValueError("the first code isn't a colour")
                now = table_[code]
            else:
                if code < len(table_):
                    now = table_[code]
                elif code == len(table_):
                    now = before + before[:1]
                else:
                    raise ValueError("a code that isn't in the table yet")
                if len(table_) < 4096:
                    table_.append(before + now[:1])
                    if len(table_) == 1 << width and width < 12:
                        width += 1
            out.append(now)
            size += len(now)
            if size >= most:
                return b"".join(out)[:most]
            before = now
    return b"".join(out)[:most]


def lzw_encode(indices: bytes, least: int) -> bytes:
    clear, end = 1 << least, (1 << least) + 1
    known, width = {bytes([i]): i for i in range(clear)}, least + 1
    bits, held, out, following = 0, 0, bytearray(), end + 1

    def put(code: int) -> None:
        nonlocal bits, held
        bits |= code << held
        held += width
        while held >= 8:
            out.append(bits & 255)
            bits >>= 8
            held -= 8

    put(clear)
    own = b""
    for i in indices:
        more = own + bytes([i])
        if more in known:
            own = more
            continue
        put(known[own])
        if following < 4096:
            known[more] = following
            if following == 1 << width and width < 12:
                width += 1
            following += 1
        else:
            put(clear)
            known, width, following = {bytes([i]): i for i in range(clear)}, least + 1, end + 1
        own = bytes([i])
    if own:
        put(known[own])
        if following == 1 << width and width < 12 and following < 4096:
            width += 1
    put(end)
    if held:
        out.append(bits & 255)
    return bytes(out)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        if at + 1 + n > len(data):
            raise IndexError
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _rows(height: int) -> list[int]:
    return [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, height, step)]


def shown_frames(data: bytes, most_pixels: int = MOST_PIXELS) -> Iterator[Shown]:
    """The frames in order, one at a time: a frame's rgba is the canvas itself, which the next one draws on.

    ValueError says what is wrong with the data, once the frames before that have come.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    try:
        width, height, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
        if width * height > most_pixels:
            raise ValueError("the canvas is too large")
        at, shared = 13, None
        if flags & 0x80:
            n = 2 << (flags & 7)
            shared, at = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(n, 3), at + 3 * n
        canvas, time = np.zeros((height, width, 4), np.uint8), 0
        delay, disposal, transparent = 0, 0, None
        while (kind := data[at]) != 0x3B:
            if kind == 0x21:
                if data[at + 1] == 0xF9:
                    packed, delay, index = struct.unpack("<BHB", data[at + 3 : at + 7])
                    disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
                _, at = _blocks(data, at + 2)
                continue
            if kind != 0x2C:
                raise ValueError("an unknown block")
            left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at, palette = at + 10, shared
            if flags & 0x80:
                n = 2 << (flags & 7)
                palette, at = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(n, 3), at + 3 * n
            if palette is None:
                raise ValueError("a frame without a palette")
            least = data[at]
            if not 1 <= least <= 11:
                raise ValueError("a code size out of range")
            if w * h > most_pixels:
                raise ValueError("a frame is too large")
            code, at = _blocks(data, at + 1)
            own = np.frombuffer(lzw_decode(code, least, w * h), np.uint8)
            if len(own) < w * h:
                raise ValueError("a frame ends early")
            own = own.reshape(h, w)
            if flags & 0x40:
                straight = np.empty_like(own)
                straight[_rows(h)] = own
                own = straight
            before = canvas.copy() if disposal == 3 else None
            area = canvas[top : top + h, left : left + w]
            own = own[: area.shape[0], : area.shape[1]]
            drawn = np.ones(own.shape, bool) if transparent is None else own != transparent
            if (own[drawn] >= len(palette)).any():
                raise ValueError("a colour that isn't in the palette")
            area[drawn, :3], area[drawn, 3] = palette[own[drawn]], 255
            yield Shown(time, 10 * delay, disposal, canvas)
            time += 10 * delay
            if disposal == 2:
                area[:] = 0
            elif disposal == 3:
                canvas = before
            delay, disposal, transparent = 0, 0, None
    except (IndexError, struct.error):
        raise ValueError("the data end early") from None


def decode(data: bytes) -> list[Shown]:
    """All frames at once.  ValueError says what is wrong with the data."""
    return [f._replace(rgba=f.rgba.copy()) for f in shown_frames(data)]


def encode(width: int, height: int, palette: np.ndarray, frames: list[Frame]) -> bytes:
    """An animated GIF.  palette: n x 3, n a power of two from 2 to 256."""
    bits = lambda p: max(1, int(len(p) - 1).bit_length())
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x80 | bits(palette) - 1, 0, 0), np.asarray(palette, np.uint8).tobytes()]
    for f in frames:
        own = palette if f.palette is None else f.palette
        h, w = f.indices.shape
        packed = f.disposal << 2 | (f.transparent is not None)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", packed, f.delay, f.transparent or 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, w, h, (0 if f.palette is None else 0x80 | bits(own) - 1) | 0x40 * f.interlaced))
        if f.palette is not None:
            out.append(np.asarray(own, np.uint8).tobytes())
        least = max(2, bits(own))
        code = lzw_encode(np.asarray(f.indices[_rows(h)] if f.interlaced else f.indices, np.uint8).tobytes(), least)
        out.append(bytes([least]) + b"".join(bytes([len(code[i : i + 255])]) + code[i : i + 255] for i in range(0, len(code), 255)) + b"\0")
    return b"".join(out) + b"\x3b"


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Opaque pixels by colour: two bits of red, of green, of blue."""
    flat, out = rgba.reshape(-1, 4), np.zeros(BINS, np.int64)
    for i in range(0, len(flat), 1 << 20):
        part = flat[i : i + (1 << 20)]
        c = part[part[:, 3] > 0] >> 6
        out += np.bincount(c[:, 0] * 16 + c[:, 1] * 4 + c[:, 2], minlength=BINS)
    return out


FIELDS = "media_id long, frame int, start_ms long, delay_ms long, disposal int, width int, height int, n_opaque long, histogram array<int>, rgba binary, error string"


def frames(media: DataFrame, id_column: str = "media_id", data_column: str = "data", most_pixels: int = MOST_PIXELS) -> DataFrame:
    """A row for each frame of each GIF: FIELDS.

    Data that are null, empty, cut off, no GIF or of a larger canvas than most_pixels have a row with ``error`` and
    nulls, behind the rows of the frames that come before the fault; a GIF without a frame has none.  Many or large
    frames are handed on as they are decoded: a task holds HELD bytes of them and one frame more.  Repeated
    rows have frames each; a null id stays null; an empty table has an empty result; further columns have no part.
    """
    names = [f.split()[0] for f in FIELDS.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            rows, held = [], 0
            for media_id, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    for i, f in enumerate(shown_frames(data.as_py() or b"", most_pixels)):
                        h, w = f.rgba.shape[:2]
                        rows.append((media_id, i, f.start_ms, f.delay_ms, f.disposal, w, h, int((f.rgba[..., 3] > 0).sum()), histogram(f.rgba), f.rgba.tobytes(), None))
                        held += f.rgba.size
                        if held > HELD or len(rows) > 5000:
                            yield made(rows)
                            rows, held = [], 0
                except ValueError as e:
                    rows.append((media_id, *[None] * 9, str(e)))
            if rows:
                yield made(rows)

    return media.select(media[id_column].cast("long").alias("media_id"), media[data_column].cast("binary").alias("data")).mapInArrow(run, FIELDS)


PALETTE = np.array([[17 * i, 255 - 17 * i, (85 * i) % 256] for i in range(16)], np.uint8)


def drawing(vector: np.ndarray) -> list[Frame]:
    """Four frames that draw a vector of 64 numbers on 8 x 8 pixels, with every kind of disposal."""
    level = np.clip(np.floor((np.asarray(vector, float) + 0.5) * 16), 0, 15).astype(np.uint8).reshape(8, 8)
    return [
        Frame(0, 0, level, delay=10, disposal=1),
        Frame(2, 2, 15 - level[2:6, 2:6], delay=5, disposal=2, transparent=7, interlaced=True),
        Frame(0, 4, level[:4], palette=PALETTE[::-1], delay=7, disposal=3, transparent=8),
        Frame(4, 0, level[:, 4:].T.copy(), delay=20, transparent=int(level[0, 0])),
    ]


def drawn(vectors: DataFrame) -> DataFrame:
    """(media_id, data): vectors(vec_id, embedding) as GIFs; one that hasn't 64 finite numbers has null data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                v = np.array([np.nan if x is None else x for x in v or []], float)
                out.append(encode(8, 8, PALETTE, drawing(v)) if len(v) == 64 and np.isfinite(v).all() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["media_id", "data"])

    return vectors.select(vectors["vec_id"].cast("long").alias("media_id"), vectors["embedding"].cast("array<double>").alias("v")).mapInArrow(run, "media_id long, data binary")


def op8_gif_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test tables hold no media, so the query draws each row of embeddings as a GIF and decodes that."""
    return frames(drawn(table(spark, sf_dir, "embeddings")))
