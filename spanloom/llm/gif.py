"""GIF media columns: a writer, an LZW decoder, and timed frames with colour histograms.

``encode_payloads`` stores byte payloads losslessly as the samples of a GIF animation;
``decode_media`` decodes any GIF89a/87a column: LZW code streams, global and local palettes,
interlacing, transparency and the disposal rules, frame times and a colour histogram of every
composed frame.

Defined results: a null text is an empty payload, which is padded like any other; a null or broken
media value gives ``error`` and no frames; rows are independent, so repeated rows repeat; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import chunks, quoted

#: Payloads are padded with bytes 255 to a positive multiple of this.
UNIT = 576
#: Frames are WIDTH wide and at most WIDTH high; UNIT is a multiple of WIDTH.
WIDTH = 96
#: Hundredths of a second that the writer shows each frame.
DELAY_CS = 4
#: Levels of each of red, green and blue that the histograms tell apart (64 bins).
LEVELS = 4

CLEAR, END, FIRST = 256, 257, 258


def widths(min_size: int) -> np.ndarray:
    """Code widths by the number k of codes since the last clear code, until the table is full.

    Before the k-th code a reader's table holds k - 1 entries of its own (none before the first two).
    """
    first = (1 << min_size) + 2
    held = first + np.maximum(np.arange(4098 - first) - 1, 0)
    return np.minimum(12, np.floor(np.log2(held)) + 1).astype(np.int64)


WIDTHS = widths(8)
_GREY = bytes(v for v in range(256) for _ in range(3))
_TWELVE = np.arange(12)
#: Pixels of a canvas or frame beyond which media counts as broken; four bytes of memory each.
MOST_PIXELS = 1 << 24


class BrokenMedia(ValueError):
    """The bytes are not a GIF that can be decoded."""


def lzw_codes(data: bytes) -> list[list[int]]:
    """Greedy LZW codes of bytes, in runs that each begin on an empty table."""
    if not data:
        return [[]]
    runs: list[list[int]] = []
    run: list[int] = []
    emit, place = run.append, {}.setdefault
    new, last = FIRST, data[0]
    for byte in data[1:]:
        code = place(last << 8 | byte, new)
        if code == new:  # a pair that was not in the table and now is
            emit(last)
            last = byte
            new += 1
            if new == 4096:
                runs.append(run)
                run = []
                emit, place, new = run.append, {}.setdefault, FIRST
        else:
            last = code
    emit(last)
    return [*runs, run]


def pack(runs: list[list[int]]) -> bytes:
    """Runs of codes as GIF's bit stream: a clear code before each, the end code after the last."""
    codes: list[int] = []
    spans: list[np.ndarray] = []
    width = 9
    for run in runs:
        codes.append(CLEAR)
        codes += run
        spans += [np.array([width]), WIDTHS[: len(run)]]
        width = int(WIDTHS[len(run)])
    codes.append(END)
    spans.append(np.array([width]))
    values, sizes = np.array(codes), np.concatenate(spans)
    bits = (values[:, None] >> _TWELVE & 1).astype(np.uint8)
    return np.packbits(bits[_TWELVE < sizes[:, None]], bitorder="little").tobytes()


def sub_blocks(data: bytes) -> bytes:
    out = []
    for i in range(0, len(data), 255):
        part = data[i : i + 255]
        out += [bytes((len(part),)), part]
    return b"".join(out) + b"\0"


def write_gif(samples: bytes, width: int = WIDTH, delay_cs: int = DELAY_CS) -> bytes:
    """A greyscale animation whose frames hold ``samples`` row by row, ``width`` square or less."""
    if not samples or len(samples) % width:
        raise ValueError("whole rows are needed")
    step = width * width
    high = min(width, len(samples) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, high, 0xF7, 0, 0), _GREY]
    for at in range(0, len(samples), step):
        part = samples[at : at + step]
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay_cs, 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, width, len(part) // width, 0))
        out += [b"\x08", sub_blocks(pack(lzw_codes(part)))]
    return b"".join([*out, b"\x3b"])


def _windows(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    return raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16


def read_codes(data: bytes, min_size: int) -> Iterator[list[int]]:
    """Runs of codes between clear codes. Widths follow from the place in a run alone."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    sizes = WIDTHS if min_size == 8 else widths(min_size)
    ends = np.cumsum(sizes)
    words, total, at = _windows(data), 8 * len(data), 0
    while at < total:
        k = int(np.searchsorted(ends, total - at, side="right"))
        more = 0
        if k == len(sizes):  # a full table without a clear code: 12 bits from here on
            more = (total - at - int(ends[-1])) // 12
        if not k:
            return
        width = np.concatenate([sizes[:k], np.full(more, 12)]) if more else sizes[:k]
        place = at + np.cumsum(width) - width
        codes = words[place >> 3] >> (place & 7) & (1 << width) - 1
        stop = np.flatnonzero((codes == clear) | (codes == end))
        if not len(stop):
            yield codes.tolist()
            return
        n = int(stop[0])
        if n:
            yield codes[:n].tolist()
        if codes[n] == end:
            return
        at = int(place[n] + width[n])


def unlzw(data: bytes, min_size: int, most: int) -> bytes:
    """The bytes of an LZW stream of any GIF writer, up to the run of codes that reaches ``most`` of them."""
    base = [bytes((i,)) for i in range(1 << min_size)] + [b"", b""]
    runs: list[bytes] = []
    size = 0
    for codes in read_codes(data, min_size):
        if size >= most:
            break
        out: list[bytes] = []
        table = base.copy()
        if codes[0] >= len(base):
            raise BrokenMedia("a code beyond the table")
        last = table[codes[0]]
        room = 4097 - len(base)
        emit, place = out.append, table.append
        emit(last)
        for code in codes[1:room]:
            try:
                text = table[code]
            except IndexError:
                if code != len(table):
                    raise BrokenMedia("a code beyond the table") from None
                text = last + last[:1]
            emit(text)
            place(last + text[:1])
            last = text
        runs.append(b"".join(out))
        size += len(runs[-1])
        for at in range(room, len(codes), 256):  # a full table: each code may stand for thousands of bytes
            if size >= most:
                break
            runs.append(b"".join([table[code] for code in codes[at : at + 256]]))
            size += len(runs[-1])
    return b"".join(runs)


@dataclass
class Frame:
    index: int
    start_ms: int
    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    disposal: int
    transparent: int | None
    indices: np.ndarray = field(repr=False)
    canvas: np.ndarray = field(repr=False)

    def row(self) -> dict:
        return {k: getattr(self, k) for k in ("index", "start_ms", "delay_ms", "left", "top", "width", "height", "disposal", "transparent")} | {"histogram": histogram(self.canvas)}


def histogram(canvas: np.ndarray) -> list[int]:
    """Counts of the opaque pixels by red, green and blue level, and last those of clear pixels."""
    level = (canvas >> 6).astype(np.int64)
    bins = (level[..., 0] * LEVELS + level[..., 1]) * LEVELS + level[..., 2]
    bins = np.where(canvas[..., 3] > 0, bins, LEVELS**3)
    return np.bincount(bins.ravel(), minlength=LEVELS**3 + 1).tolist()


def _interlaced(height: int) -> np.ndarray:
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def read_gif(media: bytes, most_pixels: int = MOST_PIXELS) -> Iterator[Frame]:
    """Frames in order, each with its indices and the composed RGBA canvas as it is shown.

    A canvas or a frame of more than ``most_pixels`` is broken media: headers are not trusted with memory.
    """
    if media[:6] not in (b"GIF89a", b"GIF87a") or len(media) < 13:
        raise BrokenMedia("not a GIF")
    try:
        yield from _frames(media, most_pixels)
    except (IndexError, struct.error) as e:
        raise BrokenMedia("it ends early") from e


def _frames(media: bytes, most_pixels: int) -> Iterator[Frame]:
    wide, high, flags, _, _ = struct.unpack_from("<HHBBB", media, 6)
    at = 13

    def palette(bits: int) -> np.ndarray:
        nonlocal at
        n = 3 << bits + 1
        if at + n > len(media):
            raise BrokenMedia("it ends in a palette")
        out = np.zeros((256, 4), np.uint8)
        out[:, 3] = 255
        out[: n // 3, :3] = np.frombuffer(media, np.uint8, n, at).reshape(-1, 3)
        at += n
        return out

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while n := media[at]:
            parts.append(media[at + 1 : at + 1 + n])
            at += n + 1
        at += 1
        return b"".join(parts)

    shared = palette(flags & 7) if flags & 0x80 else None
    if wide * high > most_pixels:
        raise BrokenMedia("more pixels than the bound")
    canvas = np.zeros((high, wide, 4), np.uint8)
    index = time = delay = disposal = 0
    transparent: int | None = None
    while (kind := media[at]) != 0x3B:
        at += 1
        if kind == 0x21:
            label = media[at]
            at += 1
            body = blocks()
            if label == 0xF9:
                packed, hundredths, clear = struct.unpack_from("<BHB", body)
                delay, disposal, transparent = 10 * hundredths, packed >> 2 & 7, clear if packed & 1 else None
        elif kind == 0x2C:
            left, top, width, height, packed = struct.unpack_from("<HHHHB", media, at)
            at += 9
            colours = palette(packed & 7) if packed & 0x80 else shared
            if colours is None:
                raise BrokenMedia("no palette")
            min_size = media[at]
            at += 1
            if not 2 <= min_size <= 8:
                raise BrokenMedia("no such code size")
            if width * height > most_pixels:
                raise BrokenMedia("more pixels than the bound")
            data = unlzw(blocks(), min_size, width * height)
            if len(data) < width * height:
                raise BrokenMedia("a frame lacks pixels")
            pixels = np.frombuffer(data, np.uint8, width * height).reshape(height, width)
            if packed & 0x40:
                rows = np.empty_like(pixels)
                rows[_interlaced(height)] = pixels
                pixels = rows
            before = canvas.copy() if disposal == 3 else None
            part = canvas[top : top + height, left : left + width]
            seen = pixels[: part.shape[0], : part.shape[1]]
            if transparent is None:
                part[...] = colours[seen]
            else:
                opaque = seen != transparent
                part[opaque] = colours[seen[opaque]]
            yield Frame(index, time, delay, left, top, width, height, disposal, transparent, pixels, canvas)
            if disposal == 2:
                part[...] = 0
            elif before is not None:
                canvas = before
            index, time = index + 1, time + delay
            delay, disposal, transparent = 0, 0, None
        else:
            raise BrokenMedia("an unknown block")


def encode_payloads(df: DataFrame, key: str = "doc_id", payload: Column | str = "text") -> DataFrame:
    """One row for each row of ``df``: doc_id, n_bytes (unpadded), media (a GIF of the payload)."""
    source = F.col(payload) if isinstance(payload, str) else payload
    given = df.select(F.col(key).alias("doc_id"), F.coalesce(source.cast("binary"), F.lit(b"").cast("binary")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "payload"):
                raw = part.column("payload").to_pylist()
                media = [write_gif(p + b"\xff" * (-len(p) % UNIT if p else UNIT)) for p in raw]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


FRAME = "struct<index:int,start_ms:long,delay_ms:long,left:int,top:int,width:int,height:int,disposal:int,transparent:int,histogram:array<long>>"


def decode_media(df: DataFrame, key: str = "doc_id", media: str = "media", carry: tuple[str, ...] = (), most_pixels: int = MOST_PIXELS) -> DataFrame:
    """One row for each row of ``df``: doc_id, columns of ``carry``, media, frames, samples, error.

    Media that are no GIF, end early or have more than ``most_pixels`` in a canvas or frame give ``error``,
    no frames and null samples.

    ``samples`` are the red values of every composed frame's own rectangle, end to end, which are
    the palette indices where the palette is grey. ``frames`` holds times and histograms.
    """
    given = df.select(F.col(quoted(key)).alias("doc_id"), *(F.col(quoted(c)).alias(f"carry_{i}") for i, c in enumerate(carry)), F.col(quoted(media)).alias("media"))
    kinds = pa.struct([(n, pa.int64() if n.endswith("_ms") else pa.list_(pa.int64()) if n == "histogram" else pa.int32()) for n in ("index", "start_ms", "delay_ms", "left", "top", "width", "height", "disposal", "transparent", "histogram")])

    def one(raw: bytes | None) -> tuple[list[dict], bytes | None, str | None]:
        try:
            frames, parts = [], []
            for f in read_gif(raw or b"", most_pixels):
                frames.append(f.row())
                parts.append(f.canvas[f.top : f.top + f.height, f.left : f.left + f.width, 0].tobytes())
            return frames, b"".join(parts), None
        except BrokenMedia as e:
            return [], None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "media"):
                found = [one(m) for m in part.column("media").to_pylist()]
                frames, samples, errors = zip(*found, strict=True)
                made = [pa.array(frames, pa.list_(kinds)), pa.array(samples, pa.binary()), pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, "frames", "samples", "error"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema)
    found = given.mapInArrow(run, f"{kept}, frames array<{FRAME}>, samples binary, error string")
    return found.select("doc_id", *(F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)), "media", "frames", "samples", "error")
