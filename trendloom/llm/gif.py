"""GIF media columns: decode LZW code streams, palettes, disposal and transparency into timed frames.

``decode_gif`` reads one file, ``gif_frames`` turns a DataFrame with a binary column into one row per frame
with colour-histogram columns, ``encode_gif`` writes frames losslessly. Each row is decoded on its own; there
is no shuffle, and memory is bounded by one file, its canvas and one frame, whatever a header claims.

Defined results: null bytes give one row with error 'null'; bytes that are no GIF or are cut short give the
frames before the fault and one row whose error says what is wrong (frame_index -1), and so does a canvas of more
than MOST_PIXELS pixels; empty frames have no pixels; equal rows give equal rows; an empty table gives none.
``media_digest`` takes a null text as empty, gives every row a result of its own, and ignores columns besides
doc_id and text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trendloom.llm.common import small_batches

#: Side of the rows of a stored payload, and rows of a frame at most.
WIDTH, ROWS, DELAY_CS = 192, 64, 4
#: Pixels of a canvas that is decoded, at most (four bytes each).
MOST_PIXELS = 1 << 25
_GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(256, 3)


class GifError(ValueError):
    pass


def _widths(count: int, size: int) -> np.ndarray:
    """Bits of the 1st, 2nd, ... code after a clear code; both sides derive them from the count alone."""
    entries = np.arange(count, dtype=np.int64) + ((1 << size) + 1)
    entries[:1] = 1 << size
    bits = np.full(count, size + 1, np.int64)
    for b in range(size + 1, 12):
        bits[entries >= (1 << b)] = b + 1
    return bits


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    """The LZW code stream of data, whose values are below 2**size. The table is cleared when it is full."""
    clear, first = 1 << size, (1 << size) + 2
    codes, runs, began = [clear], [], 1
    if data:
        table: dict[int, int] = {}
        get, put, following, cur = table.get, codes.append, first, data[0]
        for b in memoryview(data)[1:]:
            key = cur << 8 | b
            code = get(key)
            if code is not None:
                cur = code
                continue
            put(cur)
            cur = b
            if following < 4096:
                table[key] = following
                following += 1
            else:
                put(clear)
                runs.append(len(codes) - began)
                began = len(codes)
                table.clear()
                following = first
        put(cur)
    codes.append(clear + 1)
    runs.append(len(codes) - began)
    bits = np.concatenate([[size + 1], *(_widths(n, size) for n in runs)])
    at = np.cumsum(bits)
    total, at = int(at[-1]), at - bits
    value = np.array(codes, np.int64) << (at & 7)
    byte, n = at >> 3, (total + 7) // 8
    out = np.bincount(byte, value & 255, n + 2) + np.bincount(byte + 1, value >> 8 & 255, n + 2) + np.bincount(byte + 2, value >> 16, n + 2)
    return out[:n].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, size: int, most: int) -> bytes:
    """The values of an LZW code stream, most at most. Raises GifError on a code that no table entry explains."""
    clear, end, first = 1 << size, (1 << size) + 1, (1 << size) + 2
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    joined = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    total, at, out, made = len(stream) * 8, 0, [], 0
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, prev, seen = list(roots), None, 0
    while made < most:
        past = min(seen, 4096)  # from there on all codes have 12 bits
        bits = _widths(past + 4096, size)[past:]
        stops = at + np.cumsum(bits)
        fit = int(np.searchsorted(stops, total, "right"))
        if not fit:
            raise GifError("code stream ends early")
        starts = stops[:fit] - bits[:fit]
        codes = joined[starts >> 3] >> (starts & 7) & ((1 << bits[:fit]) - 1)
        special = np.flatnonzero((codes == clear) | (codes == end))
        n = int(special[0]) if len(special) else fit
        for c in codes[:n].tolist():
            if prev is None:
                if c >= clear:
                    raise GifError("first code is no root")
                entry = roots[c]
            else:
                if c < len(table):
                    entry = table[c]
                elif c == len(table) and c < 4096:
                    entry = prev + prev[:1]
                else:
                    raise GifError("code beyond the table")
                if len(table) < 4096:
                    table.append(prev + entry[:1])
            out.append(entry)
            made += len(entry)
            prev = entry
        seen += n
        if len(special):
            at = int(stops[n])
            if codes[n] == end:
                break
            table, prev, seen = list(roots), None, 0
        else:
            at = int(stops[fit - 1])
    return b"".join(out)[:most]


def _blocks(stream: bytes) -> bytes:
    return b"".join(bytes([len(p := stream[i : i + 255])]) + p for i in range(0, len(stream), 255)) + b"\0"


def encode_gif(frames: list[dict], palette: np.ndarray = _GREY, loop: int | None = None) -> bytes:
    """A GIF of frames. A frame: pixels (rows of palette indices, uint8), and optionally left, top, delay_cs,
    disposal (0-3), transparent (an index), palette (its own)."""
    tall = max((f.get("top", 0) + f["pixels"].shape[0] for f in frames), default=1)
    wide = max((f.get("left", 0) + f["pixels"].shape[1] for f in frames), default=1)
    if max(tall, wide) > 65535:
        raise GifError("a canvas has 65535 rows and columns at most")
    depth = max(1, int(np.ceil(np.log2(max(2, len(palette))))))
    padded = np.zeros((1 << depth, 3), np.uint8)
    padded[: len(palette)] = palette
    out = [b"GIF89a", struct.pack("<HHBBB", wide, tall, 0x80 | 7 << 4 | depth - 1, 0, 0), padded.tobytes()]
    if loop is not None:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", loop) + b"\0")
    for f in frames:
        t = f.get("transparent")
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", f.get("disposal", 1) << 2 | (t is not None), f.get("delay_cs", 0), t or 0, 0))
        rows, cols = f["pixels"].shape
        own, bits, flags = f.get("palette"), depth, 0
        if own is not None:
            bits = max(1, int(np.ceil(np.log2(max(2, len(own))))))
            flags = 0x80 | bits - 1
        out.append(b"\x2c" + struct.pack("<HHHHB", f.get("left", 0), f.get("top", 0), cols, rows, flags))
        if own is not None:
            table = np.zeros((1 << bits, 3), np.uint8)
            table[: len(own)] = own
            out.append(table.tobytes())
        size = max(2, bits)
        out += [bytes([size]), _blocks(lzw_encode(np.ascontiguousarray(f["pixels"]).tobytes(), size))]
    return b"".join(out) + b"\x3b"


def _order(rows: int) -> np.ndarray:
    """Where each stored row of an interlaced image belongs."""
    return np.concatenate([np.arange(a, rows, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode_gif(data: bytes) -> Iterator[dict]:
    """The frames of a GIF as composed on its canvas: index, delay_cs, disposal, left, top, indices (what the
    frame itself stores), rgba (the canvas after it, a fresh array)."""

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise GifError("file ends early")
        at += n
        return data[at - n : at]

    def chain() -> bytes:
        parts = []
        while n := take(1)[0]:
            parts.append(take(n))
        return b"".join(parts)

    at = 0
    if take(6) not in (b"GIF87a", b"GIF89a"):
        raise GifError("no GIF signature")
    wide, tall, flags, _, _ = struct.unpack("<HHBBB", take(7))
    shared = np.frombuffer(take(3 << (flags & 7) + 1), np.uint8).reshape(-1, 3) if flags & 0x80 else None
    if wide * tall > MOST_PIXELS:
        raise GifError("canvas too large")
    canvas = np.zeros((tall, wide, 4), np.uint8)
    index, delay, disposal, clear = 0, 0, 0, None
    while (kind := take(1)) != b"\x3b":
        if kind == b"\x21":
            label, body = take(1), chain()
            if label == b"\xf9" and len(body) >= 4:
                bits, delay, t = struct.unpack("<BHB", body[:4])
                disposal, clear = bits >> 2 & 7, t if bits & 1 else None
            continue
        if kind != b"\x2c":
            raise GifError("unknown block")
        left, top, cols, rows, bits = struct.unpack("<HHHHB", take(9))
        colours = np.frombuffer(take(3 << (bits & 7) + 1), np.uint8).reshape(-1, 3) if bits & 0x80 else shared
        size = take(1)[0]
        if colours is None or not 1 <= size <= 11:
            raise GifError("no palette" if colours is None else "bad code size")
        if top + rows > tall or left + cols > wide:
            raise GifError("frame beyond the canvas")
        values = lzw_decode(chain(), size, rows * cols)
        if len(values) < rows * cols:
            raise GifError("frame lacks pixels")
        pixels = np.frombuffer(values, np.uint8).reshape(rows, cols)
        if bits & 0x40:
            straight = np.empty_like(pixels)
            straight[_order(rows)] = pixels
            pixels = straight
        if len(colours) < 256 and pixels.size and int(pixels.max()) >= len(colours):
            raise GifError("index beyond the palette")
        region, before = canvas[top : top + rows, left : left + cols], canvas.copy() if disposal == 3 else None
        if clear is None:
            region[..., :3], region[..., 3] = colours[pixels], 255
        else:
            seen = pixels != clear
            region[seen, :3], region[seen, 3] = colours[pixels[seen]], 255
        yield {"index": index, "delay_cs": delay, "disposal": disposal, "left": left, "top": top, "indices": pixels, "rgba": canvas.copy()}
        if disposal == 2:
            region[...] = 0
        elif before is not None:
            canvas = before
        index, delay, disposal, clear = index + 1, 0, 0, None


def colour_histogram(rgba: np.ndarray) -> np.ndarray:
    """Visible pixels in 64 cells, 4 for each of red, green, blue."""
    shown = rgba.reshape(-1, 4)
    shown = shown[shown[:, 3] > 0] >> 6
    return np.bincount(shown[:, 0].astype(np.int64) * 16 + shown[:, 1] * 4 + shown[:, 2], minlength=64)


def gif_frames(df: DataFrame, column: str = "gif", key: str = "id") -> DataFrame:
    """One row per frame of the binary column: key, frame_index, start_ms, delay_ms, disposal, width, height,
    rgba (binary), histogram (64 counts), error (null where all is well). Other columns aren't kept."""
    small_batches(df.sparkSession, 200)
    kind = df.select(key).schema[0].dataType.simpleString()
    shape = f"{key} {kind}, frame_index int, start_ms long, delay_ms long, disposal int, width int, height int, rgba binary, histogram array<long>, error string"

    def rows_of(who, data):
        start, n = 0, 0
        try:
            if data is None:
                raise GifError("null")
            for f in decode_gif(data):
                tall, wide = f["rgba"].shape[:2]
                yield who, f["index"], start, f["delay_cs"] * 10, f["disposal"], wide, tall, f["rgba"].tobytes(), colour_histogram(f["rgba"]).tolist(), None
                start, n = start + f["delay_cs"] * 10, n + 1
        except GifError as e:
            yield who, -1, start, 0, 0, 0, 0, None, None, str(e)

    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for who, data in zip(batch.column(0), batch.column(1), strict=True):
                for row in rows_of(who.as_py(), data.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [batch.schema.types[0], *kinds], strict=True)], names)

    names = [key, "frame_index", "start_ms", "delay_ms", "disposal", "width", "height", "rgba", "histogram", "error"]
    return df.select(key, df[column].cast("binary")).mapInArrow(run, shape)


def store_payload(payload: bytes) -> bytes:
    """payload, a positive multiple of 192 bytes, as grey samples of a GIF with frames of 64 rows at most."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return encode_gif([{"pixels": rows[i : i + ROWS], "delay_cs": DELAY_CS} for i in range(0, len(rows), ROWS)])


def read_payload(media: bytes) -> tuple[bytes, np.ndarray, int]:
    """The samples back from the composed canvas, their histogram of 16 grey levels, and the frames' number."""
    parts, levels, frames = [], np.zeros(256, np.int64), 0
    for f in decode_gif(media):
        rows, cols = f["indices"].shape
        grey = f["rgba"][f["top"] : f["top"] + rows, f["left"] : f["left"] + cols, 0]
        parts.append(grey.tobytes())
        levels += np.bincount(np.frombuffer(parts[-1], np.uint8), minlength=256)
        frames += 1
    return b"".join(parts), levels.reshape(16, 16).sum(axis=1), frames


def media_digest(df: DataFrame) -> DataFrame:
    """For each row (doc_id, text): the text's bytes stored as a GIF, read back, and digests of both."""
    small_batches(df.sparkSession)
    kind = df.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_ms"]

    def one(text: str | None) -> tuple:
        raw = (text or "").encode()
        media = store_payload(raw + b" " * (-len(raw) % WIDTH or (0 if raw else WIDTH)))
        back, levels, frames = read_payload(media)
        feature = ",".join(map(str, levels.tolist()))
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, frames, frames * DELAY_CS * 10

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = [one(x) for x in batch.column(1).to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_ms long")
