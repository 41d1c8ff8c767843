"""Media columns for GIF: LZW code streams, palettes, disposal, transparency, timed frames, colour histograms.

read_gif() decodes any GIF87a or GIF89a stream to composed RGB frames with their delays; frames() makes
them a table of one row a frame. write_gif() stores 8-bit samples losslessly. The document query stores
each text's bytes as palette indexes of a 192 samples wide picture and reads them back from the colours of
the composed frames.

Defined results: a null or empty payload is one row of blanks; texts of any length are stored whole, in
frames of at most ROWS lines. Broken streams raise ValueError in read_gif() and give a row with an error and
no frames in frames(). A null id stays null, repeated rows and ids each give a row of equal values, and an
empty table gives an empty result. Columns other than doc_id and text (media_id and gif) are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, texts, tune

WIDTH, ROWS = 192, 4096
LIMIT = 4096  # codes of the largest table


def packed(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of the given bit widths, least significant bit first."""
    bits = (codes[:, None] >> np.arange(12)) & 1
    return np.packbits(bits[np.arange(12) < widths[:, None]].astype(np.uint8), bitorder="little").tobytes()


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    """LZW codes of samples of `size` bits: a clear code first and whenever the table is full, an end code last."""
    clear, end = 1 << size, (1 << size) + 1
    runs: list[list[int]] = []
    table: dict[int, int] = {}
    get, codes, fresh = table.get, [], end + 1
    at = iter(data)
    prefix = next(at, None)
    for c in at:
        key = prefix << 8 | c
        code = get(key)
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        prefix = c
        if fresh < LIMIT:
            table[key] = fresh
            fresh += 1
        else:  # the decoder's table is one entry behind: it fills with this code
            runs.append(codes)
            table.clear()
            codes, fresh = [], end + 1
    if prefix is not None:
        codes.append(prefix)
    runs.append(codes)
    out, width = [], []
    for i, codes in enumerate(runs):
        # the clear code has the width that the run before it had reached
        out.append(clear)
        width.append(size + 1 if i == 0 else min(12, max(size + 1, (end + len(runs[i - 1])).bit_length())))
        out += codes
        width += _widths(len(codes), size)
    out.append(end)
    width.append(min(12, max(size + 1, (end + len(runs[-1])).bit_length())))
    return packed(np.array(out, np.int32), np.array(width, np.int32))


def _widths(n: int, size: int) -> list[int]:
    """Bit widths of the n codes after a clear code: code k comes when the table has grown by k - 1 entries."""
    base = (1 << size) + 1
    k = np.maximum(np.arange(n), 1)
    return np.clip(np.ceil(np.log2(base + k + 0.5)).astype(int), size + 1, 12).tolist()


def _codes(data: np.ndarray, at: int, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes from bit `at` on for the given table lengths, as far as the data reach, and the bit after each."""
    width = np.clip(np.frexp(lengths)[1], size + 1, 12)
    ends = at + np.cumsum(width)
    ends = ends[: np.searchsorted(ends, 8 * (len(data) - 4), "right")]
    width = width[: len(ends)]
    start = ends - width
    byte = start >> 3
    value = data[byte].astype(np.int64) | data[byte + 1].astype(np.int64) << 8 | data[byte + 2].astype(np.int64) << 16
    return value >> (start & 7) & ((1 << width) - 1), ends


def lzw_decode(data: bytes, size: int, count: int) -> bytes:
    """The samples of a code stream, at most count; clear codes may come early, late or never.

    Widths follow from the table's length alone, so the codes up to the next clear are cut out at once.
    """
    clear, end = 1 << size, (1 << size) + 1
    bits = np.frombuffer(data + b"\0\0\0\0", np.uint8)
    first = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, out, last = list(first), [], b""
    at = made = 0
    while made < count:
        room = LIMIT - len(table)
        if room:  # the first code after a clear adds no entry
            lengths = np.minimum(len(table) + np.maximum(np.arange(room + 1) - (0 if last else 1), 0), LIMIT - 1)[: room + (0 if last else 1)]
        else:
            lengths = np.full(LIMIT, LIMIT - 1)
        codes, ends = _codes(bits, at, lengths, size)
        if not len(codes):
            break
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else len(codes)
        run = codes[:stop].tolist()
        at = int(ends[min(stop, len(codes) - 1)])
        before = len(out)
        if run and not last:
            if run[0] >= clear:
                raise ValueError("a code beyond the table")
            last = table[run[0]]
            out.append(last)
            del run[0]
        if room:
            for code in run:
                try:
                    s = table[code]
                except IndexError:
                    if code != len(table):
                        raise ValueError("a code beyond the table") from None
                    s = last + last[:1]
                table.append(last + s[:1])
                out.append(s)
                last = s
        elif run:
            out += map(table.__getitem__, run)
            last = out[-1]
        made += sum(map(len, out[before:]))
        if len(stops):
            if codes[stop] == end:
                break
            table, last = list(first), b""
    return b"".join(out)[:count]


@dataclass
class Frame:
    delay_ms: int
    disposal: int
    rgb: np.ndarray  # height, width, 3: composed on the canvas
    indexes: bytes  # the frame's own samples, rows in order
    box: tuple[int, int, int, int]


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + 255] for i in range(0, len(data), 255)]


def write_gif(samples: bytes, width: int = WIDTH, delay_ms: int = 100) -> bytes:
    """Samples as frames of `width` by at most ROWS, over a grey palette. The last sub-block of each frame's codes is followed by an empty one."""
    per, total = width * ROWS, -(-len(samples) // width)
    parts = [samples[i : i + per] for i in range(0, len(samples), per)]
    height = min(ROWS, total)
    grey = bytes(v for i in range(256) for v in (i, i, i))
    out = [b"GIF89a", width.to_bytes(2, "little"), height.to_bytes(2, "little"), b"\xf7\0\0", grey]
    for p in parts:
        out += [b"\x21\xf9\x04\x04", (delay_ms // 10).to_bytes(2, "little"), b"\0\0", b"\x2c\0\0\0\0", width.to_bytes(2, "little"), (len(p) // width).to_bytes(2, "little"), b"\0\x08"]
        for b in blocks(lzw_encode(p)):
            out += [bytes([len(b)]), b]
        out.append(b"\0")
    out.append(b"\x3b")
    return b"".join(out)


def read_gif(data: bytes, compose: bool = True) -> list[Frame]:
    """The frames of a GIF, as each_frame() gives them."""
    return list(each_frame(data, compose))


def each_frame(data: bytes, compose: bool = True) -> Iterator[Frame]:
    """The frames of a GIF one by one. With compose, each is the canvas after it: transparent samples keep what
    is there; then disposal 2 clears the frame's box and disposal 3 restores what was there before it."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    wide, high, flags = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little"), data[10]
    at = 13

    def palette(flag: int) -> np.ndarray | None:
        nonlocal at
        if not flag & 128:
            return None
        n = 3 * (2 << (flag & 7))
        at += n
        return np.frombuffer(data[at - n : at].ljust(n, b"\0"), np.uint8).reshape(-1, 3)

    def body() -> bytes:
        nonlocal at
        out = []
        while True:
            if at >= len(data):
                raise ValueError("a block runs past the end")
            n = data[at]
            out.append(data[at + 1 : at + 1 + n])
            at += 1 + n
            if not n:
                return b"".join(out)

    shared = palette(flags)
    canvas = np.zeros((high, wide, 3), np.uint8) if compose else None
    delay = disposal = 0
    clear = None
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        at += 1
        if kind == 0x21:
            label = data[at] if at < len(data) else 0
            at += 1
            info = body()
            if label == 0xF9 and len(info) >= 4:
                disposal, delay = info[0] >> 2 & 7, 10 * int.from_bytes(info[1:3], "little")
                clear = info[3] if info[0] & 1 else None
        elif kind == 0x2C:
            if at + 9 > len(data):
                raise ValueError("a frame's head runs past the end")
            x, y, w, h = (int.from_bytes(data[at + i : at + i + 2], "little") for i in (0, 2, 4, 6))
            own = data[at + 8]
            at += 9
            colours = palette(own)
            colours = shared if colours is None else colours
            size = data[at] if at < len(data) else 0
            at += 1
            if not 1 <= size <= 8:
                raise ValueError("a code size out of range")
            samples = lzw_decode(body(), size, w * h).ljust(w * h, b"\0")
            if own & 64:  # interlaced: rows come in four passes
                rows = [r for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(start, h, step)]
                lines = {r: samples[i * w : (i + 1) * w] for i, r in enumerate(rows)}
                samples = b"".join(lines[r] for r in range(h))
            if compose:
                if colours is None:
                    colours = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
                before = canvas.copy() if disposal == 3 else None
                index = np.frombuffer(samples, np.uint8).reshape(h, w)[: max(0, high - y), : max(0, wide - x)]
                box = canvas[y : y + index.shape[0], x : x + index.shape[1]]
                shown = colours.take(index, axis=0, mode="clip")
                if clear is None:
                    box[:] = shown
                else:
                    seen = index != clear
                    box[seen] = shown[seen]
                yield Frame(delay, disposal, canvas.copy(), samples, (x, y, w, h))
                if disposal == 2:
                    box[:] = 0
                elif disposal == 3:
                    canvas = before
            else:
                yield Frame(delay, disposal, np.zeros((0, 0, 3), np.uint8), samples, (x, y, w, h))
            delay = disposal = 0
            clear = None
        elif kind:
            raise ValueError("an unknown block")


def histogram(rgb: np.ndarray) -> list[int]:
    """Pixels in each of 64 colour bins, two bits a channel."""
    q = rgb.reshape(-1, 3) >> 6
    return np.bincount(q[:, 0] << 4 | q[:, 1] << 2 | q[:, 2], minlength=64).tolist()


def payload(frame: Frame) -> bytes:
    """The samples that write_gif() stored, from the colours in the frame's box: each is a level of grey."""
    x, y, w, h = frame.box
    box = frame.rgb[y : y + h, x : x + w]
    level = box[..., 0]
    if not (np.array_equal(level, box[..., 1]) and np.array_equal(level, box[..., 2])):
        raise ValueError("a colour that is not grey")
    return level.tobytes()


FRAMES = "media_id long, frame int, start_ms long, delay_ms int, disposal int, width int, height int, rgb binary, histogram array<long>, error string"


def frames(media: DataFrame) -> DataFrame:
    """A row for each timed frame of media (media_id, gif); a row with an error for broken or null streams."""
    tune(media.sparkSession)

    def work(batch: pa.RecordBatch):
        rows = []
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                start = 0
                for i, f in enumerate(read_gif(data or b"")):
                    rows.append((key, i, start, f.delay_ms, f.disposal, f.rgb.shape[1], f.rgb.shape[0], f.rgb.tobytes(), histogram(f.rgb), None))
                    start += f.delay_ms
            except ValueError as e:
                rows.append((key, None, None, None, None, None, None, None, None, str(e)))
        names = [c.split()[0] for c in FRAMES.split(", ")]
        return {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return per_batch(media.select(F.col("media_id").cast("long"), F.col("gif").cast("binary")), FRAMES, work)


COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Every text of docs (doc_id, text) as a GIF: what was stored and read back from the composed frames, with
    each frame's start, delay and colour histogram (64 bins) as feature. keep_media adds the GIF itself."""
    tune(docs.sparkSession)

    def work(batch: pa.RecordBatch):
        ids, rows = batch.column(0).to_pylist(), []
        for text in batch.column(1).to_pylist():
            raw = (text or "").encode()
            gif = write_gif(raw + b" " * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw)))
            parts, timed, start = [], [], 0
            for f in each_frame(gif):
                parts.append(payload(f))
                timed.append(f"{start}+{f.delay_ms}ms:" + ",".join(map(str, histogram(f.rgb))))
                start += f.delay_ms
            back, feature = b"".join(parts), ";".join(timed)
            rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(gif), hashlib.sha256(gif).hexdigest(), feature, gif))
        names = [c.split()[0] for c in COLUMNS.split(", ")][1:] + ["media"]
        return {"doc_id": ids} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    docs = docs.withColumn("doc_id", docs["doc_id"].cast("long"))
    return per_batch(texts(docs, "doc_id", "text"), COLUMNS + (", media binary" if keep_media else ""), work)
