"""TIFF media columns: pages are written to and read from a binary column, one row per page.

The reader walks the chain of image directories in either byte order, decodes strips or tiles that are stored plain or
by PackBits, LZW or deflate, undoes horizontal differencing (8, 16 and 32 bits) and the floating-point predictor, and
returns each page's samples row by row.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ostinato.llm.rows import map_rows
from ostinato.llm.storage import read_table

PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {PLAIN: "plain", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}

# Fixed values of the format: tags of image directories and the sizes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PAGE_NUMBER, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 297, 317, 322, 323, 324, 325
FIELD_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}

#: No page is decoded to more bytes than this.
MOST_BYTES = 1 << 28


class Malformed(ValueError):
    """The stored bytes aren't a picture that can be read."""


# --- codecs


def packbits_encode(row: bytes) -> bytes:
    """Runs of three or more equal bytes become a count and the byte, everything else is copied in pieces."""
    out, at = bytearray(), 0

    def literal(a: int, b: int) -> None:
        for k in range(a, b, 128):
            piece = row[k : min(b, k + 128)]
            out.append(len(piece) - 1)
            out.extend(piece)

    for run in re.finditer(rb"(.)\1{2,127}", row, re.DOTALL):
        literal(at, run.start())
        out.append(257 - (run.end() - run.start()))
        out.extend(run[1])
        at = run.end()
    literal(at, len(row))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out[:size])


CLEAR, END, FIRST_FREE, FULL = 256, 257, 258, 4094


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; widths grow one code early, as the format has it."""
    codes: list[tuple[int, int]] = [(CLEAR, 9)]
    singles = {bytes([i]): i for i in range(256)}
    table, free, width, known = dict(singles), FIRST_FREE, 9, b""
    for i in range(len(data)):
        longer = known + data[i : i + 1]
        if longer in table:
            known = longer
            continue
        codes.append((table[known], width))
        table[longer] = free
        free += 1
        width = max(9, free.bit_length())
        if free == FULL:
            codes.append((CLEAR, width))
            table, free, width = dict(singles), FIRST_FREE, 9
        known = data[i : i + 1]
    if known:
        codes.append((table[known], width))
        width = max(9, (free + 1).bit_length())
    codes.append((END, width))
    out, held, bits = bytearray(), 0, 0
    for code, width in codes:
        held = held << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    singles = [bytes([i]) for i in range(256)] + [b"", b""]
    table, before, out, made = list(singles), b"", [], 0
    held = bits = at = 0
    width = 9
    while made < size:
        while bits < width:
            if at >= len(data):
                return b"".join(out)[:size]
            held = held << 8 | data[at]
            at += 1
            bits += 8
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == END:
            break
        if code == CLEAR:
            table, before, width = list(singles), b"", 9
            continue
        if code < len(table):
            now = table[code]
        elif code == len(table) and before:
            now = before + before[:1]
        else:
            raise Malformed("an LZW code is ahead of its table")
        out.append(now)
        made += len(now)
        if before:
            table.append(before + now[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        before = now
    return b"".join(out)[:size]


def decode(data: bytes, compression: int, size: int) -> bytes:
    if compression == PLAIN:
        out = data[:size]
    elif compression == PACKBITS:
        out = packbits_decode(data, size)
    elif compression == LZW:
        out = lzw_decode(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise Malformed(f"deflate: {e}") from e
    else:
        raise Malformed(f"compression {compression} isn't supported")
    if len(out) < size:
        raise Malformed(f"a strip or tile has {len(out)} bytes of {size}")
    return out


def difference(block: np.ndarray, samples: int) -> np.ndarray:
    """Each sample less the one of the pixel to its left."""
    out = block.copy()
    out[:, samples:] -= block[:, :-samples]
    return out


def undo_predictor(raw: bytes, rows: int, columns: int, samples: int, bits: int, predictor: int, order: str) -> bytes:
    if predictor == 1:
        return raw
    if predictor == 2 and bits in (8, 16, 32):
        kind = np.dtype(f"{order}u{bits // 8}")
        block = np.frombuffer(raw, kind).reshape(rows, columns, samples)
        return np.cumsum(block, axis=1, dtype=kind.newbyteorder("=")).astype(kind).tobytes()
    if predictor == 3 and bits in (16, 32, 64):
        wide = columns * samples
        block = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, wide * bits // 8 // samples, samples), axis=1, dtype=np.uint8).reshape(rows, bits // 8, wide)
        block = block.transpose(0, 2, 1)  # the bytes of a number lie apart, highest first
        return (block if order == ">" else block[:, :, ::-1]).tobytes()
    raise Malformed(f"predictor {predictor} with {bits} bits isn't supported")


# --- reader


@dataclass
class Page:
    index: int
    width: int
    height: int
    samples: int
    bits: int
    compression: str
    predictor: int
    tiled: bool
    data: bytes


def pages(media: bytes) -> Iterator[Page]:
    """The pages of a picture in the order of its directories; raises Malformed where it can't go on."""
    order = {b"II": "<", b"MM": ">"}.get(media[:2])
    if order is None or len(media) < 8 or struct.unpack(order + "H", media[2:4])[0] != 42:
        raise Malformed("no TIFF header")
    at, seen = struct.unpack(order + "I", media[4:8])[0], set()
    while at:
        if at in seen or at + 2 > len(media):
            raise Malformed("the chain of directories is broken")
        seen.add(at)
        n = struct.unpack_from(order + "H", media, at)[0]
        if at + 2 + 12 * n + 4 > len(media):
            raise Malformed("a directory is cut off")
        tags = dict(_field(media, order, at + 2 + 12 * i) for i in range(n))
        yield _page(media, order, tags, len(seen) - 1)
        at = struct.unpack_from(order + "I", media, at + 2 + 12 * n)[0]


def _field(media: bytes, order: str, at: int) -> tuple[int, list[int]]:
    tag, kind, count = struct.unpack_from(order + "HHI", media, at)
    size = FIELD_SIZES.get(kind, 0) * count
    if kind not in (1, 3, 4):
        return tag, []
    start = at + 8 if size <= 4 else struct.unpack_from(order + "I", media, at + 8)[0]
    if start + size > len(media):
        raise Malformed(f"the values of tag {tag} are cut off")
    return tag, np.frombuffer(media, np.dtype(f"{order}u{FIELD_SIZES[kind]}"), count, start).tolist()


def _page(media: bytes, order: str, tags: dict[int, list[int]], index: int) -> Page:
    one = lambda tag, default=None: (tags.get(tag) or [default])[0]
    width, height, samples, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1)
    compression, predictor, tiled = one(COMPRESSION, PLAIN), one(PREDICTOR, 1), TILE_OFFSETS in tags
    if not width or not height or one(PLANAR, 1) != 1 or len(set(tags.get(BITS, [1]))) > 1:
        raise Malformed("a page has no size or an unsupported layout")
    wide, high = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, counts = tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, []), tags.get(TILE_COUNTS if tiled else STRIP_COUNTS, [])
    if not wide or not high:
        raise Malformed("a page's blocks have no size")
    across, down = -(-width // wide), -(-height // high)
    if len(offsets) != across * down or len(counts) != len(offsets) or (bits % 8 and tiled):
        raise Malformed("strips or tiles are missing")
    row, block_row = (width * samples * bits + 7) // 8, (wide * samples * bits + 7) // 8
    if row * height > MOST_BYTES or block_row * high > MOST_BYTES:
        raise Malformed("a page is too large")
    canvas = np.zeros((height, row), np.uint8)
    for k, (start, length) in enumerate(zip(offsets, counts, strict=True)):
        if start + length > len(media):
            raise Malformed("a strip or tile is cut off")
        top, left = k // across * high, k % across * block_row
        rows = high if tiled else min(high, height - top)
        raw = decode(media[start : start + length], compression, rows * block_row)
        block = np.frombuffer(undo_predictor(raw, rows, wide, samples, bits, predictor, order), np.uint8).reshape(rows, block_row)
        canvas[top : top + rows, left : left + block_row] = block[: height - top, : row - left]
    return Page(index, width, height, samples, bits, NAMES.get(compression, str(compression)), predictor, tiled, canvas.tobytes())


# --- writer


def _blocks(samples: np.ndarray, wide: int, high: int, tiled: bool) -> Iterator[np.ndarray]:
    height, width = samples.shape
    for top in range(0, height, high):
        for left in range(0, width, wide):
            block = samples[top : top + high, left : left + wide]
            yield np.pad(block, ((0, high - block.shape[0]), (0, wide - block.shape[1]))) if tiled else block


def _encode(block: np.ndarray, compression: int, predictor: int) -> bytes:
    if predictor == 2:
        block = difference(block, 1)
    if compression == PACKBITS:  # rows are packed apart
        return b"".join(packbits_encode(r.tobytes()) for r in block)
    raw = np.ascontiguousarray(block).tobytes()
    return lzw_encode(raw) if compression == LZW else zlib.compress(raw, 6) if compression == DEFLATE else raw


def write(images: list[tuple[np.ndarray, int, int, tuple[int, int] | None, int]]) -> bytes:
    """A little-endian file of 8-bit grey pages: (samples, compression, predictor, tile size or None, rows per strip)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for number, (samples, compression, predictor, tile, rows) in enumerate(images):
        height, width = samples.shape
        wide, high = (tile[1], tile[0]) if tile else (width, rows)
        offsets, counts = [], []
        for block in _blocks(samples, wide, high, bool(tile)):
            data = _encode(block, compression, predictor)
            offsets.append(len(out))
            counts.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PLANAR, 3, [1]), (PAGE_NUMBER, 3, [number & 0xFFFF, len(images) & 0xFFFF]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [wide]), (TILE_HEIGHT, 4, [high]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [high]), (STRIP_COUNTS, 4, counts)]
        entries = b""
        for tag, kind, values in sorted(fields):
            packed = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(packed) > 4:
                place = struct.pack("<I", len(out))
                out += packed
            else:
                place = packed.ljust(4, b"\0")
            entries += struct.pack("<HHI", tag, kind, len(values)) + place
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


#: A text's picture is this wide and has pages of so many rows.
ROW, PAGE_ROWS = 192, 256
#: The codecs of pages; a page's checksum chooses one, so that each has its share of pages of every size.
CODECS = (PACKBITS, LZW, DEFLATE, DEFLATE, DEFLATE, DEFLATE, DEFLATE, DEFLATE)


def store(payload: bytes, codecs: tuple[int, ...] = CODECS) -> bytes:
    """A payload, some multiple of ROW bytes, as a picture. Whole pages are in differenced tiles, shorter ones in strips."""
    grey = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    images = []
    for page in (grey[a : a + PAGE_ROWS] for a in range(0, len(grey), PAGE_ROWS)):
        codec = codecs[zlib.crc32(page) % len(codecs)]
        images.append((page, codec, 2, (64, 64), 0) if len(page) == PAGE_ROWS else (page, codec, 1, None, 64))
    return write(images)


def padded(text: str | None) -> tuple[bytes, int]:
    """A text in UTF-8, spaces up to a positive multiple of ROW, and its length without them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(1, -(-len(raw) // ROW)) * ROW - len(raw)), len(raw)


def feature(data: bytes, n_pages: int) -> str:
    """Pages, mean, deviation and entropy of the samples, and which of 64 parts are brighter than the mean."""
    grey = np.frombuffer(data, np.uint8)
    counts = np.bincount(grey, minlength=256)
    levels, share = np.arange(256), counts / len(grey)
    mean = float(share @ levels)
    deviation = float(np.sqrt(max(0.0, share @ (levels * levels) - mean * mean)))
    entropy = float(-(share[counts > 0] * np.log2(share[counts > 0])).sum())
    edges = np.arange(64) * len(grey) // 64
    parts = np.add.reduceat(grey, edges, dtype=np.int64) / np.diff(np.append(edges, len(grey)))
    bits = int("".join("1" if p > mean else "0" for p in parts), 2)
    return f"pages={n_pages};mean={mean:.4f};deviation={deviation:.4f};entropy={entropy:.4f};hash={bits:016x}"


def store_texts(docs: DataFrame, codecs: tuple[int, ...] = CODECS) -> DataFrame:
    """(doc_id, n_bytes, media): every text as a picture; a null text is an empty one. Rows and ids stay as they are.

    Equal texts give equal pictures, repeated rows repeated ones, an empty table an empty one; columns other than doc_id
    and text aren't read. ``codecs`` are those that a page's checksum chooses from.
    """

    def step():
        def call(batch: dict[str, list]) -> dict[str, list]:
            made = [padded(t) for t in batch["text"]]
            return {"doc_id": batch["doc_id"], "n_bytes": [n for _, n in made], "media": [store(p, codecs) for p, _ in made]}

        return call

    return map_rows(docs.select("doc_id", "text"), step, "doc_id long, n_bytes long, media binary")


def read_pages(media: DataFrame) -> DataFrame:
    """One row per page of each picture in (doc_id, media): its layout and samples.

    Where a picture is null or can't be read, one row says so in ``error``, after the pages that came before the fault.
    """

    def step():
        def call(batch: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("doc_id", "page", "width", "height", "samples", "bits", "compression", "predictor", "tiled", "data", "error")}
            for doc_id, stored in zip(batch["doc_id"], batch["media"], strict=True):
                try:
                    for p in pages(stored or b""):
                        for k, v in zip(out, (doc_id, p.index, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.data, None), strict=True):
                            out[k].append(v)
                except (Malformed, struct.error) as e:
                    for k in out:
                        out[k].append({"doc_id": doc_id, "error": str(e)}.get(k))
            return out

        return call

    return map_rows(media.select("doc_id", "media"), step, "doc_id long, page int, width int, height int, samples int, bits int, compression string, predictor int, tiled boolean, data binary, error string")


def digests(media: DataFrame) -> DataFrame:
    """One row per picture of (doc_id, n_bytes, media): digests of what is stored and of what is read back from it.

    The payload is that of all pages in their order. A null picture, or one that can't be read, fails the job, as there is
    nothing to describe; read_pages gives such rows an error instead. Repeated rows give repeated rows, an empty table an
    empty one; other columns aren't read.
    """

    def step():
        def call(batch: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"]} | {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for stored in batch["media"]:
                parts = [p.data for p in pages(stored)]
                payload = b"".join(parts)
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-16:]))
                out["media_bytes"].append(len(stored))
                out["media_sha256"].append(hashlib.sha256(stored).hexdigest())
                out["feature"].append(feature(payload, len(parts)))
            return out

        return call

    return map_rows(media.select("doc_id", "n_bytes", "media"), step, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op4_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as a picture, read back, and described."""
    return digests(store_texts(read_table(spark, sf_dir, "documents")))
