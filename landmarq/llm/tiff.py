"""TIFF images held in a binary column: reading pages out of them and writing them.

The reader walks the chain of image directories in either byte order, decodes
strips or tiles that are stored plainly or by PackBits, LZW or deflate, undoes
horizontal and floating-point predictors, and gives one row for each page.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

# Fixed values of the format.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_TYPES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTOMETRIC = 256, 257, 258, 259, 262
_STRIP_OFFSETS, _SAMPLES, _ROWS_PER_STRIP, _STRIP_COUNTS, _PLANAR = 273, 277, 278, 279, 284
_PREDICTOR, _TILE_WIDTH, _TILE_HEIGHT, _TILE_OFFSETS, _TILE_COUNTS, _FORMAT = 317, 322, 323, 324, 325, 339
#: Bytes that a byte of each codec's data can give at most: two bytes of PackBits give 128, nine bits of LZW a string of the table's 3,838 new entries.
_MOST_OUT = {NONE: 1, PACKBITS: 64, LZW: 3839, DEFLATE: 1032, OLD_DEFLATE: 1032}
#: Bytes of pixels in a page, and of a strip or tile: a page is one cell of a column, which holds no more.
MOST_PAGE = 1 << 30


class BadTiff(ValueError):
    """The bytes are no TIFF that this reader knows."""


@dataclass
class Page:
    """One image: ``samples`` has the shape (height, width, samples)."""

    samples: np.ndarray
    compression: int
    predictor: int
    tiled: bool


# -- codecs ---------------------------------------------------------------


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        head = data[at]
        at += 1
        if head < 128:
            out += data[at : at + head + 1]
            at += head + 1
        elif head > 128:
            out += data[at : at + 1] * (257 - head)
            at += 1
    return bytes(out)


_RUNS = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def pack_bits(data: bytes) -> bytes:
    out = bytearray()

    def literal(part: bytes) -> None:
        for i in range(0, len(part), 128):
            piece = part[i : i + 128]
            out.append(len(piece) - 1)
            out.extend(piece)

    at = 0
    for run in _RUNS.finditer(data):
        literal(data[at : run.start()])
        out.append(257 - (run.end() - run.start()))
        out.extend(run[1])
        at = run.end()
    literal(data[at:])
    return bytes(out)


_SINGLE = [bytes([i]) for i in range(256)]


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first, code widths one code early, as the format has it."""
    out, held, bits = bytearray(), 256, 9  # a clear code first
    table: dict[bytes, int] = {s: i for i, s in enumerate(_SINGLE)}
    following, width, prefix = 258, 9, b""
    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if longer in table:
            prefix = longer
            continue
        held = held << width | table[prefix]
        bits += width
        table[longer] = following
        following += 1
        if following == 4095:
            held = held << 12 | 256
            bits += 12
            table = {s: i for i, s in enumerate(_SINGLE)}
            following, width = 258, 9
        elif following + 1 > 1 << width:
            width += 1
        prefix = data[i : i + 1]
        if bits >= 4096:
            keep = bits % 8
            out += (held >> keep).to_bytes(bits // 8, "big")
            held, bits = held & (1 << keep) - 1, keep
    if prefix:
        held = held << width | table[prefix]
        bits += width
        following += 1
        if following + 1 > 1 << width and width < 12:
            width += 1
    held = held << width | 257
    bits += width
    pad = -bits % 8
    return bytes(out) + (held << pad).to_bytes((bits + pad) // 8, "big")


def lzw_decode(data: bytes, size: int) -> bytes:
    out: list[bytes] = []
    table: list[bytes] = []
    made, held, bits, width, last = 0, 0, 0, 9, b""
    for byte in data:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 256:
            table, width, last = [*_SINGLE, b"", b""], 9, b""
            continue
        if code == 257 or made >= size:
            break
        if not table:
            raise BadTiff("LZW data starts without a clear code")
        if not last:
            if code >= 256:
                raise BadTiff("bad LZW code")
            last = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                raise BadTiff("bad LZW code")
            table.append(last + entry[:1])
            last = entry
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        out.append(last)
        made += len(last)
    return b"".join(out)


def _decode(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        raw = data
    elif compression == PACKBITS:
        raw = unpack_bits(data, size)
    elif compression == LZW:
        raw = lzw_decode(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        try:
            raw = zlib.decompressobj().decompress(data, size)
        except zlib.error as wrong:
            raise BadTiff(str(wrong)) from wrong
    else:
        raise BadTiff(f"compression {compression}")
    if len(raw) < size:
        raise BadTiff(f"{len(raw)} of {size} bytes in a strip or tile")
    return raw[:size]


def _encode(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return pack_bits(data)
    if compression == LZW:
        return lzw_encode(data)
    return zlib.compress(data, 6)


# -- predictors -----------------------------------------------------------


def _undo(block: np.ndarray, predictor: int, raw: bytes, order: str) -> np.ndarray:
    """``block``: (rows, columns, samples) as stored."""
    if predictor == 1:
        return block
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    if predictor == 3:  # byte planes of the row, most significant first, then differences between bytes
        rows, columns, samples = block.shape
        size = block.dtype.itemsize
        planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8)
        values = planes.reshape(rows, size, columns * samples).transpose(0, 2, 1)
        return np.ascontiguousarray(values).view(block.dtype.newbyteorder(">")).reshape(rows, columns, samples).astype(block.dtype)
    raise BadTiff(f"predictor {predictor}")


# -- reading --------------------------------------------------------------


def _fields(data: bytes, order: str, at: int) -> tuple[dict[int, tuple], int]:
    try:
        (count,) = struct.unpack_from(order + "H", data, at)
        found: dict[int, tuple] = {}
        for i in range(count):
            tag, kind, number = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind not in _TYPES:
                continue
            form = f"{order}{number}{_TYPES[kind]}"
            size = struct.calcsize(form)
            place = at + 10 + 12 * i
            if size > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            if place + size > len(data):
                raise BadTiff("a field lies beyond the end")
            found[tag] = struct.unpack_from(form, data, place)
        (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * count)
    except struct.error as wrong:
        raise BadTiff("cut off") from wrong
    return found, following


def _page(data: bytes, order: str, f: dict[int, tuple], most: int) -> Page:
    one = lambda tag, default=None: f.get(tag, (default,))[0]
    width, height, samples = one(_WIDTH), one(_HEIGHT), one(_SAMPLES, 1)
    bits, compression, predictor = f.get(_BITS, (1,)), one(_COMPRESSION, NONE), one(_PREDICTOR, 1)
    if not width or not height or not samples or min(width, height, samples) < 0:
        raise BadTiff("no size")
    if compression not in _MOST_OUT:
        raise BadTiff(f"compression {compression}")
    if len(set(bits)) != 1 or bits[0] not in (8, 16, 32):
        raise BadTiff(f"bits {bits}")
    kind = {1: "u", 2: "i", 3: "f"}.get(one(_FORMAT, 1))
    if kind is None or kind == "f" and bits[0] == 8:
        raise BadTiff("sample format")
    dtype = np.dtype(f"{order}{kind}{bits[0] // 8}")
    planes = samples if one(_PLANAR, 1) == 2 else 1
    depth = samples // planes if planes > 1 else samples
    tiled = _TILE_OFFSETS in f
    if tiled:
        wide, high = one(_TILE_WIDTH), one(_TILE_HEIGHT)
        offsets, counts = f[_TILE_OFFSETS], f.get(_TILE_COUNTS, ())
    else:
        wide, high = width, min(one(_ROWS_PER_STRIP, height) or height, height)
        offsets, counts = f.get(_STRIP_OFFSETS, ()), f.get(_STRIP_COUNTS, ())
    if not wide or not high or min(wide, high) < 0:
        raise BadTiff("no tile size")
    across, down = -(-width // wide), -(-height // high)
    if len(offsets) < across * down * planes or len(counts) < across * down * planes:
        raise BadTiff("strips or tiles are missing")
    if any(at < 0 or n < 0 or at + n > len(data) for at, n in zip(offsets, counts)):
        raise BadTiff("a strip or tile lies beyond the end")
    # What is declared is held against what the stored bytes can give before anything is set aside for it.
    if max(width * height * samples, wide * high * depth) * dtype.itemsize > most:
        raise BadTiff(f"a page or tile of over {most} bytes")
    if width * height * samples * dtype.itemsize > sum(counts) * _MOST_OUT[compression]:
        raise BadTiff("more pixels than its bytes can hold")
    image = np.empty((height, width, samples), dtype)
    for plane in range(planes):
        for k in range(across * down):
            i = plane * across * down + k
            top, left = k // across * high, k % across * wide
            rows = high if tiled else min(high, height - top)
            size = rows * wide * depth * dtype.itemsize
            if size > counts[i] * _MOST_OUT[compression]:
                raise BadTiff(f"{counts[i]} bytes can't hold a strip or tile of {size}")
            raw = _decode(data[offsets[i] : offsets[i] + counts[i]], compression, size)
            block = _undo(np.frombuffer(raw, dtype).reshape(rows, wide, depth), predictor, raw, order)
            block = block[: height - top, : width - left]
            image[top : top + rows, left : left + wide, plane * depth if planes > 1 else 0 : (plane + 1) * depth if planes > 1 else samples] = block
    return Page(image.astype(dtype.newbyteorder("="), copy=False), compression, predictor, tiled)


def read_pages(data: bytes, most: int = MOST_PAGE) -> Iterator[Page]:
    """The pages of one file, in the order of its directories; BadTiff at the first that is damaged or has over ``most`` bytes of pixels."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(bytes(data[:4]))
    if order is None or len(data) < 8:
        raise BadTiff("no TIFF header")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise BadTiff("directories in a ring")
        seen.add(at)
        found, at = _fields(data, order, at)
        yield _page(data, order, found, most)


# -- writing --------------------------------------------------------------


def write_pages(pages: Sequence[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 64, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A file of ``pages``, each (height, width, samples) of unsigned 8- or 16-bit samples; ``tile``: (height, width) in place of strips."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 0))
    link = 4
    for image in pages:
        height, width, samples = image.shape
        stored = image.dtype.newbyteorder(order)
        high, wide = tile or (rows_per_strip, width)
        offsets, counts = [], []
        for top in range(0, height, high):
            for left in range(0, width, wide):
                block = image[top : top + high, left : left + wide]
                if tile and block.shape[:2] != tile:
                    block = np.pad(block, ((0, high - block.shape[0]), (0, wide - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                raw = _encode(block.astype(stored).tobytes(), compression)
                offsets.append(len(out))
                counts.append(len(raw))
                out += raw
        entries = [
            (_WIDTH, "I", [width]), (_HEIGHT, "I", [height]), (_BITS, "H", [image.dtype.itemsize * 8] * samples), (_COMPRESSION, "H", [compression]),
            (_PHOTOMETRIC, "H", [2 if samples >= 3 else 1]), (_SAMPLES, "H", [samples]), (_PLANAR, "H", [1]), (_PREDICTOR, "H", [predictor]),
        ]
        if tile:
            entries += [(_TILE_WIDTH, "I", [wide]), (_TILE_HEIGHT, "I", [high]), (_TILE_OFFSETS, "I", offsets), (_TILE_COUNTS, "I", counts)]
        else:
            entries += [(_STRIP_OFFSETS, "I", offsets), (_ROWS_PER_STRIP, "I", [high]), (_STRIP_COUNTS, "I", counts)]
        packed = []
        for tag, form, values in sorted(entries):
            value = struct.pack(f"{order}{len(values)}{form}", *values)
            if len(value) > 4:
                out += b"\0" * (len(out) % 2)
                place = struct.pack(order + "I", len(out))
                out += value
                value = place
            packed.append(struct.pack(order + "HHI", tag, {"H": 3, "I": 4}[form], len(values)) + value.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        link = len(out) + 2 + 12 * len(packed)
        out += struct.pack(order + "H", len(packed)) + b"".join(packed) + struct.pack(order + "I", 0)
    return bytes(out)


# -- columns --------------------------------------------------------------


def page_feature(samples: np.ndarray) -> str:
    """Size, mean of each sample and a difference hash of the page's brightness on a grid of 8 by 9."""
    height, width, depth = samples.shape
    means = samples.reshape(-1, depth).mean(axis=0)
    grey = samples.mean(axis=2)
    rows, columns = np.arange(8) * height // 8, np.arange(9) * width // 9
    grid = np.add.reduceat(grey, np.unique(rows), axis=0)[np.searchsorted(np.unique(rows), rows)]
    grid = np.add.reduceat(grid, np.unique(columns), axis=1)[:, np.searchsorted(np.unique(columns), columns)]
    spans = np.diff(np.r_[columns, width]).clip(1)
    grid = grid / spans
    bits = (grid[:, 1:] > grid[:, :-1]).ravel()
    return f"{width}x{height}x{depth}:{','.join(f'{m:.3f}' for m in means)}:{np.packbits(bits).tobytes().hex()}"


def decode_pages(media: DataFrame, media_col: str = "media") -> DataFrame:
    """A row for each page of each file in ``media_col``, with the file's other columns.

    Adds ``page`` (from 0), ``width, height, samples, bits, compression,
    predictor, tiled, pixels`` (rows of samples, little-endian), ``feature`` and
    ``error``. A file that can't be read gives its whole pages and then one row
    with the reason in ``error`` and nulls beside it; so does a null (reason
    "null"). Columns of ``media`` that have one of these names give way. Repeated
    rows come back as often as they came, an empty table gives an empty one.
    A page that declares over ``MOST_PAGE`` bytes of pixels, or more than its
    stored bytes can unpack to, counts as one that can't be read. One file is held at a time.
    """
    ship(media.sparkSession)
    added = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, feature string, error string"
    names = [x.split()[0] for x in added.split(", ")]
    kept = [c for c in media.columns if c != media_col and c not in names]
    base = media.select(F.col(media_col).alias("_media"), *kept)
    schema = pa.schema([("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("pixels", pa.binary()), ("feature", pa.string()), ("error", pa.string())])

    def rows_of(data: bytes | None) -> Iterator[tuple]:
        if data is None:
            yield (*[None] * 10, "null")
            return
        page = 0
        try:
            for page, found in enumerate(read_pages(data)):
                height, width, depth = found.samples.shape
                little = found.samples.astype(found.samples.dtype.newbyteorder("<"), copy=False)
                yield page, width, height, depth, found.samples.dtype.itemsize * 8, found.compression, found.predictor, found.tiled, little.tobytes(), page_feature(found.samples), None
        except BadTiff as wrong:
            yield (*[None] * 10, str(wrong))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, source, size = [], [], 0
            for i, data in enumerate(batch.column(0)):
                for row in rows_of(data.as_py()):
                    held.append(row)
                    source.append(i)
                    size += len(row[8] or b"")
                    if size > 16 << 20:
                        yield made(batch, held, source)
                        held, source, size = [], [], 0
            if held:
                yield made(batch, held, source)

    def made(batch: pa.RecordBatch, held: list[tuple], source: list[int]) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*held), schema)]
        rows = pa.array(source, pa.int64())
        return pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[1:]), *columns], names=[*batch.schema.names[1:], *names])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "_media"), added])
    return base.mapInArrow(scan, fields)


#: Ways in which ``encode_payloads`` stores a page; the payload's checksum picks one, so equal payloads are stored alike.
FORMS = (
    {"compression": DEFLATE, "predictor": 1, "rows_per_strip": 64},
    {"compression": DEFLATE, "predictor": 2, "rows_per_strip": 32},
    {"compression": DEFLATE, "predictor": 1, "tile": (32, 32)},
    {"compression": PACKBITS, "predictor": 1, "rows_per_strip": 64},
    {"compression": DEFLATE, "predictor": 2, "tile": (64, 64), "order": ">"},
    {"compression": LZW, "predictor": 1, "rows_per_strip": 64},
    {"compression": DEFLATE, "predictor": 1, "rows_per_strip": 128, "order": ">"},
    {"compression": PACKBITS, "predictor": 2, "rows_per_strip": 16},
)
#: Samples in a row of an encoded page: 64 pixels of red, green and blue.
ROW_BYTES = 192


def encode_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, payload_bytes, media``: each whole text's UTF-8, padded by spaces to a positive multiple of 192, as the pixels of a TIFF.

    A null text is an empty one. Equal texts give equal files. Other columns are
    ignored.
    """
    ship(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, padded, media = [], [], []
                for value in part.column(1):
                    text = value.as_py() or b""
                    payload = text.ljust(max(1, -(-len(text) // ROW_BYTES)) * ROW_BYTES, b" ")
                    pixels = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)
                    sizes.append(len(text))
                    padded.append(len(payload))
                    media.append(write_pages([pixels], **FORMS[zlib.crc32(payload) % len(FORMS)]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(padded, pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "payload_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(scan, f"id {kind}, n_bytes long, payload_bytes long, media binary").withColumnRenamed("id", id_col)
