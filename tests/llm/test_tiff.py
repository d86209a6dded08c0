import hashlib
import struct
import zlib

import numpy as np
import pytest
from landmarq.llm import tiff
from pyspark.sql import functions as F


def test_codecs_round_trip():
    random = np.random.default_rng(0)
    for size in (0, 1, 2, 255, 256, 300, 3000, 4200, 50000):
        for kinds in (1, 2, 8, 256):
            data = random.integers(0, kinds, size, dtype=np.uint8).tobytes()
            assert tiff.lzw_decode(tiff.lzw_encode(data), size) == data
            assert tiff.unpack_bits(tiff.pack_bits(data), size) == data


def test_known_codes():
    """The examples that the format's own description gives."""
    assert tiff.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == _bits([256, 7, 258, 8, 8, 258, 6, 6, 257])


def _bits(codes):
    text = "".join(f"{c:09b}" for c in codes)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 16), (32, 64)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_pages_round_trip(dtype, compression, predictor, tile, order):
    random = np.random.default_rng(1)
    images = [random.integers(0, 60000, shape).astype(dtype) for shape in ((1, 1, 1), (37, 50, 3), (64, 64, 3), (5, 200, 4))]
    pages = list(tiff.read_pages(tiff.write_pages(images, compression, predictor, 16, tile, order)))
    assert len(pages) == 4
    assert all((a == p.samples).all() and p.tiled == bool(tile) and p.compression == compression for a, p in zip(images, pages))


def _by_hand(raw, tags):
    """A file of one strip and the given short or long tags."""
    body = b"II*\0" + struct.pack("<I", 8 + len(raw)) + raw
    entries = b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in sorted(({273: 8, 279: len(raw)} | tags).items()))
    return body + struct.pack("<H", len(entries) // 12) + entries + struct.pack("<I", 0)


def test_floating_point_predictor():
    values = np.array([[1.5, -2.25, 3e9, 0.0], [7.0, 7.0, 7.5, -1e-9]], np.float32)
    planes = np.ascontiguousarray(values.astype(">f4")).view(np.uint8).reshape(2, 4, 4).transpose(0, 2, 1).reshape(2, 16)
    raw = np.diff(planes, axis=1, prepend=np.zeros((2, 1), np.uint8)).astype(np.uint8).tobytes()
    file = _by_hand(zlib.compress(raw), {256: 4, 257: 2, 258: 32, 259: 8, 277: 1, 278: 2, 317: 3, 339: 3})
    (page,) = tiff.read_pages(file)
    assert (page.samples[:, :, 0] == values).all()


def test_broken_files():
    good = tiff.write_pages([np.zeros((4, 4, 3), np.uint8)], tiff.LZW)
    ring = bytearray(good)
    at = struct.unpack_from("<I", good, 4)[0]
    struct.pack_into("<I", ring, at + 2 + 12 * struct.unpack_from("<H", good, at)[0], at)
    for data in (b"", b"no image", good[:20], good[:-9], bytes(ring), good.replace(struct.pack("<HHIH", 259, 3, 1, 5), struct.pack("<HHIH", 259, 3, 1, 99))):
        with pytest.raises(tiff.BadTiff):
            list(tiff.read_pages(data))


def test_payloads(odd_docs, no_docs):
    stored = tiff.encode_payloads(odd_docs).withColumn("page", F.lit("clash"))
    rows = tiff.decode_pages(stored).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in odd_docs.collect()}
    assert len(rows) == odd_docs.count()
    by_text = {}
    for r in rows:
        text = texts[r.doc_id]
        payload = text + b" " * (-len(text) % 192 or (0 if text else 192))
        assert (bytes(r.pixels), r.n_bytes, r.payload_bytes, r.page, r.error) == (payload, len(text), len(payload), 0, None)
        assert by_text.setdefault(payload, r.feature) == r.feature
    assert tiff.decode_pages(tiff.encode_payloads(no_docs)).count() == 0


def test_one_row_per_page(spark):
    random = np.random.default_rng(2)
    images = [random.integers(0, 256, (9, 7, 3), dtype=np.uint8) for _ in range(3)]
    good = tiff.write_pages(images, tiff.DEFLATE, 2)
    frame = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"junk"))], "k int, media binary")
    rows = tiff.decode_pages(frame).collect()
    assert [(r.k, r.page, r.error) for r in sorted(rows, key=lambda r: (r.k, r.page or 0))] == [(1, 0, None), (1, 1, None), (1, 2, None), (2, None, "null"), (3, None, "no TIFF header")]
    assert [hashlib.sha1(bytes(r.pixels)).digest() for r in rows if r.k == 1] == [hashlib.sha1(i.tobytes()).digest() for i in images]


HUGE = {
    "more pixels than its bytes can hold": {256: 4, 257: 30_000_000, 258: 8, 259: 1, 277: 1, 278: 1},
    "a page or tile of over 1073741824 bytes": {256: 1 << 31, 257: 1 << 31, 258: 8, 259: 1, 277: 1, 278: 1 << 31},
    "strips or tiles are missing": {256: 4, 257: 1 << 31, 258: 8, 259: 1, 277: 1, 278: 1},
    "a strip or tile lies beyond the end": {256: 4, 257: 2, 258: 8, 259: 1, 277: 1, 278: 2, 273: 1 << 30},
    "no tile size": {256: 4, 257: 2, 258: 8, 259: 1, 277: 1, 322: 0, 323: 16, 324: 8, 325: 8},
}


@pytest.mark.parametrize("why", HUGE)
def test_declared_sizes_are_held_against_the_bytes(spark, why):
    tags = HUGE[why] | ({278: 30_000_000} if why.startswith("more") else {})
    bad = _by_hand(b"\0" * 8, tags)
    good = tiff.write_pages([np.zeros((4, 4, 3), np.uint8)], tiff.LZW)
    rows = tiff.decode_pages(spark.createDataFrame([(1, bytearray(bad)), (2, bytearray(good))], "k int, media binary")).collect()
    assert sorted((r.k, r.error) for r in rows) == [(1, why), (2, None)]


def test_negative_offsets():
    """Signed field types are read, but no strip lies ahead of the file."""
    body = _by_hand(b"\0" * 8, {256: 4, 257: 2, 258: 8, 259: 1, 277: 1, 278: 2})
    signed = body.replace(struct.pack("<HHII", 273, 4, 1, 8), struct.pack("<HHIi", 273, 9, 1, -8))
    with pytest.raises(tiff.BadTiff, match="beyond the end"):
        list(tiff.read_pages(signed))


def test_a_bomb_of_a_tile_is_refused():
    """A tile size far beyond its page is bounded like a page."""
    body = _by_hand(zlib.compress(b"\0" * 64), {256: 4, 257: 2, 258: 8, 259: 8, 277: 1, 322: 1 << 16, 323: 1 << 16, 324: 8, 325: 8})
    with pytest.raises(tiff.BadTiff, match="a page or tile"):
        list(tiff.read_pages(body))


def _slow_lzw(data, size):
    """Codes read off a string of bits, the table as a dictionary: a decoder of its own to hold the other against."""
    bits, at, width, out = "".join(f"{b:08b}" for b in data), 0, 9, b""
    table, before = {}, None
    while True:
        code = int(bits[at : at + width], 2)
        at += width
        if code == 256:
            table, width, before = {i: bytes([i]) for i in range(256)}, 9, None
            continue
        if code == 257 or len(out) >= size:
            return out
        entry = table.get(code) or before + before[:1]
        if before is not None:
            table[len(table) + 2] = before + entry[:1]
        out, before = out + entry, entry
        width = 9 if len(table) + 2 < 511 else 10 if len(table) + 2 < 1023 else 11 if len(table) + 2 < 2047 else 12


def test_payloads_by_a_decoder_of_its_own(spark, odd_docs):
    """Stored files unpacked by plain code that shares nothing with the reader: strips and tiles, both byte orders, all codecs used."""
    stored = tiff.encode_payloads(odd_docs).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in odd_docs.collect()}
    seen = set()
    for r in stored:
        data, end = bytes(r.media), "<" if r.media[:2] == b"II" else ">"
        (at,) = struct.unpack_from(end + "I", data, 4)
        tags = {}
        for i in range(struct.unpack_from(end + "H", data, at)[0]):
            tag, kind, n = struct.unpack_from(end + "HHI", data, at + 2 + 12 * i)
            form = f"{end}{n}{'H' if kind == 3 else 'I'}"
            place = at + 10 + 12 * i
            place = struct.unpack_from(end + "I", data, place)[0] if struct.calcsize(form) > 4 else place
            tags[tag] = struct.unpack_from(form, data, place)
        width, height, codec = tags[256][0], tags[257][0], tags[259][0]
        wide, high = (tags[322][0], tags[323][0]) if 324 in tags else (width, tags[278][0])
        image = {}
        for k, (start, size) in enumerate(zip(tags.get(324, tags.get(273)), tags.get(325, tags.get(279)))):
            top, left = k // -(-width // wide) * high, k % -(-width // wide) * wide
            rows = high if 324 in tags else min(high, height - top)
            raw = data[start : start + size]
            raw = zlib.decompress(raw) if codec == 8 else _slow_lzw(raw, rows * wide * 3) if codec == 5 else tiff.unpack_bits(raw, rows * wide * 3)
            for y in range(rows):
                before = [0, 0, 0]
                for x in range(wide):
                    pixel = list(raw[(y * wide + x) * 3 :][:3])
                    if tags[317][0] == 2:
                        pixel = before = [(a + b) % 256 for a, b in zip(pixel, before)]
                    image[top + y, left + x] = pixel
        payload = bytes(v for y in range(height) for x in range(width) for v in image[y, x])
        text = texts[r.doc_id]
        assert payload == text.ljust(max(1, -(-len(text) // 192)) * 192)
        seen.add((codec, 324 in tags))
    assert len(seen) > 2
