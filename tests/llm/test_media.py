import hashlib
import random
import zlib

import numpy as np
import pytest
from tidemill.llm import jpeg, media


def test_bytes_come_back_from_the_thumbnail():
    rng = np.random.default_rng(1)
    payloads = [rng.integers(0, 256, 576 * k, dtype=np.uint8).tobytes() for k in (1, 2, 340, 341, 701)] + [b"\xff" * 576, b"\0" * 1152, bytes([0, 255] * 288)]
    images = jpeg.encode(payloads)
    assert images == [jpeg.encode([p])[0] for p in payloads] and jpeg.encode([]) == []
    frames = [jpeg.parse(m) for m in images]
    assert [len(f) for f in frames] == [1] * 8
    assert [jpeg.thumbnails(f)[0].tobytes() for f in frames] == payloads
    together = jpeg.thumbnails([x for f in frames for x in f])
    assert b"".join(t.tobytes() for t in together) == b"".join(payloads)


SYMBOLS = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
AC_BITS = bytes([0, 1, 0, 1, 0, 0, 0, 0, 160] + [0] * 7)  # end of block has 2 bits, a run of 16 zeros 4, the rest 9


class Writer:
    """A plain coefficient-by-coefficient encoder for tests."""

    def __init__(self):
        self.bits = ""

    def value(self, v, size):
        self.bits += format(v if v >= 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    def block(self, diff, ac, dc_codes, ac_codes):
        size = abs(diff).bit_length()
        self.bits += dc_codes[size]
        self.value(diff, size)
        run = 0
        for i, v in enumerate(ac):
            if v == 0:
                run += 1
                continue
            while run > 15:
                self.bits += ac_codes[0xF0]
                run -= 16
            size = abs(v).bit_length()
            self.bits += ac_codes[run << 4 | size]
            self.value(v, size)
            run = 0
        if run:
            self.bits += ac_codes[0]

    def flush(self):
        self.bits += "1" * (-len(self.bits) % 8)
        out = bytes(int(self.bits[i : i + 8], 2) for i in range(0, len(self.bits), 8))
        self.bits = ""
        return out.replace(b"\xff", b"\xff\x00")


def picture(width, height, parts, restart, seed, step=8, reach=128):
    """A baseline image with random coefficients in components of given sampling, and its luminance DC values by block."""
    rng = random.Random(seed)
    dc_codes = {v: format(c, f"0{n}b") for v, c, n in jpeg._codes(jpeg.DC_BITS, jpeg.DC_VALUES)}
    ac_codes = {v: format(c, f"0{n}b") for v, c, n in jpeg._codes(AC_BITS, bytes(SYMBOLS))}
    h, v = parts[0] if len(parts) > 1 else (1, 1)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    dc = np.zeros((down * v, across * h), int)
    w, scan, last = Writer(), b"", [0] * len(parts)
    for m in range(across * down):
        if restart and m and m % restart == 0:
            scan += w.flush() + bytes([0xFF, 0xD0 + (m // restart - 1) % 8])
            last = [0] * len(parts)
        for c, (ph, pv) in enumerate(parts if len(parts) > 1 else [(1, 1)]):
            for y in range(pv):
                for x in range(ph):
                    value = rng.randrange(-reach, reach)
                    ac = [rng.choice((0, 0, 0, rng.randrange(-1000, 1001))) if rng.random() < 0.5 else 0 for _ in range(63)]
                    w.block(value - last[c], ac, dc_codes, ac_codes)
                    last[c] = value
                    if c == 0:
                        dc[m // across * v + y, m % across * h + x] = value
    scan += w.flush()
    segment = jpeg._segment
    frame = b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(parts)]) + b"".join(bytes([i + 1, ph << 4 | pv, 0]) for i, (ph, pv) in enumerate(parts))
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xDB, b"\x00" + bytes([step] * 64)) + segment(0xC0, frame)
    head += segment(0xC4, b"\x00" + jpeg.DC_BITS + jpeg.DC_VALUES + b"\x10" + AC_BITS + bytes(SYMBOLS)) + (segment(0xDD, restart.to_bytes(2, "big")) if restart else b"")
    head += segment(0xDA, bytes([len(parts)]) + b"".join(bytes([i + 1, 0]) for i in range(len(parts))) + b"\x00\x3f\x00")
    return head + scan + b"\xff\xd9", np.clip(np.rint(dc[: -(-height // 8), : -(-width // 8)] * step / 8) + 128, 0, 255)


@pytest.mark.parametrize(("size", "parts", "restart"), [((50, 37), [(1, 1)], 0), ((64, 40), [(2, 2), (1, 1), (1, 1)], 0), ((33, 70), [(2, 1), (1, 1), (1, 1)], 3), ((20, 20), [(2, 2)], 2)])
def test_other_baseline_images(size, parts, restart):
    made = [picture(*size, parts, restart, seed) for seed in range(3)]
    thumbs = jpeg.thumbnails([f for data, _ in made for f in jpeg.parse(data)])
    assert all((t == dc).all() for t, (_, dc) in zip(thumbs, made, strict=True))


@pytest.mark.parametrize("parts", ([(1, 1)], [(2, 1), (1, 1), (1, 1)]))
def test_differences_of_more_bits_than_one_look_shows(parts):
    """Differences of 10 and 11 bits have codes of 8 and 9: more than the 16 bits by which the usual ones are known."""
    known = jpeg._differences(jpeg.DC_BITS, jpeg.DC_VALUES)[1]
    assert known.max() == 16 and (known == 0).any()
    made = [picture(70, 66, parts, 4, seed, step=1, reach=1024) for seed in range(4)]
    thumbs = jpeg.thumbnails([f for data, _ in made for f in jpeg.parse(data)])
    assert all((t == dc).all() for t, (_, dc) in zip(thumbs, made, strict=True))


def test_damaged_and_missing_values_say_why():
    good = jpeg.encode([media.padded(b"abc" * 400)])[0]
    found = media.features([None, b"", b"no image", good[:200], good, good.replace(b"\xff\xc0", b"\xff\xc2")], True)
    assert [bool(f["error"]) for f in found] == [True, True, True, True, False, True]
    assert found[4]["n_bytes"] == 1200 and (found[4]["width"], found[4]["height"]) == (192, 192 * 3)


def test_texts_through_the_column_and_back(odd_docs, no_docs):
    found = media.media_features(media.store_texts(odd_docs), with_payload=True).collect()
    assert len(found) == 13 and not [r for r in found if r.error]
    for r, text in [(r, t) for r in found for t in [x.text for x in odd_docs.select("doc_id", "text").collect() if x.doc_id == r.doc_id]][:13]:
        payload = media.padded((text or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    same = {(r.media_sha256, r.ahash, r.dhash) for r in found if r.doc_id in (2, 3)}
    assert len(same) == 1
    assert media.media_features(media.store_texts(no_docs)).count() == 0


def test_images_wider_than_high_and_several_in_a_value(monkeypatch):
    text = "long text é " * 3000
    payload = media.padded(text.encode())
    whole = media.features(jpeg.encode([payload]), True)[0]
    same = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "error")
    monkeypatch.setattr(jpeg, "MOST", 576 * 2)  # 1,152 rows at most
    for beside in (3, 1):  # intervals beside each other, with padding; one to a row
        monkeypatch.setattr(jpeg, "_shape", lambda n, beside=beside: (576 * beside, -(-n // beside)))
        found = media.features(jpeg.encode([payload]), True)[0]
        assert {k: found[k] for k in same} == {k: whole[k] for k in same} and found["width"] == 8 * 576 * beside
    monkeypatch.setattr(jpeg, "MOST", 576)  # several images in one value
    many = payload * 12
    found = media.features(jpeg.encode([many]), True)[0]
    assert len(jpeg.parse(jpeg.encode([many])[0])) == 2 and found["payload_bytes"] == len(many)
    assert whole["payload_sha256"] == hashlib.sha256(payload).hexdigest()


def test_a_long_text_is_one_image_in_bounded_memory():
    import tracemalloc

    payload = media.padded(bytes(range(32, 127)) * 60_000)  # 5.7 MB, more than 8,191 intervals
    tracemalloc.start()
    image = jpeg.encode([payload])[0]
    found = media.features([image], True)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found["error"] is None and (found["width"], found["n_bytes"]) == (576 * 2 * 8, 5_700_000)
    assert found["payload_sha256"] == hashlib.sha256(payload).hexdigest() and peak < 25 * len(payload)


def test_the_query_gives_what_the_texts_say(spark, data):
    from tidemill.llm.queries import op5_media_jpeg

    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    found = op5_media_jpeg(spark, data).collect()
    assert len(found) == len(texts)
    for r in found:
        payload = media.padded(texts[r.doc_id])
        image = jpeg.encode([payload])[0]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest()) and r.feature


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (8, 9), (24, 24), (31, 24), (17, 61), (200, 43)])
def test_hashes_compare_the_means_of_cells(shape):
    from fractions import Fraction

    image = np.random.default_rng(shape[0]).integers(0, 256, shape, dtype=np.uint8)

    def cells(columns):
        def part(i, n, length):
            low = min(i * length // n, length - 1)
            return range(low, max(low + 1, (i + 1) * length // n))

        def mean(i, j):
            area = [int(image[y, x]) for y in part(i, 8, shape[0]) for x in part(j, columns, shape[1])]
            return Fraction(sum(area), len(area))

        return [[mean(i, j) for j in range(columns)] for i in range(8)]

    small, wide = cells(8), cells(9)
    level = sum(map(sum, small)) / 64
    average = "".join(str(int(c >= level)) for row in small for c in row)
    difference = "".join(str(int(b > a)) for row in wide for a, b in zip(row, row[1:], strict=False))
    assert media.thumbnail_hashes(image) == (f"{int(average, 2):016x}", f"{int(difference, 2):016x}")
