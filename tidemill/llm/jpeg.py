"""Baseline JPEG in numpy: Huffman decoding of DC values, and grey images that hold bytes.

The decoder parses markers and reads the scan of any baseline file, grey or in
colour, as far as DC-only thumbnails need: DC values are kept, AC values are
skipped over. Restart intervals are independent, so all intervals of all files
at hand are decoded side by side, one numpy step per block.

The writer makes a grey image in which each 8x8 block is flat and stands for one
byte: with 8 as the DC step, the block's DC value is the byte less 128, and the
DC-only thumbnail is the bytes themselves.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Blocks in a restart interval of the writer; as 24 rows of 24 in images of up to NARROW intervals, and as a row in larger ones.
INTERVAL, WIDE, NARROW = 576, 24, 340
#: The format's limit for blocks across and down. Payloads over 14 * 8,191 intervals (66 MB) become several images.
MOST = 8191
#: Intervals that are coded or decoded side by side: what bounds the working arrays.
LANES = 2048
#: Table K.3 of the standard: how many DC luminance codes have 1, 2, ... bits.
DC_BITS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_VALUES = bytes(range(12))
#: One code, of one bit, for the end of a block.
AC_BITS, AC_VALUES = bytes([1] + [0] * 15), bytes([0])
_STEP = 8
#: The highest category of a DC difference in baseline files.
LARGEST = 11


def _codes(bits: bytes, values: bytes) -> list[tuple[int, int, int]]:
    """(value, code, length) by the standard's rule: codes count up, and double with each further bit."""
    out, code, k = [], 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out.append((values[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


@lru_cache(64)
def _lookup(bits: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Value and length of the code that any 16 bits begin with; length 0 where none does."""
    value, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for v, code, n in _codes(bits, values):
        value[code << (16 - n) : (code + 1) << (16 - n)] = v
        length[code << (16 - n) : (code + 1) << (16 - n)] = n
    return value, length


@lru_cache(64)
def _differences(bits: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The DC difference that any 16 bits begin with, and its length in bits, extra bits included; length 0 where 16 bits don't tell."""
    size, length = _lookup(bits, values)
    total = size + length
    known = (length > 0) & (size <= LARGEST) & (total <= 16)
    step = _signed(np.arange(1 << 16) >> np.where(known, 16 - total, 0) & (1 << np.minimum(size, 16)) - 1, size)
    return np.where(known, step, 0), np.where(known, total, 0)


def _signed(extra: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The number that a category's extra bits stand for."""
    whole = 1 << np.minimum(size, 16)
    return np.where(extra < whole >> 1, extra - whole + 1, extra)


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Code and length of a block by its DC difference + 255: category, extra bits, end of block."""
    codes = {v: (c, n) for v, c, n in _codes(DC_BITS, DC_VALUES)}
    code, length = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        c, n = codes[size]
        code[d + 255] = (c << size | (d if d >= 0 else d + (1 << size) - 1)) << 1
        length[d + 255] = n + size + 1
    return code, length


_CODE, _LENGTH = _difference_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _head(across: int, down: int) -> bytes:
    size = (8 * down).to_bytes(2, "big") + (8 * across).to_bytes(2, "big")
    tables = _segment(0xDB, bytes([0, _STEP]) + bytes([1] * 63)) + _segment(0xC0, b"\x08" + size + b"\x01\x01\x11\x00")
    tables += _segment(0xC4, b"\x00" + DC_BITS + DC_VALUES) + _segment(0xC4, b"\x10" + AC_BITS + AC_VALUES)
    return b"\xff\xd8" + tables + _segment(0xDD, INTERVAL.to_bytes(2, "big")) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


def _shape(intervals: int) -> tuple[int, int]:
    """Blocks across and down of an image that holds so many intervals, and as few more as make a rectangle."""
    if intervals <= NARROW:
        return WIDE, WIDE * intervals
    beside = -(-intervals // MOST)
    return INTERVAL * beside, -(-intervals // beside)


def _scans(lanes: np.ndarray):
    """The coded bytes of each interval, LANES of them at a time."""
    for a in range(0, len(lanes), LANES):
        yield from _coded(lanes[a : a + LANES])


def _coded(lanes: np.ndarray) -> list[bytes]:
    step = np.empty(lanes.shape, np.int16)
    step[:, 0] = lanes[:, 0].astype(np.int16) - 128
    np.subtract(lanes[:, 1:], lanes[:, :-1], out=step[:, 1:], dtype=np.int16)
    step = np.ascontiguousarray(step.T) + 255
    n = _LENGTH[step]
    ends = np.cumsum(n, axis=0)
    size = (ends[-1] + 7) // 8
    start = np.zeros(len(lanes) + 1, np.int64)
    np.cumsum(size, out=start[1:])
    out = np.zeros(int(start[-1]) + 3, np.uint8)

    def put(code: np.ndarray, bits: np.ndarray, length: np.ndarray) -> None:
        at = start[:-1] + (bits >> 3)
        word = code << (24 - length - (bits & 7)).astype(np.uint32)
        out[at] |= (word >> 16).astype(np.uint8)
        out[at + 1] |= (word >> 8).astype(np.uint8)
        out[at + 2] |= word.astype(np.uint8)

    # lanes are written side by side, each block into bytes of its own lane, or zeros into what follows it
    for k in range(INTERVAL):
        put(_CODE[step[k]], ends[k] - n[k], n[k])
    fill = -ends[-1] % 8
    put(((1 << fill) - 1).astype(np.uint32), ends[-1], fill)
    whole = out.tobytes()
    return [whole[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload, a positive multiple of INTERVAL bytes, as one image; from MOST intervals on it may be followed by bytes 255 there."""
    pad = _coded(np.full((1, INTERVAL), 255, np.uint8))[0]
    scans, images = _scans(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, INTERVAL)), []
    for payload in payloads:
        left, parts = len(payload) // INTERVAL, []
        while left:
            here = min(left, MOST * (MOST // INTERVAL))
            across, down = _shape(here)
            parts.append(_head(across, down))
            total = across * down // INTERVAL
            for i in range(total):
                parts.append(next(scans) if i < here else pad)
                if i < total - 1:
                    parts.append(bytes([0xFF, 0xD0 + i % 8]))
            parts.append(b"\xff\xd9")
            left -= here
        images.append(b"".join(parts))
    return images


@dataclass
class Frame:
    """One image: its size, components (id, h, v, DC step, DC table, AC table) and the intervals of its scan."""

    width: int
    height: int
    components: list[tuple]
    restart: int
    intervals: list[bytes]


_STOP = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.DOTALL)
_RESTART = re.compile(rb"\xff\xff*[\xd0-\xd7]")


def parse(data: bytes) -> list[Frame]:
    """The baseline images in data, one after the other. Raises ValueError for what isn't baseline JPEG."""
    at, frames = 0, []
    steps: dict[int, int] = {}
    tables: dict[int, tuple[bytes, bytes]] = {}
    size, parts, restart = None, [], 0
    while at < len(data):
        if data[at] != 0xFF or at + 1 >= len(data):
            raise ValueError(f"no marker at byte {at}")
        marker, at = data[at + 1], at + 2
        if marker == 0xFF:
            at -= 1
            continue
        if marker == 0xD8:
            steps, tables, size, parts, restart = {}, {}, None, [], 0
            continue
        if marker == 0xD9:
            continue
        n = int.from_bytes(data[at : at + 2], "big")
        body, at = data[at + 2 : at + n], at + n
        if n < 2 or len(body) != n - 2:
            raise ValueError("a segment is cut off")
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                steps[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif marker == 0xC0:
            if body[0] != 8:
                raise ValueError("samples must have 8 bits")
            size = (int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"))
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a baseline image")
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xDA:
            if size is None or not all(size):
                raise ValueError("a scan without a frame")
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            stop = _STOP.search(data, at)
            scan = data[at : stop.start() if stop else len(data)]
            if parts and parts[0][0] in chosen:  # of several scans the one with the luminance
                components = [(i, h, v, steps[q], tables[chosen[i] >> 4], tables[16 | chosen[i] & 15]) for i, h, v, q in parts if i in chosen]
                frames.append(Frame(*size, components, restart, [x.replace(b"\xff\x00", b"\xff") for x in _RESTART.split(scan)]))
            at += len(scan)
    return frames


def _layout(frame: Frame) -> tuple[int, int, int, int]:
    """MCUs across and down, and luminance blocks in each across and down; a scan of one component has single blocks."""
    _, h, v, *_ = frame.components[0]
    if len(frame.components) == 1:
        h = v = 1
    return -(-frame.width // (8 * h)), -(-frame.height // (8 * v)), h, v


def thumbnails(frames: list[Frame]) -> list[np.ndarray]:
    """For each frame its luminance at an eighth of the size, one sample from the DC value of each block."""
    groups: dict[tuple, list[int]] = {}
    for i, f in enumerate(frames):
        groups.setdefault(tuple(c[1:3] + c[4:] for c in f.components), []).append(i)
    out: list = [None] * len(frames)
    for program, members in groups.items():
        lanes, counts = [], []
        for i in members:
            f = frames[i]
            across, down, *_ = _layout(f)
            total, each = across * down, f.restart or across * down
            if len(f.intervals) < -(-total // each):
                raise ValueError("the scan lacks intervals")
            for k in range(-(-total // each)):
                lanes.append(f.intervals[k])
                counts.append(min(each, total - k * each))
        lengths, values, lane = np.array(counts), [], 0
        for a in range(0, len(lanes), LANES):
            blocks = _decode(lanes[a : a + LANES], lengths[a : a + LANES], program)
            each = program[0][0] * program[0][1] if len(program) > 1 else 1
            values += [row[: n * each].copy() for row, n in zip(blocks, counts[a : a + LANES], strict=True)]
        for i in members:
            f = frames[i]
            across, down, h, v = _layout(f)
            n = -(-across * down // (f.restart or across * down))
            dc = np.concatenate(values[lane : lane + n])
            lane += n
            grid = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            samples = np.empty(grid.shape, np.uint8)
            rows = max(1, (1 << 18) // grid.shape[1])
            for a in range(0, len(grid), rows):
                samples[a : a + rows] = np.clip(np.rint(grid[a : a + rows] * (f.components[0][3] / 8)) + 128, 0, 255)
            out[i] = samples[: -(-f.height // 8), : -(-f.width // 8)]
    return out


def _long_difference(bits: np.ndarray, dc_size: np.ndarray, dc_length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """DC differences whose code and extra bits are more than 16 bits, and their lengths."""
    code = bits >> 48 & 0xFFFF
    size, length = dc_size[code], dc_length[code]
    if not length.all() or (size > LARGEST).any():
        raise ValueError("a code that no table has")
    return _signed(((bits << length) >> 48 & 0xFFFF) >> (16 - size), size), length + size


def _decode(lanes: list[bytes], counts: np.ndarray, program: tuple) -> np.ndarray:
    """Luminance DC values of each lane, in the order of its blocks."""
    order = np.argsort(-counts, kind="stable")  # the lanes still at work come first
    data = np.frombuffer(b"".join(lanes[i] + b"\0\0\0\0\0\0\0\0" for i in order.tolist()) + b"\0" * 7, np.uint8)
    word = np.ndarray((len(data) - 7,), ">i8", data, strides=(1,)).astype(np.int64)  # the 64 bits from each byte on
    sizes = np.array([len(lanes[i]) for i in order.tolist()], np.int64)
    pos = np.zeros(len(lanes), np.int64)
    np.cumsum((sizes[:-1] + 8) * 8, out=pos[1:])
    limit = pos + sizes * 8
    blocks = [(c, part[2], _differences(*part[2]), _lookup(*part[3])) for c, part in enumerate(program) for _ in range(1 if len(program) == 1 else part[0] * part[1])]
    mine = sum(c == 0 for c, *_ in blocks)
    out = np.zeros((int(counts.max()) * mine, len(lanes)), np.int32)
    last = np.zeros((len(program), len(lanes)), np.int64)
    ordered, row = counts[order], 0

    def bits_from(p: np.ndarray) -> np.ndarray:
        return word.take(p >> 3, mode="clip") << (p & 7)

    def first(bits: np.ndarray) -> np.ndarray:
        return bits >> 48 & 0xFFFF

    for k in range(int(counts.max())):
        n = int(np.searchsorted(-ordered, -k, side="left"))
        bound = limit[:n]
        for c, dc_table, (dc_step, dc_length), (ac_value, ac_length) in blocks:
            bits = bits_from(pos[:n])  # 57 at least: a DC code with its extra bits, and an AC code
            code = first(bits)
            step, used = dc_step[code], dc_length[code]
            if not used.all():
                long = np.flatnonzero(used == 0)
                step[long], used[long] = _long_difference(bits[long], *_lookup(*dc_table))
            last[c, :n] += step
            if c == 0:
                out[row, :n] = last[0, :n]
                row += 1
            at = pos[:n] + used
            code = first(bits << used)
            value, length = ac_value[code], ac_length[code]
            if not length.all() or (at > bound).any():
                raise ValueError("a scan ends early or has a code that no table has")
            at += length
            if value.any():
                at += value & 15
                done = np.where(value == 0, 64, (value >> 4) + 2)
                while len(alive := np.flatnonzero(done < 64)):
                    here = at[alive]
                    code = first(bits_from(here))
                    value, length = ac_value[code], ac_length[code]
                    if not length.all() or (here > bound[alive]).any():
                        raise ValueError("a scan ends early or has a code that no table has")
                    at[alive] = here + length + (value & 15)
                    done[alive] += np.where(value == 0, 64, (value >> 4) + 1)
            pos[:n] = at
    if (pos > limit).any():
        raise ValueError("a scan ends early")
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out.T[back]
