"""Word and shingle hashes of Arrow text columns, computed with numpy.

Spark hands each task its rows in Arrow batches; these helpers turn the bytes of
such a batch into 64-bit hashes without making a Python object per word. Words
are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. Hashes
depend on the bytes of the word alone, so they agree between tasks and runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18  # bytes hashed at once: bounds the working arrays, not the texts
SHINGLE = 5

_P = np.uint64(0x9E3779B97F4A7C55)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_PLACE = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits; bytes of longer characters count as letters.
NOT_LETTERS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    table = _powers.get(name)
    if table is None or len(table) < n:
        table = np.full(max(n, CHUNK + 1), base, dtype=np.uint64)
        table[0] = 1
        np.cumprod(table, out=table)
        if n <= 4 * CHUNK:
            _powers[name] = table
    return table[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values after which all bits depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h *= _MIX[0]
    h ^= h >> np.uint64(27)
    h *= _MIX[1]
    h ^= h >> np.uint64(31)
    return h


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary array; nulls become empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def runs(texts: pa.Array, limit: int = 1 << 19):
    """Ranges of rows with so many bytes at most, or one longer row: what is worked on at once, however large Spark's batches are."""
    at, row = buffers(texts)[1], 0
    while row < len(texts):
        last = min(len(texts), max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1))
        yield row, last
        row = last
    pa.default_memory_pool().release_unused()  # a worker lives on between tasks, and would keep what its largest batch took


def _pieces(data: np.ndarray, at: np.ndarray, separator: np.ndarray):
    """(first row, last row + 1, from byte, to byte): whole rows up to CHUNK bytes, or parts of one long row that end at a separator."""
    row, n = 0, len(at) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK, side="right")) - 1)
        last = min(last, n)
        a, b = int(at[row]), int(at[last])
        if b - a <= CHUNK:
            yield row, last, a, b
        else:
            while a < b:
                c = min(a + CHUNK, b)
                while c < b and not separator[data[c]]:
                    ahead = np.flatnonzero(separator[data[c : c + CHUNK]])
                    c = c + int(ahead[0]) if len(ahead) else min(c + CHUNK, b)
                yield row, last, a, c
                a = c
        row = last


def words(texts: pa.Array, separator: np.ndarray = SPACES, prefixes: tuple[int, ...] = (), fold: bool = False):
    """Hashes of all words, and where each row's words start: (hashes, row starts).

    prefixes: also hashes of the words' first so many bytes, as further arrays
    (the whole word's hash where it is not longer). fold: lower-case the
    two-byte Latin letters too.
    """
    data, at = buffers(texts)
    found = [[np.zeros(0, np.uint64)] for _ in range(1 + len(prefixes))]
    counts = np.zeros(len(at), np.int64)
    for row, last, a, b in _pieces(data, at, separator):
        if a == b:
            continue
        part = _LOWER[data[a:b]]
        if fold:
            high = part[1:]
            high[(part[:-1] == 0xC3) & (high >= 0x80) & (high <= 0x9E) & (high != 0x97)] += 0x20
        edge = np.zeros(len(part) + 1, dtype=bool)  # a row begins here
        inner = at[row : last + 1]
        edge[inner[(inner >= a) & (inner <= b)] - a] = True
        gap = separator[part]
        before = np.empty_like(gap)
        before[0], before[1:] = True, gap[:-1]
        after = np.empty_like(gap)
        after[-1], after[:-1] = True, gap[1:]
        starts = np.flatnonzero(~gap & (before | edge[:-1]))
        ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
        if not len(starts):
            continue
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _power(_P, "p", len(part)), out=total[1:])
        back = _power(_P_INV, "i", len(part))[starts]
        for k, cut in enumerate((None, *prefixes)):
            stop = ends if cut is None else np.minimum(ends, starts + cut)
            h = (total[stop] - total[starts]) * back
            h += (stop - starts).astype(np.uint64) * _PLACE[0]
            found[k].append(mix(h))
        if last == row + 1:
            counts[row + 1] += len(starts)
        else:
            counts[row + 1 : last + 1] = np.diff(np.searchsorted(starts, inner - a))
    out = [np.concatenate(x) for x in found]
    return (*out, np.cumsum(counts))


def word_counts(texts: pa.Array) -> np.ndarray:
    """How many words each row has."""
    data, at = buffers(texts)
    counts = np.zeros(len(at) - 1, np.int64)
    for row, last, a, b in _pieces(data, at, SPACES):
        if a == b:
            continue
        gap = SPACES[data[a:b]]
        before = np.empty_like(gap)
        before[0], before[1:] = True, gap[:-1]
        inner = at[row : last + 1]
        inner = inner[(inner >= a) & (inner < b)] - a
        before[inner] = True
        starts = np.flatnonzero(~gap & before)
        if last == row + 1:
            counts[row] += len(starts)
        else:
            counts[row:last] = np.diff(np.searchsorted(starts, at[row : last + 1] - a))
    return counts


def shingles(hashes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For each row its distinct hashes of SHINGLE words, sorted; of fewer words, the whole sequence as one; of none, an empty array."""
    n = len(hashes)
    rolled = np.zeros(max(0, n - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        if len(rolled):
            rolled += hashes[j : n - SHINGLE + 1 + j] * _PLACE[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            s = np.sort(rolled[a : b - SHINGLE + 1])
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            short = (hashes[a:b] * np.array(_PLACE[: b - a])).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(short + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
