"""Vectorised word scanning over Arrow string columns.

Words are maximal runs of bytes outside {0x20, 0x09-0x0D}.  The scan works on
the UTF-8 buffer of a whole Arrow batch in slices of bounded size, so neither
a huge batch nor one very long text needs working memory beyond a slice plus
sixteen bytes a word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_U = np.uint64
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True
IS_SPACE_OR_MARK = IS_SPACE.copy()
IS_SPACE_OR_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[0x41:0x5B] += 0x20
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, SLICE_BYTES + 1)
_POW_INV = _powers(_BASE_INV, SLICE_BYTES + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (public splitmix64 constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Words:
    """Words of a batch: 64-bit hash, byte range, and per text the range of words."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # words of text i: bounds[i]:bounds[i + 1]

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null text has length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.zeros(0, np.uint8) if raw is None else np.frombuffer(raw, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of every byte range; ranges are in order and don't overlap.  Longer ranges than a slice are folded slice by slice."""
    out = np.zeros(len(starts), dtype=np.uint64)
    table = _BYTE_VALUE if fold is None else _BYTE_VALUE[fold]
    at = 0
    while at < len(starts):
        base = int(starts[at])
        upto = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
        if int(ends[upto - 1]) - base <= SLICE_BYTES:
            part = data[base : int(ends[upto - 1])]
            total = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(table[part] * _POW[: len(part)], out=total[1:])
            s, e = starts[at:upto] - base, ends[at:upto] - base
            out[at:upto] = (total[e] - total[s]) * _POW_INV[s] + (e - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93)
        else:
            acc, n = 0, int(ends[at]) - base
            for k in range(base, int(ends[at]), SLICE_BYTES):
                part = data[k : min(k + SLICE_BYTES, int(ends[at]))]
                piece = int((table[part] * _POW[: len(part)]).sum(dtype=np.uint64))
                acc = (acc * 0xA0761D6478BD642F + piece) % 2**64
            out[at] = (acc + n * 0xD6E8FEB86659FD93) % 2**64
        at = upto
    return mix(out)


def word_ranges(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; text boundaries end words."""
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    starts, ends = [], []
    open_word = False
    for k in range(0, len(data), SLICE_BYTES):
        part = ~breaks[data[k : k + SLICE_BYTES]]
        before = np.empty(len(part), dtype=bool)
        before[0] = open_word
        before[1:] = part[:-1]
        open_word = bool(part[-1])
        cuts = edges[np.searchsorted(edges, k) : np.searchsorted(edges, k + len(part))] - k
        s, e = part & ~before, before & ~part
        s[cuts] |= part[cuts]
        e[cuts] |= before[cuts]
        starts.append(np.flatnonzero(s) + k)
        ends.append(np.flatnonzero(e) + k)
    if open_word:
        ends.append(np.array([len(data)]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *ends])


def scan_words(column, lower: bool = True, breaks: np.ndarray = IS_SPACE) -> Words:
    """All words of a string column, hashed; A-Z fold to a-z unless told otherwise; `breaks` marks the bytes between words."""
    data, offsets = buffers(column)
    starts, ends = word_ranges(data, offsets, breaks)
    hashes = range_hashes(data, starts, ends, ASCII_LOWER if lower else None)
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets))


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside a text, and the text of each.  A text of fewer words (one at least) has its whole sequence as one shingle."""
    h, bounds = words.hashes, words.bounds
    counts = np.diff(bounds)
    text = words.text_of()
    n = len(h)
    out = np.zeros(max(0, n - size + 1), dtype=np.uint64)
    for j in range(size):
        out = mix(out * _U(0x2545F4914F6CDD1D) + h[j : n - size + 1 + j] + _U(j + 1)) if len(out) else out
    inside = (np.arange(len(out)) + size) <= bounds[1:][text[: len(out)]] if len(out) else np.zeros(0, bool)
    texts, hashes = [text[: len(out)][inside]], [out[inside]]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        acc = counts[short].astype(np.uint64)
        for j in range(size - 1):
            has = counts[short] > j
            nxt = mix(acc * _U(0x2545F4914F6CDD1D) + h[np.minimum(bounds[short] + j, n - 1)] + _U(j + 1))
            acc = np.where(has, nxt, acc)
        texts.append(short)
        hashes.append(mix(acc + _U(0x5851F42D4C957F2D)))
    t, s = np.concatenate(texts), np.concatenate(hashes)
    order = np.argsort(t, kind="stable") if len(short) else None
    return (s, t) if order is None else (s[order], t[order])


def slices_of(column, limit: int = 8 << 20):
    """Row ranges of a string column of at most `limit` bytes (one row at least)."""
    _, offsets = buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(upto, n)
        at = upto
