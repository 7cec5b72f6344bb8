"""Words of Arrow string arrays as numpy columns: bounds, 64-bit digests and CRC-32, a step for each word's k-th piece."""

from __future__ import annotations

import zlib

import numpy as np

from .common import U64, mix, string_buffers

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words made of digits, letters and anything beyond ASCII, once A-Z are lower-cased.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True
#: Bytes of words between ASCII white space.
VISIBLE = np.ones(256, dtype=bool)
VISIBLE[[32, 9, 10, 11, 12, 13]] = False
#: Words longer than this are taken one by one, so that one long word makes no steps for the others.
STEPS = 64


def lowered(array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes with A-Z lower-cased, and n+1 offsets; nulls are empty."""
    raw, offsets = string_buffers(array)
    return LOWER[raw], offsets


def bounds(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n+1 first word indices of each text, and the words' starts and ends in ``raw``; ``inside`` says which bytes make words."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(len(offsets), np.int64), none, none
    word = inside[raw]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | cut[1:n]
    last[:-1] &= ~word[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(starts, offsets), starts, ends


def digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each span: its eight-byte pieces go through the finaliser of splitmix64 one after another, so equal
    digests of different spans are chance alone, whatever the spans repeat."""
    size = ends - starts
    out = mix(size.astype(U64) + U64(0x9E3779B97F4A7C15))
    if not len(starts):
        return out
    padded = np.zeros(len(raw) + 16, np.uint8)
    padded[: len(raw)] = raw
    piece = np.ndarray((len(raw) + 8,), "<u8", padded, strides=(1,))
    mask = np.array([(1 << (8 * k)) - 1 for k in range(1, 8)] + [2**64 - 1], dtype=U64)
    at, rows = 0, np.flatnonzero(size <= 8 * STEPS)
    out[rows] = mix(out[rows] ^ (piece[starts[rows]] & mask[np.clip(size[rows], 1, 8) - 1]))
    while len(rows := rows[size[rows] > at + 8]):
        at += 8
        out[rows] = mix(out[rows] * U64(3) ^ (piece[starts[rows] + at] & mask[np.minimum(size[rows] - at, 8) - 1]))
    for i in np.flatnonzero(size > 8 * STEPS):
        import xxhash

        out[i] ^= U64(xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes()))
    return out


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def crc32s(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Unsigned CRC-32 of each span, or of the strings with CRC-32 ``before`` followed by the spans."""
    crc = ~(np.zeros(len(starts), np.uint32) if before is None else before)
    size = ends - starts
    at, rows = 0, np.flatnonzero(size <= STEPS)
    while len(rows := rows[size[rows] > at]):
        crc[rows] = _CRC[(crc[rows] ^ raw[starts[rows] + at]) & np.uint32(255)] ^ (crc[rows] >> np.uint32(8))
        at += 1
    crc = ~crc
    for i in np.flatnonzero(size > STEPS):
        crc[i] = zlib.crc32(raw[starts[i] : ends[i]].tobytes(), 0 if before is None else int(before[i]))
    return crc


def shingle_sets(array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """n+1 offsets, and each text's distinct shingle hashes in ascending order.

    A text with fewer words than ``width`` has its whole word sequence as one shingle; one without words has none.
    """
    raw, offsets = lowered(array)
    first, starts, ends = bounds(raw, offsets, VISIBLE)
    words = digests(raw, starts, ends)
    n_docs = len(offsets) - 1
    counts, begins = np.diff(first), first
    doc = np.repeat(np.arange(n_docs), counts)
    m = len(words)
    hashes = np.zeros(m, dtype=U64)
    for k in range(min(width, m)):
        factor = U64((0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1))
        hashes[: m - k] += mix(words[k:] ^ factor) * U64(2 * k + 3) if k else words * U64(3)
    left = begins[doc + 1] - np.arange(m) if m else np.zeros(0, np.int64)
    whole = left >= width
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        seq = words[begins[i] : begins[i + 1]]
        h = U64(counts[i])
        for w in seq:
            h = mix(np.array([h], U64) * U64(31) + w)[0]
        hashes[begins[i]] = h
        whole[begins[i]] = True
    doc, hashes = doc[whole], mix(hashes[whole])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    if len(doc):
        keep = np.ones(len(doc), dtype=bool)
        keep[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
        doc, hashes = doc[keep], hashes[keep]
    return np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n_docs))]).astype(np.int64), hashes
