"""Word shingles of whole texts as sets of 64-bit hashes, and MinHash bands over them, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once (a longer text goes alone).
CHUNK = 1 << 20
_POWER = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(20240601).integers(1, 2**63, size=(2, 512), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor-shift and multiply, twice)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _POWER, dtype=np.uint64))


def word_hashes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts in ``data`` (UTF-8) and the number of words in each text.

    edges: the texts' bounds. A-Z count as a-z; words are runs without space and U+0009..U+000D.
    """
    n_texts = len(edges) - 1
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(n_texts, np.int64)
    low = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    solid = ~((low == 32) | ((low >= 9) & (low <= 13)))
    begins = np.empty(len(low), dtype=bool)
    begins[0] = True
    begins[1:] = ~solid[:-1]
    begins[edges[:-1][edges[:-1] < len(low)]] = True
    begins &= solid
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(n_texts, np.int64)
    inside = np.arange(len(low)) - starts[0]
    spans = np.diff(np.append(starts, len(low)))
    inside[starts[0] :] = np.arange(int(spans.sum())) - np.repeat(starts - starts[0], spans)
    parts = (low.astype(np.uint64) + np.uint64(1)) * _powers(int(spans.max()) + int(starts[0]) + 1)[np.maximum(inside, 0)]
    parts[~solid] = 0
    hashes = mix(np.add.reduceat(parts, starts))
    return hashes, np.diff(np.searchsorted(starts, edges))


def shingle_sets(data: np.ndarray, edges: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted set of hashes of ``width``-word shingles of each text.

    A text of fewer words has its whole sequence as one shingle; one without words has an empty set.
    """
    words, counts = word_hashes(data, edges)
    ends = np.cumsum(counts)
    out = []
    if len(words) >= width:
        rolled = np.zeros(len(words) - width + 1, dtype=np.uint64)
        for i in range(width):
            rolled = mix(rolled + words[i : len(words) - width + 1 + i] + np.uint64(i + 1))
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(rolled[end - n : end - width + 1]))
        elif n:
            h = np.full(1, n, dtype=np.uint64)
            for w in words[end - n : end]:
                h = mix(h + w)
            out.append(h)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def text_chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of pieces of a text column; nulls are empty texts."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def set_digests(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit digests of each set: sums of differently mixed members."""
    out = np.zeros((len(sets), 2), dtype=np.uint64)
    for i, s in enumerate(sets):
        if len(s):
            out[i] = mix(s + np.uint64(11)).sum(), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()
    return out


def minhash_bands(sets: list[np.ndarray], n_bands: int, rows: int) -> np.ndarray:
    """n_bands hashes, each of ``rows`` minimum hashes, of each set; zeros for an empty set."""
    out = np.zeros((len(sets), n_bands), dtype=np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    members = np.concatenate([sets[i] for i in full])
    bounds = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
    for band in range(n_bands):
        key = np.full(len(full), band + 1, dtype=np.uint64)
        for r in range(band * rows, (band + 1) * rows):
            key = mix(key + np.minimum.reduceat((members ^ _SEEDS[0, r]) * _SEEDS[1, r], bounds))
        out[full, band] = key
    return out
