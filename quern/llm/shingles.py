"""Word shingles of many texts at once, as 64-bit digests in numpy arrays."""

from __future__ import annotations

import numpy as np

WORDS = 5
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2^64."""
    if len(_powers[0]) <= n:
        size = 1 << int(n + 1).bit_length()
        inverse = pow(int(_BASE), -1, 1 << 64)
        for k, base in enumerate((int(_BASE), inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_digests(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the words of texts laid end to end, and each text's number of words.

    Text i is data[bounds[i]:bounds[i + 1]], in UTF-8. A digest is a polynomial of the word's bytes, from a running sum.
    """
    first, last = word_edges(data, bounds)
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * up[: len(data)], out=total[1:])
    digests = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
    return digests, np.diff(np.searchsorted(first, bounds))


def word_edges(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of each word and the one after its last."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = ~_SPACE[data]
    starts = ink.copy()
    starts[1:] &= ~ink[:-1]
    ends = np.zeros(n + 1, bool)
    ends[1:n] = ink[:-1] & ~ink[1:]
    ends[n] = ink[-1]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    inner = inner[ink[inner] & ink[inner - 1]]
    starts[inner] = True
    ends[inner] = True
    return np.flatnonzero(starts), np.flatnonzero(ends)


def shingles(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all runs of five words, text by text, and each text's number of them.

    A text of one to four words has one shingle of all its words.
    """
    words, counts = word_digests(data, bounds)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    n = np.maximum(counts - (WORDS - 1), np.minimum(counts, 1))
    out = np.empty(int(n.sum()), np.uint64)
    if len(words) >= WORDS:
        m = len(words) - WORDS + 1
        run = words[:m].copy()
        for k in range(1, WORDS):
            run = run * _STEP + words[k : k + m]
        whole = np.repeat(offsets[1:], counts)[:m] - np.arange(m) >= WORDS
        long = np.repeat(counts >= WORDS, n)
        out[long] = mix(run[whole])
    place = np.concatenate([[0], np.cumsum(n)])
    for size in range(1, WORDS):
        short = np.flatnonzero(counts == size)
        value = np.full(short.size, size, np.uint64)
        for k in range(size):
            value = value * _STEP + words[offsets[short] + k]
        out[place[short]] = mix(value)
    return out, n


def blocks(column, most: int = 1 << 21):
    """Cut an Arrow string column into (rows, data, bounds) of about `most` bytes; a null is an empty text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield range(start, end), data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def bags(digests: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's shingles in order without repeats, their weights, and the number of them per text. Sorts `digests` in place."""
    offsets = np.concatenate([[0], np.cumsum(counts)])
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        digests[a:b].sort()
    fresh = np.ones(len(digests), bool)
    fresh[1:] = digests[1:] != digests[:-1]
    fresh[offsets[:-1][counts > 0]] = True
    at = np.flatnonzero(fresh)
    weights = np.diff(np.append(at, len(digests)))
    return digests[at], weights, np.diff(np.searchsorted(at, offsets))
